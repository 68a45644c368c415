"""Training-data operators. Nothing else in this repository imports this subpackage."""
