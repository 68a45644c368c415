from loupe.plans import results  # noqa: F401  registers its queries in the catalogue
