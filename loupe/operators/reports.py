"""Reports of several languages as one.  The order of reports decides only what it has to: which tests count, the last word on a file that wasn't loaded, and the order of lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Reports:
    """Rows of reports, each with `report`, its number in order (a merged one has none), and within a report `ord`, the order of its lists.

    segments: report, ord, part (files, branches or inventory), file, and any further columns.  notes: report, ord, list (missing, integration_missing or
    failed), value.  languages: report, language.  tests: report, test, and any further columns.  has_tests: report, of reports that measured tests, even none.
    proven: report, file.  unloaded: report, file, why.
    """

    segments: DataFrame
    notes: DataFrame
    languages: DataFrame
    tests: DataFrame
    has_tests: DataFrame
    proven: DataFrame
    unloaded: DataFrame


def merge(reports: Reports) -> Reports:
    """One report of them all, as number 0.

    Segments of a file and the notes of a list follow one another, report by report; languages and proven files are the union; tests are those of
    the first report that measured any, none of the others; what a file wasn't loaded for is what the last report says of it.
    Each part is an aggregate or a window over a file or list, so no report is gathered anywhere.
    """
    def joined(rows: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("report", "ord")) - 1
        return rows.withColumn("place", place).drop("ord").withColumnRenamed("place", "ord").withColumn("report", F.lit(0))

    first = reports.has_tests.agg(F.min("report").alias("report"))
    return Reports(
        joined(reports.segments, "part", "file"),
        joined(reports.notes, "list"),
        reports.languages.select("language").distinct().withColumn("report", F.lit(0)),
        reports.tests.join(F.broadcast(first), "report", "left_semi").withColumn("report", F.lit(0)),
        first.where("report IS NOT NULL").withColumn("report", F.lit(0)),
        reports.proven.select("file").distinct().withColumn("report", F.lit(0)),
        reports.unloaded.groupBy("file").agg(F.max_by("why", "report").alias("why")).withColumn("report", F.lit(0)),
    )
