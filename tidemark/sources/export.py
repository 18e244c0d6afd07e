"""CSV export of opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of the export, in order.
CSV_COLUMNS = ("trademark", "owner", "representative", "expiry_date", "nice_classes", "opportunity_type", "district")


def opportunity_columns(rows: DataFrame) -> DataFrame:
    """The export's columns as text; lists are joined by commas, missing values are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    classes = F.coalesce(F.array_join(F.col("nice_classes").cast("array<string>"), ","), F.lit("")).alias("nice_classes")
    return rows.select(F.coalesce("word_mark", F.lit("")).alias("trademark"), text("owner"), text("representative"), text("expiry_date"), classes, text("opportunity_type"), text("district"))


def write_csv(rows: DataFrame, path: str) -> None:
    opportunity_columns(rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
