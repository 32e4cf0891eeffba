"""External entity labels: cleaned, one entity an address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_labels(rows: DataFrame, pattern: str) -> DataFrame:
    """``address, entity, display, rows`` from ``address, entity``: addresses that match, entities without regard to case
    and surrounding space, addresses of several entities dropped, and each entity's most frequent spelling (ties: the least)."""
    named = rows.where(F.col("address").rlike(pattern)).select("address", F.trim("entity").alias("raw"), F.lower(F.trim("entity")).alias("entity")).where("entity <> ''")
    one = named.groupBy("address").agg(F.count_distinct("entity").alias("kinds"), F.min("entity").alias("entity"), F.count("*").alias("rows")).where("kinds = 1").drop("kinds")
    spelled = named.groupBy("entity", "raw").agg(F.count("*").alias("n")).groupBy("entity").agg(F.min(F.struct((-F.col("n")).alias("n"), "raw"))["raw"].alias("display"))
    return one.join(spelled, "entity").select("address", "entity", "display", "rows")
