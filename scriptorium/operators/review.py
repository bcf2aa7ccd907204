"""Review decisions and the gate in front of publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_of(quality: Column) -> Column:
    return F.when(quality == 1, "approved").when(quality == 0, "rejected").otherwise("pending")


def gate(records: DataFrame, preview: bool = False) -> DataFrame:
    """Approved records; with ``preview`` pending ones too. Rejected records never pass."""
    allowed = F.col("status") == "approved"
    return records.where(allowed | (F.col("status") == "pending") if preview else allowed)


def latest(decisions: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last decision of each record."""
    by = Window.partitionBy(key).orderBy(*order)
    return decisions.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def unknown(decisions: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Ids that were decided on but do not exist."""
    return decisions.select(key).distinct().join(records.select(key), key, "left_anti")


def routed(decisions: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Decisions on records of this corpus."""
    return decisions.join(records.select(key).distinct(), key, "left_semi")


def apply_decisions(records: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Records with the status of their decision, or their own."""
    return records.join(decisions.select(key, F.col("status").alias("__s")), key, "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")
