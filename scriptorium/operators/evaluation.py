"""Question sets, their evaluation against ranked hits, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cards import LABELS

CASES = "query string, expected_parent_record_id string, expected_field string, expected_max_rank int"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of questions with what they should find, numbered in no particular order."""
    rows = spark.read.schema(CASES).option("multiLine", True).json(path)
    return rows.select(F.xxhash64("query", "expected_parent_record_id", "expected_field").alias("query_id"), F.col("query").alias("text"), "expected_parent_record_id", "expected_field", "expected_max_rank")


def judged(cases: DataFrame, hits: DataFrame, passages: DataFrame, limit: int = 5) -> DataFrame:
    """Each case with ``matched_rank`` and ``success``.

    A hit counts if its parent is the expected one and, where a field is expected, it is that
    field's passage or holds its label; it must stand at the expected rank or better.
    """
    label = F.coalesce(*[F.when(F.col("expected_field") == name, F.lit(f"{shown or 'Course Details'}:")) for name, shown, _, _ in LABELS])
    found = hits.join(passages.select("id", "parent", "field_name", F.col("text").alias("body")), "id").join(cases, "query_id")
    field = F.col("expected_field").isNull() | (F.col("field_name") == F.col("expected_field")) | F.contains("body", label)
    good = (F.col("parent") == F.col("expected_parent_record_id")) & F.coalesce(field, F.lit(False))
    best = found.where(good).groupBy("query_id").agg(F.min("place").alias("matched_rank"))
    most = F.coalesce("expected_max_rank", F.lit(limit))
    return cases.join(best, "query_id", "left").withColumn("success", F.coalesce(F.col("matched_rank") <= most, F.lit(False)))


def summary(results: DataFrame) -> DataFrame:
    """One row: total, passed, accuracy to six digits (0 without cases) and a line for readers."""
    counted = results.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("passed"))
    share = F.coalesce(F.try_divide("passed", "total"), F.lit(0.0))
    line = F.concat(F.format_string("%d/%d (%.1f", "passed", "total", share * 100), F.lit("%)"))
    return counted.select("total", "passed", F.round(share, 6).alias("accuracy"), line.alias("line"))


def write_report(results: DataFrame, path: str) -> None:
    """``results`` as JSON lines and ``summary`` as one JSON line below ``path``."""
    results.write.mode("overwrite").json(f"{path}/results")
    summary(results).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
