"""Corpus sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def page_numbers(spec: Column) -> Column:
    """Sorted distinct pages of a text such as ``1,54-56,128``; bad parts raise."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))

    def span(p):
        ok = F.rlike(p, F.lit("^[0-9]+(?:-[0-9]+)?$"))
        lo = F.substring_index(p, "-", 1).try_cast("int")
        hi = F.substring_index(p, "-", -1).try_cast("int")
        good = ok & (lo >= 1) & (hi >= lo)
        return F.when(good, F.sequence(F.when(good, lo).otherwise(1), F.when(good, hi).otherwise(1))).otherwise(
            F.raise_error(F.concat(F.lit("bad page range: "), p)).cast("array<int>")
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def read_corpus(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON records under a fixed schema; a record that breaks it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that ``df`` holds, through the committer."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One digest over all rows, whatever their order: digests of 4,096 slices are joined in order.

    The digests of a slice meet in one row, so this suits up to some hundred million rows; ``digest`` has no such bound.
    """
    each = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    rows = df.select(each.alias("h"))
    slices = rows.groupBy(F.substring("h", 1, 3).alias("s")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return slices.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """One digest over all rows, whatever their order, from their number and four sums of their digests' parts."""
    each = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    sums = [F.coalesce(part(i), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.select(each.alias("h")).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias("digest"))
