"""Proportional stratified interleaving.

Rows are shuffled by a seeded digest within each source, given the fractional
rank (2 r + 1) / (2 n) of their place among the n rows of the source, and
sorted by it. Cutting that order into equal runs gives shards whose sources
stand in the corpus's own proportions, with row counts at most one apart.

No rank is computed over a whole source or the whole table in one task. Rows
fall into about sqrt(N) buckets of their digest, whose counts, summed before
the shuffle, give each bucket its first rank; then into about sqrt(N) slices of
their fractional rank, whose starts follow from the sizes of the sources: a
source of more rows than slices gives each slice a number, a smaller one gives
a number to the slices that its rows fall into, so there are never more numbers
than twice the rows. Windows run inside a bucket or a slice only. A source of
fewer rows than shards can't be in all of them; one of a single row stands in
the middle.

Defined results: null sources form a stratum of their own; a null text has
size 16 and the checksum of the empty text; a null id is shuffled like the
empty one; equal rows are interchangeable; a very long text counts by its bytes
and is not cut; an empty table gives an empty result. Input columns may have
any name; those that carry the name of a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import inner_name, shielded, whole


def _first_ranks(counts: DataFrame) -> DataFrame:
    """Rows of a stratum before each of its buckets."""
    before = Window.partitionBy("__stratum").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("__base", F.sum("__n").over(before) - F.col("__n"))


def _slice_starts(sizes: DataFrame, buckets: int) -> DataFrame:
    """(__slice, __base): rows of all strata below each slice.

    Of the n rows of a stratum (2 n b + buckets - 1) div (2 buckets) lie below slice b.
    """
    below = lambda b: F.expr(f"(2 * __of * ({b}) + {buckets - 1}L) div {2 * buckets}L")
    slices = F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))
    large = sizes.where(F.col("__of") > buckets).withColumn("__slice", F.explode(slices))
    large = large.select("__slice", (below("__slice + 1") - below("__slice")).alias("__n"))
    small = sizes.where(F.col("__of") <= buckets).withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1)))
    small = small.select(F.expr(f"((2 * __r + 1) * {buckets}L) div (2 * __of)").alias("__slice"), F.lit(1).cast("long").alias("__n"))
    counts = large.union(small).groupBy("__slice").agg(F.sum("__n").alias("__n"))
    # as many rows as slices, about the root of the table's
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("__slice", (F.sum("__n").over(before) - F.col("__n")).alias("__base"))


def interleave(df: DataFrame, n_shards: int = 40, seed: str = "scriptorium", source: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All input columns with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``."""
    own_id, own_text, own_source = inner_name(df, id_col), inner_name(df, text), inner_name(df, source)
    df, back = shielded(df, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    keep = df.columns
    total = df.count()
    buckets = max(1, math.isqrt(max(total - 1, 0)) + 1)
    key: Column = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(own_id).cast("string"), F.lit(""))))
    df = df.select(
        *keep,
        (F.octet_length(whole(F.col(own_text))) + 16).cast("long").alias("size"),
        F.crc32(whole(F.col(own_text)).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(own_source).cast("string")), F.lit("n")).alias("__stratum"),
        key.alias("__key"),
    )
    df = df.withColumn("__bucket", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") * buckets / 4294967296.0))

    counts = df.groupBy("__stratum", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    sizes = counts.groupBy("__stratum").agg(F.sum("__n").alias("__of"))
    bases = _first_ranks(counts).join(sizes, "__stratum").drop("__n")
    tie = [F.col("__key"), F.col(own_id), F.col("text_crc32"), F.col("size")]
    within = F.row_number().over(Window.partitionBy("__stratum", "__bucket").orderBy(*tie)) - 1 + F.col("__base")
    ranked = df.join(bases, ["__stratum", "__bucket"]).select(
        "*",
        ((within + 0.5) / F.col("__of")).alias("__frac"),
        within.alias("__rank"),
    )
    ranked = ranked.withColumn("__slice", F.expr(f"((2 * __rank + 1) * {buckets}L) div (2 * __of)")).drop("__base", "__of", "__bucket", "__rank")

    starts = _slice_starts(sizes, buckets)
    order = Window.partitionBy("__slice").orderBy("__frac", "__stratum", *tie)
    placed = ranked.join(starts, "__slice").withColumn("__g", F.row_number().over(order) - 1 + F.col("__base"))
    placed = placed.withColumn("shard", F.expr(f"cast((__g * {n_shards}L) div {max(total, 1)}L as int)"))
    # the first place of shard k is the least g with g * n_shards >= k * total
    first = F.expr(f"(cast(shard as long) * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select(
        *back,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("__g") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
