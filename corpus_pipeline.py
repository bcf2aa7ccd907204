"""From raw documents to shards: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given and
returns documents; the last adds its shard. ``run`` writes each stage's result
to the shared folder as Parquet and reads it again for the next.

Defined results, for all stages: a null or empty text is judged like any other,
so the first stage drops it for its length, and the later ones, given it, keep
it; a null id is an id like others; repeated rows are judged alike, but of
equal texts the second stage keeps the least id only, with all its rows; very
long texts are read whole; of ties the least id stays; columns beyond those of
documents are dropped by every stage, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, jaccard, mixing, quality, shards
from scriptorium.llm.queries import MIXTURE
from scriptorium.llm.storage import materialise
from scriptorium.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go; so do documents that lose too much or fail the base rules."""
    judged = quality.clean_lines(docs.select(*COLUMNS))
    changed = F.col("n_failed_lines") > 0
    row = F.struct(
        "doc_id",
        F.when(changed, F.col("clean_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )
    # a filter would be pushed below the projections, which would put their whole expressions in its place
    return judged.select(F.inline(F.when(F.col("kept"), F.array(row))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least id stays."""
    docs = docs.select(*COLUMNS)
    found = jaccard.near_components(docs)
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, F.col("doc_id").eqNullSafe(F.col("__lost")), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    lost = found.where("contaminated").select(F.col("doc_id").alias("__lost"))
    return docs.join(lost, F.col("doc_id").eqNullSafe(F.col("__lost")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays with the odds of its rate, at most one; those whose likely domain has no weight go.

    A digest of the id stands for the draw, so a rerun keeps the same documents.
    Without labels all stay.
    """
    carried = docs.select(*COLUMNS, F.col("text").alias("__text"))
    out = mixing.mix(carried.withColumnRenamed("text", "body").withColumnRenamed("__text", "text"), table(spark, sf_dir, "labels"), MIXTURE, max_rate=1.0, relative=True)
    wanted = F.col("domain").isin("all", *[d for d, w in MIXTURE.items() if w > 0])
    digest = F.md5(F.concat(F.lit("mixing:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    return out.where(wanted & (draw < F.col("rate"))).withColumnRenamed("body", "text").select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return shards.interleave(docs.select(*COLUMNS), n_shards=40).select(*COLUMNS, "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality rules", clean_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The mixing stage trains a classifier, which SQL can't express; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
