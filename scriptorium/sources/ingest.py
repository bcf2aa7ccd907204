"""Ingestion as one call: parse, review, build chunks, and publish all tables of a run together.

A run's tables lie in a folder of their own; the row appended to ``runs`` is what
publishes them, so readers see all tables of a run or none. A run whose inputs
have the fingerprint of the last one is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards, chunks, policies
from ..operators import questions as Q
from .corpus import digest

TABLES = ("courses", "sections", "appendix_rows", "chunks")
RUNS = "document string, fingerprint string, version string, folder string, at timestamp, n_chunks long"


@dataclass(frozen=True)
class Result:
    skipped: bool
    fingerprint: str
    n_chunks: int | None = None
    unknown_abbreviations: tuple[str, ...] = ()


def inputs_fingerprint(lines: DataFrame, tables: DataFrame, decisions: DataFrame, version: str) -> str:
    """A digest of every input that can change the chunks; the order of rows has no part in it."""
    made = [
        df.select(F.concat_ws(":", F.lit(kind), F.xxhash64(*df.columns).cast("string"), F.lit(version)).alias("id"), F.to_json(F.struct(*sorted(df.columns))).alias("text"))
        for kind, df in (("line", lines), ("table", tables), ("decision", decisions))
    ]
    return digest(made[0].union(made[1]).union(made[2]), "id", "text").first()[0]


def runs(spark: SparkSession, store: str) -> DataFrame:
    """All published runs; none before the first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/runs")
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(RUNS).parquet(f"{store}/runs") if there else spark.createDataFrame([], RUNS)


def latest(spark: SparkSession, store: str, document: str | None = None) -> DataFrame:
    """The last run of each document, or of one."""
    rows = runs(spark, store)
    rows = rows.where(F.col("document") == document) if document else rows
    return rows.groupBy("document").agg(F.max(F.struct("at", "fingerprint", "folder", "n_chunks")).alias("r")).select("document", "r.*")


def default_document(spark: SparkSession, store: str) -> str:
    """The document of the last run; an error names the lack of any."""
    row = latest(spark, store).orderBy(F.desc("at"), "document").first()
    if row is None:
        raise ValueError("no document has been published")
    return row["document"]


def load(spark: SparkSession, store: str, name: str, document: str | None = None) -> DataFrame:
    """One table of the last run of a document."""
    row = latest(spark, store, document or default_document(spark, store)).first()
    if row is None:
        raise ValueError(f"document {document!r} has not been published")
    return spark.read.parquet(f"{row['folder']}/{name}")


def ingest(store: str, document: str, lines: DataFrame, tables: DataFrame, decisions: DataFrame, version: str = "1", force: bool = False, course_pages: tuple[int, int] = (54, 127)) -> Result:
    """Parse one document's lines and tables, apply the decisions (record_id, status) and publish its tables.

    Decisions on records that do not exist are an error, as is an input of another document.
    """
    spark = lines.sparkSession
    if lines.where(F.col("document") != document).limit(1).count():
        raise ValueError("lines of another document")
    mark = inputs_fingerprint(lines, tables, decisions, version)
    last = latest(spark, store, document).first()
    if last is not None and last["fingerprint"] == mark and not force:
        return Result(True, mark)

    stamp = spark.sql("SELECT current_timestamp() AS t").first()["t"]
    folder = f"{store}/run-{stamp:%Y%m%dT%H%M%S%f}-{mark[:12]}"
    inside = F.col("page").between(*course_pages)
    found = {
        "courses": cards.courses(lines.where(inside), tables.where(inside)),
        "sections": policies.sections(lines),
        "appendix_rows": policies.appendix_rows(tables),
    }
    saved = {}
    for name, df in found.items():
        df.write.parquet(f"{folder}/{name}")
        saved[name] = spark.read.parquet(f"{folder}/{name}")
    ids = saved["courses"].select("record_id").union(saved["sections"].select("record_id")).union(saved["appendix_rows"].select("record_id"))
    unknown = decisions.join(ids, "record_id", "left_anti").select("record_id").distinct().orderBy("record_id").limit(10).collect()
    if unknown:
        raise ValueError(f"decisions on unknown records: {[r[0] for r in unknown]}")
    made = [
        chunks.course_chunks(chunks.gated(saved["courses"], decisions)),
        chunks.section_chunks(chunks.gated(saved["sections"], decisions)),
        chunks.appendix_chunks(chunks.gated(saved["appendix_rows"], decisions)),
    ]
    made[0].unionByName(made[1]).unionByName(made[2]).write.parquet(f"{folder}/chunks")
    n = spark.read.parquet(f"{folder}/chunks").count()
    names = saved["courses"].select(F.explode(Q.uncovered_abbreviations(F.col("course_name"))).alias("a")).distinct().orderBy("a").limit(100).collect()
    spark.createDataFrame([(document, mark, version, folder, stamp, n)], RUNS).coalesce(1).write.mode("append").parquet(f"{store}/runs")
    return Result(False, mark, n, tuple(r[0] for r in names))
