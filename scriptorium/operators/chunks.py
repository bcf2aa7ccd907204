"""Retrieval chunks from reviewed courses, sections and appendix rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import questions as Q
from .policies import APPENDIX_LABELS

COLUMNS = ["chunk_id", "document", "chunk_type", "parent_record_id", "title", "text", "field_name", "metadata", "status"]
GUIDE = "Guide"


def page_label(printed: Column, page: Column, guide: str = GUIDE) -> Column:
    """Where a record stands: the printed page if there is one, and the physical page."""
    return F.when(
        F.coalesce(printed, F.lit("")) != "", F.concat(F.lit(f"{guide}, page "), printed, F.lit(" (physical page "), page.cast("string"), F.lit(")"))
    ).otherwise(F.concat(F.lit(f"{guide}, physical page "), page.cast("string")))


def appendix_label(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in APPENDIX_LABELS.items()])


def gated(records: DataFrame, decisions: DataFrame, preview: bool = False) -> DataFrame:
    """Records with their status; pending ones stay in a preview only, rejected ones never."""
    status = decisions.select("record_id", F.col("status").alias("__status"))
    out = records.join(status, "record_id", "left").withColumn("status", F.coalesce("__status", F.lit("pending"))).drop("__status")
    return out.where(F.col("status").isin("approved", *(["pending"] if preview else [])))


def _line(label: str, value: Column) -> Column:
    """``label: value``, or null without a value."""
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def _text(*parts: Column) -> Column:
    """Lines joined; null ones are left out."""
    return F.concat_ws("\n", *parts)


def _metadata(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def course_chunks(courses: DataFrame, guide: str = GUIDE) -> DataFrame:
    fields = F.transform("fields", lambda f: F.concat(f["label"], F.lit(": "), f["value"], F.lit("\n")))
    row = lambda cells: F.array_join(F.transform(cells, lambda c: F.concat(T.display_name(c["key"]), F.lit("="), c["text"])), "; ")
    table = lambda t: F.concat(F.lit("Course Details:\n"), F.array_join(F.transform(t["rows"], lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), row(r))), "\n"), F.lit("\n"))
    pages = F.concat(F.array(page_label(F.col("printed"), F.col("page"), guide)), F.transform("fields", lambda f: page_label(F.col("printed"), f["page"], guide)))
    text = _text(
        _line("Course", F.col("course_name")),
        _line("Expanded Course Name", F.array_join(Q.title_names(F.col("course_name")), ", ")),
        _line("Course Code", F.col("course_code")),
        _line("Faculty", F.col("faculty")),
        _line("Programme Level", F.col("program_level")),
        F.lit("Record Type: Course Profile\n"),
        F.nullif(F.array_join(fields, "\n"), F.lit("")),
        F.nullif(F.array_join(F.transform("tables", table), "\n"), F.lit("")),
        _line("Source Pages", F.array_join(F.array_distinct(pages), ", ")),
    )
    return courses.select(
        F.concat("record_id", F.lit(":overview")).alias("chunk_id"), "document", F.lit("course_overview").alias("chunk_type"), F.col("record_id").alias("parent_record_id"),
        F.concat("course_name", F.lit(" - Complete Course Information")).alias("title"), text.alias("text"), F.lit(None).cast("string").alias("field_name"),
        _metadata(course_name=F.col("course_name"), course_code=F.col("course_code"), faculty=F.col("faculty"), program_level=F.col("program_level"), retrieval_role=F.lit("llm_context")).alias("metadata"), "status",
    )


def section_chunks(sections: DataFrame, guide: str = GUIDE) -> DataFrame:
    text = _text(
        _line("Section", F.col("heading")), _line("Section Path", F.array_join("heading_path", " > ")), F.lit(""), F.col("text"),
        F.concat(F.lit("\nSource: "), page_label(F.col("printed"), F.col("page"), guide)),
    )
    return sections.select(
        F.concat("record_id", F.lit(":chunk")).alias("chunk_id"), "document", F.lit("policy_section").alias("chunk_type"), F.col("record_id").alias("parent_record_id"),
        F.col("heading").alias("title"), text.alias("text"), F.lit(None).cast("string").alias("field_name"), _metadata(heading=F.col("heading")).alias("metadata"), "status",
    )


def appendix_chunks(rows: DataFrame, guide: str = GUIDE) -> DataFrame:
    label = appendix_label(F.col("appendix_type"))
    values = F.array_join(F.transform("values", lambda v: F.concat(T.display_name(v["key"]), F.lit(": "), v["text"])), "\n")
    text = _text(
        _line("Course", F.col("course_name")), F.concat(F.lit("Record Type: "), label), _line("Course Code", F.col("course_code")), _line("Faculty or Unit", F.col("faculty")),
        _line("Programme Group", F.col("programme_group")), _line("Category", F.col("category")), F.lit(""), F.nullif(values, F.lit("")),
        F.concat(F.lit("\nSource: "), page_label(F.col("printed"), F.col("page"), guide)),
    )
    named = {c: F.col(c) for c in ("appendix_type", "course_name", "course_code", "faculty", "programme_group", "category")}
    return rows.select(
        F.concat("record_id", F.lit(":chunk")).alias("chunk_id"), "document", F.lit("appendix_row").alias("chunk_type"), F.col("record_id").alias("parent_record_id"),
        F.concat("course_name", F.lit(" - "), label).alias("title"), text.alias("text"), F.col("appendix_type").alias("field_name"), _metadata(**named).alias("metadata"), "status",
    )


def build(courses: DataFrame, sections: DataFrame, rows: DataFrame, decisions: DataFrame, preview: bool = False, guide: str = GUIDE) -> DataFrame:
    """All chunks of records that the gate lets pass.

    Courses, sections and rows must be of the same documents; the error names those that are not.
    """
    ids = [x.select("document").distinct() for x in (courses, sections)]
    strange = ids[0].exceptAll(ids[1]).union(ids[1].exceptAll(ids[0])).limit(5).collect()
    if strange:
        raise ValueError(f"courses and sections of different documents: {sorted(r[0] for r in strange)}")
    made = [
        course_chunks(gated(courses, decisions, preview), guide),
        section_chunks(gated(sections, decisions, preview), guide),
        appendix_chunks(gated(rows, decisions, preview), guide),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2]).select(*COLUMNS)


def approved_only(chunks: DataFrame, allow_empty: bool = False) -> DataFrame:
    """The chunks, if all are approved and, unless allowed, there are any; an error otherwise."""
    found = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "approved").alias("bad")).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} chunks are not approved")
    if not found["n"] and not allow_empty:
        raise ValueError("no approved chunks")
    return chunks
