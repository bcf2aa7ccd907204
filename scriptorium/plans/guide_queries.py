"""Queries on a small made-up guide: cards, sections, appendix rows, chunks, search and answers."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import cards, chunks, evaluation, policies, search
from ..operators import questions as Q
from ..session import table
from ..sources import corpus
from .record_queries import literal
from .registry import query

LINES = "document string, page int, printed string, width double, height double, n int, text string, x0 double, top double, x1 double, bottom double, size double"
TABLES = "document string, page int, printed string, n int, top double, rows array<array<string>>"
HEADERS = ("example guide",)

#: (page, printed page, lines as (text, top, x0, size)); x0 and size are 40 and 10 unless given.
_PAGES = (
    (19, "19", (("Example Guide", 10), ("RULES FOR ALL", 40, 40, 14), ("First   rule.", 60), ("Documents needed:", 70), ("Bring a photograph", 80), ("and two copies.", 90), ("19", 780))),
    (20, "20", (("Still needed here", 50), ("CALENDAR", 90), ("1. Dates follow", 100))),
    (53, "A.1", (("Faculty of Science", 700),)),
    (54, "B.1", (
        ("Example Guide", 10), ("Course of Study", 100), (": M.Sc. Physics", 102, 200), ("Self Financing Scheme", 115, 200), ("Qualifying", 140), ("B.Sc. with 50 %", 141, 200),
        ("Examination and more", 150), ("Age Limit: none", 170), ("Faculty of Arts", 300), ("Course of Study: M.A. History", 320), ("Selection Process: test", 340),
        ("Process by merit", 350), ("then interview", 360, 200), ("B.1", 790),
    )),
    (55, "B.2", (("continued on merit", 60, 200), ("Remarks: twice a year", 80), ("NEW PART", 200, 40, 14), ("Age Limit: lost", 220))),
    (56, "B.3", (("The Course of Study is narrative", 60, 20), ("Course of Study: nothing follows", 500))),
    (60, "C.1", (("Age Limit: not merged", 60), ("Course of Study: Ph.D. Law", 300), ("Remarks: none", 320))),
)
_TABLES = (
    (54, "B.1", 0, 200.0, [["Duration", "Course Code", "Intake", None], [None, None, "Male", "Female"], ["2 years", "PH-1", "10", "5"], ["", "", None, ""], [None, None, "12", None]]),
    (54, "B.1", 1, 345.0, [["Course of Study", ":", "M.A. History and Culture"], ["Code", "Faculty"], ["HI-1", None]]),
    (130, "130", 0, 90.0, [
        ["S.No.", "Name of Course"], ["UNDERGRADUATE PROGRAMMES"], ["Faculty of Arts"], ["1.", "B.A. (Hons.)", "AB-1", "Rs. 300", "1 May", "20 May", "30 May", "Dean"],
        ["2", "C ertificate in Law"], ["POSTGRADUATE COURSES"], ["3.", "M.A.", "See the website", "Office"],
    ]),
    (150, "150", 0, 50.0, [["1.", "B.Tech.", "T", "10 June", "2 hours", "10 am"], ["Paper II", "4 pm"], ["2.", "B.Arch."], ["3.", "MBA", "D", "By interview"], ["4.", "LLM", "N"]]),
    (173, "173", 0, 50.0, [["1.", "B.A.", "(Hons.)", "Rs. 900"], ["2.", "alone"]]),
)


def guide(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    lines = []
    for page, printed, rows in _PAGES:
        for n, (text, top, *rest) in enumerate(rows):
            x0, size = (*rest, *(40, 10)[len(rest) :])
            lines.append(("g", page, printed, 600.0, 800.0, n, text, float(x0), float(top), x0 + 200.0, top + 8.0, float(size)))
    return spark.createDataFrame(lines, LINES), spark.createDataFrame([("g", *t) for t in _TABLES], TABLES)


def _courses(spark: SparkSession) -> DataFrame:
    return cards.courses(*guide(spark), headers=HEADERS)


@lru_cache
def _values(rows: tuple, columns: str) -> str:
    """A VALUES list of plain rows."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


_PHYSICS, _HISTORY, _LAW = "g:54:1:m-sc-physics-self-financing-scheme", "g:54:2:m-a-history-and-culture", "g:60:1:ph-d-law"
_CARDS = (
    (_PHYSICS, "M.Sc. Physics Self Financing Scheme", "PH-1", "postgraduate", "Faculty of Science", 2, 1),
    (_HISTORY, "M.A. History and Culture", "HI-1", "postgraduate", "Faculty of Arts", 2, 1),
    (_LAW, "Ph.D. Law", None, "research", "Faculty of Arts", 1, 0),
)


@query("course_cards", _values(_CARDS, "record_id, course_name, course_code, program_level, faculty, n_fields, n_tables"))
def course_cards(spark, sf):
    return _courses(spark).select("record_id", "course_name", "course_code", "program_level", "faculty", F.size("fields").alias("n_fields"), F.size("tables").alias("n_tables"))


_FIELDS = (
    (_PHYSICS, "qualifying_examination", "B.Sc. with 50 % and more", 54),
    (_PHYSICS, "age_limit", "none", 54),
    (_HISTORY, "selection_process", "test by merit then interview continued on merit", 54),
    (_HISTORY, "remarks", "twice a year", 55),
    (_LAW, "remarks", "none", 60),
)


@query("course_fields", _values(_FIELDS, "record_id, name, value, page"))
def course_fields(spark, sf):
    return _courses(spark).select("record_id", F.explode("fields").alias("f")).select("record_id", "f.name", "f.value", "f.page")


_ROWS = (
    (_PHYSICS, 1, "duration", "2 years", False), (_PHYSICS, 1, "course_code", "PH-1", False), (_PHYSICS, 1, "intake_male", "10", False), (_PHYSICS, 1, "intake_female", "5", False),
    (_PHYSICS, 2, "duration", "2 years", True), (_PHYSICS, 2, "intake_male", "12", False), (_PHYSICS, 2, "intake_female", "5", True),
    (_HISTORY, 1, "course_code", "HI-1", False),
)


@query("course_tables", _values(_ROWS, '"record_id", "row", "key", "text", inherited'))
def course_tables(spark, sf):
    rows = _courses(spark).select("record_id", F.explode("tables").alias("t")).select("record_id", F.posexplode("t.rows").alias("r", "cells"))
    return rows.select("record_id", (F.col("r") + 1).alias("row"), F.explode("cells").alias("c")).select("record_id", "row", "c.key", "c.text", "c.inherited")


@query("crs_titles", "SELECT page, card, name, below::DOUBLE AS below FROM (VALUES (54, 0, 'M.Sc. Physics Self Financing Scheme', 320), (54, 1, 'M.A. History and Culture', 800), (56, 0, 'nothing follows', 800), (60, 0, 'Ph.D. Law', 800)) AS t(page, card, name, below)")
def crs_titles(spark, sf):
    return cards.anchors(*guide(spark)).select("page", "card", "name", "below")


_SECTIONS = (
    ("g:policy:19:1:rules-for-all", "RULES FOR ALL", "", "First rule."),
    ("g:policy:19:2:documents-needed", "Documents needed", "RULES FOR ALL", "Bring a photograph / and two copies."),
    ("g:policy:20:1:documents-needed", "Documents needed", "RULES FOR ALL", "Still needed here"),
    ("g:policy:20:2:calendar", "CALENDAR", "RULES FOR ALL", "1. Dates follow"),
    ("g:policy:53:1:calendar", "CALENDAR", "RULES FOR ALL", "Faculty of Science"),
)


@query("policy_sections", _values(_SECTIONS, "record_id, heading, path, body"))
def policy_sections(spark, sf):
    rows = policies.sections(guide(spark)[0], headers=HEADERS)
    return rows.select("record_id", "heading", F.array_join("heading_path", " > ").alias("path"), F.replace("text", F.lit("\n"), F.lit(" / ")).alias("body"))


_APPENDIX = (
    ("g:application_summary:130:4:1:b-a-hons", "B.A. (Hons.)", "AB-1", "UNDERGRADUATE PROGRAMMES", "Faculty of Arts", 5, False),
    ("g:application_summary:130:5:2:certificate-in-law", "Certificate in Law", None, "UNDERGRADUATE PROGRAMMES", "Faculty of Arts", 5, True),
    ("g:application_summary:130:7:3:m-a", "M.A.", None, "POSTGRADUATE COURSES", None, 2, False),
    ("g:test_schedule:150:1:1:b-tech", "B.Tech.", None, None, None, 3, False),
    ("g:test_schedule:150:3:2:b-arch", "B.Arch.", None, None, None, 3, True),
    ("g:test_schedule:150:4:3:mba", "MBA", None, None, None, 1, False),
    ("g:test_schedule:150:5:4:llm", "LLM", None, None, None, 1, True),
    ("g:fee_summary:173:1:1:b-a-hons", "B.A. (Hons.)", None, None, None, 1, False),
)


@query("appendix_records", _values(_APPENDIX, "record_id, course_name, course_code, programme_group, faculty, n, inherited"))
def appendix_records(spark, sf):
    rows = policies.appendix_rows(guide(spark)[1])
    return rows.select("record_id", "course_name", "course_code", "programme_group", "faculty", F.size("values").alias("n"), F.exists("values", lambda v: v["inherited"]).alias("inherited"))


_SCHEDULE = (
    ("1", "T", "date_or_method", "10 June", False), ("1", "T", "duration", "2 hours | Paper II", False), ("1", "T", "scheduled_start", "10 am | 4 pm", False),
    ("2", "T", "date_or_method", "10 June", True), ("2", "T", "duration", "2 hours | Paper II", True), ("2", "T", "scheduled_start", "10 am | 4 pm", True),
    ("3", "D", "date_or_method", "By interview", False), ("4", "N", "date_or_method", "By interview", True),
)


@query("apx_schedule", _values(_SCHEDULE, 'serial, category, "key", "text", inherited'))
def apx_schedule(spark, sf):
    rows = policies.appendix_rows(guide(spark)[1]).where("appendix_type = 'test_schedule'")
    return rows.select(F.col("serial_number").alias("serial"), "category", F.explode("values").alias("v")).select("serial", "category", "v.key", "v.text", "v.inherited")


_CHUNKS = (
    (f"{_LAW}:overview", "course_overview", "Ph.D. Law - Complete Course Information", None, "Course: Ph.D. Law / Expanded Course Name: Doctor of Philosophy / Faculty: Faculty of Arts / Programme Level: research / Record Type: Course Profile /  / Remarks: none /  / Source Pages: Guide, page C.1 (physical page 60)"),
    ("g:policy:19:2:documents-needed:chunk", "policy_section", "Documents needed", None, "Section: Documents needed / Section Path: RULES FOR ALL /  / Bring a photograph / and two copies. /  / Source: Guide, page 19 (physical page 19)"),
    ("g:fee_summary:173:1:1:b-a-hons:chunk", "appendix_row", "B.A. (Hons.) - Admission Fee", "fee_summary", "Course: B.A. (Hons.) / Record Type: Admission Fee /  / Fee At Admission: Rs. 900 /  / Source: Guide, page 173 (physical page 173)"),
)


@query("guide_chunks", _values(_CHUNKS, 'chunk_id, chunk_type, title, field_name, "text"'))
def guide_chunks(spark, sf):
    lines, tables = guide(spark)
    decisions = literal(spark, f"(VALUES ('{_LAW}', 'approved'), ('g:policy:19:2:documents-needed', 'approved'), ('g:fee_summary:173:1:1:b-a-hons', 'approved'), ('{_PHYSICS}', 'rejected')) AS t(record_id, status)")
    made = chunks.build(_courses(spark), policies.sections(lines, headers=HEADERS), policies.appendix_rows(tables), decisions)
    return made.select("chunk_id", "chunk_type", "title", "field_name", F.replace("text", F.lit("\n"), F.lit(" / ")).alias("text"))


# questions over a few passages

_PASSAGES = """(VALUES ('p1', 'M.Sc. Physics', 'Course: Master of Science in Physics\\nCode: PH 201\\nAge Limit: 25 years', 'course_overview', NULL, 'c1'),
('p2', 'B.Sc. Physics', 'Course: Bachelor of Science in Physics\\nSeats: 40', 'course_overview', NULL, 'c2'),
('p3', 'Fees', 'Course: Master of Science in Physics\\nFee At Admission: Rs. 900', 'appendix_row', 'fee_summary', 'a1'),
('p4', 'Rules', 'Bring all documents to the admission office', 'policy_section', NULL, 's1')) AS t(id, title, text, type, field_name, parent)"""
_COURSES = "(VALUES ('c1', 'Master of Science in Physics', 'postgraduate'), ('c2', 'Bachelor of Science in Physics', 'undergraduate')) AS t(parent, course_name, program_level)"
_ASKED = "(VALUES (1, 'fee of the M.Sc. in Physics'), (2, 'I have a bachelor degree, which courses can I take in physics?'), (3, 'is PH-201 the code'), (4, 'documents for admission')) AS t(query_id, text)"


def _asked(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return literal(spark, _PASSAGES), literal(spark, _COURSES), literal(spark, _ASKED)


@query("question_analysis", _values(((1, "fee of the Master of Science in Physics", "MSC", "master of science,master of science in physics", False), (2, "I have a bachelor degree, which courses can I take in physics?", "", "", True), (3, "is PH-201 the code", "", "", False), (4, "documents for admission", "", "", False)), "query_id, expanded, aliases, names, discovery"))
def question_analysis(spark, sf):
    _, courses, asked = _asked(spark)
    rows = search.analyse(asked, courses)
    return rows.select("query_id", "expanded", F.array_join(F.transform("aliases", lambda a: a["abbreviation"]), ",").alias("aliases"), F.array_join("names", ",").alias("names"), "discovery")


@query("search_first", _values(((1, "p3", True, True), (3, "p1", False, False), (4, "p4", False, False)), "query_id, id, named, wanted"))
def search_first(spark, sf):
    passages, courses, asked = _asked(spark)
    hits = search.search(passages, search.analyse(asked, courses).where("query_id <> 2"), 1)
    return hits.select("query_id", "id", (F.col("name_boost") > 0).alias("named"), (F.col("intent_boost") > 0).alias("wanted"))


@query("discover_first", "SELECT 2 AS query_id, 'c1' AS parent, round(0.5::DOUBLE / 61, 9) AS level_boost")
def discover_first(spark, sf):
    passages, courses, asked = _asked(spark)
    hits = search.discover(passages, search.analyse(asked.where("query_id = 2"), courses), courses, 1)
    return hits.select("query_id", "parent", F.round("level_boost", 9).alias("level_boost"))


@query("ask_answers", _values(((1, "hybrid_retrieval", "p3", "1", None), (4, "hybrid_retrieval", "p4", "", "cites sources that are not there: 9")), "query_id, mode, first, valid, warning"))
def ask_answers(spark, sf):
    passages, courses, asked = _asked(spark)
    answer = lambda q, c: F.when(F.contains(q, F.lit("fee")), "Rs. 900 [SOURCE 1]").otherwise("See [SOURCE 9]")
    rows = search.ask(passages, courses, asked.where("query_id IN (1, 4)"), answer)
    return rows.select("query_id", "mode", F.get("sources", F.lit(0)).alias("first"), F.array_join("valid", ",").alias("valid"), "warning")


@query("eval_report", _values(((3, 2, "2/3 (66.7%)"),), "total, passed, line"))
def eval_report(spark, sf):
    passages, courses, asked = _asked(spark)
    wanted = literal(spark, "(VALUES (1, 'a1', 'fee_summary', NULL), (3, 'c1', 'age_limit', NULL), (4, 'c2', NULL, 1)) AS t(query_id, expected_parent_record_id, expected_field, expected_max_rank)")
    cases = asked.join(wanted, "query_id")
    hits = search.search(passages, search.analyse(cases.select("query_id", "text"), courses))
    return evaluation.summary(evaluation.judged(cases, hits, passages)).select("total", "passed", "line")


@query("search_documents")
def search_documents(spark, sf):
    """The whole flow over all documents and all benchmark questions; sources stand in for parents."""
    d = table(spark, sf, "documents")
    passages = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), "text", F.lit(search.POLICY).alias("type"), F.lit(None).cast("string").alias("field_name"), F.col("source").alias("parent"))
    courses = d.select(F.col("source").alias("parent"), F.col("source").alias("course_name"), F.lit("other").alias("program_level")).distinct()
    asked = table(spark, sf, "benchmark").where("trim(text) <> ''").select(F.col("item_id").alias("query_id"), "text")
    return search.search(passages, search.analyse(asked, courses)).select("query_id", "id", "place", F.round("score", 9).alias("score"))


@query("alias_matches", _values(((0, 5, "PGDCP"), (10, 22, "PGD"), (24, 31, "BTECH")), "b, e, abbreviation"))
def alias_matches(spark, sf):
    found = literal(spark, "(VALUES ('PGDCP and P.G. Diploma, b.tech. x')) AS t(q)").select(F.explode(Q.alias_spans(F.col("q"))).alias("s"))
    return found.select(F.col("s.start").alias("b"), F.col("s.end").alias("e"), "s.abbreviation")


@query("uncovered_abbreviations", _values((("ABC",), ("G.H.Q.",)), "abbreviation"))
def uncovered_abbreviations(spark, sf):
    return literal(spark, "(VALUES ('M.Sc. (ABC) with G.H.Q. and GIS')) AS t(q)").select(F.explode(Q.uncovered_abbreviations(F.col("q"))).alias("abbreviation"))


@query("page_labels", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Guide, page B.' || page_id || ' (physical page ' || page_id || ')' ELSE 'Guide, physical page ' || page_id END AS label FROM pages")
def page_labels(spark, sf):
    printed = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("B."), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").select("page_id", chunks.page_label(printed, F.col("page_id")).alias("label"))


@query("vector_literals", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6e', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.vector_literal(F.col("embedding"), "%.6e").alias("literal"))


@query("corpus_digest", """WITH h AS (SELECT sha256(doc_id || chr(31) || text) AS h FROM documents),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT AS a, sum(('0x' || substr(h, 16, 15))::BIGINT)::HUGEINT AS b, sum(('0x' || substr(h, 31, 15))::BIGINT)::HUGEINT AS c, sum(('0x' || substr(h, 46, 15))::BIGINT)::HUGEINT AS d FROM h)
SELECT sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS digest FROM s""")
def corpus_digest(spark, sf):
    return corpus.digest(table(spark, sf, "documents"), "doc_id", "text")


@query("named_in_title", _values(((1, "Master of Science"), (2, "")), "k, names"))
def named_in_title(spark, sf):
    return literal(spark, "(VALUES (1, 'M.Sc. Physics (old MA style)'), (2, 'Physics')) AS t(k, title)").select("k", F.array_join(Q.title_names(T.clean(F.col("title"))), ",").alias("names"))
