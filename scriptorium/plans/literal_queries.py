"""Queries on layout fixtures, questions and answers, over literal rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..operators import questions as Q
from .record_queries import literal
from .registry import query

_WORDS = "(VALUES (1, 'World', 40.0, 10.4, 70.0, 20.0), (1, 'Hello', 10.0, 10.0, 38.0, 20.5), (1, 'below', 10.0, 12.5, 30.0, 22.0), (1, 'edge', 50.0, 12.0, 60.0, 21.0), (2, 'alone', 5.0, 3.0, 9.0, 8.0)) AS t(page, text, x0, top, x1, bottom)"


@query("lay_group_lines", "SELECT * FROM (VALUES (1, 0, 'Hello World edge', 10.0, 10.0, 70.0, 21.0), (1, 1, 'below', 10.0, 12.5, 30.0, 22.0), (2, 0, 'alone', 5.0, 3.0, 9.0, 8.0)) AS t(page, line, text, x0, top, x1, bottom)")
def lay_group_lines(spark, sf):
    words = literal(spark, _WORDS).select("page", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")])
    return L.group_lines(words)


_CELLS = "(VALUES (1, '  a  b '), (2, '   '), (3, NULL), (4, 'x')) AS t(k, cell)"


@query("lay_clean_cells", f"SELECT k, nullif(trim(regexp_replace(cell, '\\s+', ' ', 'g')), '') AS cell FROM {_CELLS}")
def lay_clean_cells(spark, sf):
    return literal(spark, _CELLS).select("k", L.clean_cell(F.col("cell")).alias("cell"))


@query("lay_page_label", "SELECT * FROM (VALUES (1, '17'), (2, 'xiv'), (3, 'B.4'), (4, NULL)) AS t(k, label)")
def lay_page_label(spark, sf):
    rows = "(VALUES (1, array('Head', '17')), (2, array('(xiv)', 'text here')), (3, array('9', 'B.4', 'end')), (4, array('none', 'at all'))) AS t(k, lines)"
    return literal(spark, rows).select("k", L.page_label(F.col("lines")).alias("label"))


_HEAD = "(VALUES (1, 'GENERAL RULES', 10.0), (2, 'plain text', 10.0), (3, 'Large words', 14.0), (4, '1. GENERAL', 15.0), (5, 'Documents needed:', 9.0), (6, 'See https://x.y:', 9.0)) AS t(k, text, size)"


@query("lay_headings", "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, true), (6, false)) AS t(k, heading)")
def lay_headings(spark, sf):
    return literal(spark, _HEAD).select("k", L.is_heading(F.col("text"), F.col("size").cast("double")).alias("heading"))


_NOISE = "(VALUES (1, 'Annual Guide', 20.0), (2, 'Faculty of Arts', 300.0), (3, '42', 790.0), (4, 'Course text', 400.0)) AS t(k, text, top)"


@query("lay_drop_noise", f"SELECT k, text FROM {_NOISE} WHERE lower(text) NOT IN ('annual guide') AND NOT regexp_matches(text, '^Faculty of ') AND NOT regexp_matches(text, '^[0-9]+$') AND top < 0.94 * 800")
def lay_drop_noise(spark, sf):
    keep = ~F.lower("text").isin("annual guide") & ~F.rlike("text", F.lit("^Faculty of ")) & ~F.rlike("text", F.lit("^[0-9]+$")) & (F.col("top") < 0.94 * 800)
    return literal(spark, _NOISE).where(keep).select("k", "text")


_TOPS = "(VALUES (1, 1, 100.0, NULL), (1, 2, 150.0, 'A'), (1, 3, 300.0, NULL), (2, 1, 50.0, 'B'), (2, 2, 60.0, NULL)) AS t(page, n, top, faculty)"


@query("lead_anchor", f"SELECT page, n, coalesce(lead(top) OVER (PARTITION BY page ORDER BY top), 842.0)::DOUBLE AS bottom FROM {_TOPS}")
def lead_anchor(spark, sf):
    by = Window.partitionBy("page").orderBy("top")
    return literal(spark, _TOPS).select("page", "n", F.coalesce(F.lead("top").over(by).cast("double"), F.lit(842.0)).alias("bottom"))


@query("asof_faculty", "SELECT * FROM (VALUES (1, 1, 'carried'), (1, 2, 'carried'), (1, 3, 'A'), (2, 1, 'A'), (2, 2, 'B')) AS t(page, n, faculty)")
def asof_faculty(spark, sf):
    by = Window.orderBy("page", "top")  # one document of a few lines; a corpus partitions by document
    return literal(spark, _TOPS).select("page", "n", F.coalesce(L.before(F.col("faculty"), by), F.lit("carried")).alias("faculty"))


@query("forward_fill", f"SELECT page, n, last_value(faculty IGNORE NULLS) OVER (PARTITION BY page ORDER BY n ROWS UNBOUNDED PRECEDING) AS faculty, faculty IS NULL AND last_value(faculty IGNORE NULLS) OVER (PARTITION BY page ORDER BY n ROWS UNBOUNDED PRECEDING) IS NOT NULL AS inherited FROM {_TOPS}")
def forward_fill(spark, sf):
    filled = L.carried(F.col("faculty"), Window.partitionBy("page").orderBy("n"))
    return literal(spark, _TOPS).select("page", "n", filled.alias("faculty"), (F.col("faculty").isNull() & filled.isNotNull()).alias("inherited"))


@query("box_union", f"SELECT page, min(x0)::DOUBLE AS x0, min(top)::DOUBLE AS top, max(x1)::DOUBLE AS x1, max(bottom)::DOUBLE AS bottom FROM {_WORDS} GROUP BY page")
def box_union(spark, sf):
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")]).alias("b")
    return literal(spark, _WORDS).select("page", box).groupBy("page").agg(*L.box_union("b"))


@query("interval_cards", "SELECT * FROM (VALUES (110.0::DOUBLE, 1), (149.0::DOUBLE, 1), (150.0::DOUBLE, 2), (500.0::DOUBLE, 3)) AS t(line_top, card)")
def interval_cards(spark, sf):
    cards = literal(spark, "(VALUES (100.0, 1), (150.0, 2), (300.0, 3)) AS t(top, card)").select(F.col("top").cast("double").alias("top"), "card")
    lines = literal(spark, "(VALUES (110.0), (149.0), (150.0), (500.0), (20.0)) AS t(top)").select(F.col("top").cast("double").alias("top"), F.lit(None).cast("int").alias("card"))
    # cards come first at equal tops, so a line on its card's top belongs to it
    both = cards.withColumn("o", F.lit(0)).union(lines.withColumn("o", F.lit(1)))
    card = L.carried(F.col("card"), Window.orderBy("top", "o"))
    return both.select(F.col("top").alias("line_top"), card.alias("card"), "o").where("o = 1 and card is not null").drop("o")


@query("tbl_nearest_header", "SELECT * FROM (VALUES (1, 'name'), (2, 'seats'), (3, 'name')) AS t(k, header)")
def tbl_nearest_header(spark, sf):
    heads = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(n).alias("name")) for n, x in (("name", 10.0), ("seats", 50.0), ("fee", 90.0))])
    cells = literal(spark, "(VALUES (1, 12.0), (2, 69.0), (3, 30.0)) AS t(k, x)")
    return cells.select("k", L.nearest_header(F.col("x").cast("double"), heads).alias("header"))


@query("band_name_match", "SELECT * FROM (VALUES ('t1', 'Master of Computer Science'), ('t2', 'Bachelor of Arts')) AS t(title, name)")
def band_name_match(spark, sf):
    titles = literal(spark, "(VALUES ('t1', 1, 100.0, 'Computer Science Master'), ('t2', 1, 300.0, 'Arts Bachelor'), ('t3', 1, 700.0, 'Arts Bachelor')) AS t(title, page, top, words)")
    names = literal(spark, "(VALUES (1, 130.0, 'Master of Computer Science'), (1, 140.0, 'Computer Science'), (1, 350.0, 'Bachelor of Arts')) AS n(p, y, name)")
    near = (F.col("page") == F.col("p")) & (F.abs(F.col("top") - F.col("y")) <= 80) & (L.token_overlap(F.col("words"), F.col("name")) >= 0.6)
    best = Window.partitionBy("title").orderBy(F.length("name").desc(), "name")
    return titles.join(names, near).withColumn("n", F.row_number().over(best)).where("n = 1").select("title", "name")


@query("ctx_carry", "SELECT * FROM (VALUES (1, 'UG', NULL), (2, 'UG', 'Arts'), (3, 'UG', 'Arts'), (4, 'PG', NULL), (5, 'PG', 'Law')) AS t(n, programme, faculty)")
def ctx_carry(spark, sf):
    rows = literal(spark, "(VALUES (1, 'UG', NULL), (2, NULL, 'Arts'), (3, NULL, NULL), (4, 'PG', NULL), (5, NULL, 'Law')) AS t(n, programme, faculty)")
    by = Window.orderBy("n")
    part = rows.withColumn("g", F.count("programme").over(by)).withColumn("programme", L.carried(F.col("programme"), by))
    return part.select("n", "programme", L.carried(F.col("faculty"), Window.partitionBy("g").orderBy("n")).alias("faculty"))


@query("apx_inherit_map", "SELECT * FROM (VALUES (1, 'a=1', false), (2, 'a=1', true), (3, 'b=2', false), (4, 'b=2', true)) AS t(n, tail, inherited)")
def apx_inherit_map(spark, sf):
    rows = literal(spark, "(VALUES (1, map('a', '1')), (2, NULL), (3, map('b', '2')), (4, NULL)) AS t(n, m)")
    filled = L.carried(F.col("m"), Window.orderBy("n"))
    show = F.array_join(F.transform(F.map_entries(filled), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("n", show.alias("tail"), F.col("m").isNull().alias("inherited"))


@query("apx_continuation", "SELECT * FROM (VALUES (1, 'Paper I | Paper II | Paper III'), (2, 'Only')) AS t(serial, paper)")
def apx_continuation(spark, sf):
    rows = literal(spark, "(VALUES (1, 1, 'Paper I'), (2, NULL, 'Paper II'), (3, NULL, 'Paper III'), (4, 2, 'Only')) AS t(n, serial, cell)")
    part = rows.withColumn("serial", L.carried(F.col("serial"), Window.orderBy("n")))
    return part.groupBy("serial").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cell"))), lambda x: x["cell"]), " | ").alias("paper"))


@query("ordered_distinct_pages", "SELECT 1 AS k, '12, 7, 13' AS pages")
def ordered_distinct_pages(spark, sf):
    return literal(spark, "(VALUES (1, array('12', '7', '12', '13', '7'))) AS t(k, p)").select("k", F.array_join(F.array_distinct("p"), ", ").alias("pages"))


@query("apx_classify_rows", "SELECT * FROM (VALUES (1, 'record'), (2, 'header'), (3, 'group'), (4, 'context')) AS t(k, kind)")
def apx_classify_rows(spark, sf):
    rows = literal(spark, "(VALUES (1, '12. B.Sc. Physics'), (2, 'S.No. Course Date'), (3, 'UNDERGRADUATE PROGRAMMES'), (4, 'Faculty of Science')) AS t(k, text)")
    kind = F.when(F.rlike("text", F.lit("^[0-9]+\\.?\\s")), "record").when(F.rlike("text", F.lit("(?i)^s\\.?\\s*no")), "header").when(F.rlike("text", F.lit("(?i)programmes$")), "group").otherwise("context")
    return rows.select("k", kind.alias("kind"))


_COURSE = "(VALUES ('c1', 'M.Sc. Physics', 'Science', array(struct('duration' AS name, '2 years' AS value), struct('fee' AS name, NULL AS value)), array(map('seats', '20'), map('seats', '30')))) AS t(id, title, faculty, fields, rows)"


@query("chunk_course", "SELECT 'c1:overview' AS id, 'Course: M.Sc. Physics' || chr(10) || 'Faculty: Science' || chr(10) || 'Duration: 2 years' || chr(10) || 'Row 1: seats=20' || chr(10) || 'Row 2: seats=30' AS text")
def chunk_course(spark, sf):
    fields = F.transform(F.filter("fields", lambda x: x["value"].isNotNull()), lambda x: F.concat(T.display_name(x["name"]), F.lit(": "), x["value"]))
    rows = F.transform("rows", lambda m, i: F.concat(F.lit("Row "), i + 1, F.lit(": "), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")))
    head = F.array(F.concat(F.lit("Course: "), "title"), F.concat(F.lit("Faculty: "), "faculty"))
    return literal(spark, _COURSE).select(F.concat("id", F.lit(":overview")).alias("id"), F.array_join(F.concat(head, fields, rows), "\n").alias("text"))


@query("chunk_policy", "SELECT 's1:chunk' AS id, 'Section: General > Rules' || chr(10) || 'Be on time.' AS text")
def chunk_policy(spark, sf):
    rows = literal(spark, "(VALUES ('s1', array('General', 'Rules'), 'Be on time.')) AS t(id, path, body)")
    return rows.select(F.concat("id", F.lit(":chunk")).alias("id"), F.concat(F.lit("Section: "), F.array_join("path", " > "), F.lit("\n"), "body").alias("text"))


@query("chunk_appendix", "SELECT * FROM (VALUES ('a1', 'Fee' || chr(10) || 'Group: PG' || chr(10) || 'Total: 500'), ('a2', 'Fee' || chr(10) || 'Total: 90')) AS t(id, text)")
def chunk_appendix(spark, sf):
    rows = literal(spark, "(VALUES ('a1', 'PG', '500'), ('a2', NULL, '90')) AS t(id, g, total)")
    return rows.select("id", F.concat_ws("\n", F.lit("Fee"), F.concat(F.lit("Group: "), "g"), F.concat(F.lit("Total: "), "total")).alias("text"))


@query("crs_valid", "SELECT * FROM (VALUES (2), (3)) AS t(k)")
def crs_valid(spark, sf):
    rows = literal(spark, "(VALUES (1, 0, 0), (2, 1, 0), (3, 0, 2)) AS t(k, fields, tables)")
    return rows.where("fields > 0 or tables > 0").select("k")


@query("continuation_end", "SELECT * FROM (VALUES (1, 120.0::DOUBLE), (2, 842.0::DOUBLE)) AS t(page, bottom)")
def continuation_end(spark, sf):
    rows = literal(spark, "(VALUES (1, 300.0, true), (1, 120.0, true), (1, 50.0, false), (2, 70.0, false)) AS t(page, top, heading)")
    return rows.groupBy("page").agg(F.coalesce(F.min(F.when(F.col("heading"), F.col("top").cast("double"))), F.lit(842.0)).alias("bottom"))


@query("fix_initials", "SELECT * FROM (VALUES (1, 'Certificate in Law'), (2, 'A Course'), (3, 'Diploma')) AS t(k, name)")
def fix_initials(spark, sf):
    return literal(spark, "(VALUES (1, 'C ertificate in Law'), (2, 'A Course'), (3, 'D iploma')) AS t(k, name)").select("k", T.fix_initials(F.col("name")).alias("name"))


@query("display_name", "SELECT * FROM (VALUES (1, 'Fee Summary'), (2, 'Test-Date'), (3, 'X2Y')) AS t(k, name)")
def display_name(spark, sf):
    return literal(spark, "(VALUES (1, 'fee_summary'), (2, 'test-date'), (3, 'x2y')) AS t(k, name)").select("k", T.display_name(F.col("name")).alias("name"))


_ANSWERS = "(VALUES (1, 'It is so [SOURCE 2] and [source 1], again [SOURCE 2].', 2), (2, 'No 【SOURCE 9】 here [SOURCE 1]', 3), (3, 'none', 1)) AS t(k, answer, n)"


@query("citations", "SELECT * FROM (VALUES (1, [2, 1], []::INTEGER[]), (2, [1], [9]), (3, []::INTEGER[], []::INTEGER[])) AS t(k, valid, invalid)")
def citations(spark, sf):
    a, n = F.col("answer"), F.col("n")
    return literal(spark, _ANSWERS).select("k", T.valid_citations(a, n).alias("valid"), T.invalid_citations(a, n).alias("invalid"))


@query("link_citations", "SELECT * FROM (VALUES (1, 'It is so [[2]](#source-2) and [[1]](#source-1), again [[2]](#source-2).'), (2, 'No 【SOURCE 9】 here [[1]](#source-1)'), (3, 'none')) AS t(k, linked)")
def link_citations(spark, sf):
    return literal(spark, _ANSWERS).select("k", T.link_citations(F.col("answer"), F.col("n")).alias("linked"))


@query("target_levels", "SELECT * FROM (VALUES (1, 'research'), (2, 'postgraduate'), (3, 'undergraduate,diploma'), (4, '')) AS t(k, levels)")
def target_levels(spark, sf):
    rows = literal(spark, "(VALUES (1, 'I completed my master degree'), (2, 'I have a bachelor degree'), (3, 'I finished class 12'), (4, 'What is the fee?')) AS t(k, q)")
    return rows.select("k", F.array_join(T.target_levels(F.col("q")), ",").alias("levels"))


_QUESTIONS = "(VALUES (1, 'Fee for M.C.A.?'), (2, 'b tech and MBA dates'), (3, 'it will be fine'), (4, 'B.E. seats'), (5, 'xMCAx éMCA')) AS t(k, q)"


@query("alias_expand", "SELECT * FROM (VALUES (1, 'Fee for Master of Computer Applications?'), (2, 'Bachelor of Technology and Master of Business Administration dates'), (3, 'it will be fine'), (4, 'Bachelor of Engineering seats'), (5, 'xMCAx éMCA')) AS t(k, q)")
def alias_expand(spark, sf):
    return literal(spark, _QUESTIONS).select("k", Q.expand(F.col("q")).alias("q"))


@query("alias_spans", "SELECT * FROM (VALUES (1, 'MCA'), (2, 'MBA,BTECH'), (3, ''), (4, 'BE'), (5, '')) AS t(k, found)")
def alias_spans(spark, sf):
    return literal(spark, _QUESTIONS).select("k", F.array_join(Q.aliases_in(F.col("q")), ",").alias("found"))


@query("unknown_abbreviations", "SELECT * FROM (VALUES ('NRI'), ('OBC')) AS t(abbreviation)")
def unknown_abbreviations(spark, sf):
    rows = literal(spark, "(VALUES ('NRI and M.C.A. seats'), ('O.B.C. with MBA; NRI')) AS t(q)")
    return Q.unknown_abbreviations(rows, "q", [a for a, _ in Q.ALIASES])


@query("title_expansion", "SELECT 'MSC' AS short, 'Master of Science' AS full_name")
def title_expansion(spark, sf):
    table = spark.createDataFrame(list(Q.ALIASES), "short string, full_name string")
    title = literal(spark, "(VALUES ('M.Sc. Physics (old MA style)')) AS t(title)")
    flat = F.upper(F.regexp_replace("title", "[. _-]", ""))
    hits = title.crossJoin(F.broadcast(table)).where(F.contains(flat, F.col("short")))
    longest = Window.orderBy(F.length("short").desc())
    return hits.withColumn("r", F.rank().over(longest)).where("r = 1").select("short", "full_name").distinct()


@query("named_courses", "SELECT * FROM (VALUES (1, 'Master of Computer Applications')) AS t(k, course)")
def named_courses(spark, sf):
    names = literal(spark, "(VALUES ('Master of Computer Applications'), ('Bachelor of Laws')) AS n(course)")
    asked = literal(spark, _QUESTIONS).select("k", T.fold(Q.expand(F.col("q"))).alias("q"))
    return asked.join(F.broadcast(names), F.contains(F.col("q"), T.fold(F.col("course")))).select("k", "course")


@query("exact_value_match", "SELECT * FROM (VALUES (1, true), (2, false), (3, false)) AS t(k, hit)")
def exact_value_match(spark, sf):
    rows = literal(spark, "(VALUES (1, 'is code PH-201 open', 'Code: PH 201'), (2, 'is code PH-999 open', 'Code: PH 201'), (3, 'plain', 'no pairs here')) AS t(k, q, p)")
    return rows.select("k", Q.exact_value(F.col("q"), F.col("p")).alias("hit"))


@query("crs_continuations", "SELECT * FROM (VALUES (1, true), (2, false), (3, true)) AS t(page, continues)")
def crs_continuations(spark, sf):
    rows = literal(spark, "(VALUES (1, 500.0, 10.0, 9.0, 'Duration: 2 years'), (2, 200.0, 10.0, 14.0, 'NEW COURSE'), (3, 80.0, 120.0, 10.0, 'more text')) AS t(page, top, x0, size, text)")
    first = F.min_by(F.struct("top", "x0", "size"), "top")
    label = F.bool_or(F.rlike("text", F.lit("(?i)^(?:duration|eligibility|intake|fee)\\b")))
    return rows.groupBy("page").agg(label.alias("l"), first.alias("f")).select("page", (F.col("l") | ((F.col("f.top") <= 90) & (F.col("f.x0") >= 0.15 * 595) & (F.col("f.size") <= 11))).alias("continues"))


@query("crs_fields", "SELECT * FROM (VALUES ('duration', '2 years full time'), ('intake', '30')) AS t(label, value)")
def crs_fields(spark, sf):
    rows = literal(spark, "(VALUES (1, 'Duration: 2 years'), (2, 'full time'), (3, 'Intake: 30')) AS t(n, text)")
    m = F.lower(F.regexp_extract("text", "^(Duration|Intake|Eligibility|Fee)\\s*:", 1))
    label = L.carried(F.nullif(m, F.lit("")), Window.orderBy("n"))
    part = rows.select("n", label.alias("label"), F.trim(F.regexp_replace("text", "^(?:Duration|Intake|Eligibility|Fee)\\s*:", "")).alias("v"))
    return part.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), " ").alias("value"))


@query("tbl_headers", "SELECT * FROM (VALUES (1, 'name'), (2, 'intake_boys'), (3, NULL)) AS t(k, header)")
def tbl_headers(spark, sf):
    known = F.create_map(*[F.lit(x) for kv in (("course", "name"), ("boys", "intake_boys"), ("girls", "intake_girls")) for x in kv])
    norm = F.regexp_replace(F.lower(F.trim("cell")), "[^a-z]+", "")
    return literal(spark, "(VALUES (1, ' Course '), (2, 'Boys*'), (3, 'Other')) AS t(k, cell)").select("k", F.try_element_at(known, norm).alias("header"))


@query("apx_decode", "SELECT * FROM (VALUES (1, 'B.A.', 500)) AS t(serial, course, fee)")
def apx_decode(spark, sf):
    cells = literal(spark, "(VALUES (array('1.', 'B.A.', 'x', '500'))) AS t(c)")
    return cells.select(F.regexp_extract(F.get("c", F.lit(0)), "([0-9]+)", 1).cast("int").alias("serial"), F.get("c", F.lit(1)).alias("course"), F.element_at("c", -1).cast("int").alias("fee"))


@query("crs_merge_pages", "SELECT * FROM (VALUES ('c1', 'fee,intake'), ('c2', 'fee')) AS t(course, fields)")
def crs_merge_pages(spark, sf):
    courses = literal(spark, "(VALUES ('c1', 10, array('fee')), ('c2', 20, array('fee'))) AS t(course, page, fields)")
    parts = literal(spark, "(VALUES (11, array('intake', 'fee')), (22, array('lost'))) AS t(p, more)")
    merged = courses.join(parts, F.col("p") == F.col("page") + 1, "left")
    return merged.select("course", F.array_join(F.array_distinct(F.concat("fields", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("fields"))
