"""Policy sections and appendix rows from positioned lines and tables of pages.

Inputs are those of ``cards``. Headings are carried over a document's lines,
runs of lines between headings are packed to a number of words, and appendix
rows inherit what the rows above them leave open. Each appendix of a document
is one ordered run of rows; nothing is ordered across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import layout as L
from .cards import PAGE

# First and last page of each kind.
SECTIONS = ((19, 53), (164, 171), (187, 187))
APPENDICES = (("application_summary", 128, 148), ("test_schedule", 149, 163), ("fee_summary", 172, 186))
# Marks of header rows, groups and units.
HEADER_MARKS = (
    "name of course", "course of study", "processing charges", "form opening date", "form closing date",
    "scheduled start", "fee payable at the", "without late fee", "rs.300.00",
)
GROUP_MARKS = ("PROGRAM", "PROGAM", "COURSES", "DIPLOMA", "CERTIFICATE")
UNIT_STARTS = ("faculty of ", "centre for ", "center for ")
UNIT_MARKS = ("college", "school", "academy", "planning", "polytechnic")
FIRST_HEADING = "Admissions policies"
APPENDIX_LABELS = {"application_summary": "Application Form Details", "test_schedule": "Admission Test Schedule", "fee_summary": "Admission Fee"}
DATES = ("form_opening_date", "closing_without_late_fee", "closing_with_late_fee")


def in_pages(page: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | page.between(a, b)
    return out


def chunk_numbers(counts: Column, limit: int) -> Column:
    """For each line's words the number of its chunk: a chunk ends before the line that would overfill it."""
    if limit < 50:
        raise ValueError("a chunk must have room for 50 words")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, words: Column) -> Column:
        full = (F.size(a["out"]) > 0) & (a["n"] + words > limit)
        k = F.when(full, a["k"] + 1).otherwise(a["k"])
        return F.struct(F.when(full, words).otherwise(a["n"] + words).cast("int").alias("n"), k.alias("k"), F.concat(a["out"], F.array(k)).alias("out"))

    return F.aggregate(counts, start, step, lambda a: a["out"])


def sections(lines: DataFrame, limit: int = 300, ranges: tuple[tuple[int, int], ...] = SECTIONS, headers: tuple[str, ...] = ()) -> DataFrame:
    """Sections (record_id, document, page, printed, heading, heading_path, text, box) of at most ``limit`` words."""
    t = F.lower(F.trim("text"))
    number = (F.col("top") >= F.col("height") * 0.94) & F.rlike(t, F.lit("^(?:[a-k]\\.)?[0-9]+$"))
    rows = lines.where(in_pages(F.col("page"), ranges) & ~number)
    rows = rows.where(~t.isin(*headers)) if headers else rows
    rows = rows.withColumn("heads", L.is_heading(F.trim("text"), F.coalesce("size", F.lit(0.0))))
    name = F.rtrim(T.clean(F.col("text")), F.lit(":"))
    order = Window.partitionBy("document").orderBy("page", "top", "n")
    rows = rows.select(
        "*",
        F.coalesce(L.carried(F.when(F.col("heads"), name), order), F.lit(FIRST_HEADING)).alias("heading"),
        F.coalesce(L.carried(F.when(F.col("heads") & (F.col("size") >= 13), name), order), F.lit(FIRST_HEADING)).alias("major"),
        F.count_if("heads").over(Window.partitionBy(*PAGE).orderBy("top", "n").rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
    )
    line = F.struct("top", "n", T.clean(F.col("text")).alias("text"), F.struct("x0", "top", "x1", "bottom").alias("box"))
    runs = rows.where(~F.col("heads")).groupBy(*PAGE, "printed", "run", "heading", "major").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    words = F.transform("lines", lambda x: F.size(F.array_remove(F.split(x["text"], " ", -1), "")))
    runs = runs.withColumn("numbers", chunk_numbers(words, limit))
    each = runs.select(*PAGE, "printed", "run", "heading", "major", F.explode(F.arrays_zip("lines", "numbers")).alias("z")).select(*PAGE, "printed", "run", "heading", "major", F.col("z.numbers").alias("k"), "z.lines.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "n", "text"))), lambda x: x["text"]), "\n")
    chunks = each.groupBy(*PAGE, "printed", "run", "heading", "major", "k").agg(text.alias("text"), F.struct(*L.box_union("box")).alias("box"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("run", "k"))
    return chunks.select(
        F.concat_ws(":", "document", F.lit("policy"), "page", place, T.slug(F.col("heading"), 64)).alias("record_id"),
        *PAGE, "printed", "heading",
        F.when(F.col("major") != F.col("heading"), F.array("major")).otherwise(F.array().cast("array<string>")).alias("heading_path"),
        "text", "box",
    )


def row_kind(cells: Column) -> Column:
    """record, header, group, unit or other, from the cells of an appendix row."""
    first, alone = cells[0], F.size(cells) == 1
    joined = F.lower(F.array_join(cells, " "))
    any_of = lambda text, marks: F.greatest(*[F.contains(text, F.lit(m)) for m in marks])
    unit = F.greatest(*[F.startswith(F.lower(first), F.lit(s)) for s in UNIT_STARTS]) | any_of(F.lower(first), UNIT_MARKS)
    return (
        F.when(F.rlike(first, F.lit("^[0-9]+\\.?$")), "record")
        .when(any_of(joined, HEADER_MARKS) | (joined == "fee of"), "header")
        .when(alone & any_of(F.upper(first), GROUP_MARKS), "group")
        .when(alone & unit, "unit")
        .otherwise("other")
    )


def _entries(*pairs: tuple[str, Column]) -> Column:
    """Array of (key, text) of the pairs that have a text."""
    made = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.alias("text"))) for k, c in pairs])
    return F.array_compact(made)


def _at(cells: Column, i: int) -> Column:
    return F.get(cells, F.lit(i))


def application_values(tail: Column) -> Column:
    """Charges, dates and office of an application row; empty if the row says nothing."""
    paid = F.startswith(F.lower(_at(tail, 0)), F.lit("rs."))
    later = F.startswith(F.lower(_at(tail, 1)), F.lit("will be notified"))
    last = lambda least: F.when(F.size(tail) > least, F.element_at(tail, -1))
    outside = _entries(("application_form_details", _at(tail, 0)), ("form_handling_office", last(1)))
    announced = _entries(("processing_charges", _at(tail, 0)), ("application_form_details", _at(tail, 1)), ("form_handling_office", last(2)))
    dated = _entries(("processing_charges", _at(tail, 0)), *[(k, _at(tail, i + 1)) for i, k in enumerate(DATES)], ("form_handling_office", last(4)))
    return F.when(F.size(tail) == 0, F.array().cast("array<struct<key:string,text:string>>")).when(~paid, outside).when(F.coalesce(later, F.lit(False)), announced).otherwise(dated)


def appendix_cells(tables: DataFrame, appendices: tuple = APPENDICES) -> DataFrame:
    """(document, page, printed, kind, r, cells) of each page's longest table, cleaned."""
    kind = F.coalesce(*[F.when(F.col("page").between(a, b), F.lit(k)) for k, a, b in appendices])
    longest = Window.partitionBy(*PAGE).orderBy(F.size("rows").desc(), "n")
    main = tables.withColumn("kind", kind).where("kind is not null").withColumn("first", F.row_number().over(longest)).where("first = 1")
    rows = main.select(*PAGE, "printed", "kind", F.posexplode("rows").alias("r", "row"))
    cells = F.filter(F.transform("row", lambda c: T.clean(c)), lambda c: c != "")
    return rows.select(*PAGE, "printed", "kind", "r", cells.alias("cells")).where(F.size("cells") > 0)


def appendix_rows(tables: DataFrame, appendices: tuple = APPENDICES) -> DataFrame:
    """Records of all appendices with what they inherit: category, group, faculty and values (key, text, inherited)."""
    rows = appendix_cells(tables, appendices).withColumn("is", row_kind(F.col("cells")))
    run = Window.partitionBy("document", "kind").orderBy("page", "r")
    rows = rows.withColumn("programme_group", L.carried(F.when(F.col("is") == "group", _at(F.col("cells"), 0)), run))
    rows = rows.withColumn("groups", F.count_if(F.col("is") == "group").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    of_group = Window.partitionBy("document", "kind", "groups").orderBy("page", "r")
    rows = rows.withColumn("faculty", L.carried(F.when(F.col("is") == "unit", _at(F.col("cells"), 0)), of_group))

    fee = F.col("kind") == "fee_summary"
    rest = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    rows = rows.withColumn("rest", rest)
    rest = F.col("rest")
    record = (F.col("is") == "record") & (F.size(rest) > 0) & ~(fee & (F.size(rest) < 2))
    code = F.when(~fee & F.rlike(_at(rest, 1), F.lit("^[A-Z0-9-]{3,10}$")), _at(rest, 1))
    rows = rows.withColumn("record", record).withColumn("course_code", F.when(F.col("record"), code))
    skip = F.when(F.col("course_code").isNotNull(), 3).otherwise(2)
    rows = rows.withColumn("tail", F.slice(rest, skip, F.greatest(F.size(rest) - skip + 1, F.lit(0))))
    own = F.when(F.col("kind") == "test_schedule", F.when(_at(F.col("tail"), 0).isin("T", "D", "N"), _at(F.col("tail"), 0)))
    rows = rows.withColumn("own", F.when(F.col("record"), own))
    rows = rows.withColumn("tail", F.when(F.col("own").isNotNull(), F.slice("tail", 2, F.size("tail"))).otherwise(F.col("tail")))

    t = F.col("tail")
    schedule = _entries(("date_or_method", _at(t, 0)), ("duration", _at(t, 1)), ("scheduled_start", _at(t, 2)))
    explicit = F.when(fee, _entries(("fee_at_admission", F.element_at(rest, -1)))).when(F.col("kind") == "test_schedule", schedule).otherwise(application_values(t))
    rows = rows.withColumn("explicit", F.when(F.col("record"), explicit)).withColumn("says", F.size("explicit") > 0)
    says = F.col("record") & F.col("says")

    # a row that says nothing takes all values of the last that did, with what was added below that one since
    adds = (F.col("kind") == "test_schedule") & (F.col("is") == "other") & (F.size("cells") <= 3)
    rows = rows.select(
        "*",
        F.count_if("record").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("block"),
        L.carried(F.when(says, F.struct("explicit")), run).alias("base"),
        F.count_if(says).over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("since"),
        L.carried(F.when(says, F.col("own")), run).alias("category_before"),
        F.when(adds, F.col("cells")).alias("added"),
    )
    since = Window.partitionBy("document", "kind", "since").orderBy("page", "r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pieces", F.collect_list("added").over(since)).where("block > 0")
    block = ["document", "kind", "block"]
    whole = rows.groupBy(*block).agg(F.max_by("pieces", F.struct("page", "r")).alias("pieces"))
    out = rows.where("record").drop("pieces").join(whole, block)

    def more(i: int) -> Column:
        return F.array_compact(F.transform("pieces", lambda p: F.get(p, F.lit(i))))

    def extended(values: Column) -> Column:
        grown = F.transform(
            values,
            lambda v: F.struct(
                v["key"].alias("key"),
                F.concat_ws(" | ", v["text"], F.when(v["key"] == "duration", more(0)).when(v["key"] == "scheduled_start", more(1)).otherwise(F.array().cast("array<string>"))).alias("text"),
            ),
        )
        keys = F.transform(values, lambda v: v["key"])
        new = [
            F.when((F.size(more(i)) > 0) & ~F.array_contains(keys, key), F.struct(F.lit(key).alias("key"), F.concat_ws(" | ", more(i)).alias("text")))
            for i, key in enumerate(("duration", "scheduled_start"))
        ]
        return F.concat(grown, F.array_compact(F.array(*new)))

    taken = F.coalesce(F.col("base.explicit"), F.array().cast("array<struct<key:string,text:string>>"))
    values = F.when(F.col("kind") == "fee_summary", F.col("explicit")).when(F.col("kind") == "test_schedule", extended(taken)).otherwise(taken)
    name = F.when(F.col("kind") == "fee_summary", F.array_join(F.slice("rest", 1, F.size("rest") - 1), " ")).otherwise(T.fix_initials(_at(F.col("rest"), 0)))
    serial = F.regexp_extract(_at(F.col("cells"), 0), "^([0-9]+)", 1)
    return out.select(
        F.concat_ws(":", "document", "kind", "page", F.col("r") + 1, serial, T.slug(name, 60)).alias("record_id"),
        "document", "page", "printed",
        F.col("kind").alias("appendix_type"),
        serial.alias("serial_number"),
        name.alias("course_name"),
        "course_code",
        F.when(F.col("kind") == "test_schedule", F.coalesce("own", "category_before")).alias("category"),
        "programme_group", "faculty",
        F.transform(values, lambda v: F.struct(v["key"].alias("key"), v["text"].alias("text"), (~F.col("says")).alias("inherited"))).alias("values"),
    )
