"""Course cards from positioned lines and tables of pages.

Inputs, one row each:

    lines    document, page, printed, width, height, n (place on the page), text, x0, top, x1, bottom, size
    tables   document, page, printed, n, top, rows (array of arrays of cells)

A card begins at its title line and ends at the next one or the page's end.
Lines fall into cards by an ordered window, labels are carried along a card's
lines, and what stands at the head of a following page goes on with the last
card. All windows are partitioned by document, most by page or card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import layout as L

PAGE = ["document", "page"]
CARD = ["document", "page", "card"]
# Field, shown label (none: not a field of its own), pattern, pattern of a label's second part.
LABELS = (
    ("course_of_study", None, "(?i)^Course of Study\\b\\s*:?", None),
    ("course_details", None, "(?i)^Course Details\\b\\s*:?", None),
    ("qualifying_examination", "Qualifying Examination", "(?i)^Qualifying(?:\\s+Examination)?\\b\\s*:?", "(?i)^Examination\\b\\s*:?"),
    ("age_limit", "Age Limit", "(?i)^Age Limit\\b\\s*:?", None),
    ("selection_process", "Selection Process", "(?i)^Selection(?:\\s+Process)?\\b\\s*:?", "(?i)^Process\\b\\s*:?"),
    ("test_paper_details", "Test Paper Details", "(?i)^(?:Test Paper(?:\\s+Details)?|Test Details)\\b\\s*:?", "(?i)^Details\\b\\s*:?"),
    ("test_centres", "Test Centre(s)", "(?i)^Test Centre(?:\\(s\\)|s)?\\s*:?", None),
    ("additional_information", "Additional Information", "(?i)^Additional(?:\\s+Information)?\\b\\s*:?", "(?i)^Information\\b\\s*:?"),
    ("specialization", "Specialization", "(?i)^Specialization\\b\\s*:?", None),
    ("remarks", "Remarks", "(?i)^Remarks\\b\\s*:?", None),
)
# Header text, key.
HEADERS = (
    ("duration", "duration"),
    ("specialization", "specialization"),
    ("course code", "course_code"),
    ("code", "course_code"),
    ("intake", "intake"),
    ("study location", "study_location"),
    ("branch name", "branch_name"),
    ("major subject", "major_subject"),
    ("discipline /department", "discipline"),
    ("discipline/department", "discipline"),
    ("faculty", "faculty"),
    ("male", "intake_male"),
    ("males", "intake_male"),
    ("female", "intake_female"),
    ("females", "intake_female"),
    ("general", "intake_general"),
    ("pwbd", "intake_pwbd"),
)
# Keys whose merged cells go on below, and keys of which a row needs one.
FILLED = ("duration", "intake", "intake_male", "intake_female", "intake_general", "intake_pwbd", "faculty")
TELLING = ("course_code", "specialization", "study_location", "branch_name", "major_subject", "discipline", "duration", "intake", "intake_male")
# Programme level by the first letter of the printed page.
LEVELS = {"A": "undergraduate", "B": "postgraduate", "C": "research", "D": "diploma", "E": "school", "F": "bridge", "G": "diploma", "H": "other", "I": "certificate"}
UNRESOLVED = "Faculty not resolved"


def strip(c: Column, chars: str = " :") -> Column:
    return F.btrim(c, F.lit(chars))


def is_faculty(text: Column) -> Column:
    return F.startswith(F.lower(F.trim(text)), F.lit("faculty of "))


def is_noise(text: Column, headers: tuple[str, ...] = ()) -> Column:
    """Running headers, faculty and group lines, printed page labels."""
    t = F.lower(F.trim(text))
    named = t.isin(*headers) if headers else F.lit(False)
    return named | is_faculty(text) | F.endswith(t, F.lit(" programmes")) | F.rlike(t, F.lit("^[a-k]\\.[0-9]+$"))


def label_of(text: Column) -> Column:
    """The field whose label begins the line, or null."""
    return F.coalesce(*[F.when(F.rlike(F.trim(text), F.lit(p)), F.lit(name)) for name, _, p, _ in LABELS])


def _without(text: Column, label: Column, which: int) -> Column:
    """The text behind its label (2) or its label's second part (3)."""
    out = text
    for x in LABELS:
        if x[which]:
            out = F.when(label == x[0], strip(F.regexp_replace(F.trim(text), x[which], ""))).otherwise(out)
    return out


def titles(lines: DataFrame) -> DataFrame:
    """Title lines with the name that they, a neighbour behind a colon or a scheme line give."""
    around = Window.partitionBy(*PAGE).orderBy("n").rowsBetween(-3, 3)
    seen = lines.withColumn("near", F.collect_list(F.struct("n", "top", "text")).over(around))
    seen = seen.where(F.rlike(F.trim("text"), F.lit(LABELS[0][2])))
    beside = F.get(F.filter("near", lambda x: (F.abs(x["top"] - F.col("top")) <= 20) & F.startswith(F.trim(x["text"]), F.lit(":"))), F.lit(0))["text"]
    own = F.nullif(_without(F.col("text"), F.lit("course_of_study"), 2), F.lit(""))
    name = F.coalesce(own, F.nullif(F.trim(F.ltrim(F.trim(beside), F.lit(":"))), F.lit("")))
    scheme = F.trim(F.get(F.filter("near", lambda x: (x["n"] > F.col("n")) & (F.abs(x["top"] - F.col("top")) <= 22) & F.contains(x["text"], F.lit("Self Financing Scheme"))), F.lit(0))["text"])
    whole = F.when(scheme.isNotNull() & ~F.contains(name, scheme), F.concat_ws(" ", name, scheme)).otherwise(name)
    return seen.select(*PAGE, "printed", "width", "height", "n", "top", F.nullif(T.clean(whole), F.lit("")).alias("name")).where("name is not null")


def table_titles(tables: DataFrame) -> DataFrame:
    """(document, page, top, name) of the cells that follow a title cell."""
    flat = tables.select(*PAGE, "n", "top", F.filter(F.flatten("rows"), lambda x: x != "").alias("cells"))
    at = flat.select("*", F.posexplode("cells").alias("i", "cell")).where(F.lower(F.trim("cell")) == "course of study")
    after = F.transform(F.slice("cells", F.col("i") + 2, F.size("cells")), lambda x: strip(x))
    name = F.get(F.filter(after, lambda x: (x != "") & (F.lower(x) != "course details")), F.lit(0))
    return at.select(*PAGE, F.col("n").alias("t"), "i", F.col("top").alias("at"), T.clean(name).alias("better")).where("better is not null")


def anchors(lines: DataFrame, tables: DataFrame, band: float = 80, overlap: float = 0.6) -> DataFrame:
    """Cards (document, page, card, top, below, name, ...); a longer name in a table near by that shares its words wins."""
    found = titles(lines)
    named = found.join(table_titles(tables), PAGE, "left")
    near = (F.abs(F.col("at") - F.col("top")) <= band) & (L.token_overlap(F.col("name"), F.col("better")) >= overlap)
    best = F.min(F.when(near, F.struct(F.abs(F.col("at") - F.col("top")).alias("d"), "t", "i", "better")))["better"]
    picked = named.groupBy(*PAGE, "printed", "width", "height", "n", "top", "name").agg(best.alias("better"))
    by = Window.partitionBy(*PAGE).orderBy("top", "n")
    return picked.select(
        *PAGE, "printed", "width", "height", "n", "top",
        (F.row_number().over(by) - 1).alias("card"),
        F.coalesce(F.lead("top").over(by), F.col("height")).alias("below"),
        F.when(F.length("better") > F.length("name"), F.col("better")).otherwise(F.col("name")).alias("name"),
    )


def in_cards(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows with a top, each with the card whose span holds it; rows above the first card go."""
    keyed = rows.withColumn("__row", F.struct(*rows.columns))
    both = cards.select(*PAGE, "top", F.lit(0).alias("o"), "card", F.lit(None).cast(keyed.schema["__row"].dataType).alias("__row"))
    both = both.unionByName(keyed.select(*PAGE, "top", F.lit(1).alias("o"), F.lit(None).cast("int").alias("card"), "__row"))
    card = L.carried(F.col("card"), Window.partitionBy(*PAGE).orderBy("top", "o", F.col("card").asc_nulls_last()))
    return both.withColumn("card", card).where("o = 1 and card is not null").select("card", "__row.*")


def tables_of(tables: DataFrame) -> DataFrame:
    """Tables with known headers: (document, page, n, top, headers, rows of (key, text, inherited))."""
    known = F.create_map(*[F.lit(x) for kv in HEADERS for x in kv])
    key = [*PAGE, "n"]
    cells = tables.select(*key, "top", F.posexplode("rows").alias("r", "row")).select(*key, "top", "r", F.posexplode("row").alias("c", "cell")).where("cell <> ''")
    heads = cells.where("r < 3").select(*key, "r", "c", F.try_element_at(known, F.lower(T.clean(F.col("cell")))).alias("key")).where("key is not null")
    heads = heads.groupBy(*key, "key").agg(F.max(F.struct("r", "c")).alias("last"), F.min(F.struct("r", "c")).alias("first"))
    all_heads = Window.partitionBy(*key)
    sexes = F.bool_or(F.col("key").isin("intake_male", "intake_female")).over(all_heads)
    heads = heads.select(*key, "key", F.col("last.c").alias("pos"), "first", F.max("last.r").over(all_heads).alias("end"), F.count(F.lit(1)).over(all_heads).alias("m"), sexes.alias("sexes"))
    heads = heads.where((F.col("m") >= 2) & ~((F.col("key") == "intake") & F.col("sexes")))
    whole = heads.groupBy(*key, "end").agg(F.array_sort(F.collect_list(F.struct("first", "pos", "key"))).alias("heads"))

    body = cells.join(whole, key).where(F.col("r") > F.col("end"))
    nearest = F.array_min(F.transform("heads", lambda h, i: F.struct(F.abs(h["pos"] - F.col("c")).alias("d"), i.alias("i"), h["key"].alias("key"))))["key"]
    text = T.clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda x: x["cell"]), " "))
    values = body.withColumn("key", nearest).groupBy(*key, "r", "key").agg(F.nullif(text, F.lit("")).alias("text")).where("text is not null")
    grid = values.select(*key, "r").distinct().join(heads.select(*key, "key", "pos"), key).join(values, [*key, "r", "key"], "left")
    above = L.carried(F.col("text"), Window.partitionBy(*key, "key").orderBy("r"))
    filled = grid.withColumn("inherited", F.col("text").isNull() & F.col("key").isin(*FILLED) & above.isNotNull())
    filled = filled.withColumn("text", F.when(F.col("key").isin(*FILLED), above).otherwise(F.col("text"))).where("text is not null")
    rows = filled.groupBy(*key, "r").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "text", "inherited"))).alias("cells"))
    rows = rows.where(F.exists("cells", lambda x: x["key"].isin(*TELLING)))
    plain = F.transform("cells", lambda x: F.struct(x["key"].alias("key"), x["text"].alias("text"), x["inherited"].alias("inherited")))
    made = rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", plain.alias("cells")))), lambda x: x["cells"]).alias("rows"))
    order = F.transform(F.array_sort(F.transform("heads", lambda h: F.struct(h["pos"].alias("p"), h["key"].alias("k")))), lambda h: h["k"])
    return made.join(whole.select(*key, order.alias("headers")), key).join(tables.select(*key, "top"), key).select(*key, "top", "headers", "rows")


def fragments(lines: DataFrame, cards: DataFrame, headers: tuple[str, ...] = ()) -> DataFrame:
    """Lines at the head of a page that go on with the last card before it; ``cards`` have n_fields."""
    pages = lines.select(*PAGE, "height").distinct()
    pages = pages.withColumn("follows", F.lag("page").over(Window.partitionBy("document").orderBy("page")) == F.col("page") - 1)
    t = F.trim("text")
    ends = F.rlike(t, F.lit(LABELS[0][2])) | F.rlike(t, F.lit(LABELS[1][2])) | F.endswith(F.upper(t), F.lit("PROGRAMMES")) | (F.col("size") >= 13)
    text = lines.where(~is_noise(F.col("text"), headers))
    end = F.coalesce(F.min(F.when(ends, F.col("top"))).over(Window.partitionBy(*PAGE)), F.col("height"))
    head = text.withColumn("end", end).where("top < end")
    first = F.min(F.struct("top", "n", "x0", "size"))
    shape = head.groupBy(*PAGE, "width").agg(first.alias("f"), F.bool_or(F.coalesce(_is_field(label_of(F.col("text"))), F.lit(False))).alias("labelled"))
    plain = (F.col("f.top") <= 90) & (F.col("f.x0") >= F.col("width") * 0.15) & (F.coalesce(F.col("f.size"), F.lit(0.0)) <= 11)
    shape = shape.select(*PAGE, "labelled", plain.alias("plain"))

    both = pages.where("follows").select(*PAGE, F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(None).cast("struct<page:int,card:int,n_fields:bigint>").alias("to"))
    both = both.union(cards.select(*PAGE, F.lit(1), F.col("card"), F.struct(F.col("page").cast("int").alias("page"), F.col("card").cast("int").alias("card"), F.col("n_fields").cast("long").alias("n_fields"))))
    last = L.before(F.col("to"), Window.partitionBy("document").orderBy("page", "o", "i"))
    target = both.withColumn("last", last).where("o = 0 and last is not null").select(*PAGE, "last")
    goes_on = target.join(shape, PAGE).where("labelled or (plain and last.n_fields > 0)")
    return head.join(goes_on.select(*PAGE, "last"), PAGE).select(
        "document", F.col("last.page").alias("of_page"), F.col("last.card").alias("card"), *[c for c in lines.columns if c != "document"]
    )


def _is_field(label: Column) -> Column:
    return label.isin(*[name for name, shown, _, _ in LABELS if shown])


def fields_of(rows: DataFrame) -> DataFrame:
    """(document, of_page, card, name, label, value, page, box) from the lines of cards, in the order of labels.

    A line without a label belongs to the last label on its page; on a further
    page it goes on with the field that was begun last.
    """
    card = ["document", "of_page", "card"]
    order = Window.partitionBy(*card).orderBy("page", "n")
    hit = rows.withColumn("hit", label_of(F.col("text")))
    begun = F.when(F.col("hit").isNotNull() & (F.row_number().over(Window.partitionBy(*card, "hit").orderBy("page", "n")) == 1), F.col("hit"))
    hit = hit.withColumn("begun", begun)
    here = L.carried(F.col("hit"), Window.partitionBy(*card, "page").orderBy("n"))
    hit = hit.withColumn("name", F.coalesce(here, L.before(F.col("begun"), order))).where("name is not null")
    second = (F.col("x0") <= F.col("width") * 0.12) & F.col("name").isin(*[x[0] for x in LABELS if x[3]])
    piece = F.when(F.col("hit").isNotNull(), _without(F.col("text"), F.col("hit"), 2)).otherwise(F.when(second, _without(F.col("text"), F.col("name"), 3)).otherwise(F.col("text")))
    hit = hit.withColumn("piece", F.nullif(piece, F.lit(""))).withColumn("box", F.struct("x0", "top", "x1", "bottom"))
    some = F.when(F.col("piece").isNotNull(), F.col("box"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("page", "n", "piece")))), lambda x: x["piece"]), " ")
    found = hit.withColumn("some", some).groupBy(*card, "name").agg(
        T.clean(joined).alias("value"),
        F.min(F.struct("page", "n")).alias("at"),
        F.min("page").alias("page"),
        F.min_by("printed", "page").alias("printed"),
        F.max("page").alias("to_page"),
        F.struct(*L.box_union("some")).alias("box"),
    )
    shown = F.coalesce(*[F.when(F.col("name") == name, F.lit(label)) for name, label, _, _ in LABELS if label])
    found = found.withColumn("label", shown).where("label is not null and value <> ''")
    return found.withColumn("box", F.when(F.col("page") == F.col("to_page"), F.col("box"))).drop("to_page")


def courses(lines: DataFrame, tables: DataFrame, initial_faculty: str | None = None, headers: tuple[str, ...] = ()) -> DataFrame:
    """Course records with their fields and tables, one row for each card that has any."""
    cards = anchors(lines, tables)
    own = in_cards(lines.where(~is_noise(F.col("text"), headers)), cards).withColumn("of_page", F.col("page"))
    card = ["document", "of_page", "card"]
    placed = in_cards(tables_of(tables), cards).withColumnRenamed("page", "of_page")
    entry = F.struct("n", "headers", "rows")
    placed = placed.groupBy(*card).agg(F.array_sort(F.collect_list(entry)).alias("tables"))
    counted = fields_of(own).groupBy(*card).agg(F.count(F.lit(1)).alias("n_fields"))
    valid = cards.withColumnRenamed("page", "of_page").join(counted, card, "left").join(placed, card, "left")
    valid = valid.fillna(0, ["n_fields"]).where("n_fields > 0 or tables is not null")

    more = fragments(lines, valid.withColumnRenamed("of_page", "page"), headers)
    fields = fields_of(own.select(*more.columns).unionByName(more))
    entry = F.struct("at", "name", "label", "value", "page", "box")
    plain = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(*[x[c].alias(c) for c in ("name", "label", "value", "page", "box")]))
    fields = fields.groupBy(*card).agg(plain.alias("fields"))

    out = valid.join(fields, card, "left").withColumnRenamed("of_page", "page").join(faculties(lines, cards, initial_faculty), CARD)
    codes = F.array_distinct(F.transform(F.filter(F.flatten(F.flatten(F.transform("tables", lambda t: t["rows"]))), lambda x: x["key"] == "course_code"), lambda x: x["text"]))
    level = F.coalesce(*[F.when(F.upper(F.substring("printed", 1, 1)) == k, F.lit(v)) for k, v in LEVELS.items()], F.lit("other"))
    slug = T.slug(F.col("name"), 72)
    return out.select(
        F.concat_ws(":", "document", "page", F.col("card") + 1, slug).alias("record_id"),
        "document",
        F.col("name").alias("course_name"),
        F.when(F.size(codes) == 1, codes[0]).alias("course_code"),
        level.alias("program_level"),
        "faculty",
        "page",
        "printed",
        F.coalesce("fields", F.array().cast(out.schema["fields"].dataType)).alias("fields"),
        F.coalesce("tables", F.array().cast(out.schema["tables"].dataType)).alias("tables"),
    )


def faculties(lines: DataFrame, cards: DataFrame, initial: str | None = None) -> DataFrame:
    """The faculty line strictly above each card on its page, or the last one of the pages before."""
    named = lines.where(is_faculty(F.col("text"))).select(*PAGE, "n", "top", F.trim("text").alias("faculty"))
    both = cards.select(*PAGE, "top", F.lit(0).alias("o"), "card", F.lit(None).cast("string").alias("faculty"))
    both = both.union(named.select(*PAGE, "top", F.lit(1), F.lit(None).cast("int"), "faculty"))
    # at equal tops cards come first, so a faculty line counts for what is below it
    above = L.carried(F.col("faculty"), Window.partitionBy(*PAGE).orderBy("top", "o"))
    last = named.groupBy(*PAGE).agg(F.max_by("faculty", "n").alias("last"))
    pages = lines.select(*PAGE).distinct().join(last, PAGE, "left")
    pages = pages.select(*PAGE, L.before(F.col("last"), Window.partitionBy("document").orderBy("page")).alias("earlier"))
    here = both.withColumn("above", above).where("o = 0").select(*CARD, "above").join(pages, PAGE)
    return here.select(*CARD, F.coalesce("above", "earlier", F.lit(initial or UNRESOLVED)).alias("faculty"))
