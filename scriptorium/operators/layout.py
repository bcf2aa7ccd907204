"""Operators on positioned lines and tables of pages.

Ordered state (the last heading, a merged cell's value, the current card) is
carried by windows over a document's pages and lines; only the greedy anchors
of line grouping and word packing, whose resets depend on their own output,
are folds over the ordered array of one page or section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T


def carried(value: Column, by: WindowSpec) -> Column:
    """The value, or the last one before it that is not null."""
    return F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def before(value: Column, by: WindowSpec) -> Column:
    """The last value that is not null, strictly before the row."""
    return F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))


def group_lines(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines (page, line, text, x0, top, x1, bottom) of positioned words (page, text, x0, top, x1, bottom).

    Words are taken by (rounded top, x0); a line goes on while a word's top
    lies within the tolerance of the top of the line's first word.
    """
    row = F.struct(F.round("top", 1).alias("r"), "x0", "top", "x1", "bottom", "text")
    pages = words.groupBy("page").agg(F.array_sort(F.collect_list(row)).alias("ws"))
    start = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("out"))

    def step(a, w):
        new = a["anchor"].isNull() | (F.abs(w["top"] - a["anchor"]) > tolerance)
        n = F.when(new, a["n"] + 1).otherwise(a["n"])
        return F.struct(n.alias("n"), F.when(new, w["top"]).otherwise(a["anchor"]).alias("anchor"), F.concat(a["out"], F.array(n)).alias("out"))

    lines = pages.withColumn("line", F.aggregate("ws", start, step, lambda a: a["out"]))
    each = lines.select("page", F.explode(F.arrays_zip("ws", "line")).alias("z")).select("page", "z.line", "z.ws")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ws.x0", "ws.text"))), lambda x: x["text"]), " ")
    return each.groupBy("page", "line").agg(text.alias("text"), *box_union("ws"))


def box_union(box: str) -> list[Column]:
    return [F.min(f"{box}.x0").alias("x0"), F.min(f"{box}.top").alias("top"), F.max(f"{box}.x1").alias("x1"), F.max(f"{box}.bottom").alias("bottom")]


def clean_cell(cell: Column) -> Column:
    return F.nullif(T.clean(cell), F.lit(""))


def page_label(lines: Column) -> Column:
    """The printed label among a page's last twelve lines, searched from the bottom; parentheses go."""
    tail = F.slice(F.reverse(lines), 1, 12)
    hit = F.get(F.filter(tail, lambda x: F.rlike(F.trim(x), F.lit("^(?:[A-Z]\\.[0-9]+|[0-9]+|\\([ivxlcdm]+\\))$"))), F.lit(0))
    return F.translate(F.trim(hit), "()", "")


def is_heading(text: Column, size: Column) -> Column:
    letters = F.rlike(text, F.lit("\\p{L}")) & ~F.rlike(text, F.lit("\\p{Ll}"))
    shape = (size >= 13) | (letters & (F.length(text) >= 5)) | (F.endswith(text, F.lit(":")) & (F.length(text) <= 90) & ~F.rlike(text, F.lit("(?i)https?:|www\\.")))
    return (F.length(text) <= 140) & ~F.rlike(text, F.lit("^\\s*(?:[•▪*-]|[0-9]+[.)])\\s")) & shape


def pack_lines(lines: Column, limit: int = 300) -> Column:
    """Runs of lines of at most ``limit`` words each; a longer line stands alone."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<array<string>>").alias("out"))

    def step(a, line):
        n = F.size(F.array_remove(F.split(line, "[\\x20\\x09-\\x0D]+", -1), ""))
        fits = (F.size(a["out"]) > 0) & (a["n"] + n <= limit)
        last = F.element_at(a["out"], -1)
        joined = F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.concat(last, F.array(line))))
        return F.struct(
            F.when(fits, a["n"] + n).otherwise(n).cast("int").alias("n"),
            F.when(fits, joined).otherwise(F.concat(a["out"], F.array(F.array(line)))).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda a: F.transform(a["out"], lambda x: F.array_join(x, "\n")))


def nearest_header(x: Column, headers: Column) -> Column:
    """The header whose position is nearest; the first of equally near ones."""
    return F.array_min(F.transform(headers, lambda h, i: F.struct(F.abs(h["x"] - x).alias("d"), i.alias("i"), h["name"].alias("name"))))["name"]


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the smaller token set that both hold."""
    x, y = F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))
