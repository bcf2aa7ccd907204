"""Line-first cleaning.

Each line is judged by its own rules (punctuation, navigation, symbols,
shouting, boilerplate); failing lines are removed, and a document that loses
more than a set share of its words to them is rejected. Everything is a column
expression over one scan: no shuffle, no Python.

The phrases of the boilerplate rule are English; lines in other languages are
judged by the other rules.

Defined results: a null or empty text has no words and fails the base rule on
length. Blank lines are neither kept nor failed. Repeated rows get equal
results. A very long text is judged whole, in time near linear in it. An empty
table gives an empty result. Input columns may have any name; those that carry
the name of a result, the text apart, are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, inner_name, shielded, whole, words

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line of a page's frame. Fixed values.
BOILERPLATE = (
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "click here to",
    "lorem ipsum",
)

_FRAME = "(?i)" + "|".join(BOILERPLATE)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; shares are whole percents."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 50
    symbol_percent: int = 10
    nav_separators: int = 2
    nav_words_per_separator: int = 4
    shout_words: int = 4
    shout_percent: int = 70
    stub_words: int = 3
    boilerplate_chars: int = 160


def base_measures(df: DataFrame, text: str) -> DataFrame:
    """Add the base counts, the words and the lines, all named with a leading ``__``.

    Three-word windows are compared by a 64-bit hash of their words' hashes,
    within one document only. Intermediate arrays are columns of their own: an
    expression inside a lambda would be computed again for each element.
    """
    t = F.col("__t")
    df = df.withColumn("__t", whole(F.col(text)))
    df = df.withColumn("__w", words(t))
    df = df.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    h = F.col("__h")
    df = df.withColumn(
        "__win",
        F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
    )
    # only a text with equal windows needs their places; sorted, equal windows stand side by side
    some = F.size(F.array_distinct("__win")) < F.size("__win")
    df = df.withColumn("__pairs", F.when(some, F.sort_array(F.transform("__win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    pairs = F.col("__pairs")
    twice = F.filter(
        F.transform(pairs, lambda x, j: F.when((x["h"] == F.get(pairs, j - 1)["h"]) | (x["h"] == F.get(pairs, j + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return df.select(
        "*",
        F.size("__w").cast("long").alias("__n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("__word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("__n_symbols"),
        lines.alias("__lines"),
        F.when(pairs.isNull(), 0).otherwise(covered).cast("long").alias("__n_repeat"),
    ).withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))


def _traits() -> list[Column]:
    """Whether any line of ``__t`` can fail a rule at all; spares most texts the line's own tests."""
    return [
        (F.contains("__t", F.lit("|")) | F.contains("__t", F.lit("»")) | F.contains("__t", F.lit("›")) | F.contains("__t", F.lit("•"))).alias("__bars"),
        F.rlike("__t", F.lit("\\p{Lu}[^\\p{L}]*\\p{Lu}")).alias("__caps"),
    ]


def _count(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACE, -1), ""))


def _is_frame(line: Column, rules: LineRules) -> Column:
    return (F.length(line) <= rules.boilerplate_chars) & F.rlike(line, F.lit(_FRAME))


def _is_stub(line: Column, rules: LineRules) -> Column:
    return ~F.rlike(line, F.lit("[.!?:;]")) & ~F.rlike(line, F.lit("[…。！？]")) & (_count(line) <= rules.stub_words)


def line_verdict(line: Column, rules: LineRules) -> Column:
    """Name of the first rule that the line fails, or null."""
    chars = F.length(F.regexp_replace(line, SPACE, ""))
    n = _count(line)
    symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    bars = F.length(F.regexp_replace(line, "[^|»›•]+", ""))
    letters = F.length(F.regexp_replace(line, "[^\\p{L}]+", ""))
    upper = F.length(F.regexp_replace(line, "[^\\p{Lu}]+", ""))
    return (
        F.when(F.col("__bars") & (bars >= rules.nav_separators) & (n <= bars * rules.nav_words_per_separator), "navigation")
        .when((F.col("__n_symbols") > 0) & (symbols * 100 > chars * rules.symbol_percent), "symbols")
        .when(F.col("__caps") & (upper * 100 > letters * rules.shout_percent) & (n >= rules.shout_words), "shouting")
        .when(_is_frame(line, rules), "boilerplate")
        .when(_is_stub(line, rules), "punctuation")
    )


def clean_lines(df: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """All input columns, the base counts, the verdicts and ``clean_text``.

    ``clean_text`` holds the lines that passed, in order, with the blank lines
    between them gone; ``lost_words`` counts the words of the failed lines.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "n_lines", "n_failed_lines", "kept", "clean_text"]
    own_text = inner_name(df, text)
    df, back = shielded(df, [r for r in results if r != text])
    out = base_measures(df, own_text)
    out = out.select("*", *_traits())
    simple = lambda x: F.when(_is_frame(x, rules), "boilerplate").when(_is_stub(x, rules), "punctuation")
    # the flags also stand outside the lambda, which keeps the optimizer from moving their tests of the whole text into it
    plain = ~F.col("__bars") & ~F.col("__caps") & (F.col("__n_symbols") == 0)
    out = out.withColumn(
        "__judged",
        F.when(plain, F.transform("__lines", lambda x: F.struct(x.alias("line"), simple(x).alias("rule")))).otherwise(
            F.transform("__lines", lambda x: F.struct(x.alias("line"), line_verdict(x, rules).alias("rule")))
        ),
    )
    out = out.withColumn("__failed", F.filter("__judged", lambda x: x["rule"].isNotNull()))
    failed = F.col("__failed")
    out = out.withColumn("__lost", F.aggregate(failed, F.lit(0).cast("long"), lambda a, x: a + _count(x["line"])))
    base = (F.col("__n_words") < rules.min_words) | (F.col("__n_repeat") * 100 > F.col("__n_words") * rules.max_repeat_percent)
    return out.select(
        *back,
        F.col("__n_words").alias("n_words"),
        F.col("__word_chars").alias("word_chars"),
        F.col("__n_symbols").alias("n_symbols"),
        F.col("__n_dup_lines").alias("n_dup_lines"),
        F.col("__n_repeat").alias("n_repeat_words"),
        base.alias("base_failed"),
        F.col("__lost").alias("lost_words"),
        F.size("__judged").cast("long").alias("n_lines"),
        F.size(failed).cast("long").alias("n_failed_lines"),
        (~base & (F.col("__lost") * 100 <= F.col("__n_words") * rules.max_lost_percent)).alias("kept"),
        F.array_join(F.transform(F.filter("__judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )
