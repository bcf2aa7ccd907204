"""Column expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: U+0020 and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: What separates words in benchmark matching: ASCII that is neither digit nor letter.
NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs without white space, in order."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z alone.

    ``lower`` gives the same result, far faster, unless the text holds a
    non-ASCII character with a lower-case form.
    """
    plain = F.octet_length(text) == F.length(text)
    cased = F.rlike(text, F.lit("[\\p{javaUpperCase}\\p{javaTitleCase}&&[^\\x00-\\x7F]]"))
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(plain | ~cased, F.lower(text)).otherwise(slow)


def drop_clashes(df, names):
    """Remove input columns that carry the names of results; results win."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shielded(df, names):
    """``df`` under neutral names, and the columns that give its own names back.

    Columns that carry the names of results are gone from the second. An
    operator that works on the first can name its own columns as it likes.
    """
    taken = {n.lower() for n in names}
    inner = [f"in{i}" for i in range(len(df.columns))]
    back = [F.col(i).alias(c) for i, c in zip(inner, df.columns, strict=True) if c.lower() not in taken]
    return df.toDF(*inner), back


def inner_name(df, column: str) -> str:
    """The neutral name that ``shielded`` gives a column; an exact match goes before another case."""
    exact = [i for i, c in enumerate(df.columns) if c == column]
    return f"in{(exact or [i for i, c in enumerate(df.columns) if c.lower() == column.lower()])[0]}"
