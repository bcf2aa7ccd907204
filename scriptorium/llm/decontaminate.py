"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ``window`` words (a shorter item is
one window), and each window into shingles of three words (a shorter window is
one shingle). Shingles are ordered by rarity, counted over all documents. A
document that contains a window holds all of its shingles, so under that order
the first alone is the necessary prefix: shingles of the documents meet the
windows on it. Length and position bounds (the window must fit around the
shingle) and the exact comparison of the words decide; windows with a shingle
that no document holds are dropped beforehand.

All expressions run inside one generated stage, where the words of a document
are referenced, not copied, for each exploded shingle. That holds while the
windows are broadcast, which they are if they are counted to be below
``broadcast_words`` words. Beyond that, numbered rows go to the shared folder;
only (row, position, shingle) are shuffled to meet the windows, and the
candidates left by the bounds fetch the words of their rows.

Defined results: every row of the documents gets a row, rows that share an id
each their own; a null id is an id like others; null or empty texts have no
words and no hits; a very long text is matched whole; items without words are
ignored, repeated items are one class with all their ids; an empty benchmark
gives no hits and empty documents an empty result; other columns of either
table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .text import NON_WORD, ascii_lower, whole

SHINGLE = 3
#: Stands for the end of a text, where one empty window meets it.
_END = -0x5C81B7D1


def match_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(whole(text)), NON_WORD, -1), "")


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with the class of their item, and the classes' item ids.

    Items of equal words form one class, so copies of an item are matched once.
    """
    by_words = (
        items.select(F.col("item_id").cast("string").alias("item_id"), match_words(F.col("text")).alias("ws"))
        .where(F.size("ws") > 0)
        .groupBy("ws")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        .withColumn("cls", F.sha2(F.array_join("ws", " "), 256))
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    windows = by_words.select("cls", "ws", F.explode(starts).alias("s")).select("cls", F.slice("ws", F.col("s") + 1, window).alias("win")).distinct()
    return windows, by_words.select("cls", "item_ids")


def _key(words: str, at: Column, size: int) -> Column:
    """Hash of ``size`` words from a place on; fewer at the end of the words."""
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(size)])


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, cls, win, o, size, key): the shingles of each window with their places."""
    size = F.least(F.size("win"), F.lit(SHINGLE))
    placed = windows.select(F.sha2(F.concat_ws(" ", F.col("cls"), F.array_join("win", " ")), 256).alias("wid"), "cls", "win", size.alias("size"))
    at = placed.select("*", F.explode(F.sequence(F.lit(0), F.size("win") - F.col("size"))).alias("o"))
    keys = F.lit(None).cast("long")
    for n in range(1, SHINGLE + 1):
        keys = F.when(F.col("size") == n, _key("win", F.col("o"), n)).otherwise(keys)
    return at.select("wid", "cls", "win", "o", "size", keys.alias("key"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_words: int = 2_000_000) -> DataFrame:
    """One row for each occurrence (row, doc_id, n_words, start, length, cls), and one with null cls for each document.

    ``row`` numbers the rows of ``docs``.
    """
    windows, _ = item_windows(items, window)
    shingled = materialise(_window_shingles(windows))
    n_words, sizes = shingled.agg(F.sum(F.when(F.col("o") == 0, F.size("win"))), F.array_sort(F.collect_set("size"))).first()
    fits_broadcast = (n_words or 0) <= broadcast_words
    small = F.broadcast if fits_broadcast else (lambda df: df)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text"))
    if not fits_broadcast:
        rows = materialise(rows)
    words = rows.select("row", "doc_id", match_words(F.col("text")).alias("__w"))
    at = words.select("row", "doc_id", "__w", F.posexplode(F.array_append("__w", F.lit(""))).alias("pos", "word"))
    # one key for each size of shingle that the windows have; mostly that is one
    keys = [_key("__w", F.col("pos"), n) for n in sizes or [SHINGLE]]
    inside = F.when(F.col("pos") < F.size("__w"), keys[0]).otherwise(F.lit(_END)) if len(keys) == 1 else None

    def keyed(columns: list) -> DataFrame:
        if inside is not None:
            return at.select(*columns, inside.alias("key"))
        every = F.when(F.col("pos") < F.size("__w"), F.array_distinct(F.array(*keys))).otherwise(F.array(F.lit(_END).cast("long")))
        return at.select(*columns, F.explode(every).alias("key"))

    vocabulary = shingled.select("key").distinct()
    counts = keyed([]).join(small(vocabulary), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # the inner join drops shingles that no document holds; a window that lost one can't occur
    anchors = (
        shingled.join(counts, "key")
        .groupBy("wid")
        .agg(
            F.min(F.struct("n", "key", "o")).alias("a"),
            F.any_value("cls").alias("cls"),
            F.any_value("win").alias("win"),
            F.any_value("size").alias("size"),
            F.count(F.lit(1)).alias("found"),
        )
        .where(F.col("found") == F.size("win") - F.col("size") + 1)
        .select(F.col("a.key").alias("anchor"), F.col("a.o").alias("o"), "wid", "cls", "win", F.size("win").alias("len"))
    )
    anchors = materialise(anchors)
    mark = docs.sparkSession.range(1).select(
        F.lit(_END).cast("long").alias("anchor"), F.lit(0).alias("o"), F.lit("").alias("wid"), F.lit(None).cast("string").alias("cls"), F.array().cast("array<string>").alias("win"), F.lit(0).alias("len")
    )
    start = F.col("pos") - F.col("o")
    fits = (F.col("key") == F.col("anchor")) & (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = F.slice("__w", start + 1, F.col("len")) == F.col("win")
    out = ["row", "doc_id", F.col("n").cast("long").alias("n_words"), start.alias("start"), F.col("len").alias("length"), "cls"]
    if fits_broadcast:
        return keyed(["row", "doc_id", "__w", "pos", F.size("__w").alias("n")]).join(small(anchors.unionByName(mark)), fits & same).select(*out)
    narrow = keyed(["row", "pos", F.size("__w").alias("n")])
    candidates = narrow.join(anchors.select("anchor", "o", "len", "wid"), fits).select("row", "pos", "o", "wid")
    named = candidates.join(anchors.select("wid", "win", "cls", "len"), "wid")
    found = named.join(words.withColumn("n", F.size("__w")), "row").where(same).select(*out)
    ends = words.select("row", "doc_id", F.size("__w").cast("long").alias("n_words"), F.size("__w").alias("start"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("cls"))
    return found.union(ends)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_words: int = 2_000_000) -> DataFrame:
    """For each row: ``doc_id``, ``n_words``, ``n_hit``, ``spans``, ``items``, ``n_items``, ``items_sha256``, ``contaminated``."""
    _, classes = item_windows(items, window)
    found = occurrences(docs, items, window, broadcast_words)
    span = F.when(F.col("cls").isNotNull(), F.struct(F.col("start").alias("start"), (F.col("start") + F.col("length")).alias("end")))
    per_row = materialise(
        found.groupBy("row", "doc_id").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set(span)).alias("spans"),
            F.collect_set("cls").alias("classes"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["start"]), F.lit(0))).alias("n"),
            F.greatest(a["to"], x["end"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    hit = per_row.select("row", "doc_id", "n_words", "spans", covered.cast("long").alias("n_hit"), "classes")
    named = (
        hit.where(F.size("classes") > 0)
        .select("row", F.explode("classes").alias("cls"))
        .join(classes, "cls")
        .groupBy("row")
        .agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("items"))
    )
    # two parts instead of a join of every row with its items
    clean = hit.where(F.size("classes") == 0).withColumn("items", F.array().cast("array<string>")).drop("classes")
    dirty = hit.where(F.size("classes") > 0).drop("classes").join(named, "row")
    return clean.unionByName(dirty).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
        "items",
    )
