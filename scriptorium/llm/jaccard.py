"""N-gram Jaccard join by filtering under several global token orders.

Two texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or
more share a token among the first n - ceil(0.8 n) + 1 of each, whatever the
order of tokens, as long as it is the same for all. The first order puts rare
tokens first, by counts over all documents in a table of fixed size; the other
two are random and independent. Candidates come from the first order: the
smaller set of a pair needs only its first n - ceil(1.6 n / 1.8) + 1 tokens
there, the larger one its whole prefix, and lengths and positions must fit.
Then the prefixes under each of the three orders must share so many tokens that
the overlap can still be reached. Only pairs that pass all of these filters have
their sets fetched and compared.

What is asked for is connection, so groups of copies never form all their
pairs. Equal sets are one class by digest, with one posting for each token. Of
the classes that share a token, each is compared with the first; links join
components; then only pairs that share a token and still lie in different
components are compared. A pair left out lies within one component, so the
components are those of all links. Python sees one batch of texts at a time;
joins, counts and comparisons are Spark's, which spill and split hot tokens.
Joins of tables that grow with the input are sort-merge joins at every size.

Defined results: an empty table gives an empty result; a very long text is hashed
by itself and compared as one array; other columns of the input are ignored,
whatever their names; a text with fewer than five words has its whole sequence as
one shingle; a null or empty text has none and is linked with nothing; rows
that share an id are one node with the links of each; a null id is a node whose
component is null unless another text is smaller (null sorts first).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .components import components
from .marks import bits_for, marked, marks
from .storage import discard, materialise

_NULL_ID = -(1 << 63)
_CHUNK_WORDS = 300_000
_SLICES = 1024
ORDERS = ("first", "second", "third")
K2, K3 = wh.U(0x8CB92BA72F3D8DD7), wh.U(0x2545F4914F6CDD1D)


def shingle_sets(ids: np.ndarray, texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks (ids, text, shingle): distinct shingle hashes of each text, sorted by text and hash."""
    held, size = [], 0

    def sets(first: int, end: int, data: np.ndarray, offsets: np.ndarray):
        data = wh.lower(data)
        starts, ends, fw = wh.words_in(data, offsets)
        h = wh.word_hashes(data, starts, ends)
        n = np.diff(fw)
        count = np.maximum(n - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), count)
        at = fw[:-1][doc] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        docs, hashes = [doc], [wh.window_hashes(h, k)[at]]
        for short in range(1, k):
            few = np.flatnonzero(n == short)
            if len(few):
                docs.append(few)
                hashes.append(wh.mix(wh.window_hashes(h, short)[fw[few]] + wh.U(short)))
        doc, g = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((g, doc))
        doc, g = doc[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
        return ids[first:end], doc[new], g[new]

    def joined():
        base = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
        return np.concatenate([x[0] for x in held]), np.concatenate([x[1] + b for x, b in zip(held, base, strict=True)]), np.concatenate([x[2] for x in held])

    for first, end, data, offsets in wh.text_blocks(texts):
        held.append(sets(first, end, data, offsets))
        size += len(held[-1][2])
        if size >= _CHUNK_WORDS:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 for each text; texts stand in order."""
    total = np.concatenate([[wh.U(0)], np.cumsum(values, dtype=np.uint64)])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _digests(doc: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.bincount(doc, minlength=n), _sums(doc, wh.mix(g ^ K2), n), _sums(doc, wh.mix(g ^ K3), n)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any partner: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def _prefix(doc: np.ndarray, key: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the prefix tokens under an order, and their ranks from 1."""
    order = np.lexsort((key, doc))
    start = np.cumsum(n) - n
    rank = np.arange(len(doc)) - start[doc[order]]
    short = rank < (n - _needed(n, percent) + 1)[doc[order]]
    return order[short], rank[short] + 1


def _counted(k: int, bits: int):
    """First pass: a row for each text (n, digests), then this task's counts of shingles by slice of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for ids, doc, g in shingle_sets(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1), k):
                np.add.at(counts, (g >> wh.U(64 - bits)).astype(np.int64), 1)
                n, a, b = _digests(doc, g, len(ids))
                yield _survey_rows(ids, n, a.view(np.int64), b.view(np.int64), None)
        part = np.minimum(counts, 65535).astype("<u2").reshape(_SLICES, -1)
        used = np.flatnonzero(part.any(axis=1))
        zero = np.zeros(len(used), np.int64)
        yield _survey_rows(used, zero - 1 - TaskContext.get().partitionId() % _SLICES, zero, zero, [part[i].tobytes() for i in used])

    return wh.lean(run)


def _survey_rows(ids, n, a, b, counts) -> pa.RecordBatch:
    cols = [pa.array(x, pa.int64()) for x in (ids, n, a, b)]
    return pa.record_batch([*cols, pa.array(counts or [None] * len(ids), pa.binary())], ["id", "n", "a", "b", "counts"])


def _add_counts(dtype: str):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), dtype).astype(np.uint64) for x in table.column("counts"))
        return pa.table({"id": table.column("id")[:1], "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())})

    return run


def _levels(survey: DataFrame, bits: int) -> np.ndarray:
    """How common the shingles of each slot are, on a logarithmic scale; 2^bits bytes, whatever the input.

    Tasks' counts are added in two steps, so a group never holds those of all tasks.
    """
    some = survey.where("n < 0").select("id", "n", "counts").groupBy("id", "n").applyInArrow(_add_counts("<u2"), "id long, counts binary")
    found = some.groupBy("id").applyInArrow(_add_counts("<u4"), "id long, counts binary").toArrow()
    table = np.zeros((_SLICES, (1 << bits) // _SLICES), np.uint8)
    for i, x in zip(found.column("id").to_pylist(), found.column("counts"), strict=True):
        table[i] = np.floor(4 * np.log2(1.0 + np.frombuffer(x.as_buffer(), "<u4")))
    return table.ravel()


def _order_keys(g: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort keys under the three orders: rare first, and two by chance."""
    bits = len(levels).bit_length() - 1
    level = levels[(g >> wh.U(64 - bits)).astype(np.int64)].astype(np.uint64) << wh.U(56)
    return level | (wh.mix(g + K2) >> wh.U(8)), wh.mix(g + K3), wh.mix(g ^ (K2 + K3))


def _postings(k: int, percent: int, levels):
    """Second pass: prefix tokens under the first order, once a task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        seen: set[bytes] = set()
        for batch in batches:
            for ids, doc, g in shingle_sets(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1), k):
                n, a, b = _digests(doc, g, len(ids))
                marks = np.stack([a, b], 1).tobytes()
                chosen = np.zeros(len(ids), bool)
                for i in range(len(ids)):
                    mark = marks[16 * i : 16 * i + 16]
                    if mark not in seen:
                        seen.add(mark)
                        chosen[i] = True
                at, rank = _prefix(doc, _order_keys(g, table)[0], n, percent)
                keep = chosen[doc[at]]
                at, rank = at[keep], rank[keep]
                yield pa.record_batch(
                    [pa.array(g[at].view(np.int64)), pa.array(ids[doc[at]]), pa.array(n[doc[at]].astype(np.int32)), pa.array(rank.astype(np.int32))],
                    ["token", "id", "n", "rank"],
                )

    return wh.lean(run)


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values))


SETS = "id long, n int, tokens array<long>, first array<int>, second array<int>, third array<int>, slack int"


def _sets_of(k: int, percent: int, levels, bitmap=None):
    """Whole sets of texts, and their prefixes under each order as 32-bit hashes; with a bitmap, of texts whose third column is set in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in batches:
            if bitmap is not None:
                batch = batch.filter(pa.array(marked(bitmap.value, batch.column(2).to_numpy())))
            for ids, doc, g in shingle_sets(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1), k):
                n = np.bincount(doc, minlength=len(ids))
                short = wh.mix(g ^ K2).view(np.int64).astype(np.int32)
                cols, slack = [], np.zeros(len(ids), np.int64)
                for key in _order_keys(g, table):
                    at, _ = _prefix(doc, key, n, percent)
                    d, s = doc[at], short[at]
                    order = np.lexsort((s, d))
                    d, s = d[order], s[order]
                    new = np.ones(len(d), bool)
                    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
                    slack = np.maximum(slack, np.bincount(d[~new], minlength=len(ids)))
                    cols.append(_lists(d[new], s[new], len(ids)))
                yield pa.record_batch(
                    [pa.array(ids), pa.array(n.astype(np.int32)), _lists(doc, g.view(np.int64), len(ids)), *cols, pa.array(slack.astype(np.int32))],
                    ["id", "n", "tokens", "first", "second", "third", "slack"],
                )

    return wh.lean(run)


def _bounds(percent: int, n1: Column, r1: Column, n2: Column, r2: Column) -> Column:
    """Length and position bounds; the overlap needed is ceil(percent (n1 + n2) / (100 + percent))."""
    fits = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return fits & ((F.least(n1 - r1, n2 - r2) + 1) * (100 + percent) >= (n1 + n2) * percent)


def _head(percent: int) -> Column:
    """Whether a token lies in the shorter prefix that suffices for the smaller set of a pair."""
    return F.col("rank") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent) - 1e-9) + 1


def _candidate_sets(texts: DataFrame, wanted: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """The sets of the wanted ids, and of few others: marks of the ids, eight slots for each up to 8 MB, pass texts on."""
    bits = bits_for(wanted.count())
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    bitmap = marks(wanted, slot, bits)
    return materialise(texts.select("id", "text", slot.alias("slot")).mapInArrow(_sets_of(k, percent, levels, bitmap), SETS))


def _needed_overlap(percent: int, n1: Column, n2: Column) -> Column:
    return F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)


def passing(pairs: DataFrame, sets: DataFrame, percent: int, orders: tuple[str, ...] = ORDERS) -> DataFrame:
    """Pairs (u, v) whose prefixes meet often enough under each of ``orders``.

    Of two prefixes the one that ends first is known whole in both sets, so the
    overlap is at most what the prefixes share and the larger rest behind them.
    """
    a = sets.select(F.col("id").alias("u"), F.col("n").alias("n1"), F.col("slack").alias("x1"), *[F.col(o).alias(f"{o}1") for o in orders])
    b = sets.select(F.col("id").alias("v"), F.col("n").alias("n2"), F.col("slack").alias("x2"), *[F.col(o).alias(f"{o}2") for o in orders])
    needed = _needed_overlap(percent, F.col("n1"), F.col("n2"))
    rest = F.ceil(F.greatest("n1", "n2") * percent / 100 - 1e-9) - 1 + F.least("x1", "x2")
    ok = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    for o in orders:
        ok = ok & (F.size(F.array_intersect(f"{o}1", f"{o}2")) >= F.greatest(needed - rest, F.lit(1)))
    return pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where(ok).select("u", "v")


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """Pairs (u, v) that pass the filters of all orders and then the comparison of their sets."""
    pairs = materialise(pairs)
    wanted = materialise(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    sets = _candidate_sets(texts, wanted, k, percent, levels)
    # rows that share an id may differ in text, so a pair can meet in several rows
    near = materialise(passing(pairs, sets, percent).distinct())
    left = sets.select(F.col("id").alias("u"), F.col("n").alias("n1"), F.col("tokens").alias("t1"))
    right = sets.select(F.col("id").alias("v"), F.col("n").alias("n2"), F.col("tokens").alias("t2"))
    enough = F.size(F.array_intersect("t1", "t2")) >= _needed_overlap(percent, F.col("n1"), F.col("n2"))
    found = materialise(near.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(enough).select("u", "v").distinct())
    discard(pairs, wanted, sets, near)
    return found


class _Join:
    """The passes over the texts that components and links share."""

    def __init__(self, docs: DataFrame, id_col: str, text: str, k: int, percent: int, sketch_bits: int):
        spark = docs.sparkSession
        self.k, self.percent = k, percent
        self.texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text).alias("text"))
        survey = materialise(self.texts.mapInArrow(_counted(k, sketch_bits), "id long, n long, a long, b long, counts binary"))
        self.levels = spark.sparkContext.broadcast(_levels(survey, sketch_bits))
        wh.release()

        rows = survey.where("n >= 0").select("id", "n", "a", "b")
        # written first, so that a large group of copies can be split in the join
        classes = materialise(rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("class")))
        self.classed = materialise(rows.join(classes.hint("merge"), ["n", "a", "b"], "left").select("id", "n", F.coalesce("class", "id").alias("class")))
        discard(survey, classes)
        #: ids with several texts join the classes of all
        self.several = self.classed.groupBy("id").agg(F.min("class").alias("u"), F.max("class").alias("v")).where("u <> v")
        self.several = self.classed.join(self.several.select("id", "u"), "id").select("u", F.col("class").alias("v"))

        posts = materialise(self.texts.mapInArrow(_postings(k, percent, self.levels), "token long, id long, n int, rank int"))
        met = posts.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max(_head(percent)).alias("h")).where("c > 1 and h").select("token")
        copies = self.classed.where("id <> class").select("id", "class").distinct()
        self.shared = materialise(
            posts.join(met.hint("merge"), "token").join(copies.hint("merge"), "id", "left")
            .select("token", F.coalesce("class", "id").alias("id"), "n", "rank").distinct()
        )
        discard(posts)

    def stars(self, open_: DataFrame) -> DataFrame:
        """Each text with the first of those that share a token with it."""
        first = open_.where(_head(self.percent)).groupBy("token").agg(F.min(F.struct("id", "n", "rank", "c")).alias("p"))
        near = (F.col("c") != F.col("p.c")) & _bounds(self.percent, F.col("n"), F.col("rank"), F.col("p.n"), F.col("p.rank"))
        return open_.join(first, "token").where(near).select(F.least("id", "p.id").alias("u"), F.greatest("id", "p.id").alias("v")).distinct()

    def all_pairs(self, open_: DataFrame) -> DataFrame:
        """All pairs of different components that share a token within the bounds, the smaller set by its shorter prefix."""
        band = F.floor(F.log(F.col("n")) / math.log(100 / self.percent * (1 + 1e-9))).cast("int")
        small = open_.where(_head(self.percent)).withColumn("band", F.explode(F.array(band, band + 1)))
        large = open_.withColumn("band", band).toDF("token", "id2", "n2", "rank2", "c2", "band")
        order = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
        near = order & (F.col("c") != F.col("c2")) & _bounds(self.percent, F.col("n"), F.col("rank"), F.col("n2"), F.col("rank2"))
        return small.join(large, ["token", "band"]).where(near).select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        return _links(pairs, self.texts, self.k, self.percent, self.levels)


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, sketch_bits: int = 22) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``class_id`` (least id with an equal set)."""
    join = _Join(docs, id_col, text, k, percent, sketch_bits)
    stars = materialise(join.stars(join.shared.withColumn("c", F.col("id"))))
    edges = join.several.union(join.links(stars))

    # pairs that share a token and are not yet connected
    found = components(edges)
    placed = join.shared.join(found, "id", "left").select("token", "id", "n", "rank", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    open_ = materialise(placed.join(mixed, "token"))
    more = join.links(join.all_pairs(open_).join(stars, ["u", "v"], "left_anti"))
    discard(open_, stars, join.shared)
    whole = components(found.where("id <> component").toDF("u", "v").union(more)).toDF("class", "component")

    out = join.classed.join(whole, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return out.select(named("id").alias("doc_id"), F.col("n").alias("n_shingles"), named("component").alias("component_id"), named("class").alias("class_id"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, sketch_bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """All links (u, v) between class representatives, and the membership (doc_id, n_shingles, class_id).

    The first table is as large as the links: n different near copies of one
    text have up to n (n - 1) / 2 of them. ``near_components`` needs only those
    that connect.
    """
    join = _Join(docs, id_col, text, k, percent, sketch_bits)
    found = join.links(join.all_pairs(join.shared.withColumn("c", F.col("id"))))
    named = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return found.select(named("u").alias("u"), named("v").alias("v")), join.classed.select(named("id").alias("doc_id"), F.col("n").alias("n_shingles"), named("class").alias("class_id"))
