"""Exact substring deduplication with fixed-block anchors.

A window of 20 words that also starts earlier is removed. Each earlier
occurrence holds a whole reference block: 10 words that start at a multiple of
10. So the blocks are indexed, every rolling 10-word run of every text probes
the index, and only windows around a hit are compared in full; windows that
overlap join up to the maximal repeats.

1. Texts emit the hash of each rolling run, packed by hash part. Runs that
   meet a block in their own chunk of texts are settled there; one entry stands
   for all of them, so a run that a third of all texts share costs each chunk
   one entry.
2. Each part finds the hashes that a block and another run share, and sends
   the places back to the buckets of their texts.
3. Buckets hash (96 bits) the 20-word windows around those places, drop all but
   the first of equal windows within the bucket, and send the rest to parts
   that find the first of all.
4. Buckets mark the words of windows that are not the first.

No pair of texts is ever formed and no key gathers its rows in one task; work
is linear in the words. Parts and buckets follow ``spark.sql.shuffle.partitions``.
The hashes of step 1 only propose. Lineage runs through shuffles alone, so a
lost executor costs a recomputation of its part.

Defined results: null and empty texts have no words; a null id sorts before
all others; rows that share id and text count as one document and each get its
result; rows that share an id but not their text lose the places that any of
them loses; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh

_CHUNK_WORDS = 2_000_000
_SECOND = 0xC2B2AE3D27D4EB4F
_NULL_ID = -(1 << 63)
ROWS = "key int, kind int, data binary"


def _pack(ids: np.ndarray, pos: np.ndarray) -> bytes:
    """Places, which must be grouped by id with ascending positions."""
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    gap = np.diff(pos, prepend=0)
    gap[new] = pos[new]
    wide = bool(len(gap)) and (gap.max() > 65535 or gap.min() < 0)
    head = np.array([len(ids), len(new), wide], "<i8").tobytes()
    counts = np.diff(new, append=len(ids)).astype("<u4")
    return head + ids[new].astype("<i8").tobytes() + counts.tobytes() + gap.astype("<i8" if wide else "<u2").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """ids, positions and the end of what was read."""
    n, docs, wide = (int(x) for x in np.frombuffer(data, "<i8", 3))
    ids = np.frombuffer(data, "<i8", docs, 24)
    counts = np.frombuffer(data, "<u4", docs, 24 + 8 * docs).astype(np.int64)
    at, kind = 24 + 12 * docs, "<i8" if wide else "<u2"
    gap = np.frombuffer(data, kind, n, at).astype(np.int64)
    run = np.cumsum(gap)
    first = np.cumsum(counts) - counts
    pos = run - np.repeat(run[first] - gap[first], counts) if n else run
    return np.repeat(ids, counts), pos, at + n * np.dtype(kind).itemsize


def _places(blobs) -> tuple[np.ndarray, np.ndarray]:
    got = [_unpack(b)[:2] for b in blobs]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 13) ^ (ids >> 29), n)


def _bucket_column(i: Column, n: int) -> Column:
    return F.pmod(i.bitwiseXOR(F.shiftright(i, 13)).bitwiseXOR(F.shiftright(i, 29)), F.lit(n)).cast("int")


def _by_part(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each part, in their order."""
    order = np.argsort(part.astype(np.uint32), kind="stable")
    edges = np.searchsorted(part[order], np.arange(n + 1))
    for p in range(n):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p] : edges[p + 1]]


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
        ["key", "kind", "data"],
    )


def _to_buckets(ids: np.ndarray, pos: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Places as rows (bucket, bucket, packed places) for the buckets of their texts."""
    order = np.lexsort((pos, ids))
    ids, pos = ids[order], pos[order]
    return [(b, b, _pack(ids[at], pos[at])) for b, at in _by_part(_bucket(ids, n), n)]


def _hash_texts(ids: np.ndarray, texts: pa.Array):
    """Chunks (ids of texts, first words, word hashes) of whole texts."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        firsts, total = [], 0
        for _, f, h in held:
            firsts.append(f[:-1] + total)
            total += len(h)
        base = np.concatenate([x[0] for x in held])
        return base, np.append(np.concatenate(firsts), total), np.concatenate([x[2] for x in held])

    for first, end, data, offsets in wh.text_blocks(texts):
        starts, ends, fw = wh.words_in(data, offsets)
        held.append((ids[first:end], fw, wh.word_hashes(data, starts, ends)))
        size += len(starts)
        if size >= _CHUNK_WORDS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _runs(fw: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and position of each run of ``length`` words, of texts with a whole window."""
    n = np.diff(fw)
    count = np.where(n >= window, n - length + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    pos = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return text, fw[:-1][text] + pos, pos


def _probes(n_parts: int, window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for owner, fw, h in _hash_texts(ids, batch.column(1)):
                text, start, pos = _runs(fw, block, window)
                if not len(start):
                    continue
                g = wh.window_hashes(h, block)[start]
                order = np.argsort(g)
                s = g[order]
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                size = np.diff(first, append=len(s))
                settled = (size > 1) & np.logical_or.reduceat(pos[order] % block == 0, first)
                live = np.zeros(len(s), bool)
                live[order] = np.repeat(settled, size)
                out = []
                at = np.flatnonzero(live)
                if len(at):
                    out += _to_buckets(owner[text[at]], pos[at], n_parts)
                stand = s[first[settled]]
                stand_part = (stand % wh.U(n_parts)).astype(np.int64)
                stands = dict(_by_part(stand_part, n_parts))
                open_at = np.flatnonzero(~live)
                part = (g[open_at] % wh.U(n_parts)).astype(np.int64)
                asks = dict(_by_part(part, n_parts))
                for p in sorted(stands.keys() | asks.keys()):
                    at = open_at[asks.get(p, np.zeros(0, np.int64))]
                    marks = stand[stands.get(p, np.zeros(0, np.int64))]
                    places = _pack(owner[text[at]], pos[at])
                    out.append((p, -1, places + _five(g[at]) + _five(marks)))
                yield _rows(out)

    return run


def _five(h: np.ndarray) -> bytes:
    """Bits 24 to 63 of each hash."""
    return np.ascontiguousarray((h >> wh.U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view("<u8").ravel()


def _live(n_parts: int, block: int):
    """Places whose run meets a block elsewhere, as rows for the buckets."""

    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data")
        out = [(k, k, data[i].as_py()) for i, k in enumerate(kinds) if k >= 0]
        ids, pos, asks, marks = [], [], [], []
        for i, k in enumerate(kinds):
            if k < 0:
                raw = data[i].as_py()
                a, b, end = _unpack(raw)
                rest = np.frombuffer(raw, np.uint8, offset=end)
                ids.append(a), pos.append(b), asks.append(_unfive(rest[: 5 * len(a)])), marks.append(_unfive(rest[5 * len(a) :]))
        if ids:
            ids, pos, asks, marks = (np.concatenate(x) for x in (ids, pos, asks, marks))
            keys = np.concatenate([asks, marks])
            aligned = np.concatenate([pos % block == 0, np.ones(len(marks), bool)])
            weight = np.concatenate([np.ones(len(asks), np.int64), np.full(len(marks), 2)])
            order = np.argsort(keys)
            s = keys[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            if len(first):
                good = (np.add.reduceat(weight[order], first) > 1) & np.logical_or.reduceat(aligned[order], first)
                live = np.zeros(len(s), bool)
                live[order] = np.repeat(good, np.diff(first, append=len(s)))
                at = np.flatnonzero(live[: len(asks)])
                if len(at):
                    out += _to_buckets(ids[at], pos[at], n_parts)
        return pa.Table.from_batches([_rows(out)])

    return run


def _not_first(h1, h2, ids, pos) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each group of equal windows, and of the others."""
    order = np.lexsort((pos, ids, h2, h1))
    a, b, i, p = h1[order], h2[order], ids[order], pos[order]
    same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
    first = np.flatnonzero(~same)
    lead = np.repeat(first, np.diff(first, append=len(order)))
    twin = (i == i[lead]) & (p == p[lead])  # rows that repeat one document
    return order[first], order[~twin]


def _windows(n_parts: int, window: int, block: int):
    """Windows around live places: repeats within the bucket, and the rest for the parts."""

    def run(docs: pa.Table, live: pa.Table) -> pa.Table:
        ids, pos = _places(live.column("data").to_pylist())
        if not len(ids) or not docs.num_rows:
            return pa.Table.from_batches([_rows([])])
        order = np.lexsort((pos, ids))
        ids, pos = ids[order], pos[order]
        named = np.unique(ids)
        mine = docs.filter(pa.array(np.isin(docs.column("id").to_numpy(), named)))
        everything = []
        for owner, fw, h in _hash_texts(mine.column("id").to_numpy().astype(np.int64), mine.column("text").combine_chunks()):
            lo, hi = np.searchsorted(ids, owner), np.searchsorted(ids, owner, "right")
            mark = np.zeros(len(h) + 1, np.int64)
            text = np.repeat(np.arange(len(owner)), hi - lo)
            at = np.arange(len(text)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[text]
            mark[np.minimum(fw[text] + pos[at], len(h))] = 1
            seen = np.concatenate([[0], np.cumsum(mark)])
            text, start, where = _runs(fw, window, window)
            near = seen[start + window - block + 1] > seen[start]
            text, start, where = text[near], start[near], where[near]
            if len(start):
                h1, h2 = wh.window_hashes(h, window)[start], wh.window_hashes(h, window, _SECOND)[start]
                everything.append((h1, h2, owner[text], where))
        if not everything:
            return pa.Table.from_batches([_rows([])])
        h1, h2, i, p = (np.concatenate(x) for x in zip(*everything, strict=True))
        first, others = _not_first(h1, h2, i, p)
        out = _to_buckets(i[others], p[others], n_parts) if len(others) else []
        first = first[np.lexsort((p[first], i[first]))]
        for part, at in _by_part((h1[first] % wh.U(n_parts)).astype(np.int64), n_parts):
            f = first[at]
            out.append((part, -1, _pack(i[f], p[f]) + h1[f].astype("<u8").tobytes() + (h2[f] >> wh.U(32)).astype("<u4").tobytes()))
        return pa.Table.from_batches([_rows(out)])

    return run


def _later(n_parts: int):
    """Places of windows that also start earlier, as rows for the buckets."""

    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data")
        out = [(k, k, data[i].as_py()) for i, k in enumerate(kinds) if k >= 0]
        cols = []
        for i, k in enumerate(kinds):
            if k < 0:
                raw = data[i].as_py()
                a, b, end = _unpack(raw)
                cols.append((np.frombuffer(raw, "<u8", len(a), end), np.frombuffer(raw, "<u4", len(a), end + 8 * len(a)), a, b))
        if cols:
            h1, h2, ids, pos = (np.concatenate(x) for x in zip(*cols, strict=True))
            _, others = _not_first(h1, h2, ids, pos)
            if len(others):
                out += _to_buckets(ids[others], pos[others], n_parts)
        return pa.Table.from_batches([_rows(out)])

    return run


def _strip(window: int, with_text: bool):
    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        ids, pos = _places(gone.column("data").to_pylist())
        order = np.lexsort((pos, ids))
        ids, pos = ids[order], pos[order]
        out = [[], [], [], []]
        keys = docs.column("id").to_numpy().astype(np.int64)
        lo, hi = np.searchsorted(ids, keys), np.searchsorted(ids, keys, "right")
        for i, text in enumerate(docs.column("text")):
            words = (text.as_py() or "").encode().split()
            kept = words
            if lo[i] < hi[i]:
                edge = np.zeros(len(words) + 1, np.int64)
                at = pos[lo[i] : hi[i]]
                at = at[at + window <= len(words)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                kept = list(compress(words, np.cumsum(edge[:-1]) == 0))
            joined = b" ".join(kept)
            out[0].append(len(words))
            out[1].append(len(words) - len(kept))
            out[2].append(hashlib.sha256(joined).hexdigest())
            out[3].append(joined.decode() if with_text else None)
        cols = {"doc_id": docs.column("doc_id"), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept_sha256": pa.array(out[2], pa.string())}
        if with_text:
            cols["kept_text"] = pa.array(out[3], pa.string())
        return pa.table(cols)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, block: int = 10, parts: int | None = None, with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text``.

    ``window`` must be at least ``2 * block - 1``, or a window could hold no whole block.
    """
    if window < 2 * block - 1:
        raise ValueError("window must be at least 2 * block - 1")
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("id"), F.col(text).alias("text"))
    bucketed = texts.withColumn("key", _bucket_column(F.col("id"), n))
    probes = texts.select("id", "text").mapInArrow(_probes(n, window, block), ROWS)
    live = probes.groupBy("key").applyInArrow(_live(n, block), ROWS)
    windows = bucketed.groupBy("key").cogroup(live.groupBy("key")).applyInArrow(_windows(n, window, block), ROWS)
    later = windows.groupBy("key").applyInArrow(_later(n), ROWS)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return bucketed.groupBy("key").cogroup(later.groupBy("key")).applyInArrow(_strip(window, with_text), schema)
