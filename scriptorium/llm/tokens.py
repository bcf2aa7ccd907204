"""Token-id output as flat unsigned integer files with 64-bit document offsets.

Three folders hold one file each for every range of ids, in ascending order:

    kind=ids       uint16 (uint32 above 65,536 ids), each document ended by id 0
    kind=offsets   uint64 [n + 1], in ids from the start of the file
    kind=docs      int64 [n] document ids, and uint64 how many of them are null (these come first)

so ``numpy.memmap`` reads all three in place. Spark's text writer puts the bytes
down: that works on every file system that Spark writes to, and its committer
makes a retried task harmless. Its line separator is the end id in the first
folder and the zero top bytes of the last number in the others. A document's
place in the corpus is its offset plus its file's base, and the bases are prefix
sums of the files' lengths in ascending order of ids. There are at least as many
files as shuffle partitions, and enough that one holds about ``file_bytes`` of text.

Texts are cut into chunks that byte-level pre-tokens never reach over: white
space but for its last character, and what follows up to the next white space or
the first mark behind a letter. Chunks are found, hashed and replaced by their
ids with NumPy over blocks of texts; the tokenizers library encodes each chunk
that the table of known chunks lacks. The table holds a 64-bit hash, the length
and the first eight bytes of a chunk; its size is fixed, and a chunk that lost
its slot is encoded again. Texts with white space beyond ASCII, or control
characters on which definitions of white space differ, go to the library whole.

Defined results: a null or empty text is the end id alone; a very long text is
encoded in pieces of about ``_PIECE`` bytes; rows that share an id keep one entry
each; null ids come first; an empty table gives no entries; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .storage import materialise, shared_dir

_U = np.uint64
_BLOCK = 1 << 19
_PIECE = 1 << 22
_TABLE_BITS = 20
_POOL = 1 << 24
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?*#$%&|()[]{}\"/<>=+_-")] = True
#: Bytes that can begin white space beyond ASCII, and control characters that some count as white space.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_UNSURE = re.compile(b"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_BASE = 0x9E3779B97F4A7C15
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all chunks of the texts that ``offsets`` delimit."""
    space = _SPACE[data]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut = np.zeros(len(data), bool)
    cut[:-1] = space[:-1] & ~space[1:]  # the last white space before a word
    cut[last] = False
    before = data[:-1]
    cut[1:] |= space[1:] & ~space[:-1]
    cut[1:] |= ~space[1:] & space[:-1] & (before != 0x20)
    cut[1:] |= _MARK[data[1:]] & _LETTER[before]
    cut[first] = True
    return np.flatnonzero(cut)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, a hash and the first eight bytes of each chunk; chunks tile the data."""
    ends = np.append(starts[1:], len(data))
    up, down = _powers(1 << max(len(data) - 1, _BLOCK).bit_length())
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wh._BYTE[data] * up[: len(data)], dtype=np.uint64)])
    length = ends - starts
    h = wh.mix((run[ends] - run[starts]) * down[starts] + length.astype(np.uint64) * _U(0xA24BAED4963EE407))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,))[starts]
    return ends, h, eight & _MASKS[np.minimum(length, 8)]


class ChunkEncoder:
    """Encodes blocks of texts, remembering the ids of chunks in a table of fixed size."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        self._reset()

    def _reset(self) -> None:
        n = 1 << _TABLE_BITS
        self.hash, self.head = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.at, self.size = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _store(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        at = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + total] = np.fromiter((i for x in found for i in x), self.dtype, total)
        self.used += total
        return at, size

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's first id (length texts + 1)."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        if self.used > _POOL:
            self._reset()
        starts = chunk_starts(data, offsets)
        ends, h, head = _keys(data, starts)
        slot = (h & _U((1 << _TABLE_BITS) - 1)).astype(np.int64)
        known = (self.hash[slot] == h) & (self.head[slot] == head) & (self.size[slot] >= 0)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            order = new[np.lexsort((ends[new] - starts[new], head[new], h[new]))]
            other = np.ones(len(order), bool)
            other[1:] = (h[order][1:] != h[order][:-1]) | (head[order][1:] != head[order][:-1])
            one, which = order[other], np.cumsum(other) - 1
            raw = data.tobytes()
            got_at, got_size = self._store(self._encode([raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]))
            at[order], size[order] = got_at[which], got_size[which]
            self.hash[slot[one]], self.head[slot[one]] = h[one], head[one]
            self.at[slot[one]], self.size[slot[one]] = got_at, got_size
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The bytes of each text's ids, without the end id."""
        out = []
        for ids, first in self.texts(pa.array(texts, pa.string())):
            out += [ids[a : b - 1].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return out

    def whole(self, raw: bytes) -> np.ndarray:
        return np.array(self._encode([raw.decode()])[0], self.dtype)

    def long(self, data: np.ndarray) -> np.ndarray:
        """One text, piece by piece; pieces end before a single space between words."""
        out, first = [], 0
        while first < len(data):
            end = first + _PIECE
            while end < len(data):
                window = _SPACE[data[end - 1 : end + _PIECE]]
                free = np.flatnonzero(~window[:-2] & window[1:-1] & ~window[2:] & (data[end : end + len(window) - 2] == 0x20))
                if len(free):
                    end += int(free[0])
                    break
                end += _PIECE
            end = min(end, len(data))
            out.append(self.block(data[first:end], np.array([0, end - first]))[0])
            first = end
        return np.concatenate(out)

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, first ids) of runs of whole texts, each ended by id 0."""
        zero = np.zeros(1, self.dtype)
        for _, _, data, offsets in wh.text_blocks(column, _BLOCK):
            odd = []
            if _ODD[data].any():
                odd = sorted({int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in _UNSURE.finditer(data)})
            if len(offsets) == 2 and len(data) > _PIECE and not odd:
                parts = [self.long(data)]
            elif odd:
                parts, sure = [], 0
                for i in [*odd, len(offsets) - 1]:
                    ids, first = self.block(data[offsets[sure] : offsets[i]], offsets[sure : i + 1] - offsets[sure])
                    parts += [ids[first[j] : first[j + 1]] for j in range(i - sure)]
                    if i < len(offsets) - 1:
                        parts.append(self.whole(data[offsets[i] : offsets[i + 1]].tobytes()))
                    sure = i + 1
            else:
                ids, first = self.block(data, offsets)
                n = len(first) - 1
                out = np.zeros(len(ids) + n, self.dtype)
                out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
                yield out, first + np.arange(n + 1)
                continue
            yield np.concatenate([x for p in parts for x in (p, zero)]), np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])


@lru_cache(2)
def encoder_of(path: str, dtype: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker."""
    return ChunkEncoder(path, dtype)


def id_dtype(path: str) -> str:
    """Width of an id, from the size of the vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _binary(raw: bytes, edges: np.ndarray) -> pa.Array:
    """Slices of ``raw`` between neighbouring edges as one binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype("<i8").tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


def _lines(kind: str, seq: np.ndarray, value: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind] * len(value)), pa.array(seq, pa.int64()), value], ["kind", "seq", "value"])


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", files: int | None = None, file_bytes: int = 256 << 20
) -> None:
    """Write ``docs`` as token files below ``path``; one of each kind for each range of ids."""
    spark = docs.sparkSession
    dtype = id_dtype(tokenizer)
    width = int(dtype[-1])
    if not files:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, dtype)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        n_null = seq = 0
        for batch in batches:
            n_null += batch.column(0).null_count
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for out, first in encoder.texts(batch.column(1)):
                lengths.append(np.diff(first))
                # the writer's separator is the end id of the last document
                yield _lines("ids", np.array([seq]), _binary(out.astype(dtype).tobytes(), np.array([0, (len(out) - 1) * width])))
                seq += 1
        if not ids or not sum(map(len, ids)):
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
        if width == 4 and int(offsets[-1]) >> 32:
            raise ValueError("more ids in a file than 32 bits count; ask for more files")
        places = np.concatenate([np.concatenate(ids), np.array([n_null], "<i8")])
        for kind, numbers in (("offsets", offsets), ("docs", places)):
            yield _lines(kind, np.zeros(1, np.int64), pa.array([numbers.tobytes()[:-width]], pa.binary()))

    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange(files, "id").sortWithinPartitions("id")
    lines = placed.mapInArrow(encode, "kind string, seq long, value binary").sortWithinPartitions("kind", "seq")
    lines.select("kind", F.col("value").cast("string")).write.partitionBy("kind").option("lineSep", "\0" * width).option("compression", "none").text(path)


def views(ids: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """ids, offsets, document ids and the count of null ids, from the bytes of a range's three files."""
    offsets, places = offsets.view("<u8"), places.view("<i8")
    width, left = divmod(len(ids), int(offsets[-1]))
    if left or width not in (2, 4) or len(places) != len(offsets):
        raise ValueError("not a token file")
    return ids.view(f"<u{width}"), offsets, places[:-1], int(places[-1])


def open_range(path: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``views``, memory-mapped from the files named ``name`` below a folder that this machine sees."""
    return views(*[np.memmap(f"{path}/kind={kind}/{name}", np.uint8, "r") for kind in ("ids", "offsets", "docs")])


INDEX = "file string, doc_id long, local long, n_tokens long, ids_crc32 long"


def _entries(name: str, ids: np.ndarray, offsets: np.ndarray, docs: np.ndarray, n_null: int) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(docs), 10_000):
        at = offsets[first : first + 10_001].astype(np.int64)
        n = len(at) - 1
        part = np.asarray(ids[at[0] : at[-1]]).astype("<u4")
        crc = [zlib.crc32(part[a:b]) for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
        yield pa.record_batch(
            [pa.array([name] * n, pa.string()), pa.array(docs[first : first + n], mask=np.arange(first, first + n) < n_null), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
            ["file", "doc_id", "local", "n_tokens", "ids_crc32"],
        )


def _mapped(folder: str):
    """Entries of the ranges named in each batch, memory-mapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _entries(name, *open_range(folder, name))

    return run


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same from the files' contents, one range a row, for stores that only Spark reads."""
    for batch in batches:
        for i, name in enumerate(batch.column(0).to_pylist()):
            yield from _entries(name, *views(*[np.frombuffer(batch.column(j)[i].as_buffer(), np.uint8) for j in (1, 2, 3)]))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files below ``path``: doc_id, file, start, n_tokens, ids_crc32.

    Files on a file system that machines mount are memory-mapped.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    name = F.regexp_extract("path", "([^/]+)$", 1)

    def files(kind: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind={kind}").where("length > 0")

    if scheme == "file":
        folder = target.toUri().getPath()
        found = files("ids").select(name.alias("name")).mapInArrow(_mapped(folder), INDEX)
    else:
        joined = files("ids").select(name.alias("name"), F.col("content").alias("ids"))
        for kind in ("offsets", "docs"):
            joined = joined.join(files(kind).select(name.alias("name"), F.col("content").alias(kind)), "name")
        found = joined.mapInArrow(_sent, INDEX)
    index = materialise(found)
    # file names carry the number of the id range; there are few files, and only their totals meet here
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long")
    before = F.sum("n").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return index.join(totals.select("file", before.alias("base")), "file").select("doc_id", "file", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer: str, path: str | None = None, files: int | None = None) -> DataFrame:
    """Write the token files and return their index, read back from them."""
    path = path or shared_dir(docs.sparkSession) + "/tokens"
    docs = docs.select("doc_id", "text")
    write_tokens(docs, path, tokenizer, files=files)
    if not docs.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path").head(1):
        return docs.sparkSession.createDataFrame([], "doc_id long, file string, start long, n_tokens long, ids_crc32 long")
    return read_index(docs.sparkSession, path)
