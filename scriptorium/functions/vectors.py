"""Vector functions: JVM expressions for pairs, Arrow and NumPy for whole embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain, pairwise, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # Python's own, where it is built in, spends less on short names
    from _md5 import md5 as _md5
except ImportError:
    _md5 = partial(hashlib.md5, usedforsecurity=False)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Feature prefixes, their weights and the sign rule are fixed values of the stored vectors.
WORD, PAIR, TRIGRAM = ("w:", 1.0), ("b:", 1.25), ("c:", 0.2)
_KNOWN = 200_000


def _features(tokens: list[str]) -> Iterator[tuple[str, float]]:
    for t in tokens:
        yield WORD[0] + t, WORD[1]
    for a, b in pairwise(tokens):
        yield f"{PAIR[0]}{a}_{b}", PAIR[1]
    joined = "_".join(tokens)
    for i in range(len(joined) - 2):
        yield TRIGRAM[0] + joined[i : i + 3], TRIGRAM[1]


@lru_cache(_KNOWN)
def _value(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def hash_vector(tokens: list[str], dims: int = 1024) -> np.ndarray:
    """Signed hashed features of a token list, scaled to length one; bit 63 set means plus."""
    found = list(_features(tokens))
    if not found:
        return np.zeros(dims, np.float32)
    values = np.array([_value(name) for name, _ in found], np.uint64)
    weights = np.array([w for _, w in found])
    signed = np.where(values >> np.uint64(63) == 1, weights, -weights)
    out = np.bincount((values % np.uint64(dims)).astype(np.int64), signed, dims)
    n = np.linalg.norm(out)
    return (out / n if n else out).astype(np.float32)


class Features:
    """Hashed words, adjacent pairs and character trigrams of many token lists at once, counted in twentieths.

    A feature's code is its bucket, plus ``dims`` if its sign is minus. Counts are integers, so sums are exact.
    """

    def __init__(self, dims: int, trigrams: bool, codes: Callable[[list[bytes]], np.ndarray]):
        self.dims, self.codes = dims, codes
        self.words: dict[bytes, int] = {}
        self.trigrams = codes([TRIGRAM[0].encode() + bytes(x) for x in product(_LETTERS, repeat=3)]) if trigrams else None

    def _words(self, flat: list[bytes]) -> np.ndarray:
        """Codes of words, which are kept up to a bound."""
        new = list(set(flat).difference(self.words))
        if len(self.words) + len(new) > _CODES:
            self.words, new = {}, list(set(flat))
        self.words.update(zip(new, self.codes([b"w:" + w for w in new]).tolist(), strict=True))
        return np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))

    def counts(self, docs: list[list[bytes]]) -> np.ndarray:
        """For each list of tokens ([a-z0-9]+) and code the weights' sum in twentieths: lists x 2 (plus, minus) x dims."""
        n, width = len(docs), 2 * self.dims
        flat = list(chain.from_iterable(docs))
        row = np.repeat(np.arange(n) * width, [len(d) for d in docs])
        total = 20 * np.bincount(row + self._words(flat), minlength=n * width)
        if len(flat) > 1:
            pair = self.codes([b"b:%b_%b" % x for x in pairwise(flat)])
            inside = row[:-1] == row[1:]
            total += 25 * np.bincount((row[:-1] + pair)[inside], minlength=n * width)
        joined = [b"_".join(d) for d in docs]
        if self.trigrams is not None and len(letters := _LETTER[np.frombuffer(b" ".join(joined), np.uint8)]) > 2:
            a, b, c = letters[:-2], letters[1:-1], letters[2:]
            row = np.repeat(np.arange(n) * width, [len(j) + 1 for j in joined])[: len(a)]
            inside = (a >= 0) & (b >= 0) & (c >= 0)
            total += 4 * np.bincount((row + self.trigrams[(a * 37 + b) * 37 + c])[inside], minlength=n * width)
        return total.reshape(n, 2, self.dims)


_CODES = 1 << 17
_LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789_"
_LETTER = np.full(256, -1, np.int64)
_LETTER[list(_LETTERS)] = np.arange(len(_LETTERS))


def _md5_codes(dims: int, names: list[bytes]) -> np.ndarray:
    h = np.frombuffer(b"".join([_md5(x).digest() for x in names]), ">u4")[::4].astype(np.int64)
    return (h >> 1) % dims + dims * (h & 1)


def _blake_codes(dims: int, names: list[bytes]) -> np.ndarray:
    h = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in names]), "<u8")
    return (h % np.uint64(dims)).astype(np.int64) + dims * (1 - (h >> np.uint64(63)).astype(np.int64))


@lru_cache(2)
def md5_features(dims: int = 1024, trigrams: bool = False) -> Features:
    """Features by md5, as SQL engines have it."""
    return Features(dims, trigrams, partial(_md5_codes, dims))


@lru_cache(2)
def embedding_features(dims: int = 1024) -> Features:
    """The features of ``hash_vector``."""
    return Features(dims, True, partial(_blake_codes, dims))


def hash_embedding(dims: int = 1024):
    """A vectorised function from token arrays to float vectors; other providers have the same shape."""
    if dims < 64:
        raise ValueError("dims must be at least 64")

    @F.pandas_udf("array<float>")
    def embed(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: hash_vector(list(t) if t is not None else [], dims))

    return embed


def hash_features(dims: int = 1024):
    """The entries of ``hash_embedding`` that are not zero, as (bucket, weight): what an exact scan joins on."""
    if dims < 64:
        raise ValueError("dims must be at least 64")

    def entries(tokens) -> list[dict]:
        v = hash_vector(list(tokens) if tokens is not None else [], dims)
        return [{"bucket": int(i), "weight": float(v[i])} for i in np.flatnonzero(v)]

    @F.pandas_udf("array<struct<bucket:int,weight:double>>")
    def features(tokens: pd.Series) -> pd.Series:
        return tokens.map(entries)

    return features


def vector_literal(v: Column, number: str = "%.9g") -> Column:
    """``[a,b,...]`` with nine significant digits, as stores of vectors read it; a null vector stays null.

    Numbers are rounded from their exact value, an exact half to the even digit, as C does; the JVM rounds halves up.
    Null elements are left out; ``%g`` keeps its zeros.
    """
    form = number.replace("%", "%#", 1) if number.endswith("g") else number

    @F.arrow_udf("string")
    def literals(vectors: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "[" + ",".join([form % y for y in x if y is not None]) + "]" for x in vectors.to_pylist()], pa.string())

    return literals(v)
