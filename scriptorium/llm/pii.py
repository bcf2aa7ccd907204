"""Personal data: base patterns and bootstrapped contextual extraction.

Base patterns find e-mail and IP addresses, card and phone numbers; these are
the seeds. The two words before a seed are a lexical pattern. Patterns and the
identifier-like tokens behind them form a bipartite graph, counted over all
documents. Each round takes the patterns that introduce enough distinct seeds,
scores each by the share of all its occurrences, whatever follows, that is
believed, and lets the patterns of high confidence pass belief to their other
tokens; tokens believed in one round are seeds of the next, so patterns spread
to contexts that no base kind shares. The last round's patterns mark the unseen
tokens that they introduce.

The first pass reads the texts once and keeps spans and tokens of the few texts
with a digit or an at sign. The second counts how often the patterns that could
qualify occur; a bitmap of their hashes, of checked size, drops other pairs of
words, and a join drops what slips through. Scoring is joins and sums over the
graph, which never leaves the executors. Rows carry a number of their own, so
neither copies nor rows without tokens meet in one task.

All regular expressions run in time linear in the text: a match can only start
at the start of a run of its first class, or where the last match ended.

Defined results: null or empty texts have no spans; repeated rows get equal
results; equal tokens are one instance; of equally strong kinds the one listed
first names a pattern; a very long text is searched whole; an empty table gives
an empty result. Input columns may have any name; those that carry the name of
a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .marks import bits_for, marked, marks
from .storage import materialise
from .text import inner_name, shielded

KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = "\"'()[]{}<>.,;:!?*#$%&|"
CANDIDATES = "array<struct<pattern:bigint,instance:bigint,kind:string,start:int,end:int>>"


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        # a run before a later at sign can't reach back over this one
        at = text.find("@", done if m else at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns by kind and start, in code points."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and _luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _candidates(text: str, raw: np.ndarray, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-like tokens behind two words, with the hashes of both."""
    starts, ends, _ = wh.words_in(raw, np.array([0, len(raw)]))
    if len(starts) < 3:
        return []
    h = wh.word_hashes(wh.lower(raw), starts, ends)
    two = wh.window_hashes(h, 2)
    char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    cs, ce = char[starts], char[ends]
    taken = np.zeros(len(starts), bool)
    out = []
    for kind, a, b in spans:
        first, last = np.searchsorted(ce, a, "right"), np.searchsorted(cs, b)
        taken[first:last] = True
        if first >= 2:
            value = hashlib.blake2b(text[a:b].lower().encode(), digest_size=8).digest()
            out.append((int(two[first - 2].astype(np.int64)), int.from_bytes(value, "little", signed=True), KINDS[kind], a, b))
    marked = ((raw >= 48) & (raw <= 57)) | (raw == 64)
    count = np.concatenate([[0], np.cumsum(marked)])
    for i in np.flatnonzero((count[ends] > count[starts]) & ~taken):
        token = text[cs[i] : ce[i]]
        core = token.strip(_EDGE)
        if i >= 2 and len(core) >= 6:
            a = int(cs[i]) + token.index(core)
            value = hashlib.blake2b(core.lower().encode(), digest_size=8).digest()
            out.append((int(two[i - 2].astype(np.int64)), int.from_bytes(value, "little", signed=True), None, a, a + len(core)))
    return [dict(zip(("pattern", "instance", "kind", "start", "end"), x, strict=True)) for x in out]


_KIND_TYPE = pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns, base spans as (kind, start, end) texts, counts and candidates."""
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rest, column = batch.columns[:-1], batch.column(batch.num_columns - 1)
        n = batch.num_rows
        spans, counts, digest, found = [""] * n, np.zeros((n, 4), np.int64), [empty] * n, [[]] * n
        for first, end, data, offsets in wh.text_blocks(column):
            if not len(data):
                continue
            marks = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
            for i in np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]]):
                text = column[first + int(i)].as_py()
                base = base_spans(text)
                joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
                row = first + int(i)
                spans[row], digest[row] = joined, hashlib.sha256(joined.encode()).hexdigest()
                for k, _, _ in base:
                    counts[row, k] += 1
                found[row] = _candidates(text, data[offsets[i] : offsets[i + 1]], base)
        yield pa.RecordBatch.from_arrays(
            [*rest, *[pa.array(counts[:, k]) for k in range(4)], pa.array(digest), pa.array(spans), pa.array(found, _KIND_TYPE)],
            [*batch.schema.names[:-1], *[f"n_{k}" for k in KINDS], "base_sha256", "base_spans", "__found"],
        )


def _count_patterns(bits: int, bitmap):
    """Occurrences of the pairs of words whose slot is set, summed over each block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in wh.text_blocks(batch.column(0)):
                starts, ends, fw = wh.words_in(data, offsets)
                two = wh.window_hashes(wh.word_hashes(wh.lower(data), starts, ends), 2)
                inner = np.ones(len(two), bool)
                inner[fw[(fw > 0) & (fw <= len(two))] - 1] = False  # over the edge of two texts
                two = two[inner]
                two = two[marked(bitmap.value, (two >> wh.U(64 - bits)).astype(np.int64))]
                found, n = np.unique(two, return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "total"])

    return run


def _totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern's words occur, whatever follows."""
    bits = bits_for(patterns.count())
    bitmap = marks(patterns, F.shiftrightunsigned("pattern", 64 - bits), bits)
    counted = texts.mapInArrow(_count_patterns(bits, bitmap), "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return materialise(counted.join(patterns, "pattern", "left_semi"))


def score_patterns(edges: DataFrame, totals: DataFrame, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """(pattern, confidence, kind) after rounds of scoring; edges are (pattern, instance, kind, n), kind an index or null."""
    own = edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("own"))
    graph = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n")).join(totals, "pattern").join(own, "instance", "left")
    graph = materialise(graph)
    belief = graph.select("instance", F.col("own").alias("kind"), F.col("own").isNotNull().cast("double").alias("s")).distinct()
    for r in range(rounds):
        seed = F.col("s") >= min_confidence
        # the kind with the greatest weight; of equal ones the first
        share = (
            graph.join(belief, "instance")
            .groupBy("pattern")
            .agg(
                F.round(F.least(F.lit(1.0), F.sum(F.col("n") * F.col("s")) / F.max("total")), 9).alias("confidence"),
                F.count_if(seed).alias("seeds"),
                F.max(F.when(seed, F.struct(F.col("n") * F.col("s"), -F.col("kind")))).alias("best"),
            )
            .where(F.col("seeds") >= min_seeds)
            .select("pattern", "confidence", (-F.col("best.col2")).alias("kind"))
        )
        if r < rounds - 1:
            doubt = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))))
            strong = share.where(F.col("confidence") >= min_confidence)
            spread = graph.join(strong, "pattern").groupBy("instance").agg(F.round(1 - doubt, 9).alias("found"), F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("by"))
            known = graph.select("instance", "own").distinct().join(spread, "instance", "left")
            belief = materialise(
                known.select(
                    "instance",
                    F.coalesce("own", -F.col("by.k")).alias("kind"),
                    F.when(F.col("own").isNotNull(), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("s"),
                )
            )
    return share


def find_personal_data(df: DataFrame, text: str = "text", min_seeds: int = 3, min_confidence: float = 0.5, rounds: int = 3) -> DataFrame:
    """All input columns but the text, ``n_<kind>``, ``base_sha256``, ``base_spans``, ``n_context``, ``n_spans`` and ``spans``."""
    results = [*[f"n_{k}" for k in KINDS], "base_sha256", "base_spans", "n_context", "n_spans", "spans"]
    own_text = inner_name(df, text)
    df, back = shielded(df, [*results, text])
    keep = [c for c in df.columns if c != own_text]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"{c} {types[c]}" for c in keep], *[f"n_{k} long" for k in KINDS], "base_sha256 string", "base_spans string", f"__found {CANDIDATES}"])
    base = df.select(*keep, own_text).mapInArrow(_scan, schema)
    # written with the rows, the number stays theirs
    base = materialise(base.withColumn("__row", F.monotonically_increasing_id()))

    some = base.where(F.size("__found") > 0)
    index = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("x.kind"))
    found = some.select("__row", F.explode("__found").alias("x")).select("__row", "x.pattern", "x.instance", index.cast("int").alias("kind"), "x.start", "x.end")
    edges = materialise(found.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")))
    possible = materialise(edges.groupBy("pattern").agg(F.countDistinct("instance").alias("m")).where(F.col("m") >= min_seeds).select("pattern"))
    totals = _totals(df.select(F.col(own_text).alias("text")), possible)
    good = score_patterns(edges.join(possible, "pattern", "left_semi"), totals, rounds, min_seeds, min_confidence)
    good = good.where(F.col("confidence") >= min_confidence).select("pattern", F.col("kind").alias("as_kind"))

    span = F.struct(F.col("as_kind"), F.col("start"), F.col("end"))
    added = found.where("kind is null").join(good, "pattern").groupBy("__row").agg(F.array_sort(F.collect_set(span)).alias("__added"))
    none = F.lit(None).cast("array<struct<as_kind:int,start:int,end:int>>")
    out = some.join(added, "__row", "left").unionByName(base.where(F.size("__found") == 0).withColumn("__added", none))
    kind = lambda x: F.element_at(F.array(*[F.lit(f"context_{k}") for k in KINDS]), x["as_kind"])
    more = F.array_join(F.transform("__added", lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")
    n_context = F.coalesce(F.size("__added"), F.lit(0)).cast("long")
    return out.select(
        *back,
        *[f"n_{k}" for k in KINDS],
        "base_sha256",
        "base_spans",
        n_context.alias("n_context"),
        (sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)) + n_context).alias("n_spans"),
        F.when(F.col("__added").isNull(), F.col("base_spans")).otherwise(F.concat_ws(",", F.nullif("base_spans", F.lit("")), more)).alias("spans"),
    )
