"""Mixing to target weights with soft membership.

A softmax classifier trained on the labelled table gives each document a
posterior over domains: the combinations of label values, with one factor for
each label, so scarce combinations share the evidence of their parts. Nonnegative rates r
then minimise

    1/2 sum_k ((sum_i r_i n_i p_ik - T_k) / B)^2 + l/2 sum_i (n_i / B) (r_i - 1)^2

where n_i counts tokens, T = B w are the target totals and the second term
keeps rates near one where the targets leave a choice: with a ridge of l, a
domain may miss its target by up to l of the budget. With ``relative``, each
squared miss is divided by the domain's share s_k = sum_i n_i p_ik / B, which
bounds the miss by l of the domain itself, however rare; what stays beyond that
is expected tokens of a domain spread thinly over documents of others, which
only dropping these would remove. The solution is r_i =
clip(1 - sum_k p_ik m_k), with one multiplier m_k for each domain; Newton steps
on the concave dual find these, each with one distributed pass that tries ten
step lengths. A document's rate follows from its posterior and the multipliers,
so no state is kept on executors: every pass computes it anew, and a lost
executor costs part of one pass.

The classifier is fit on at most ``max_train`` labelled documents, chosen by a
digest of their id. It sees which of the ``n_words`` most telling words or stems a text
has (by likelihood ratio over hashed words) and shares of characters and
repeats. All other sums run over all documents.

Defined results: a null or empty text has no tokens, the prior's posterior and
a rate all the same; repeated rows get equal results, each counting its own
tokens; a very long text is read whole; input columns that carry the name of a
result are replaced; without labels there is one domain and every rate is one;
labels whose document is missing, or with a null label, are ignored; of several
labels of one id the least counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .storage import materialise, tidy
from .text import drop_clashes

HASH_BITS = 18
STEM_BYTES = 6
_PART = 1 << 20
_CLASSES = [np.isin(np.arange(256), list(b)) for b in (b"#*$%&<>", b"|", b"!", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:?")]
N_SHARES = len(_CLASSES) + 3


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token counts, shares, and the (text, word bucket) pairs, distinct and sorted."""
    n_texts = len(offsets) - 1
    starts, ends, fw = wh.words_in(data, offsets)
    n = np.diff(fw)
    size = np.maximum(np.diff(offsets), 1)
    shares = np.zeros((n_texts, N_SHARES))
    for j, cls in enumerate(_CLASSES):
        run = np.concatenate([[0], np.cumsum(cls[data])])
        shares[:, j] = np.diff(run[offsets]) / size
    folded = wh.lower(data)
    h = wh.word_hashes(folded, starts, ends)
    # words of one stem share their first bytes
    stems = wh.word_hashes(folded, starts, np.minimum(ends, starts + STEM_BYTES), seed=1)
    same = np.zeros(len(h) + 1, np.int64)
    same[1 : len(h)] = h[1:] == h[:-1]
    run = np.concatenate([[0], np.cumsum(same)])
    shares[:, -3] = (run[np.maximum(fw[1:], fw[:-1])] - run[np.minimum(fw[:-1] + 1, fw[1:])]) / np.maximum(n, 1)
    shares[:, -2] = np.log1p(n)
    shares[:, -1] = size / np.maximum(n, 1) / 10
    text = np.repeat(np.arange(n_texts), n).astype(np.int64) << HASH_BITS
    pair = np.unique(np.concatenate([text | (x >> wh.U(64 - HASH_BITS)).astype(np.int64) for x in (h, stems)]))
    return n, shares, pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0)
        for first, end, data, offsets in wh.text_blocks(batch.column(1)):
            _, shares, text, bucket = _features(data, offsets)
            edge = np.searchsorted(text, np.arange(end - first + 1))
            yield pa.record_batch(
                [
                    labels.slice(first, end - first),
                    pa.array([s.tobytes() for s in shares], pa.binary()),
                    pa.array([bucket[edge[i] : edge[i + 1]].astype("<i4").tobytes() for i in range(end - first)], pa.binary()),
                ],
                ["domain", "shares", "words"],
            )


@dataclass
class Factor:
    """Softmax over one label's values: standardised shares and the presence of chosen words."""

    values: list[str]
    place: np.ndarray  # bucket -> row of ``weights``, or -1
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    share_weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, shares: np.ndarray, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        score = (shares - self.mean) / self.scale @ self.share_weights + self.bias
        at = self.place[bucket]
        on = at >= 0
        for k in range(len(self.values)):
            score[:, k] += np.bincount(text[on], self.weights[at[on], k], len(shares))
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Independent factors, one for each label; domains are the combinations of their values."""

    factors: list[Factor]

    @property
    def domains(self) -> list[str]:
        return [" ".join(c) for c in product(*[f.values for f in self.factors])]

    def posteriors(self, shares: np.ndarray, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.ones((len(shares), 1))
        for f in self.factors:
            p = f.posteriors(shares, text, bucket)
            out = (out[:, :, None] * p[:, None, :]).reshape(len(shares), -1)
        return out


def _likelihood_ratio(table: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """G of each word's presence against the domains."""
    n = totals.sum()
    p = table.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        yes = np.where(table > 0, table * np.log(table * n / (p * totals)), 0)
        no_ = totals - table
        no = np.where(no_ > 0, no_ * np.log(no_ * n / ((n - p) * totals)), 0)
    return 2 * np.nan_to_num(yes + no).sum(axis=1)


def _flat(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column, one behind the other, and how many each row has."""
    parts = [c for c in column.chunks if len(c)]
    edges = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] for c in parts]
    values = [np.frombuffer(c.buffers()[2], np.uint8)[e[0] : e[-1]].view(dtype) for c, e in zip(parts, edges, strict=True)]
    return np.concatenate(values), np.concatenate([np.diff(e) for e in edges]) // np.dtype(dtype).itemsize


def fit(rows: pa.Table) -> Model:
    """Fit on collected training rows (domain, shares, words); words stay in one array."""
    shares = _flat(rows.column("shares"), "<f8")[0].reshape(-1, N_SHARES)
    words, n = _flat(rows.column("words"), "<i4")
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    parts = [d.split(" ") for d in rows.column("domain").to_pylist()]
    return Model([_fit_factor([p[i] for p in parts], shares, words, owner) for i in range(len(parts[0]))])


def _fit_factor(labels: list[str], shares: np.ndarray, words: np.ndarray, owner: np.ndarray, n_words: int = 400, steps: int = 150, decay: float = 3e-4) -> Factor:
    domains = sorted(set(labels))
    y = np.array([domains.index(x) for x in labels])
    k, totals = len(domains), np.bincount(y, minlength=len(domains)).astype(float)
    table = np.zeros((1 << HASH_BITS, k))
    parts = [slice(i, i + _PART) for i in range(0, len(words), _PART)]
    for part in parts:
        np.add.at(table, (words[part], y[owner[part]]), 1)
    gain = _likelihood_ratio(table, totals)
    chosen = np.argsort(-gain, kind="stable")[:n_words]
    chosen = chosen[gain[chosen] > 15]
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    mean, scale = shares.mean(axis=0), shares.std(axis=0) + 1e-6
    x = np.zeros((len(y), len(chosen) + N_SHARES + 1), np.float32)
    for part in parts:
        at = place[words[part]]
        x[owner[part][at >= 0], at[at >= 0]] = 1
    x[:, len(chosen) : -1] = (shares - mean) / scale
    x[:, -1] = 1
    target = np.eye(k, dtype=np.float32)[y]
    w = np.zeros((x.shape[1], k), np.float32)
    ahead, t = w, 1.0
    # presence columns are sparse: steps follow each column's own size
    step = 2.0 / (np.einsum("ij,ij->j", x, x)[:, None] / len(y) * 40 + decay)
    for _ in range(steps):
        z = x @ ahead
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ (p - target) / len(y) + decay * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    m = len(chosen)
    return Factor(domains, place, w[:m].astype(float), mean, scale, w[m:-1].astype(float), w[-1].astype(float))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_train: int = 20_000) -> Model | None:
    """A model from at most ``max_train`` labelled documents; none without labels."""
    names = [c for c in labels.columns if c != id_col]
    known = labels.dropna().groupBy(id_col).agg(F.min(F.struct(*names)).alias("l"))
    domain = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.regexp_replace(F.col(f"l.{c}").cast("string"), " ", "_")) for c in sorted(names)])
    sample = known.select(id_col, domain.alias("__domain")).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(max_train)
    rows = docs.join(F.broadcast(sample), id_col).select("__domain", F.col(text)).mapInArrow(_training_rows, "domain string, shares binary, words binary").toArrow()
    tidy(docs.sparkSession)
    model = fit(rows) if rows.num_rows else None
    del rows
    wh.release()
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rest = batch.columns[:-1]
            tokens, posts = [], []
            for _, _, data, offsets in wh.text_blocks(batch.column(batch.num_columns - 1)):
                n, shares, text, bucket = _features(data, offsets)
                tokens.append(n)
                posts.append(np.ones((len(n), 1)) if m is None else m.posteriors(shares, text, bucket))
            if tokens:
                n, p = np.concatenate(tokens), np.round(np.concatenate(posts), 6)
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), lists], [*batch.schema.names[:-1], "n_tokens", "posterior"])

    return run


@dataclass(frozen=True)
class Pull:
    """Everything that a rate depends on besides its posterior: the domains' multipliers."""

    by_domain: tuple[float, ...]
    max_rate: float

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.clip(1 - p @ np.array(self.by_domain), 0, self.max_rate) if self.by_domain else np.ones(len(p))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _sums(pulls: list[Pull]):
    """For each pull: the dual's sum, tokens by domain, and tokens by pair of domains of rates that can move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                p, n = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                parts = []
                for pull in pulls:
                    z, r = p @ np.array(pull.by_domain), pull.rates(p)
                    free = n * ((1 - z >= 0) & (1 - z <= pull.max_rate))
                    parts += [[n @ ((r - 1) ** 2 / 2 + z * r)], (r * n) @ p, (p.T @ (free[:, None] * p)).ravel()]
                part = np.concatenate(parts)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["k", "s"])

    return run


def solve(scored: DataFrame, weights: np.ndarray, budget: float | None = None, ridge: float = 0.02, max_rate: float = 4.0, max_steps: int = 40, tolerance: float = 1e-5, relative: bool = False) -> tuple[Pull, np.ndarray]:
    """The pull towards the targets, and the targets; ``scored`` has n_tokens and posterior.

    Steps end when no domain's condition is off by more than ``tolerance`` of its target, or of the budget where the target is none.
    """
    table = scored.select("n_tokens", "posterior")
    k = len(weights)

    def sums(pulls: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(pulls), 1 + k + k * k))
        run = _sums([Pull(tuple(x.tolist()), max_rate) for x in pulls])
        for r in table.mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
            out.flat[r["k"]] = r["s"]
        return out

    pull = np.zeros(k)
    found = sums([pull])[0]
    has = found[1 : 1 + k]
    lead = int(np.argmax(weights))
    budget = budget or (has[lead] / weights[lead] if weights[lead] > 0 else 0.0) or 1.0

    own = ridge * (np.maximum(has / budget, 1e-9) if relative else np.ones(k))

    def value(x: np.ndarray, f: np.ndarray) -> float:
        return f[0] / budget - x @ weights - (own * x) @ x / 2

    for _ in range(max_steps):
        error = found[1 : 1 + k] / budget - weights - own * pull
        if (np.abs(error) <= tolerance * np.where(weights > 0, weights, 1)).all():
            break
        way = np.linalg.solve(found[1 + k :].reshape(k, k) / budget + np.diag(own), error)
        tries = [pull + way * 4.0**-i for i in range(10)]
        got = sums(tries)
        values = [value(x, f) for x, f in zip(tries, got)]
        best = int(np.argmax(values))
        if values[best] <= value(pull, found):
            break
        pull, found = tries[best], got[best]
    return Pull(tuple(pull.tolist()), max_rate), budget * weights


def _apply(pull: Pull):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = np.round(pull.rates(_matrix(batch.column(batch.num_columns - 1))), 4) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates, pa.float64())], [*batch.schema.names, "rate"])

    return run


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text: str = "text",
    budget: float | None = None,
    max_rate: float = 4.0,
    max_train: int = 20_000,
    ridge: float = 0.02,
    relative: bool = False,
) -> DataFrame:
    """All input columns but the text, ``n_tokens``, ``posterior``, ``domain`` (most likely) and ``rate``.

    ``targets`` weighs domains by name, as ``quality=1 toxic=0``; domains
    without a weight get none. Without a budget the domain of the greatest
    weight keeps its own expected tokens. ``relative`` weighs a domain's miss by its own size.
    """
    docs = drop_clashes(docs, ["n_tokens", "posterior", "domain", "rate"])
    keep = [c for c in docs.columns if c != text]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    columns = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "n_tokens long", "posterior array<double>"])
    model = train(docs.select(id_col, text), labels, id_col, text, max_train)
    domains = model.domains if model else ["all"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = materialise(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(_score(shared), columns))
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if model is None or not weights.sum():
        pull = Pull((), max_rate)
    else:
        pull, _ = solve(scored, weights / weights.sum(), budget, ridge, max_rate, relative=relative)
    best = F.get(F.array(*[F.lit(d) for d in domains]), (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return scored.mapInArrow(_apply(pull), columns + ", rate double").withColumn("domain", best)
