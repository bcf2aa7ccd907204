from __future__ import annotations

import random

import numpy as np

from scriptorium.llm import mixing


def corpus(n=400):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = rng.choices(words, k=rng.randint(20, 60)) + (["nasty", "vile"] if bad else [])
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(bad)))
    return docs + [(9001, None), (9002, "")], labels


def dense(p, n, target, budget, ridge, top, steps=4000):
    """Plain projected gradient over all rates at once."""
    r = np.ones(len(n))
    step = 1.0 / (n.sum() / budget + ridge)
    for _ in range(steps):
        e = ((r * n) @ p - target) / budget
        r = np.clip(r - step * (p @ e + ridge * (r - 1)), 0, top)
    return r


def test_rates_equal_a_plain_solver_and_held_out_labels(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, rate string").repartition(4)
    lab = spark.createDataFrame([*labels, (77777, 1), (3, None)], "doc_id long, toxic int")
    rows = mixing.mix(df, lab, {"toxic=0": 0.9, "toxic=1": 0.1}).collect()
    assert len(rows) == len(docs)
    known = {i for i, _ in labels}
    held = [r for r in rows if r.doc_id < 9000 and r.doc_id not in known]
    assert np.mean([(r.domain == "toxic=1") == (r.doc_id % 4 == 0) for r in held]) > 0.95
    p, n = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows], float)
    weights = np.array([0.9, 0.1])
    has = n @ p
    budget = has[0] / 0.9
    want = dense(p, n, budget * weights, budget, 0.02, 4.0)
    got = np.array([r.rate for r in rows])
    assert np.abs(got - want).max() < 0.02
    total = (got * n) @ p
    assert np.abs(total / total.sum() - weights).max() < 0.02


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.doc_id, r.n_tokens, r.rate, r.domain) for r in mixing.mix(df, none, {"toxic=0": 1.0}).collect()} == {(1, 2, 1.0, "all"), (2, 0, 1.0, "all")}
    assert mixing.mix(df.limit(0), none, {}).collect() == []


MIXTURE = {"quality=1 toxic=0": 0.95, "quality=0 toxic=0": 0.05}


def rare_corpus(n=3000):
    """Documents of three domains, one rare and without a weight: (id, text, domain)."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        q, t = (0, 1) if i % 100 == 0 else (int(i % 6 > 0), 0)
        w = rng.choices(words, k=rng.randint(20, 60)) + (["junk", "spam", "cheap", "win"] if q == 0 else ["sound", "fine", "clear", "good"]) + (["nasty", "vile", "foul", "grim"] if t else ["mild", "kind", "calm", "warm"])
        rng.shuffle(w)
        out.append((i, " ".join(w), f"quality={q} toxic={t}"))
    return out


def rare_tables(spark):
    docs = rare_corpus()
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame([(i, int(d[8]), int(d[-1])) for i, _, d in docs if i % 2 == 0], "doc_id long, quality int, toxic int")
    return {i: (d, len(t.split())) for i, t, d in docs}, df, lab


def test_rare_domain_without_weight_goes_and_totals_reach_the_targets(spark, monkeypatch):
    from scriptorium.llm import queries

    domain, df, lab = rare_tables(spark)
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: {"documents": df, "labels": lab}[name])
    rows = queries.op2(spark, "").collect()
    has, total = {}, {}
    for r in rows:
        d, n = domain[r.doc_id]
        has[d] = has.get(d, 0) + n
        total[d] = total.get(d, 0) + n * r.rate
    budget = has["quality=1 toxic=0"] / 0.95
    assert 0 < has["quality=0 toxic=1"] / budget < 0.02
    for d in has:
        assert abs(total[d] / budget - MIXTURE.get(d, 0)) < 0.003, (d, total[d] / budget)
