from __future__ import annotations

import hashlib
import random
import re

import pytest

from scriptorium.llm import repeats


def brute(rows, window):
    docs = sorted((d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows)
    seen, out = set(), {}
    for d, ws in docs:
        gone = set()
        for s in range(len(ws) - window + 1):
            g = tuple(ws[s : s + window])
            if g in seen:
                gone.update(range(s, s + window))
            seen.add(g)
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out[d] = (len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,block,parts", [(20, 10, 3), (5, 3, 2), (2, 1, 5)])
def test_against_brute_force(spark, window, block, parts):
    rng = random.Random(window)
    words = [f"é{i}" if i % 5 == 0 else f"w{i}" for i in range(2000)]
    passages = [rng.choices(words, k=rng.randint(1, 45)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two")]
    for i in range(4, 120):
        ws = []
        for _ in range(rng.randint(0, 6)):
            ws += rng.choices(words, k=rng.randint(0, 30)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((i * 7 - 3000, rng.choice([" ", "\n", "  \t"]).join(ws)))
    rows += [(900 + i, rows[40][1]) for i in range(30)] + [(1000, "x " * 5000)]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, key string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, window=window, block=block, parts=parts).collect()}
    assert got == brute(rows, window)


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (9, t)], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_removed) for r in repeats.remove_repeats(df, parts=2).collect())
    assert [g[1] for g in got] == [0, 25, 25, 25]
    clash = spark.createDataFrame([(1, t), (1, 'x'), (0, t)], 'doc_id long, text string')
    assert len(repeats.remove_repeats(clash, parts=2).collect()) == 3
    assert repeats.remove_repeats(df.limit(0), parts=2).collect() == []
