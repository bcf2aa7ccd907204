from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import jaccard
from scriptorium.llm.components import components


def brute(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 60])
def test_against_brute_force(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(400)] + ["É", "é", "The"]
    shared = rng.choices(words, k=60)
    rows = [(0, None), (1, ""), (2, "Only three Words"), (3, "only three words"), (4, " a "), (5, "A")]
    for g in range(12):
        base = rng.choices(words, k=rng.randint(8, 120)) + (shared if g % 2 else [])
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((10 * len(rows) + 7, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    rows += [(5000 + i, rows[20][1]) for i in range(15)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, percent=percent, sketch_bits=12).collect()}
    assert got == brute(rows, 5, percent)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (300, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[300] == 200


def variants(rng, words, groups, size, most):
    """Groups of texts that share most of their words; some pairs of a group link, others do not."""
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=size)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    return rows


def test_each_order_drops_candidates_and_no_link_is_lost(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    # texts that share most of six passages, among so many that a small sketch can't tell which shingles are rare
    block = lambda: " ".join(rng.choices(words, k=12))
    mixed = []
    for _ in range(30):
        base = [block() for _ in range(6)]
        for _ in range(6):
            new = rng.sample(range(6), rng.choice([1, 2]))
            mixed.append((len(mixed), " ".join(block() if i in new else b for i, b in enumerate(base))))
    mixed += [(10_000 + i, " ".join(block() for _ in range(6))) for i in range(2500)]
    join = jaccard._Join(spark.createDataFrame(mixed, "doc_id long, text string"), "doc_id", "text", 5, 80, 10)
    pairs = join.all_pairs(join.shared.withColumn("c", F.col("id"))).cache()
    sets = join.texts.mapInArrow(jaccard._sets_of(5, 80, join.levels), jaccard.SETS).cache()
    left = [jaccard.passing(pairs, sets, 80, orders).count() for orders in (("first",), ("first", "second"), ("first", "second", "third"))]
    assert pairs.count() > left[0] > left[1] > left[2]

    rows = variants(rng, words, 40, 60, 4) + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links, members = jaccard.near_links(df, sketch_bits=16)
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(56)} for d, t in rows[:-2]}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    member = {r.doc_id: (r.n_shingles, r.class_id) for r in members.collect()}
    assert member == {**{d: (len(s), min(e for e in sets if sets[e] == s)) for d, s in sets.items()}, 1000: (0, 1000), 1001: (0, 1001)}
    classes = sorted({c for d, (_, c) in member.items() if d in sets})
    want = {(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :] if near(a, b)}
    assert {(r.u, r.v) for r in links.collect()} == want and len(want) > 20


def test_a_family_below_the_threshold_gives_candidates_in_proportion(spark):
    rng = random.Random(4)
    base = [f"t{i}" for i in range(80)]

    def candidates(n):
        rows = []
        for i in range(n):
            w = list(base)
            for j in range(6):
                w[13 * j + rng.randint(0, 6)] = f"own{i}_{j}"
            rows.append((i, " ".join(w)))
        join = jaccard._Join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 80, 20)
        return join.all_pairs(join.shared.withColumn("c", F.col("id"))).count()

    small, large = candidates(150), candidates(600)
    assert small < 150 and large <= 4 * max(small, 150)


def test_edges(spark):
    df = spark.createDataFrame(
        [(5, "a b c d e f", 1, "x"), (5, "p q r s t u", 2, "x"), (9, "p q r s t u", 3, "x"), (7, "a b c d e f", 4, "x"), (None, "A b c d e f", 5, "x"), (8, None, 6, "x"), (9, "p q r s t u", 3, "x")],
        "doc_id long, text string, id int, token string",
    )
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(df).collect()), key=str)
    # a null id sorts first, so what is linked with it has a null component
    assert got == sorted([(5, 2, None), (5, 2, None), (9, 2, None), (9, 2, None), (7, 2, None), (None, 2, None), (8, 0, 8)], key=str)
    assert jaccard.near_components(df.limit(0)).collect() == []
