from __future__ import annotations

import random
import re

import numpy as np

from scriptorium.llm import licences


def grams(t):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower() if t.isascii() else t.lower())
    return {(a, b) for a, b in zip(w, w[1:])}


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_exact_and_edited_templates_are_found(spark):
    rows = [(-1, None), (-2, ""), (-3, "plain prose about nothing at all. the License"), (-4, "the mit")]
    for i, (_, _, t) in enumerate(licences.TEMPLATES):
        rows.append((i, "Ééé words before.\n" + t + "\nwords after " * 3))
    long = licences.TEMPLATES[2][2]
    rows.append((100, long.replace("merge, publish,", "merge, and publish,").replace("\n", "  \n// ")))
    rows.append((101, "x y z. " * 20000 + licences.TEMPLATES[0][2] + " q" * 50 + " " + licences.TEMPLATES[-1][2]))
    rows.append((102, long[: len(long) // 2]))
    df = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, matches string").repartition(3)
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    texts = dict(rows)
    assert len(got) == len(rows)
    for d in (-1, -2, -3, -4, 102):
        assert got[d].n_matches == 0 and got[d].licence is None and got[d].spans == ""
    for i, (name, _, t) in enumerate(licences.TEMPLATES):
        assert name in [m.licence for m in got[i].matches], (name, got[i])
        best = max(got[i].matches, key=lambda m: m.dice)
        assert best.dice == 1.0
    assert [m.licence for m in got[100].matches] == ["MIT"] and got[100].matches[0].dice > 0.9
    assert [m.licence for m in got[101].matches] == ["MIT", "proprietary"]
    for d, r in got.items():
        for m in r.matches:
            passage = texts[d][m.start : m.end]
            assert abs(m.dice - max(dice(grams(passage), grams(t)) for n, _, t in licences.TEMPLATES if n == m.licence)) < 1e-9


def test_empty(spark):
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_passage_is_missed():
    rng = random.Random(1)
    t = 0.9
    sets, lengths, _, _ = licences.templates()
    n = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(licences.TEMPLATES)[2].split()
            for _ in range(rng.randint(0, max(1, len(w) // 25)) if rng.random() < 0.4 else 0):
                w[rng.randrange(len(w))] = "zz"
            parts += [" ".join(w[rng.randint(0, max(1, len(w) // 12)) :]), " ".join(rng.choices("aa bb cc the software of".split(), k=rng.randint(0, 8)))]
        raw = np.frombuffer(" ".join(parts).encode(), np.uint8)
        two = licences._bigrams(raw, np.array([0, len(raw)]))[3]
        got = licences.match_text(two, t)
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
        for wanted, length in zip(sets, lengths):
            m, most = set(wanted.tolist()), int(length * (2 - t) / t + 1e-9)
            for i in range(len(two)):
                seen = set()
                for j in range(i, min(len(two), i + most) if int(two[i]) in m else i):
                    seen.add(int(two[j]))
                    if 2 * len(seen & m) / (len(m) + len(seen)) >= t:
                        n += 1
                        assert any(a < j + 1 and i < b for _, a, b, _ in got)
    assert n > 1000


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, licences.TEMPLATES[0][2], 5, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, `licence` int, `in0` string")
    got = licences.scan_licences(df).collect()
    assert [(r.doc_id, r.licence, r.n_matches, r.in0) for r in got] == [(1, "MIT", 1, "x")] * 3
