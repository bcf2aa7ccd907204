"""Edge rows of the operators that are column expressions alone; their SQL twins cover the rest."""

from __future__ import annotations

import random
import re
import zlib

from scriptorium.llm import decontaminate, quality, shards

PROSE = "Quite ordinary words stand here in a sentence that says little but says it well, again. " * 6


def test_lines_fail_by_their_own_rules_and_documents_by_their_loss(spark):
    good = " ".join(f"Word{i} and more{i} of it{i}." for i in range(40))
    rows = [
        (1, good),
        (2, good + "\nHome | About | Contact | Help\nAll rights reserved.\nmenu"),
        (3, "\n".join(f"a{i} | b{i} | c{i} | d{i} |" for i in range(40))),
        (4, None),
        (5, ""),
        (6, "x " * 200),
        (7, good.upper()),
        (8, "É " + good),
    ]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in quality.clean_lines(df).collect()}
    assert {d for d, r in got.items() if r.kept} == {1, 2, 8}
    assert got[2].clean_text == good and got[2].n_failed_lines == 3
    assert got[4].n_words == got[5].n_words == 0 and got[4].base_failed
    assert got[6].n_repeat_words == 200 and got[6].base_failed
    assert not got[3].base_failed and not got[3].kept
    assert quality.clean_lines(df.limit(0)).collect() == []


def test_shards_match_the_mixture(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}" if i % 5 else None, None if i == 4 else f"é{i}") for i in range(1000)] + [(4, None, None)] * 3
    df = spark.createDataFrame([(d, s, t, 9) for d, s, t in rows], "doc_id long, source string, text string, shard int").repartition(6)
    got = shards.interleave(df, n_shards=8).collect()
    assert len(got) == len(rows)
    by = {k: sorted(r.slot for r in got if r.shard == k) for k in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for k in range(8):
        share = sum(r.source == "hot" for r in got if r.shard == k) / len(by[k])
        assert abs(share - 666 / 1003) < 0.02
    assert all(r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    assert shards.interleave(df.limit(0)).collect() == []


def test_contamination_edges(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten + " eleven"), (2, "just three words"), (3, ""), (4, None), (5, ten.upper() + " Eleven!"), (6, "ÉCOLE"), (7, "nowhere to be found")]
    docs = [
        (1, f"x {ten} y"),
        (2, "Just-three; WORDS just three words"),
        (3, None),
        (4, ""),
        (5, "one two three four five six seven eight nine"),
        (6, "école ÉCOLE"),
        (7, f"{ten} eleven {ten}"),
        (7, f"{ten} eleven {ten}"),
    ]
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_words int")
    for limit in (10**6, 0):  # both joins
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(d, i, broadcast_words=limit).collect()}
        assert got == {
            1: (12, 10, ["1", "5"]),
            2: (6, 6, ["2"]),
            3: (0, 0, []),
            4: (0, 0, []),
            5: (9, 0, []),
            6: (2, 1, ["6"]),
            7: (21, 21, ["1", "5"]),
        }
    assert decontaminate.contamination(d.limit(0), i).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.contamination(d, i.limit(0)).collect())


def test_operators_keep_columns_of_any_name(spark):
    names = ["__key", "__stratum", "__t", "__w", "in0", "row", "key"]
    made = spark.createDataFrame([(i, f"s{i % 2}", PROSE + str(i), *range(len(names))) for i in range(20)], ["doc_id", "source", "text", *names])
    for got in (shards.interleave(made, n_shards=4), quality.clean_lines(made)):
        rows = got.collect()
        assert set(names) <= set(got.columns) and len(rows) == 20
        assert all([r[n] for n in names] == list(range(len(names))) for r in rows)
    items = spark.createDataFrame([(1, "Quite ordinary words stand here in a sentence that says little", 7)], "item_id long, text string, row int")
    assert all(r.contaminated for r in decontaminate.contamination(made, items).collect())


def test_small_and_large_strata_share_the_slices(spark):
    rows = [(i, f"one{i}" if i < 300 else "big", "x") for i in range(1500)] + [(None, "big", None), (None, None, "")]
    got = shards.interleave(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5), n_shards=7).collect()
    by = {k: sorted(r.slot for r in got if r.shard == k) for k in range(7)}
    assert len(got) == 1502 and all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    # sources of one row all have the middle rank
    assert {r.shard for r in got if r.source and r.source.startswith("one")} <= {2, 3, 4}
    big = [sum(r.source == "big" for r in got if r.shard == k) for k in (0, 1, 5, 6)]
    assert max(big) - min(big) <= 1


def test_contamination_gives_each_row_its_own_result_in_both_joins(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["É", "the"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 5, 12, 14])))) for i in range(30)] + [(99, "The"), (98, None)]
    docs = [(i // 2 if i % 7 else None, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    docs += [(500 + i, "x " + items[i][1].upper() + " y") for i in range(30)] + [(700, None), (700, "")]
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def brute(text):
        ws, hit, found = split(text), set(), set()
        for i, t in items:
            w = split(t)
            for s in range(max(len(w) - 10, 0) + 1) if w else []:
                part = w[s : s + 10]
                for p in range(len(ws) - len(part) + 1):
                    if ws[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        found.add(str(i))
        return len(ws), len(hit), sorted(found)

    want = sorted((str(d), *map(str, brute(t))) for d, t in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        rows = decontaminate.contamination(df, it, broadcast_words=limit).collect()
        assert sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(r["items"])) for r in rows) == want
