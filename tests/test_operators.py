from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import vectors
from scriptorium.operators import layout, questions, ranking
from scriptorium.sources import corpus
from scriptorium.streaming import reviews


def test_bad_page_ranges_raise(spark):
    for bad in ("5-2", "0", "a", "1,,2"):
        with pytest.raises(Exception, match="bad page range"):
            spark.range(1).select(corpus.page_numbers(F.lit(bad))).collect()


def test_pack_lines_keeps_an_oversize_line(spark):
    df = spark.createDataFrame([(["a b", "c", "d e f g h", "i"],)], "ls array<string>")
    assert df.select(layout.pack_lines(F.col("ls"), 3).alias("p")).first().p == ["a b\nc", "d e f g h", "i"]
    with pytest.raises(ValueError):
        layout.pack_lines(F.col("ls"), 0)


def test_limits_are_checked(spark):
    df = spark.createDataFrame([(1, 2, 0.5)], "query_id int, id int, score double")
    with pytest.raises(ValueError):
        ranking.ranked(df, 0)
    with pytest.raises(ValueError):
        vectors.hash_embedding(32)


def test_ties_keep_position_and_only_positive_scores_rank(spark):
    df = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.0), (1, 5, -1.0)], "query_id int, id int, score double")
    assert [(r.id, r["rank"]) for r in ranking.ranked(df).orderBy("rank").collect()] == [(3, 1), (9, 2)]


def test_review_stream_keeps_the_last_decision(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()

    def arrive(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps({"record_id": a, "status": b, "reviewed_at": c, "reviewer": "x"}) for a, b, c in rows))
        reviews.follow(spark, str(inbox), store, str(tmp_path / "cp")).awaitTermination()
        return {r.record_id: r.status for r in spark.read.schema(reviews.SCHEMA).parquet(store).collect()}

    assert arrive("1.json", ("a", "approved", "2026-01-02T00:00:00"), ("b", "rejected", "2026-01-01T00:00:00")) == {"a": "approved", "b": "rejected"}
    assert arrive("2.json", ("a", "rejected", "2026-01-01T00:00:00"), ("b", "approved", "2026-01-03T00:00:00")) == {"a": "approved", "b": "approved"}


def test_aliases_intents_and_context_keys_are_whole(spark):
    assert len(questions.ALIASES) == 40 and len(questions.WORD_LIKE) == 7
    cases = {
        "BALLB fees": "Bachelor of Arts and Bachelor of Laws fees",
        "B.Lib.I.Sc. and m lib seats": "Bachelor of Library and Information Science and Master of Library and Information Science seats",
        "P.G. Diploma, PGDCP": "Post Graduate Diploma, Post Graduate Diploma in Computer Programming",
        "M.Arch. or MEd or b.ed now": "Master of Architecture or Master of Education or Bachelor of Education now",
        "a bed in march, ma plan": "a bed in march, ma plan",
    }
    df = spark.createDataFrame(list(cases.items()), "q string, want string")
    for r in df.select("want", questions.expand(F.col("q")).alias("got")).collect():
        assert r.got == r.want
    asked = spark.createDataFrame([("What age must I be?", "age_limit"), ("the selection process", "selection"), ("exam centres in town", "test_centres"), ("syllabus", "test_paper")], "q string, want string")
    for r in asked.select("want", questions.intents(F.col("q")).alias("got")).collect():
        assert r.want in r.got
    lines = spark.createDataFrame([("science seats", "Faculty: Science", False), ("science seats", "Subject: Science", True)], "q string, p string, want boolean")
    for r in lines.select("want", questions.exact_value(F.col("q"), F.col("p")).alias("got")).collect():
        assert r.got == r.want


def test_trigrams_join_words_that_share_parts_only(spark):
    df = spark.createDataFrame([(1, "admission"), (2, "admissions"), (3, None)], "doc_id long, text string")

    def shared(**how):
        rows = ranking.sparse_features(df, "doc_id", "text", **how).collect()
        a, b = ({r.bucket: r.weight for r in rows if r.id == i and r.weight} for i in (1, 2))
        return sum(a[k] * b[k] for k in a.keys() & b.keys())

    assert shared() == 0
    assert shared(trigrams=True) > 0.2


def test_hash_vectors_have_the_sign_of_the_top_bit():
    # bucket of 64 and sign of each feature of "fee due", worked out by hand from its digest
    features = {}
    for name, weight in [("w:fee", 1.0), ("w:due", 1.0), ("b:fee_due", 1.25), *[(f"c:{t}", 0.2) for t in ("fee", "ee_", "e_d", "_du", "due")]]:
        digest = hashlib.blake2b(name.encode(), digest_size=8).digest()
        bucket = digest[0] % 64
        features[bucket] = features.get(bucket, 0) + (weight if digest[7] >= 128 else -weight)
    got = vectors.hash_vector(["fee", "due"], 64)
    norm = sum(x * x for x in features.values()) ** 0.5
    assert all(abs(got[i] - features.get(i, 0) / norm) < 1e-6 for i in range(64))
    assert vectors.hash_vector(["fee"], 64)[19] > 0.9 and vectors.hash_vector([], 64).tolist() == [0.0] * 64


def test_vector_literals_and_sparse_features_agree_with_vectors(spark):
    df = spark.createDataFrame([(["fee", "due"], [0.5, -1.25e-7, 1.0]), (None, None)], "w array<string>, v array<double>")
    one, none = df.select(vectors.hash_features(64)("w").alias("f"), vectors.hash_embedding(64)("w").alias("e"), vectors.vector_literal(F.col("v")).alias("s")).collect()
    assert {x.bucket: x.weight for x in one.f} == {i: x for i, x in enumerate(one.e) if x} and one.s == "[0.500000000,-1.25000000e-07,1.00000000]"
    assert none.f == [] and none.s is None


def test_vector_literals_round_exact_halves_to_even(spark):
    rows = [([1.0390625, 1.0234375, -1.0390625, 0.0, -0.0, None, float("nan"), float("inf")],), ([],), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "v array<float>").coalesce(1).select(vectors.vector_literal(F.col("v"), "%.6e").alias("s")).collect()]
    assert got == ["[1.039062e+00,1.023438e+00,-1.039062e+00,0.000000e+00,-0.000000e+00,nan,inf]", "[]", None]
