"""Queries against their SQL on rows that the given tables lack, or have only at larger sizes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from scriptorium import plans
from scriptorium.operators import ranking, scan, search

from .compare import SF, assert_same


@pytest.fixture
def same(spark, tmp_path):
    """Compare a query with its SQL on given tables: rows and schema by table name."""

    def check(names, **tables):
        for name, (rows, schema) in tables.items():
            path = f"{tmp_path}/{name}.parquet"
            if not os.path.exists(path):
                spark.createDataFrame(rows, schema).toPandas().to_parquet(path, index=False)
        for name in names:
            assert_same(spark, plans.QUERIES[name], plans.ORACLES[name], str(tmp_path))

    return check


def test_word_edges_and_case_are_those_of_the_sql(same):
    texts = ["a testä b", "étests", "teſt", "ſchedule feeſ", "list of\rcourses", "list of\ncourses", "list of courſes", "TEST CENTRES", "exam\x0bcentre", "exam\xa0centre", "exam centre", "TUITION", "marKsheets", "_test", "how long", "which options", "", None]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)] + [(99, 1, "assistant", "You are eligibleä, guaranteed admiſſion")]
    same(("query_intents", "route_mode", "overclaim_flags"), conversations=(rows, "conv_id long, turn long, role string, text string"))


RANKINGS = (
    "bm25_scores", "candidate_rank", "rank_filtered_by_type", "hash_features_sparse", "hash_features_trigrams", "rrf_fusion", "hybrid_topk", "hybrid_trigrams_topk", "rrf_topk", "candidate_union", "hydrate_chunks",
    "hydrate_parent_left", "hydrate_parent_inner", "boosted_scores", "discover_topk", "merge_dedupe", "ctx_render", "eval_hit_at_k", "eval_rank_limit", "eval_accuracy",
)


def test_rankings_of_empty_missing_copied_and_folded_texts(same):
    texts = ["fee due now", "Fee DUE", "", None, "İst Kept strasse", "straße fee fee fee", "a", "?!"] + ["copy of one text"] * 60 + [f"w{i} w{i % 7} fee" for i in range(60)]
    docs = [(i, t, "fr" if i % 2 else "en", f"src{i % 9}", len(t or "")) for i, t in enumerate(texts)]
    asked = [(0, "fee due"), (1, "the fee of the copy, fee"), (2, "IST kept STRASSE"), (3, ""), (4, None), (5, "nothing here matches"), (6, "w1 w2 w3 one text")]
    same(
        RANKINGS,
        documents=(docs, "doc_id long, text string, lang string, source string, n_chars int"),
        benchmark=(asked, "item_id long, text string"),
        labels=([(i, i % 2, 0) for i in range(0, 100, 3)], "doc_id long, quality int, toxic int"),
    )


def test_boosts_have_the_level_that_a_question_opens(spark, same, tmp_path):
    asked = [(1, "fee with a bachelor degree"), (2, "fee with a MASTER's degree"), (3, "fee, I finished class 12"), (4, "the fee"), (5, None), (6, "fee"), (6, "I hold a bachelor's fee"), (6, "I have class 12 fee"), (7, "hold\nbachelor fee")]
    docs = [(i, f"fee w{i}", lang, "src1", 1) for i, lang in enumerate(["fr", "de", "es", "it", None])]
    same(
        ("boosted_scores", "discover_topk"),
        documents=(docs, "doc_id long, text string, lang string, source string, n_chars int"),
        benchmark=(asked, "item_id long, text string"),
    )
    langs = ("fr", "de", "es")
    base = {(r.query_id, r.id): r.fused for r in plans.QUERIES["rrf_fusion"](spark, str(tmp_path)).collect()}
    got = {(r.query_id, langs[r.id]) for r in plans.QUERIES["boosted_scores"](spark, str(tmp_path)).collect() if r.boosted - base[r.query_id, r.id] > 0.5 / 61 - 1e-8}
    assert got == {(1, "fr"), (3, "de"), (3, "es"), (6, "fr"), (6, "de"), (6, "es")}
    no, yes = F.lit(False), F.lit(True)
    assert spark.range(1).select(ranking.boosts(no, no, no, yes), ranking.boosts(yes, yes, yes, yes)).first()[:] == pytest.approx((0.5 / 61, 3.75 / 61))


def test_vector_ranks_of_copies_and_missing_vectors(spark, same):
    vectors = [[float((i * j) % 5 - 2) / 3 for j in range(1, 9)] for i in range(120)]
    same(("vector_topk", "vector_rank", "cosine_pairs"), embeddings=([(i, vectors[i % 40]) for i in range(120)], "vec_id long, embedding array<float>"))
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [-1.0, 0.0])], "id int, v array<float>")
    got = ranking.ranked(ranking.vector_scores(v, v.selectExpr("id AS query_id", "v AS q"), 3, False), 3, positive=False)
    assert [(r.id, r.score) for r in got.where("query_id = 1").orderBy("rank").collect()] == [(1, 5.0), (4, -1.0), (2, None)]
    assert [r.id for r in got.where("query_id = 2").orderBy("rank").collect()] == [1, 2, 3]


def test_a_task_of_all_pairs_has_few_questions(spark, same, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "PAIR_QUESTIONS", 7)
    same(("cosine_pairs", "vector_topk"), embeddings=([(i * 25, [float(i % 7), 1.0]) for i in range(50)], "vec_id long, embedding array<float>"))
    pairs = plans.QUERIES["cosine_pairs"](spark, str(tmp_path))
    asked = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count_distinct("query_id").alias("n")).collect()]
    assert sum(asked) >= 25 and max(asked) <= 7
    assert plans.QUERIES["vector_topk"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_scans_of_few_questions_equal_joins_for_many(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"w{i % 5} w{i % 3} fee {'due' * (i % 2)}") for i in range(90)] + [("none", None)], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "w1 fee"), (1, "w2 due due"), (2, "w4 w0 w1"), (3, None)], "item_id int, text string")
    rows = lambda: sorted(map(tuple, ranking.lists(docs, asked, 10).select("l", "query_id", "id", "rank").collect()))
    scanned = rows()
    monkeypatch.setattr(ranking, "MOST_QUESTIONS", 1)
    assert scanned and scanned == rows()


@pytest.mark.parametrize("name", ["hybrid_topk", "boosted_scores", "vector_topk", "cosine_pairs", "hash_features_trigrams", "bm25_scores"])
def test_neither_pairs_nor_words_are_joined_or_shuffled(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and "Generate" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan
    assert name not in ("cosine_pairs", "hash_features_trigrams", "bm25_scores") or "Exchange" not in plan


def test_search_by_a_scan_equals_search_by_joins(spark, monkeypatch):
    texts = [f"Course {i % 7} costs {i} rupees, apply by day {i % 5}. Fee: {i % 3}" for i in range(60)] + [None]
    passages = spark.createDataFrame([(f"p{i}", "en", t, "policy_section", None, "c") for i, t in enumerate(texts)], "id string, title string, text string, type string, field_name string, parent string")
    courses = spark.createDataFrame([("c", "Course 3", "other")], "parent string, course_name string, program_level string")
    asked = search.analyse(spark.createDataFrame([(1, "what is the fee of Course 3"), (2, "apply by day 4"), (3, "rupees")], "query_id long, text string"), courses)
    rows = lambda: sorted(map(tuple, search.search(passages, asked, 5).select("query_id", "id", "place", F.round("score", 9)).collect()))
    hits = search.search(passages, asked, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") >= 1
    scanned = rows()
    monkeypatch.setattr(ranking, "MOST_QUESTIONS", 1)
    assert scanned and scanned == rows()


LISTED = (
    "candidate_union", "eval_accuracy", "eval_hit_at_k", "ctx_render", "discover_topk", "eval_rank_limit", "hydrate_chunks", "hydrate_parent_inner",
    "hydrate_parent_left", "merge_dedupe", "rrf_fusion",
)


@pytest.mark.parametrize("name", LISTED)
def test_both_lists_come_from_one_scan(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "NestedLoop" not in plan
