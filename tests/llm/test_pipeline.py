from __future__ import annotations

import importlib.util
import os

import pytest

from scriptorium.llm import decontaminate, jaccard, quality

from ..compare import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or importlib.util.find_spec("corpus_pipeline") is None, reason="no test tables")


def test_stages_take_effect_in_order(spark):
    import corpus_pipeline as cp
    from scriptorium.llm.storage import materialise
    from scriptorium.session import table

    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(materialise(stage(spark, seen[-1], SF)))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))

    assert ids[1] == {r.doc_id for r in quality.clean_lines(docs).select("doc_id", "kept").collect() if r.kept}
    found = jaccard.near_components(seen[1]).collect()
    assert ids[2] == {r.component_id for r in found}
    dirty = {r.doc_id for r in decontaminate.contamination(seen[2], table(spark, SF, "benchmark")).collect() if r.contaminated}
    assert ids[3] == ids[2] - dirty
    assert ids[5] == ids[4]
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    assert len(ids[4] & toxic) < len(ids[3] & toxic) or not ids[3] & toxic
    last = seen[-1].collect()
    assert len(last) == len(ids[4]) and {r.shard for r in last} <= set(range(40))


def test_mixing_stage_keeps_tokens_as_the_mixture_says(spark, tmp_path):
    import corpus_pipeline as cp
    from scriptorium.llm.queries import MIXTURE

    from .test_mixing import rare_tables

    domain, df, lab = rare_tables(spark)
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    docs = df.selectExpr("doc_id", "text", "'en' AS lang", "'x' AS source", "length(text) AS n_chars")
    kept = [r.doc_id for r in cp.mixing_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == sorted(r.doc_id for r in cp.mixing_stage(spark, docs.repartition(3), str(tmp_path)).collect())
    count = lambda ids: {d: sum(domain[i][1] for i in ids if domain[i][0] == d) for d, _ in domain.values()}
    has, got = count(domain), count(kept)
    budget = has["quality=1 toxic=0"] / MIXTURE["quality=1 toxic=0"]
    assert 0 < has["quality=0 toxic=1"] / budget < 0.02 and got["quality=0 toxic=1"] == 0
    for d in has:
        assert abs(got[d] / budget - MIXTURE.get(d, 0)) < 0.01, (d, got[d] / budget)


def test_stages_on_edge_rows(spark, tmp_path):
    import corpus_pipeline as cp

    def prose(seed, n=80):
        return " ".join(f"Word{seed}x{i} and then." if i % 7 == 0 else f"word{seed}x{i}" for i in range(n))

    ten = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, ten), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, prose(1)), (2, prose(1)), (3, None), (4, ""), (None, prose(2)), (5, prose(3)), (5, prose(3)), (6, prose(4) + " " + ten), (7, prose(5, 40_000)), (8, "short")]
    df = spark.createDataFrame([(d, t, "en", None, len(t or ""), "x", 1, 2) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `__lost` string, `rate` int, `shard` int").repartition(3)
    ids = lambda name, docs: sorted((r.doc_id for r in dict(cp.STAGES)[name](spark, docs, str(tmp_path)).collect()), key=str)
    kept = ids("quality rules", df)
    assert 1 in kept and None in kept and kept.count(5) == 2 and not {3, 4, 8} & set(kept)
    assert ids("n-gram Jaccard join", df) == sorted([d for d, _ in rows if d != 2], key=str)
    assert ids("benchmark decontamination", df) == sorted([d for d, _ in rows if d != 6], key=str)
    assert ids("mixing to target weights", df) == sorted([d for d, _ in rows], key=str)
    last = cp.sharding_stage(spark, df, str(tmp_path)).collect()
    assert len(last) == len(rows) and len({(r.shard, r.slot) for r in last}) == len(rows)
    for name, stage in cp.STAGES:
        out = stage(spark, df.limit(0), str(tmp_path))
        assert out.collect() == [], name
        assert out.columns[:5] == cp.COLUMNS and "__lost" not in out.columns
