"""Hand-checked fixtures and invariants of ranking, metrics, fusion and statistics."""

import math

import pytest
from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators import fuse, metrics, retrieve, stats


def run(spark, lists):
    return spark.createDataFrame([(q, d, float(len(ds) - i), i + 1) for q, ds in lists.items() for i, d in enumerate(ds)], "qid STRING, doc_id STRING, score DOUBLE, rank INT")


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 1), ("q1", "c", 1), ("q2", "d", 1), ("q3", "z", 0)], "qid STRING, doc_id STRING, grade INT")
    scores = metrics.per_query(run(spark, {"q1": ["a", "x", "b"], "q2": ["y", "d"], "q3": ["z"]}), qrels, [3])
    m = metrics.suite(scores).first()
    assert m["n_queries"] == 2 and m["precision"] == pytest.approx(0.5) and m["recall"] == pytest.approx(0.833333, abs=1e-6)
    assert m["f1"] == pytest.approx(0.625) and m["hit"] == 1 and m["rr"] == pytest.approx(0.75) and m["ap"] == pytest.approx(0.527778, abs=1e-6)
    one = scores.where("qid = 'q1'").first()
    assert one["ndcg"] == pytest.approx(0.703918, abs=1e-6) and one["ndcg_retrieved"] == pytest.approx(0.919721, abs=1e-6)
    gold = {r["qid"]: r for r in metrics.rank_of_gold(run(spark, {"q1": ["a", "x", "b"], "q2": ["d"]}), qrels).collect()}
    assert gold["q1"]["last_rank"] is None and gold["q2"]["last_rank"] == 1


def test_fusion_twins(spark):
    s, d = run(spark, {"q": ["a", "b"]}), run(spark, {"q": ["b", "c"]})
    got = {m: {r["doc_id"]: r["score"] for r in fuse.rrf([s, d], missing=m).collect()} for m in ("rank", "zero", "length")}
    assert got["rank"]["a"] == pytest.approx(1 / 61 + 1 / 161) and got["zero"]["a"] == pytest.approx(1 / 61) and got["length"]["a"] == pytest.approx(1 / 61 + 1 / 63)
    assert all(max(x, key=x.get) == "b" for x in got.values())
    order = lambda a: [r["doc_id"] for r in retrieve.top_k(fuse.linear(d, s, alpha=a), 2).collect()]
    assert order(1.0) == ["b", "c"] and order(0.0) == ["a", "b"]


def test_filter_before_and_after_the_cut(spark):
    rows = spark.range(600).select(F.lit("q").alias("qid"), F.col("id").alias("doc_id"), (-F.col("id")).cast("double").alias("score"))
    assert retrieve.filtered_top_k(rows, F.col("doc_id") >= 590, 5, mode="post").count() == 0
    assert retrieve.filtered_top_k(rows, F.col("doc_id") >= 590, 5).count() == 5


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "c d e")], "doc_id INT, text STRING")
    query = spark.createDataFrame([(0, "b")], "qid INT, text STRING")
    got = {r["doc_id"]: r["score"] for r in retrieve.bm25(retrieve.postings(docs), retrieve.query_terms(query), retrieve.collection(docs), variant="plus").collect()}
    want = math.log(4 / 2) * (1 + 2 * 2.5 / (1.5 * (0.25 + 0.75 * 3 / (8 / 3)) + 2))
    assert got[1] == pytest.approx(want)


def test_text(spark):
    row = spark.createDataFrame([("L'Été, art. 3bis œuf", "Oui, 7,5", "a  b c")], "t STRING, j STRING, w STRING").select(tx.tokens(F.col("t")), tx.first_signed_number(F.col("j")), tx.yes_no(F.col("j")), tx.first_words(F.col("w"), 2, " …"), tx.match_key(F.col("t"))).first()
    assert row[0] == ["l", "été", "art", "3bis", "œuf"] and row[1] == 7.5 and row[2] == 1 and row[3] == "a b …" and row[4].startswith("l'ete")


def test_latency_and_statistics(spark):
    t = spark.createDataFrame([("a", x) for x in (42.0, 38.5, 55.0)], "s STRING, v DOUBLE")
    r = metrics.latency(t, "s", "v").first()
    assert r["mean_ms"] == pytest.approx(45.166667, abs=1e-6) and r["qps"] == pytest.approx(22.140221, abs=1e-6)
    assert stats.student_t_p(2.228, 10) == pytest.approx(0.05, abs=1e-4) and stats.student_t_p(12.706, 1) == pytest.approx(0.05, abs=1e-4) and stats.student_t_p(0.0, 5) == 1
    same = spark.createDataFrame([(i, 1.0) for i in range(4)], "q INT, v DOUBLE")
    assert {x["stratum"] for x in stats.lexical_strata(same, "v").collect()} == {"aligned"}
    ties = spark.createDataFrame([("c", "x", 1.0), ("c", "y", 1.0)], "cell STRING, s STRING, v DOUBLE")
    assert {x["wins"] for x in stats.wins_matrix(ties, ["cell"], "s", "v").collect()} == {0.5}
