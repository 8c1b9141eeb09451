"""Hand-checked hooks, parsers, re-ranking, loops, packing and reports."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.operators import agents, packing, reports


@pytest.mark.parametrize(("answer", "want"), [
    ("Pensée\nAction: search[bail à ferme]", ("search", "bail à ferme")), ("action : LOOKUP[ 12 ]", ("lookup", "12")), ("Action: lookup[douze]", ("lookup", None)), ("Action: finish[]", ("finish", None)),
    ("Action: search(« bail »)", ("search", "bail")), ("Action: search « bail »", ("search", "bail")), ('Action: search: "bail"\n', ("search", "bail")), ("Action: search bail rural\nfin", ("search", "bail rural")), ("rien", (None, None)), ("", (None, None)), (None, (None, None)),
])
def test_actions(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a STRING")
    assert tuple(df.select(agents.action(F.col("a")).alias("x")).first()["x"]) == want
    strict = df.select(agents.action(F.col("a"), permissive=False).alias("x")).first()["x"]["verb"]
    assert strict == (want[0] if answer and "[" in answer else None)


def test_null_buckets_and_paraphrases(spark):
    rows = [("Désolé, rien", 5, "refusal_or_empty"), (None, 5, "refusal_or_empty"), ("Je pense", 5, "prose_only"), ("Action: search[bail", 60, "max_tokens_truncation"), ("Action: search « a »", 5, "french_quotes"), ("Action: search(a)", 5, "wrong_bracket_shape")]
    df = spark.createDataFrame(rows, "a STRING, n INT, want STRING")
    assert all(r[0] == r[1] for r in df.select("want", agents.null_bucket(F.col("a"), F.col("n"))).collect())
    df = spark.createDataFrame([("1. un\n\n2) deux\ntrois\n4. quatre\n5. cinq",), ("1.\n2.",)], "a STRING")
    assert [r[0] for r in df.select(agents.paraphrases(F.col("a"))).collect()] == [["un", "deux", "trois", "quatre"], ["1.", "2."]]


def test_picks():
    assert agents.picks_of('```json\n{"ids": ["a", 1, "b"]}\n```', "ids") == ["a", "b"]
    assert agents.picks_of('[{"ids": ["a"]}, 3, {"ids": ["b"]}, {"ids": "c"}]', "ids") == ["a", "b"]
    assert agents.picks_of("no", "ids") == agents.picks_of(None, "ids") == agents.picks_of("3", "ids") == []


def test_hooks_and_reranking(spark):
    texts = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (3, None), (4, "blue whale")], "doc_id INT, text STRING")
    run = spark.createDataFrame([(9, d, 1.0, r) for r, d in enumerate((4, 3, 2, 1), 1)], "qid INT, doc_id INT, score DOUBLE, rank INT")
    queries = spark.createDataFrame([(9, "red fox")], "qid INT, query STRING")
    got = sorted(agents.reranked(run, queries, texts, agents.overlap_scores, 3).collect(), key=lambda r: r["rank"])
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, 1.0), (2, 0.5), (4, 0.0)]
    v = agents.hooked(texts, ["text"], agents.hashed_vectors(16), "vector", T.ArrayType(T.DoubleType())).collect()
    assert [round(sum(x * x for x in r["vector"]), 6) for r in v] == [1.0, 1.0, 0.0, 1.0]
    assert agents.hooked(texts.limit(0), ["text"], agents.hashed_vectors(16), "vector", T.ArrayType(T.DoubleType())).count() == 0


def test_loop_keeps_the_most_confident_round(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid INT, query STRING")

    def retrieve(q, k):
        return q.select("qid", F.length("query").alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    def judge(run):  # query 1 at once, query 2 after one rewriting, query 3 never, best in round 1
        return run.select("qid", F.when((F.col("qid") == 1) | (F.col("qid") == 2) & (F.col("doc_id") == 2), 0.8).when(F.col("doc_id") == 2, 0.4).otherwise(0.1).alias("confidence"))

    run, trace = agents.loop(queries, retrieve, judge, lambda q: q.withColumn("query", F.concat("query", F.lit("+"))))
    assert sorted((r["qid"], r["doc_id"]) for r in run.collect()) == [(1, 1), (2, 2), (3, 2)]
    stats = agents.loop_stats(trace).first()
    assert (stats["n_queries"], round(stats["at_once"], 3), round(stats["corrected"], 3), round(stats["never"], 3), stats["mean_rounds"]) == (3, 0.333, 0.333, 0.333, 2.0)


def test_kendall_and_pairs(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 3), ("g", 3, 2), ("g", 4, 4), ("h", 1, 1), ("h", 1, 2)], "g STRING, x INT, y INT")
    assert {r["g"]: r["tau"] and round(r["tau"], 6) for r in reports.kendall(df, "x", "y", "g").collect()} == {"g": 0.666667, "h": None}
