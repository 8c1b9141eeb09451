"""Shares of a query's terms that documents hold, texts split once, and pools that ask vectors for their first k."""

from pyspark.sql import functions as F

from marlowe.operators import metrics, retrieve
from marlowe.plans import navigation, ranking

SF = "/root/testdata/sf0.001"


def corpus(spark):
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(words[(i * j) % 12] for j in range(1, 1 + i % 9)) for i in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id BIGINT, text STRING").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(words[q : q + 5]) + " nowhere") for q in range(7)], "qid BIGINT, text STRING")
    return docs, queries


def test_only_pairs_of_the_least_share_leave_their_tasks(spark):
    docs, queries = corpus(spark)
    d, q = ({r[0]: set((r[1] or "").split()) for r in x.collect()} for x in (docs, queries))
    want = {(i, j): len(d[j] & q[i]) / len(q[i]) for i in q for j in d if len(d[j] & q[i]) / len(q[i]) >= 0.4}
    out = retrieve.shares(retrieve.tokenised(docs), retrieve.query_terms(queries), 0.4, block=3)
    assert {(r["qid"], r["doc_id"]): r["share"] for r in out.collect()} == want
    assert 0 < len(want) < len(retrieve.bm25(retrieve.postings(docs), retrieve.query_terms(queries), retrieve.collection(docs)).collect())
    assert retrieve.shares(retrieve.tokenised(docs), retrieve.query_terms(queries.limit(0)), 0.4).count() == 0


def test_the_vocabulary_is_that_of_the_postings(spark):
    docs, _ = corpus(spark)
    want = {r["term"]: r["df"] for r in retrieve.document_counts(retrieve.postings(docs)).collect()}
    assert {r["term"]: r["df"] for r in retrieve.vocabulary(retrieve.tokenised(docs), rows=7).collect()} == want


def test_best_gains_from_the_numbers_of_each_grade(spark):
    grades = [(1, i, g) for i, g in enumerate([5, 3, 3, 2, 1, 1, 1, 1])] + [(2, i, 1) for i in range(3)]
    qrels = spark.createDataFrame(grades, "qid INT, doc_id INT, grade INT")
    run = spark.createDataFrame([(1, 7, 1), (1, 1, 2), (1, 99, 3), (2, 0, 1)], "qid INT, doc_id INT, rank INT")
    out = metrics.graded(run, qrels, [1, 2, 5])
    for r in out.collect():
        gs = [g for q, _, g in grades if q == r["qid"]]
        gain = {g: min(g / 5 * (len(gs) / gs.count(g)), 5) * g for g in gs}
        best = sum(sorted((gain[g] for g in gs), reverse=True)[: r["k"]])
        of = {(q, d): g for q, d, g in grades}
        got = sum(gain[of[q, d]] for q, d, rank in [(1, 7, 1), (1, 1, 2), (1, 99, 3), (2, 0, 1)] if q == r["qid"] and rank <= r["k"] and (q, d) in of)
        assert abs(r["ra_nwg"] - got / best) < 1e-12
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_texts_are_split_once(spark):
    b = ranking.Base(spark, SF)
    run = b.bm25(10)
    assert "regexp_extract_all" not in run._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in b.tokens._jdf.queryExecution().optimizedPlan().toString()


def test_pools_ask_vectors_for_their_first_k(spark, monkeypatch):
    asked, dense = [], ranking.Base.dense
    monkeypatch.setattr(ranking.Base, "dense", lambda self, k=None: asked.append(k) or dense(self, k))
    for query in (navigation.pool_rerank, navigation.tiered_padding):
        assert query(spark, SF).where(F.col("rank") == 1).count() > 0
    assert asked == [100, 5]
