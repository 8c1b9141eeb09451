"""What a re-ranked pool shuffles."""

from marlowe.operators import agents


def test_a_pool_reranked_shuffles_no_text(spark):
    texts = spark.createDataFrame([(i, f"w{i % 7} v{i % 5}") for i in range(300)], "doc_id BIGINT, text STRING").repartition(3)
    run = spark.createDataFrame([(q, (q * 37 + r * 11) % 300, r) for q in range(20) for r in range(1, 11)], "qid BIGINT, doc_id BIGINT, rank INT")
    queries = spark.createDataFrame([(q, f"W{q % 7} v{q % 5}") for q in range(20)], "qid BIGINT, query STRING")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = agents.reranked(run, queries, texts, agents.overlap_scores, 4)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin [doc_id" in plan
    want = {}
    for q in range(20):
        pool = [((q * 37 + r * 11) % 300, r) for r in range(1, 11)]
        score = {d: len({f"w{q % 7}", f"v{q % 5}"} & {f"w{d % 7}", f"v{d % 5}"}) / 2 for d, _ in pool}
        best = sorted(pool, key=lambda x: (-score[x[0]], x[1]))[:4]
        want |= {(q, n + 1): (d, score[d]) for n, (d, _) in enumerate(best)}
    assert got == want
