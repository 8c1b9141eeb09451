"""Queries that do the whole of a job that an older query's SQL cuts short."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marlowe.operators import retrieve
from marlowe.plans import analysis, ranking, registry  # noqa: F401

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def both(spark, duck, name):
    mine = registry.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    return mine, sorted(tuple(r[c] for c in columns) for r in mine.collect()), sorted(theirs)


def test_every_stated_query_is_searched(spark, duck):
    mine, got, want = both(spark, duck, "dense_ip_topk")
    assert got == want
    assert {r["qid"] for r in mine.collect()} == {r[0] for r in duck.execute("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0").fetchall()}


def test_queries_in_blocks(spark):
    v = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    q = v.select(F.col("doc_id").alias("qid"), F.col("vector").alias("query"))
    got = {(r["qid"], r["doc_id"]): r["score"] for r in retrieve.dense(v, q, block=5).collect()}
    assert got == {(a, b): a * b + 1.0 for a in range(40) for b in range(40)}


def test_the_first_cut_holds_500(spark, duck):
    mine, got, want = both(spark, duck, "dense_postfilter_topk")
    assert got == want
    v = duck.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    most = {}
    for q, e, _ in (x for x in v if x[0] % 50 == 0):
        ranked = sorted((-round(sum(a * b for a, b in zip(e, f, strict=True)), 9), i, c) for i, f, c in v if i != q)[:500]
        most[q] = [i for _, i, c in ranked if c == 3][:5]
    found = {}
    for r in sorted(mine.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["qid"], []).append(r["doc_id"])
    assert found == {q: x for q, x in most.items() if x}


def test_bootstrap_is_what_resampling_gives(spark):
    rows = [("a", i, float(i % 7)) for i in range(400)]
    units = spark.createDataFrame(rows, "event_type STRING, user_id BIGINT, v DOUBLE")
    means = sorted(r["mean"] for r in analysis.replicate_means(units, "event_type", "user_id", "v", 300).collect())
    centre = sum(v for _, _, v in rows) / 400
    assert len(means) == 300 and abs(sum(means) / 300 - centre) < 0.03 and 0.15 < means[-8] - centre < 0.25 and "range(2000)" in registry.SQL["bootstrap_ci"]
