"""Ranking metrics per query at several cut-offs in one pass, and their aggregates. Nulls mean "not evaluable", never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlowe.operators import stats

CUTS = [1, 5, 10, 20, 100]


def per_query(run: DataFrame, qrels: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """(qid, k, precision, recall, hit, rr, ap, ndcg, ndcg_retrieved) for queries with relevant documents.

    Gains are linear in the grade; ndcg's ideal is from the judgements, ndcg_retrieved's from the retrieved grades sorted.
    Only judged documents of the run matter past its ranks, so run and judgements meet in one shuffle by query.
    """
    cuts = cuts or CUTS
    rel = qrels.where("grade > 0")
    ideal_order = Window.partitionBy("qid").orderBy(F.col("grade").desc(), "doc_id")
    ideal = rel.withColumn("at", F.row_number().over(ideal_order)).withColumn("r", F.count("*").over(Window.partitionBy("qid")))
    hits = run.join(rel, ["qid", "doc_id"]).select("qid", "rank", "grade")
    seen = Window.partitionBy("qid").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(seen))
    by_grade = F.row_number().over(Window.partitionBy("qid", "k").orderBy(F.col("grade").desc(), "rank"))
    grid = F.explode(F.array(*map(F.lit, cuts))).alias("k")
    found = hits.select("*", grid).where("rank <= k").withColumn("best", by_grade)
    got = found.groupBy("qid", "k").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("precs"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("grade") / F.log2(F.col("best") + 1)).alias("best_dcg"))
    want = ideal.select("*", grid).groupBy("qid", "k").agg(F.first("r").alias("r"), F.sum(F.when(F.col("at") <= F.col("k"), F.col("grade") / F.log2(F.col("at") + 1))).alias("ideal"))
    zero = F.lit(0.0)
    return want.join(got, ["qid", "k"], "left").select(
        "qid", "k", F.coalesce(F.col("n") / F.col("k"), zero).alias("precision"), F.coalesce(F.col("n") / F.col("r"), zero).alias("recall"), F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1 / F.col("first"), zero).alias("rr"), F.coalesce(F.col("precs") / F.least("r", "k"), zero).alias("ap"), F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"), F.coalesce(F.col("dcg") / F.col("best_dcg"), zero).alias("ndcg_retrieved"),
    )


def suite(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro means for each cut-off; F1 is the harmonic mean of the mean precision and the mean recall."""
    keys = [*(by or []), "k"]
    out = scores.groupBy(*keys).agg(F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in ("precision", "recall", "hit", "rr", "ap", "ndcg", "ndcg_retrieved")])
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def rank_of_gold(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """First, last (only if all are found), median and found share of the relevant documents' ranks."""
    met = qrels.where("grade > 0").join(run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    return met.groupBy("qid").agg(F.min("rank").alias("first_rank"), F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("last_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"), (F.count("rank") / F.count("*")).alias("found"))


def latency(times: DataFrame, by: str, ms: str) -> DataFrame:
    """Mean, population deviation, extremes, interpolated percentiles and throughput of each group."""
    base = times.groupBy(by).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean_ms"), F.stddev_pop(ms).alias("std_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), (F.count(ms) / (F.sum(ms) / 1000)).alias("qps"))
    marks = stats.quantiles(times, ms, {f"p{p}": p / 100 for p in (50, 90, 95, 99)}, by).drop("n").withColumnRenamed(by, "_by")
    return base.join(marks, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def graded(run: DataFrame, qrels: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """(qid, k, ra_nwg, n_recall4) for queries with relevant documents.

    ra_nwg is the rarity-weighted gain of the first k over the best k's, without discount; a document of grade g weighs
    min(g / 5 x relevant / those of grade g, 5). n_recall4 counts grades of 4 and more over min(k, their number), null
    where a query has none; both are null throughout if no grade exceeds 1. Documents of a grade gain alike, so the best
    k come from their numbers and no query's judgements are sorted.
    """
    cuts = cuts or CUTS
    rel = qrels.where("grade > 0").select("qid", "doc_id", "grade")
    counts = rel.groupBy("qid", "grade").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("qid"))
    gains = counts.select("qid", "grade", "n", (F.least(F.col("grade") / 5 * (total / F.col("n")), F.lit(5.0)) * F.col("grade")).alias("gain"))
    grid = F.explode(F.array(*map(F.lit, cuts))).alias("k")
    upto = F.sum("n").over(Window.partitionBy("qid").orderBy(F.col("gain").desc(), "grade"))  # a row for each grade
    ideal = gains.withColumn("before", upto - F.col("n")).select("*", grid)
    taken = F.least(F.greatest(F.col("k") - F.col("before"), F.lit(0)), "n")
    want = ideal.groupBy("qid", "k").agg(F.sum(taken * F.col("gain")).alias("best"), F.sum(F.when(F.col("grade") >= 4, F.col("n")).otherwise(0)).alias("high"))
    met = run.select("qid", "doc_id", "rank").join(rel, ["qid", "doc_id"]).join(gains.select("qid", "grade", "gain"), ["qid", "grade"])
    got = met.select("qid", "rank", "grade", "gain", grid).where("rank <= k").groupBy("qid", "k").agg(F.sum("gain").alias("gain"), F.count_if(F.col("grade") >= 4).alias("hits"))
    is_graded = counts.agg((F.max("grade") > 1).alias("graded"))
    met = want.join(got, ["qid", "k"], "left").crossJoin(F.broadcast(is_graded))  # one row
    return met.select("qid", "k", F.when(F.col("graded"), F.coalesce("gain", F.lit(0.0)) / F.col("best")).alias("ra_nwg"), F.when(F.col("graded") & (F.col("high") > 0), F.coalesce("hits", F.lit(0)) / F.least("k", "high")).alias("n_recall4"))


def weighted(run: DataFrame, weights: DataFrame, gold: DataFrame, cuts: list[int]) -> DataFrame:
    """(qid, k, recall, precision, rr, ndcg) by the overlap weights of run units with the relevant articles.

    run: qid, unit, rank; weights: unit, article, weight; gold: qid, article. An article's recall is its weights' sum,
    1 at most; its rank is that of the first unit that overlaps it. ndcg's ideal is the retrieved gains sorted.
    """
    gold = gold.select("qid", "article").distinct()
    n = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    grid = F.explode(F.array(*map(F.lit, cuts))).alias("k")
    hits = run.select("qid", "unit", "rank").join(weights, "unit").join(gold, ["qid", "article"]).where("weight > 0").select("*", grid).where("rank <= k")
    by_article = hits.groupBy("qid", "k", "article").agg(F.sum("weight").alias("w"), F.min("rank").alias("first"))
    a = by_article.groupBy("qid", "k").agg(F.sum(F.least(F.lit(1.0), F.col("w"))).alias("covered"), F.sum("w").alias("w"), F.sum(1 / F.col("first")).alias("rr"))
    units = hits.groupBy("qid", "k", "rank").agg(F.sum("weight").alias("gain"))
    units = units.withColumn("best", F.row_number().over(Window.partitionBy("qid", "k").orderBy(F.col("gain").desc(), "rank")))
    u = units.groupBy("qid", "k").agg((F.sum(F.col("gain") / F.log2(F.col("rank") + 1)) / F.sum(F.col("gain") / F.log2(F.col("best") + 1))).alias("ndcg"))
    zero = F.lit(0.0)
    met = n.select("*", grid).join(a, ["qid", "k"], "left").join(u, ["qid", "k"], "left")
    return met.select("qid", "k", F.coalesce(F.col("covered") / F.col("n_gold"), zero).alias("recall"), F.coalesce(F.col("w") / F.col("k"), zero).alias("precision"), F.coalesce(F.col("rr") / F.col("n_gold"), zero).alias("rr"), F.coalesce("ndcg", zero).alias("ndcg"))
