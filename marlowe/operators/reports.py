"""Reports over runs of several systems: (system, qid, doc, score, rank) against gold (qid, doc); comparisons, audits, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlowe.operators import stats


def judged(run: DataFrame, gold: DataFrame) -> DataFrame:
    """The run with hit (1 or 0) and n_gold; queries without gold drop out."""
    known = gold.select("qid", "doc").distinct()
    size = known.groupBy("qid").agg(F.count("*").alias("n_gold"))
    return run.join(size, "qid").join(known.withColumn("_hit", F.lit(1)), ["qid", "doc"], "left").withColumn("hit", F.coalesce("_hit", F.lit(0))).drop("_hit")


def per_query(run: DataFrame, gold: DataFrame, cuts: list[int]) -> DataFrame:
    """(system, qid, k, precision, recall, hit, rr, ap, ndcg) of all systems in one job; id_precision and id_recall are ap and recall."""
    rows = judged(run, gold).withColumn("nth", F.sum("hit").over(Window.partitionBy("system", "qid").orderBy("rank")))
    met = rows.withColumn("k", F.explode(F.array(*map(F.lit, cuts)))).withColumn("in", (F.col("rank") <= F.col("k")) & (F.col("hit") == 1))
    some = F.when(F.col("in"), 1.0)
    out = met.groupBy("system", "qid", "k").agg(F.first("n_gold").alias("n_gold"), F.coalesce(F.sum(some), F.lit(0.0)).alias("n"), F.min(F.when(F.col("in"), F.col("rank"))).alias("first"), F.coalesce(F.sum(some * F.col("nth") / F.col("rank")), F.lit(0.0)).alias("precs"), F.coalesce(F.sum(some / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"))
    best = F.least("n_gold", "k")
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), best.cast("bigint")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return out.select("system", "qid", "k", (F.col("n") / F.col("k")).alias("precision"), (F.col("n") / F.col("n_gold")).alias("recall"), (F.col("n") > 0).cast("double").alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("precs") / best).alias("ap"), (F.col("dcg") / ideal).alias("ndcg"))


def weighted_recall(run: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Recall of gold (qid, doc, weight) by weight; by number where a query's weights are all null or sum to zero."""
    top = run.where(F.col("rank") <= k).select("system", "qid", "doc").withColumn("hit", F.lit(1))
    met = run.select("system", "qid").distinct().join(gold, "qid").join(top, ["system", "qid", "doc"], "left")
    w, h = F.coalesce("weight", F.lit(0.0)), F.coalesce("hit", F.lit(0))
    return met.groupBy("system", "qid").agg(F.when(F.sum(w) > 0, F.sum(w * h) / F.sum(w)).otherwise(F.avg(h)).alias("recall"))


def outcomes(run: DataFrame, gold: DataFrame, k: int, near: int) -> DataFrame:
    """For each system and query: gold found by k, near misses (by ``near``) and missed."""
    known = gold.select("qid", "doc").distinct()
    met = run.select("system", "qid").distinct().join(known, "qid").join(run.select("system", "qid", "doc", "rank"), ["system", "qid", "doc"], "left")
    r = F.col("rank")
    return met.groupBy("system", "qid").agg(F.count_if(r <= k).alias("hits"), F.count_if((r > k) & (r <= near)).alias("near_misses"), F.count_if(r.isNull() | (r > near)).alias("missed"))


def projected(gold: DataFrame, reachable: DataFrame) -> DataFrame:
    """For each query its gold that can be reached (doc) at all: n_gold, n_reachable and their ratio, the recall ceiling."""
    met = gold.select("qid", "doc").distinct().join(reachable.select("doc").distinct().withColumn("_in", F.lit(1)), "doc", "left")
    return met.groupBy("qid").agg(F.count("*").alias("n_gold"), F.count("_in").alias("n_reachable"), (F.count("_in") / F.count("*")).alias("ceiling"))


def tiers(run: DataFrame, gold: DataFrame, selected: Column, k: int, padded: int) -> DataFrame:
    """Nested recall of each system and query: selected rows, the first k, those padded to ``padded``, all; and whether they ascend; the tier where the first gold lands."""
    rows = judged(run, gold)
    hit = F.col("hit") == 1
    conditions = {"selected": selected & (F.col("rank") <= k), "at_k": F.col("rank") <= k, "padded": F.col("rank") <= padded, "reached": F.lit(True)}
    out = rows.groupBy("system", "qid").agg(*[(F.count_if(hit & c) / F.first("n_gold")).alias(n) for n, c in conditions.items()])
    nested = reduce(lambda x, y: x & y, [F.col(a) <= F.col(b) for a, b in zip(list(conditions), list(conditions)[1:], strict=False)])
    landing = F.coalesce(*[F.when(F.col(n) > 0, n) for n in conditions], F.lit("none"))
    return out.withColumn("nested", nested).withColumn("landing", landing)


def all_pairs(values: DataFrame, system: str, unit: str, value: str) -> DataFrame:
    """Paired comparison of every two systems over the units that both have: n, t, Cohen's d (population) and Wilcoxon's sums."""
    a = values.select(F.col(system).alias("a"), unit, F.col(value).alias("x"))
    b = values.select(F.col(system).alias("b"), unit, F.col(value).alias("y"))
    met = a.join(b, unit).where("a < b").withColumn("d", F.col("x") - F.col("y")).withColumn("pair", F.concat_ws("|", "a", "b"))
    base = met.groupBy("pair").agg(F.count("*").alias("n_pairs"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"), (F.avg("d") / F.stddev_pop("d")).alias("cohens_d"))
    return base.join(stats.wilcoxon(met, "pair", "d").drop("n"), "pair", "left")


def kendall(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by.., tau): Kendall's tau-b from pairs of distinct (x, y) cells with their counts; for few cells a group (panels of systems)."""
    cells = rows.groupBy(*by, x, y).agg(F.count("*").cast("double").alias("c"))
    a, b = cells.alias("a"), cells.alias("b")
    same = reduce(lambda p, q: p & q, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], F.lit(True))
    dx, dy, w = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}")), F.col("a.c") * F.col("b.c")
    sums = a.join(b, same).groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.sum(w * dx * dy).alias("s"), F.sum(w * F.abs(dx)).alias("x"), F.sum(w * F.abs(dy)).alias("y"))
    return sums.select(*by, F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("s") / F.sqrt(F.col("x") * F.col("y"))).alias("tau"))


def best_against(values: DataFrame, cell: list[str], system: str, value: str, baseline: str, eps: float = 1e-9) -> DataFrame:
    """For each cell the best other system's value against the baseline's: win, tie (within eps) or loss."""
    one = values.groupBy(*cell).agg(F.max(F.when(F.col(system) == baseline, F.col(value))).alias("base"), F.max(F.when(F.col(system) != baseline, F.col(value))).alias("best"))
    d = F.col("best") - F.col("base")
    return one.withColumn("outcome", F.when(F.abs(d) <= eps, "tie").when(d > 0, "win").when(d < 0, "loss"))


def argmax(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The row of each key with the greatest value; of equal ones the first in ``order``."""
    rows = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *order)
    return values.withColumn("_at", F.row_number().over(rows)).where("_at = 1").drop("_at")
