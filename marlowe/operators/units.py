"""Runs of units (chunks, nodes) that hold several articles: article rankings, set metrics, coverage, misses, ceilings.

run: qid, unit, rank, score; links: unit, article, weight; gold: qid, article. Queries without gold don't appear.
Each operator reduces (qid, article) to its first rank before it meets the cut-offs, so no step counts distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(cuts: list[int]) -> Column:
    return F.explode(F.array(*map(F.lit, cuts))).alias("k")


def article_run(run: DataFrame, links: DataFrame) -> DataFrame:
    """Articles by their best unit's score; ties by that unit's place, then by article."""
    met = run.select("qid", "unit", "rank", "score").join(links.select("unit", "article"), "unit")
    best = met.groupBy("qid", "article").agg(F.max(F.struct("score", (-F.col("rank")).alias("at"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("b.score").desc(), F.col("b.at").desc(), "article"))
    return best.select("qid", "article", F.col("b.score").alias("score"), (-F.col("b.at")).alias("first_unit"), place.alias("rank"))


def best_article(links: DataFrame) -> DataFrame:
    """Each unit's article of most weight, the least id on ties."""
    return links.groupBy("unit").agg(F.min_by("article", F.struct(-F.col("weight"), "article")).alias("article"), F.max("weight").alias("weight"))


def unit_relevance(run: DataFrame, links: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, unit, strict, lenient): the gold articles' summed weight, and whether any is above 0."""
    held = run.select("qid", "unit").join(links, "unit").join(gold.distinct(), ["qid", "article"]).groupBy("qid", "unit").agg(F.sum("weight").alias("s"), F.max("weight").alias("m"))
    met = run.select("qid", "unit").join(gold.select("qid").distinct(), "qid", "left_semi").join(held, ["qid", "unit"], "left")
    return met.select("qid", "unit", F.coalesce("s", F.lit(0.0)).alias("strict"), F.when(F.col("m") > 0, 1.0).otherwise(0.0).alias("lenient"))


def set_metrics(articles: DataFrame, gold: DataFrame, cuts: list[int]) -> DataFrame:
    """(qid, k, recall, hit, jaccard) of the first k articles against the gold set."""
    gold = gold.select("qid", "article").distinct()
    n = gold.groupBy("qid").agg(F.count("*").alias("n_gold")).join(articles.groupBy("qid").agg(F.count("*").alias("n_run")), "qid", "left")
    hits = articles.join(gold, ["qid", "article"]).select("qid", "rank", grid(cuts)).where("rank <= k").groupBy("qid", "k").agg(F.count("*").alias("h"))
    met = n.select("*", grid(cuts)).join(hits, ["qid", "k"], "left").withColumn("h", F.coalesce("h", F.lit(0)))
    top = F.least(F.col("k"), F.coalesce("n_run", F.lit(0)))
    return met.select("qid", "k", (F.col("h") / F.col("n_gold")).alias("recall"), (F.col("h") > 0).cast("double").alias("hit"), (F.col("h") / (F.col("n_gold") + top - F.col("h"))).alias("jaccard"))


def effective_gold(gold: DataFrame, present: DataFrame) -> DataFrame:
    """Gold articles that the searched text holds; queries left with none are not evaluable and go."""
    return gold.join(present.select("article").distinct(), "article", "left_semi")


def unit_context(run: DataFrame, links: DataFrame, gold: DataFrame, cuts: list[int]) -> DataFrame:
    """(qid, k, n_articles, n_gold, n_distractors, precision, units_per_article) that the first k units touch.

    Where they touch no article, precision is 0 and units_per_article null.
    """
    gold = gold.select("qid", "article").distinct().withColumn("is_gold", F.lit(1))
    first = run.join(gold.select("qid").distinct(), "qid", "left_semi").join(links.select("unit", "article"), "unit").groupBy("qid", "article").agg(F.min("rank").alias("first"))
    got = first.join(gold, ["qid", "article"], "left").select("qid", "first", "is_gold", grid(cuts)).where("first <= k").groupBy("qid", "k").agg(F.count("*").alias("n"), F.count("is_gold").alias("g"))
    met = gold.select("qid").distinct().select("qid", grid(cuts)).join(got, ["qid", "k"], "left").fillna(0, ["n", "g"])
    return met.select("qid", "k", F.col("n").alias("n_articles"), F.col("g").alias("n_gold"), (F.col("n") - F.col("g")).alias("n_distractors"), F.when(F.col("n") > 0, F.col("g") / F.col("n")).otherwise(0.0).alias("precision"), F.when(F.col("n") > 0, F.col("k") / F.col("n")).alias("units_per_article"))


def units_to_cover(run: DataFrame, links: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, units): the first units that together touch all gold articles; null if they never do."""
    gold = gold.select("qid", "article").distinct()
    first = run.join(links.select("unit", "article"), "unit").join(gold, ["qid", "article"]).groupBy("qid", "article").agg(F.min("rank").alias("first"))
    return gold.join(first, ["qid", "article"], "left").groupBy("qid").agg(F.when(F.count("first") == F.count("*"), F.max("first")).alias("units"))


def missed_gold(articles: DataFrame, gold: DataFrame, present: DataFrame, depth: int) -> DataFrame:
    """(qid, article, n_gold, miss_class, entire_miss) of gold articles beyond the first ``depth``; ABSENT ones are in no searched text."""
    gold = gold.select("qid", "article").distinct()
    pool = articles.where(F.col("rank") <= depth).select("qid", "article", F.lit(1).alias("found"))
    there = present.select("article").distinct().withColumn("there", F.lit(1))
    query = Window.partitionBy("qid")
    met = gold.join(pool, ["qid", "article"], "left").withColumn("n_gold", F.count("*").over(query)).withColumn("entire_miss", F.count("found").over(query) == 0)
    return met.where("found IS NULL").join(there, "article", "left").select("qid", "article", "n_gold", F.when(F.col("there").isNull(), "ABSENT").otherwise("BEYOND_POOL").alias("miss_class"), "entire_miss")


def padding_expectation(articles: DataFrame, gold: DataFrame, present: DataFrame, head: int, depth: int) -> DataFrame:
    """(qid, head_recall, expected_recall): the first ``head`` articles kept, the rest up to ``depth`` drawn evenly from those present.

    The expectation is the hypergeometric mean: gold left x slots / articles outside the head.
    """
    gold = gold.select("qid", "article").distinct()
    present = present.select("article").distinct().withColumn("there", F.lit(1))
    kept = articles.where(F.col("rank") <= head).select("qid", "article", F.lit(1).alias("kept"))
    size = kept.groupBy("qid").agg(F.count("*").alias("n_head"))
    g = gold.join(kept, ["qid", "article"], "left").join(present, "article", "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("kept").alias("hits"), F.count_if(F.col("there").isNotNull() & F.col("kept").isNull()).alias("left"))
    met = g.join(size, "qid", "left").fillna(0, ["n_head"]).crossJoin(F.broadcast(present.agg(F.count("*").alias("n_all"))))  # one row
    slots = F.greatest(F.lit(0), F.least(F.lit(depth), "n_all") - F.col("n_head"))
    outside = F.col("n_all") - F.col("n_head")
    caught = F.when(outside > 0, F.col("left") * slots / outside).otherwise(0.0)
    return met.select("qid", (F.col("hits") / F.col("n")).alias("head_recall"), ((F.col("hits") + caught) / F.col("n")).alias("expected_recall"))


def precision_ceiling(articles: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, achieved, ceiling): gold share of the first k articles, and the share if as many gold ones as fit stood there."""
    gold = gold.select("qid", "article").distinct()
    top = articles.where(F.col("rank") <= k)
    n = top.groupBy("qid").agg(F.count("*").alias("n")).join(gold.groupBy("qid").agg(F.count("*").alias("g")), "qid")
    met = n.join(top.join(gold, ["qid", "article"]).groupBy("qid").agg(F.count("*").alias("h")), "qid", "left").fillna(0, ["h"])
    return met.select("qid", (F.col("h") / F.col("n")).alias("achieved"), (F.least("g", "n") / F.col("n")).alias("ceiling"))


def calibrate_threshold(rows: DataFrame, score: str, label: str, taus: list[float], least_negative: float = 0.1) -> DataFrame:
    """(tau, accuracy, negative_share, chosen) for score >= tau against a 0/1 label, in one pass over the rows.

    Unlabelled rows count in negative_share alone. The chosen tau has the best accuracy, rounded to 4 places, among
    those with at least ``least_negative`` negatives (all, if none has), the first one on ties. No row: no accuracy.
    """
    s, y = F.col(score), F.col(label)
    right = [F.count_if(F.when(s >= t, 1).otherwise(0) == y) for t in taus]
    counts = rows.agg(F.count(label).alias("n_labelled"), F.count("*").alias("n"), F.array(*right).alias("right"), F.array(*[F.count_if(~F.coalesce(s >= t, F.lit(False))) for t in taus]).alias("neg"))
    each = counts.select("n_labelled", "n", F.posexplode(F.arrays_zip(F.array(*map(F.lit, taus)).alias("tau"), "right", "neg")).alias("at", "x"))
    out = each.select("at", F.col("x.tau").alias("tau"), F.round(F.col("x.right") / F.nullif("n_labelled", F.lit(0)), 4).alias("accuracy"), F.round(F.col("x.neg") / F.nullif("n", F.lit(0)), 4).alias("negative_share"))
    # one row a tau: this window holds the grid alone
    order = Window.orderBy((F.col("negative_share") >= least_negative).desc_nulls_last(), F.col("accuracy").desc_nulls_last(), "at")
    return out.withColumn("place", F.row_number().over(order)).select("tau", "accuracy", "negative_share", (F.col("place") == 1).alias("chosen"))


def stratum_delta(scores: DataFrame, system: str, unit: str, stratum: str, value: str, first: str, second: str) -> DataFrame:
    """Mean difference second - first by stratum over units that both have, with wins, ties and losses of the second."""
    wide = scores.where(F.col(system).isin(first, second)).groupBy(unit, stratum).agg(F.max(F.when(F.col(system) == first, F.col(value))).alias("a"), F.max(F.when(F.col(system) == second, F.col(value))).alias("b"))
    d = wide.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.round(F.col("b") - F.col("a"), 9))
    return d.groupBy(stratum).agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"))
