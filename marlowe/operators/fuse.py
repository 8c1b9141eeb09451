"""Rank fusion, boosting, re-ranking. Inputs are runs (qid, doc_id, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(runs: list[DataFrame], *, k: int = 60, missing: str = "zero", first_stage_k: int = 100) -> DataFrame:
    """Reciprocal-rank fusion. missing: "zero" adds nothing for a list without the document, "rank" counts first_stage_k + 1, "length" that list's length + 1."""
    marked = reduce(DataFrame.unionByName, [r.select("qid", "doc_id", "rank").withColumn("list", F.lit(i)) for i, r in enumerate(runs)])
    if missing == "zero":
        return marked.groupBy("qid", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    if missing == "rank":
        got = marked.groupBy("qid", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("s"), F.count("*").alias("c"))
        return got.select("qid", "doc_id", (F.col("s") + (len(runs) - F.col("c")) / F.lit(float(k + first_stage_k + 1))).alias("score"))
    length = marked.groupBy("qid", "list").agg(F.max("rank").alias("n"))
    total = length.groupBy("qid").agg(F.sum(1 / (k + F.col("n") + 1)).alias("absent"))
    own = marked.join(length, ["qid", "list"]).groupBy("qid", "doc_id").agg(F.sum(1 / (k + F.col("rank")) - 1 / (k + F.col("n") + 1)).alias("s"))
    return own.join(total, "qid").select("qid", "doc_id", (F.col("s") + F.col("absent")).alias("score"))


def linear(dense: DataFrame, sparse: DataFrame, *, alpha: float = 0.5) -> DataFrame:
    """alpha dense + (1 - alpha) max(0, sparse / (query's best + 1e-8)); what a list lacks counts 0."""
    best = Window.partitionBy("qid")
    s = sparse.withColumn("s", F.greatest(F.lit(0.0), F.col("score") / (F.max("score").over(best) + 1e-8))).select("qid", "doc_id", "s")
    both = dense.select("qid", "doc_id", F.col("score").alias("d")).join(s, ["qid", "doc_id"], "full")
    return both.select("qid", "doc_id", (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))).alias("score"))


def pool(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both lists' ranks and scores side by side."""
    d = dense.select("qid", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("qid", "doc_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    return d.join(s, ["qid", "doc_id"], "full")


def boost(run: DataFrame, facts: DataFrame, *, weights: dict[str, float]) -> DataFrame:
    """Drops documents whose status isn't Effective (null counts as Effective), multiplies the score for each flag that holds."""
    met = run.join(facts, "doc_id", "left").where(F.coalesce("status", F.lit("Effective")) == "Effective")
    factor = reduce(lambda a, b: a * b, [F.when(F.coalesce(F.col(flag), F.lit(False)), w).otherwise(1.0) for flag, w in weights.items()])
    return met.select("qid", "doc_id", (F.col("score") * factor).alias("score"))
