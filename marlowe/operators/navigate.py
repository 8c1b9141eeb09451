"""Trees, padded selections, pool re-ranking, judge answers and query signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def header_chain(segments: Column, most: int = 16) -> Column:
    """Labels of the ancestors, outermost first: runs of one label collapse, the nearest ``most`` stay. Null for null."""
    inner = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    kept = F.filter(inner, lambda x, i: (i == 0) | (x != F.get(inner, i - 1)))
    return F.when(F.size(kept) > most, F.slice(kept, -most, most)).otherwise(kept)


def grouped_tree(rows: DataFrame, top: str, middle: str, leaf: str, bucket: str = "_ungrouped") -> DataFrame:
    """(top, middle, n_leaves) of a three-level tree; rows without a middle go under one bucket of their top."""
    name = F.coalesce(F.nullif(F.trim(F.col(middle)), F.lit("")), F.lit(bucket))
    return rows.groupBy(F.col(top).alias("top"), name.alias("middle")).agg(F.count(leaf).alias("n_leaves"))


def joined_text(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, n, first, text): non-blank parts in order, one newline between. A key's parts make one value, so it must fit a row."""
    some = rows.where(F.trim(F.col(text)) != "")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("part"))))
    met = some.groupBy(key).agg(parts.alias("p"))
    return met.select(key, F.size("p").cast("bigint").alias("n"), F.col("p")[0]["at"].alias("first"), F.array_join(F.col("p.part"), "\n").alias("text"))


def coverage_buckets(weights: DataFrame, spans: DataFrame, keys: list[str], slack: float = 0.05) -> DataFrame:
    """(keys, total, bucket) for every span: ok if its weights sum to 1 within ``slack``, missing if to nothing, else warning."""
    total = weights.groupBy(*keys).agg(F.sum("weight").alias("total"))
    met = spans.select(*keys).distinct().join(total, keys, "left").fillna(0.0, ["total"])
    return met.withColumn("bucket", F.when(F.col("total") <= 0, "missing").when(F.abs(F.col("total") - 1) <= slack, "ok").otherwise("warning"))


def tiered(tiers: list[DataFrame], k: int) -> DataFrame:
    """(qid, doc_id, tier, rank): the first tier's run, then those of each next one that are new, up to k a query.

    Each tier is cut to its own first k before they meet, so a query sends at most k x tiers rows.
    """
    each = [t.where(F.col("rank") <= k).select("qid", "doc_id", F.lit(i).alias("tier"), F.col("rank").alias("at")) for i, t in enumerate(tiers)]
    once = reduce(DataFrame.unionByName, each).groupBy("qid", "doc_id").agg(F.min(F.struct("tier", "at")).alias("b"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("b.tier", "b.at", "doc_id"))
    return once.select("qid", "doc_id", F.col("b.tier").alias("tier"), place.alias("rank")).where(F.col("rank") <= k)


def rerank_pool(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """(qid, doc_id, score, rank): the pool by its new scores, rounded to 9 places; those without one follow in their old order."""
    met = pool.select("qid", "doc_id", F.col("rank").alias("at")).join(scores.select("qid", "doc_id", F.round("score", 9).alias("score")), ["qid", "doc_id"], "left")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "at"))
    return met.select("qid", "doc_id", "score", place.alias("rank"))


def first_digit(answer: Column, low: int, high: int) -> Column:
    """A judge's grade: the answer's first digit, brought into the range; null if it has none."""
    found = F.nullif(F.regexp_extract(answer, "[0-9]", 0), F.lit("")).cast("int")
    return F.when(found.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), found)))


def grade_means(rows: DataFrame, by: str, answer: str) -> DataFrame:
    """(by, n, mean_grade, scaled, relevant) of grades 0 to 3: mean, mean / 3, share of 2 and more; unparsed answers go."""
    g = rows.select(by, first_digit(F.col(answer), 0, 3).alias("g")).where("g IS NOT NULL")
    return g.groupBy(by).agg(F.count("*").alias("n"), F.avg("g").alias("mean_grade"), (F.avg("g") / 3).alias("scaled"), F.avg((F.col("g") >= 2).cast("int")).alias("relevant"))


def abstains(answer: Column, phrases: list[str]) -> Column:
    """Whether the answer, in lower case, holds one of the phrases; an empty or null one abstains too."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases], F.trim(low) == "")


def signals(text: Column) -> list[Column]:
    """What a query names: article references, ISO dates and long numbers, each joined in order of appearance."""

    def found(pattern: str) -> Column:
        return F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), ",")

    return [found("(?i)(?:article|art[.]) ?[0-9]+").alias("refs"), found("[0-9]{4}-[0-9]{2}-[0-9]{2}").alias("dates"), found("[0-9]{5,}").alias("numbers")]
