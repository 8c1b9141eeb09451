"""Chunks, spans, trees: windows over tokens, interval overlap, forward fill, path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_chunks(docs: DataFrame, tokens: Column, *, id_col: str = "doc_id", window: int = 128, stride: int = 96) -> DataFrame:
    """(id, chunk, start_token, end_token, text): windows at every stride until one reaches the end; none without tokens.

    The windows are cut inside one array expression, so the whole token array isn't repeated for each.
    """
    n = F.size("t")
    count = 1 + F.ceil(F.greatest(n - window, F.lit(0)) / stride).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.cast("bigint").alias("chunk"), (i * stride).cast("bigint").alias("start_token"), F.least(i * stride + window, n).cast("bigint").alias("end_token"), F.array_join(F.slice("t", i * stride + 1, window), " ").alias("text")))
    return docs.select(id_col, tokens.alias("t")).where(F.size("t") > 0).select(id_col, F.explode(cut).alias("c")).select(id_col, "c.*")


def char_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 400, stride: int = 300) -> DataFrame:
    """(id, chunk, start_char, end_char) by the same stop rule, over characters."""
    n = F.char_length(text_col)
    count = 1 + F.ceil(F.greatest(n - width, F.lit(0)) / stride).cast("int")
    at = F.explode(F.sequence(F.lit(0), count - 1)).alias("i")
    return docs.where(F.char_length(text_col) > 0).select(id_col, n.alias("n"), at).select(id_col, F.col("i").cast("bigint").alias("chunk"), (F.col("i") * stride).cast("bigint").alias("start_char"), F.least(F.col("i") * stride + width, F.col("n")).cast("bigint").alias("end_char"))


def overlap_weights(chunks: DataFrame, spans: DataFrame, unit: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk, unit, weight): the share of a unit's span lengths that a chunk covers, if any.

    Half-open intervals meet within a document, so the join is by document with the inequality as its condition.
    """
    total = Window.partitionBy(id_col, unit)
    sized = spans.withColumn("length", F.sum(F.col("span_end") - F.col("span_start")).over(total))
    met = chunks.join(sized, id_col).where((F.col("span_start") < F.col("end_char")) & (F.col("span_end") > F.col("start_char")))
    part = F.least("end_char", "span_end") - F.greatest("start_char", "span_start")
    return met.groupBy(id_col, "chunk", unit).agg((F.sum(part) / F.first("length")).alias("weight"))


def coverage(weights: DataFrame, keys: list[str], order: list[Column], cuts: list[int]) -> DataFrame:
    """(keys, k, coverage): the weights of the first k units summed, 1 at most."""
    ranked = weights.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    grid = ranked.select("*", F.explode(F.array(*[F.lit(k).cast("bigint") for k in cuts])).alias("k")).where("rank <= k")
    return grid.groupBy(*keys, "k").agg(F.least(F.lit(1.0), F.sum("weight")).alias("coverage"))


def forward_fill(rows: DataFrame, by: str, order: str, value: Column) -> Column:
    """The last non-null value at or before each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def prefix_nodes(paths: DataFrame, path: str) -> DataFrame:
    """(node, parent, depth) for every distinct prefix of slash-separated paths; roots have a null parent and depth 0."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    every = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", 1, i), "/").alias("node"), F.when(i > 1, F.array_join(F.slice("p", 1, F.greatest(i - 1, F.lit(1))), "/")).alias("parent"), (i - 1).cast("bigint").alias("depth")))
    return paths.select(parts.alias("p")).where(F.size("p") > 0).select(F.explode(every).alias("x")).select("x.*").distinct()


def tree_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes, roots, leaves, depth and the fan-out of inner nodes (mean, median, 90th percentile, greatest)."""
    fan = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("fan"))
    shape = fan.agg(F.count("*").alias("n_inner"), F.avg("fan").alias("fan_mean"), F.median("fan").alias("fan_median"), F.percentile("fan", F.lit(0.9)).alias("fan_p90"), F.max("fan").alias("fan_max"))
    size = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("parent").isNull()).alias("n_roots"), F.max("depth").alias("depth"))
    return size.crossJoin(F.broadcast(shape)).withColumn("n_leaves", F.col("n_nodes") - F.col("n_inner"))  # a row each


def nearest_ancestor(nodes: DataFrame, anchors: DataFrame, *, most: int = 32) -> DataFrame:
    """(node, anchor): the deepest proper prefix of a node, at most ``most`` levels up, that is an anchor; null if none is."""
    parts = F.split("node", "/")
    ups = F.filter(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(i.alias("d"), F.array_join(F.slice("p", 1, i), "/").alias("a"))), lambda x: (x["d"] < F.size("p")) & (x["d"] >= F.size("p") - most))
    up = nodes.select("node", parts.alias("p")).select("node", F.explode_outer(ups).alias("x")).select("node", "x.a", "x.d")
    met = up.join(anchors.select(F.col("anchor").alias("a"), F.lit(True).alias("hit")), "a", "left")
    return met.groupBy("node").agg(F.max_by("a", F.when(F.col("hit"), F.col("d"))).alias("anchor"))
