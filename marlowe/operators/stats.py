"""Statistics to compare systems: paired tests, correlation, agreement, strata, sampling, wins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def student_t_p(t: float, df: int) -> float:
    """Two-sided p-value by the continued fraction of the incomplete beta function."""
    if df < 1 or math.isnan(t):
        return 1.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return min(1.0, front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b)


def paired(scores: DataFrame, system: str, unit: str, value: str, anchor: str) -> DataFrame:
    """Sufficient statistics of each system against the anchor over the units that both have: n, mean, t, Cohen's d (population), wins, ties, losses."""
    a = scores.where(F.col(system) == anchor).select(unit, F.col(value).alias("base"))
    met = scores.where(F.col(system) != anchor).join(a, unit).withColumn("d", F.col(value) - F.col("base"))
    return met.groupBy(system).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"), (F.avg("d") / F.stddev_pop("d")).alias("cohens_d"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"))


def value_ranks(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by.., value, n, rank): ranks from 1, ties sharing their mean, from one row for each distinct value."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value))
    return counts.withColumn("rank", upto - (F.col("n") - 1) / 2)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """(by.., n, one column for each share): linear interpolation between the order statistics, from value counts and running sums.

    Nulls are left out; a group without a value has no row (without ``by`` one of nulls).
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy(value))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    parts = []
    for share in shares.values():
        at = F.lit(share) * (F.col("_n") - 1)
        parts += [F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))), F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value)))]
    found = counts.groupBy(*by).agg(F.sum("_c").alias("n"), *[p.cast("double").alias(f"_q{i}") for i, p in enumerate(parts)])
    for i, (name, share) in enumerate(shares.items()):
        at = F.lit(share) * (F.col("n") - 1)
        found = found.withColumn(name, F.col(f"_q{2 * i}") + (F.col(f"_q{2 * i + 1}") - F.col(f"_q{2 * i}")) * (at - F.floor(at)))
    return found.select(*by, "n", *shares)


def wilcoxon(pairs: DataFrame, by: str, diff: str) -> DataFrame:
    """W+ and W- over non-zero differences, ranks of equal sizes averaged."""
    some = pairs.where(F.col(diff) != 0).withColumn("size", F.round(F.abs(diff), 9))
    signed = some.groupBy(by, "size").agg(F.count("*").alias("n"), F.count_if(F.col(diff) > 0).alias("n_plus"))
    ranked = signed.withColumn("rank", F.sum("n").over(Window.partitionBy(by).orderBy("size")) - (F.col("n") - 1) / 2)
    return ranked.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n_plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("n_plus"))).alias("w_minus"))


def weighted_correlation(rows: DataFrame, x: str, y: str, n: str, *by: str) -> DataFrame:
    """(by.., n, rho): Pearson's correlation of rows that each stand for ``n``; null without spread."""
    w = F.col(n)
    sums = rows.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * F.col(x)).alias("_x"), F.sum(w * F.col(y)).alias("_y"), F.sum(w * F.col(x) * F.col(x)).alias("_xx"), F.sum(w * F.col(y) * F.col(y)).alias("_yy"), F.sum(w * F.col(x) * F.col(y)).alias("_xy"))
    spread = (F.col("_xx") - F.col("_x") * F.col("_x") / F.col("n")) * (F.col("_yy") - F.col("_y") * F.col("_y") / F.col("n"))
    return sums.select(*by, "n", F.when(spread > 0, (F.col("_xy") - F.col("_x") * F.col("_y") / F.col("n")) / F.sqrt(spread)).alias("rho"))


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Rank correlation from the counts of (x, y) pairs and of values: no row of the input is ranked by itself."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("n"))
    for c, name in ((x, "rx"), (y, "ry")):
        counts = pairs.groupBy(*by, c).agg(F.sum("n").alias("_m"))
        ranks = counts.select(*by, c, (F.sum("_m").over(Window.partitionBy(*by).orderBy(c)) - (F.col("_m") - 1) / 2).alias(name))
        pairs = pairs.join(ranks, [*by, c])
    centre = pairs.groupBy(*by).agg((F.sum(F.col("rx") * F.col("n")) / F.sum("n")).alias("_mean"))  # both ranks have it
    met = pairs.join(F.broadcast(centre), list(by)) if by else pairs.crossJoin(F.broadcast(centre))  # a row for each group
    return weighted_correlation(met.withColumn("rx", F.col("rx") - F.col("_mean")).withColumn("ry", F.col("ry") - F.col("_mean")), "rx", "ry", "n", *by)


def agreement(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Confusion counts, accuracy and Cohen's kappa of two 0/1 columns."""
    out = rows.groupBy(*by).agg(*[F.count_if((F.col(a) == i) & (F.col(b) == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    po = (F.col("n00") + F.col("n11")) / n
    pe = ((F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11")) + (F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10"))) / (n * n)
    return out.withColumn("accuracy", po).withColumn("kappa", F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)))


def wins_matrix(scores: DataFrame, cell: list[str], system: str, value: str) -> DataFrame:
    """Wins of each system over cells, ties split evenly."""
    best = scores.withColumn("place", F.rank().over(Window.partitionBy(*cell).orderBy(F.round(value, 9).desc()))).where("place = 1")
    return best.withColumn("share", 1 / F.count("*").over(Window.partitionBy(*cell))).groupBy(system).agg(F.sum("share").alias("wins"))


def mean_rank(scores: DataFrame, cell: list[str], system: str, value: str) -> DataFrame:
    placed = scores.withColumn("place", F.rank().over(Window.partitionBy(*cell).orderBy(F.round(value, 9).desc())))
    return placed.groupBy(system).agg(F.avg("place").alias("mean_rank"), F.count("*").alias("n_cells"))


def lexical_strata(scores: DataFrame, value: str) -> DataFrame:
    """Upper quartile (tested first, inclusive) aligned, lower quartile divergent, the rest between."""
    q = quantiles(scores, value, {"q25": 0.25, "q75": 0.75}).drop("n")
    met = scores.crossJoin(F.broadcast(q))
    return met.withColumn("stratum", F.when(F.col(value) >= F.col("q75"), "aligned").when(F.col(value) <= F.col("q25"), "divergent").otherwise("middle")).drop("q25", "q75")


def stratified_sample(rows: DataFrame, cell: str, key: str, rate: float, seed: int = 42) -> DataFrame:
    """max(1, floor(rate x pool)) rows of each cell, in the order of a seeded md5 that any engine can repeat."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    cells = Window.partitionBy(cell)
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(cells) * rate))
    return rows.withColumn("_n", n).withColumn("_at", F.row_number().over(cells.orderBy(order, F.col(key)))).where("_at <= _n").drop("_n", "_at")
