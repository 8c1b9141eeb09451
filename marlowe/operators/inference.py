"""Significance of paired differences and intervals of correlations."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlowe.operators import stats

#: Up to so many differences, none zero and none tied, the signed-rank sum's own distribution is used.
EXACT = 50


@lru_cache(maxsize=EXACT)
def rank_sum_shares(n: int) -> np.ndarray:
    """For each sum s of a subset of the ranks 1..n the share of all subsets with it: a sum's ways with rank r are those without it, moved by r."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways = ways + np.concatenate([np.zeros(r), ways[:-r]])
    return ways / 2.0**n


def signed_rank_p(w_plus: float, n: int, zeros: int, tied: float) -> float:
    """Two-sided p of Wilcoxon's signed ranks: w_plus over n differences that aren't zero, ``tied`` the sum of t^3 - t over runs of t equal sizes.

    Exact where n is EXACT at most and nothing is zero or tied; else the normal one with the variance that ties leave,
    without continuity correction. Without a difference, or without variance, 1.
    """
    if n <= 0:
        return 1.0
    if n + zeros <= EXACT and not zeros and not tied:
        shares, at = rank_sum_shares(n), int(round(w_plus))
        return min(1.0, 2 * min(float(shares[: at + 1].sum()), float(shares[at:].sum())))
    variance = n * (n + 1) * (2 * n + 1) / 24 - tied / 48
    return math.erfc(abs(w_plus - n * (n + 1) / 4) / math.sqrt(2 * variance)) if variance > 0 else 1.0


def _column(fn, *columns: Column) -> Column:
    """A number for each row of a small table, such as pairs of systems."""

    @F.pandas_udf("double")
    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(*series, strict=True)], dtype="float64")

    return apply(*columns)


def student_p(t: Column, df: Column) -> Column:
    return _column(lambda t, df: stats.student_t_p(float(t), int(df)), t, df)


def paired_significance(values: DataFrame, system: str, unit: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Every two systems a < b over the units that both have, differences b - a.

    (a, b, n, mean_diff, std_diff, cohens_d, t_p, w_plus, w_minus, wilcoxon_p, significant): spread and d with the
    population's deviation, d 0 without spread; t_p 1 where all differences are zero, 0 where all are one other value;
    significant if the less of both p is below ``alpha``. Units are unique for each system; rows with a null value and
    pairs of fewer than two units are left out. Signed ranks come from counts of sizes, to nine places, so no
    difference is ranked by itself; a group's window holds its distinct sizes.
    """
    some = values.where(F.col(value).isNotNull())
    a = some.select(F.col(system).alias("a"), unit, F.col(value).alias("_x"))
    b = some.select(F.col(system).alias("b"), unit, F.col(value).alias("_y"))
    d = a.join(b, unit).where("a < b").select("a", "b", (F.col("_y") - F.col("_x")).alias("d"))
    # one shuffle of partial sums, a row for each distinct size, serves the means and the ranks
    sizes = d.groupBy("a", "b", F.round(F.abs("d"), 9).alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    pair = Window.partitionBy("a", "b")
    real = F.col("size") > 0
    c = F.when(real, F.col("c")).otherwise(0)
    ranked = sizes.withColumn("rank", F.sum(c).over(pair.orderBy("size")) - (F.col("c") - 1) / 2).withColumn("_c", c)
    sums = ranked.groupBy("a", "b").agg(
        F.sum("c").alias("n"), F.sum("_c").alias("m"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        F.coalesce(F.sum(F.when(real, F.col("rank") * F.col("up"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(real, F.col("rank") * (F.col("c") - F.col("up")))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.when(real, F.col("c").cast("double") * F.col("c") * F.col("c") - F.col("c"))), F.lit(0.0)).alias("tied"), F.count("*").alias("kinds"),
    ).where("n > 1")
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    # a deviation below the rounding of sizes is none
    out = sums.withColumn("mean_diff", mean).withColumn("std_diff", F.when(spread > 1e-9, spread).otherwise(0.0))
    t = F.col("mean_diff") / (F.col("std_diff") / F.sqrt(F.col("n") - 1))
    flat = F.when(F.abs("mean_diff") > 1e-9, 0.0).otherwise(1.0)
    out = out.withColumn("t_p", F.when(F.col("std_diff") > 0, student_p(F.when(F.col("std_diff") > 0, t).otherwise(0.0), F.col("n") - 1)).otherwise(flat))
    out = out.withColumn("wilcoxon_p", _column(lambda w, m, z, k: signed_rank_p(float(w), int(m), int(z), float(k)), F.col("w_plus"), F.col("m"), F.col("n") - F.col("m"), F.col("tied")))
    d_ = F.when(F.col("std_diff") > 0, F.col("mean_diff") / F.col("std_diff")).otherwise(0.0)
    return out.select("a", "b", "n", "mean_diff", "std_diff", d_.alias("cohens_d"), "t_p", "w_plus", "w_minus", "wilcoxon_p", (F.least("t_p", "wilcoxon_p") < alpha).alias("significant"))


#: Upper ends of the Poisson(1) distribution function to nine places, fixed for all engines.
POISSON = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815]


def bootstrap_correlation(rows: DataFrame, by: str, unit: str, x: str, y: str, replicates: int = 2000) -> DataFrame:
    """(by, n, rho, low, high): Spearman's correlation of x and y over a group's units with its 95 % percentile interval.

    A unit's copies in a replicate are a Poisson draw from a hash of both, so a unit is drawn where it lies and all
    replicates are one job: draws are summed to (x, y) cells before the one shuffle, and a replicate ranks its own cells
    by running sums of copies, ties sharing their mean. Replicates without spread have no correlation and are left out;
    units with a null are left out. A group costs its distinct cells times ``replicates``, spread over as many windows.
    """
    some = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, unit, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    drawn = some.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("b").cast("string"), F.col(unit).cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    copies = F.lit(len(POISSON))
    for i, end in reversed(list(enumerate(POISSON))):
        copies = F.when(u < end, i).otherwise(copies)
    cells = drawn.withColumn("w", copies).where("w > 0").groupBy(by, "b", "x", "y").agg(F.sum("w").alias("w"))
    for v in ("x", "y"):
        upto = F.sum("w").over(Window.partitionBy(by, "b").orderBy(v))
        cells = cells.withColumn(f"r{v}", upto - (F.sum("w").over(Window.partitionBy(by, "b", v)) - 1) / 2)
    middle = (F.sum("w").over(Window.partitionBy(by, "b")) + 1) / 2  # the mean of any ranks
    cells = cells.select(by, "b", "w", (F.col("rx") - middle).alias("rx"), (F.col("ry") - middle).alias("ry"))
    replicas = stats.weighted_correlation(cells, "rx", "ry", "w", by, "b")
    ends = stats.quantiles(replicas, "rho", {"low": 0.025, "high": 0.975}, by).drop("n")
    return stats.spearman(some, "x", "y", by).join(ends, by, "left").select(by, "n", "rho", "low", "high")
