"""Trees as (node, parent) tables: leaves, ancestors, reach, and the fate of gold under a navigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.sources.writers import kept


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def closure(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, steps) for all ancestors of each node, a node its own at 0; trees of any depth.

    Rounds double the reach: what lies under 2^k steps is joined to the ancestors at exactly 2^k, and both tables are written, so
    a tree of depth d takes about log2 d rounds. A parent that isn't a node is an ancestor and ends the way. A cycle is a ValueError.
    """
    jump = kept(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor")), "jump")
    out, reach, most = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")), 1, None
    while not jump.isEmpty():
        most = most or nodes.count()
        if reach > most:
            raise ValueError("the parents have a cycle")
        further = jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_to"))
        out = kept(out.unionByName(out.join(further, "ancestor").select("node", F.col("_to").alias("ancestor"), (F.col("steps") + reach).alias("steps"))), "closure")
        jump = kept(jump.join(further, "ancestor").select("node", F.col("_to").alias("ancestor")), "jump")
        reach *= 2
    return out


FATES = ["HIT", "RESELECT", "FINE", "COARSE", "ORPHAN", "NOT_IN_TREE"]


def fates(gold: DataFrame, nodes: DataFrame, selected: DataFrame, seen: DataFrame, up: DataFrame) -> DataFrame:
    """(qid, node, fate): the best that happened to each gold leaf.

    HIT: selected. RESELECT: shown but not selected. FINE: its parent was shown. COARSE: a higher ancestor was. ORPHAN: none
    was, though it is in the tree. selected and seen are (qid, node), up is ``closure``'s table.
    """
    chain = gold.join(up, "node", "left")
    shown = seen.select("qid", F.col("node").alias("ancestor"), F.lit(1).alias("shown"))
    met = chain.join(shown, ["qid", "ancestor"], "left").join(selected.select("qid", "node", F.lit(1).alias("picked")).distinct(), ["qid", "node"], "left")
    code = F.when(F.col("picked") == 1, 0).when((F.col("shown") == 1) & (F.col("steps") == 0), 1).when((F.col("shown") == 1) & (F.col("steps") == 1), 2).when(F.col("shown") == 1, 3).when(F.col("ancestor").isNotNull(), 4).otherwise(5)
    worst = met.groupBy("qid", "node").agg(F.min(code).alias("code"))
    name = reduce(lambda w, i: w.when(F.col("code") == i, FATES[i]), range(1, 6), F.when(F.col("code") == 0, FATES[0]))
    return worst.select("qid", "node", name.alias("fate"))


def ceilings(fated: DataFrame) -> DataFrame:
    """(upto, recall): mean recall over queries if everything up to a fate were found."""
    order = F.array_position(F.array(*map(F.lit, FATES)), F.col("fate"))
    met = fated.withColumn("upto", F.explode(F.array(*map(F.lit, FATES[:5])))).withColumn("in", (order <= F.array_position(F.array(*map(F.lit, FATES)), F.col("upto"))).cast("int"))
    return met.groupBy("upto", "qid").agg(F.avg("in").alias("r")).groupBy("upto").agg(F.avg("r").alias("recall"))


def padded(scored: DataFrame, near: DataFrame, far: DataFrame, threshold: float, k: int) -> DataFrame:
    """(qid, doc, tier, rank): rows at the threshold (missing scores count as it) by score, then two tiers of fillers in their order; each document once, k a query. Applying it to its own result changes nothing."""
    from pyspark.sql import Window

    score = F.coalesce("score", F.lit(threshold))
    first = scored.where(score >= threshold).select("qid", "doc", F.lit(0).alias("tier"), (-score).alias("pos"))
    rest = [t.select("qid", "doc", F.lit(i).alias("tier"), F.col("pos").cast("double").alias("pos")) for i, t in ((1, near), (2, far))]
    every = first.unionByName(rest[0]).unionByName(rest[1]).groupBy("qid", "doc").agg(F.min(F.struct("tier", "pos")).alias("x"))
    out = every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("x", "doc"))).where(F.col("rank") <= k)
    return out.select("qid", "doc", F.col("x.tier").alias("tier"), "rank")
