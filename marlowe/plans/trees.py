"""Trees, navigation outcomes and padding. Nations' customers stand in for a tree: customer, segment of a nation, nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.operators import trees
from marlowe.plans.ranking import rounded
from marlowe.plans.registry import query, table
from marlowe.plans.reports import RUNS, run_of

TREE = """tree AS (SELECT 'n' || n_nationkey AS node, NULL AS parent FROM nation UNION ALL SELECT DISTINCT 's' || c_nationkey || c_mktsegment, 'n' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, 's' || c_nationkey || c_mktsegment FROM customer)"""


def tree_of(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    part = F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), "c_mktsegment")
    top = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"))
    middle = c.select(part.alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent")).distinct()
    return top.unionByName(middle).unionByName(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), part.alias("parent")))


@query(f"WITH {TREE} SELECT node, parent FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree x WHERE x.parent = t.node)")
def tree_leaves(spark, sf_dir):
    """STR-23."""
    return trees.leaves(tree_of(spark, sf_dir))


@query(f"WITH RECURSIVE {TREE}, up(node, ancestor, steps) AS (SELECT node, node, 0 FROM tree UNION ALL SELECT u.node, t.parent, u.steps + 1 FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.parent IS NOT NULL) SELECT * FROM up")
def tree_ancestors(spark, sf_dir):
    """STR-23, the parent index closed over ancestors."""
    return trees.closure(tree_of(spark, sf_dir))


def navigated(spark, sf_dir):
    """Gold, selected and shown nodes made from order keys: which level a query has seen depends on its customer."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("qid"), F.col("o_custkey").alias("c")).distinct()
    leaf = F.concat(F.lit("c"), F.col("c").cast("string"))
    gold = o.select("qid", F.when(F.col("c") % 11 == 0, F.lit("gone")).otherwise(leaf).alias("node")).distinct()
    held = gold.join(tree_of(spark, sf_dir), "node")
    m = F.expr("try_cast(substr(node, 2) AS INT)") % 5
    selected = held.where(m == 0).select("qid", "node")
    seen = held.where(m == 1).select("qid", "node").unionByName(held.where(m == 2).select("qid", F.col("parent").alias("node")).distinct())
    return gold, selected, seen


FATE = f"""{TREE}, g AS (SELECT DISTINCT o_orderkey % 50 AS qid, CASE WHEN o_custkey % 11 = 0 THEN 'gone' ELSE 'c' || o_custkey END AS node FROM orders), h AS (SELECT qid, g.node, parent, regexp_extract(g.node, '(\\d+)', 1)::INT % 5 AS m FROM g JOIN tree ON tree.node = g.node),
p AS (SELECT DISTINCT qid, parent FROM h WHERE m = 2), f AS (SELECT g.qid, g.node, CASE WHEN h.node IS NULL THEN 'NOT_IN_TREE' WHEN h.m = 0 THEN 'HIT' WHEN h.m = 1 THEN 'RESELECT' WHEN p.parent IS NOT NULL THEN 'FINE' ELSE 'ORPHAN' END AS fate
FROM g LEFT JOIN h ON h.qid = g.qid AND h.node = g.node LEFT JOIN p ON p.qid = g.qid AND p.parent = h.parent)"""


@query(f"WITH {FATE} SELECT * FROM f")
def gold_fates(spark, sf_dir):
    """STR-30."""
    gold, selected, seen = navigated(spark, sf_dir)
    nodes = tree_of(spark, sf_dir)
    return trees.fates(gold, nodes, selected, seen, trees.closure(nodes))


@query(f"WITH {FATE}, l AS (SELECT unnest(['HIT', 'RESELECT', 'FINE', 'COARSE', 'ORPHAN']) AS upto, unnest([1, 2, 3, 4, 5]) AS n), c AS (SELECT *, list_position(['HIT', 'RESELECT', 'FINE', 'COARSE', 'ORPHAN', 'NOT_IN_TREE'], fate) AS code FROM f) SELECT upto, round(avg(r), 6) AS recall FROM (SELECT upto, qid, avg((code <= n)::INT) AS r FROM c, l GROUP BY ALL) GROUP BY upto")
def fate_ceilings(spark, sf_dir):
    """STR-31."""
    return rounded(trees.ceilings(gold_fates(spark, sf_dir)))


@query(f"""WITH {RUNS}, a AS (SELECT qid, doc, 0 AS tier, -score AS pos FROM run WHERE system = 'click' AND score >= 20 UNION ALL SELECT qid, doc, 1, rank FROM run WHERE system = 'view' UNION ALL SELECT qid, doc, 2, rank FROM run WHERE system = 'purchase'),
d AS (SELECT qid, doc, min((tier, pos)) AS x FROM a GROUP BY ALL), r AS (SELECT qid, doc, x[1] AS tier, row_number() OVER (PARTITION BY qid ORDER BY x, doc) AS rank FROM d) SELECT * FROM r WHERE rank <= 30""")
def two_tier_padding(spark, sf_dir):
    """STR-26 and 27: scored rows at the threshold, then two tiers of fillers, each document once."""
    run = run_of(spark, sf_dir)
    part = lambda s: run.where(F.col("system") == s).select("qid", "doc", "score", F.col("rank").alias("pos"))
    return trees.padded(part("click"), part("view"), part("purchase"), 20.0, 30)


@query(f"""WITH {RUNS}, u AS (SELECT qid, doc, min(rank) FILTER (system = 'click') AS c, max(score) FILTER (system = 'view') AS d FROM run GROUP BY ALL) SELECT qid, doc, round(max(d), 6) AS score FROM u WHERE d IS NOT NULL GROUP BY ALL""")
def dense_view(spark, sf_dir):
    """RET-13: the part of a pool that has a dense score, the greatest of a document."""
    pool = run_of(spark, sf_dir).groupBy("qid", "doc").agg(F.max(F.when(F.col("system") == "view", F.col("score"))).alias("score"))
    return rounded(pool.where("score IS NOT NULL"))


@query(f"""WITH RECURSIVE {TREE}, k AS (SELECT parent, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY parent), up(node, ancestor, steps) AS (SELECT node, node, 0 FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree x WHERE x.parent = t.node) UNION ALL SELECT u.node, t.parent, u.steps + 1 FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.parent IS NOT NULL),
l AS (SELECT u.node, max(steps) AS depth, count(*) FILTER (k.n > 1) AS decisions, max(CASE WHEN steps = 1 THEN k.n END) AS section FROM up u LEFT JOIN k ON k.parent = u.ancestor GROUP BY u.node) SELECT depth, count(*) AS n, round(avg(decisions), 6) AS mean_decisions, round(avg(section), 6) AS mean_section, round(avg((section IS NULL)::INT), 6) AS orphans, round(avg((coalesce(section, 0) > 15)::INT), 6) AS oversized FROM l GROUP BY depth""")
def reachability_barriers(spark, sf_dir):
    """DIA-08: decisions on the way to a leaf, the size of its section, orphans and oversized sections by depth."""
    nodes = tree_of(spark, sf_dir)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("ancestor")).agg(F.count("*").alias("n"))
    met = trees.closure(nodes).join(trees.leaves(nodes).select("node"), "node", "left_semi").join(children, "ancestor", "left")
    each = met.groupBy("node").agg(F.max("steps").alias("depth"), F.count_if(F.col("n") > 1).alias("decisions"), F.max(F.when(F.col("steps") == 1, F.col("n"))).alias("section"))
    return rounded(each.groupBy("depth").agg(F.count("*").alias("n"), F.avg("decisions").alias("mean_decisions"), F.avg("section").alias("mean_section"), F.avg(F.col("section").isNull().cast("int")).alias("orphans"), F.avg((F.coalesce("section", F.lit(0)) > 15).cast("int")).alias("oversized")))


@query(f"WITH {RUNS} SELECT count(DISTINCT qid) AS n_queries, 0::BIGINT AS n_changed FROM run WHERE system IN ('click', 'view', 'purchase')")
def padding_rederived(spark, sf_dir):
    """DIA-16: what is padded already stays as it is when it is padded again."""
    once = two_tier_padding(spark, sf_dir)
    again = trees.padded(once.select("qid", "doc", (-F.col("rank").cast("double")).alias("score")), once.select("qid", "doc", F.col("rank").alias("pos")), once.select("qid", "doc", F.col("rank").alias("pos")), -31.0, 30)
    met = once.select("qid", "doc", "rank").join(again.select("qid", "doc", F.col("rank").alias("r")), ["qid", "doc"], "full")
    each = met.groupBy("qid").agg(F.max((~F.col("rank").eqNullSafe(F.col("r"))).cast("int")).alias("c"))
    return each.agg(F.count("*").alias("n_queries"), F.sum("c").cast("bigint").alias("n_changed"))


@query("""WITH ln AS (SELECT conv_id, turn, role, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS start, length(text) AS n FROM conversations WHERE text IS NOT NULL), m AS (SELECT conv_id, turn, start, lead(start) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM ln WHERE role = 'user'), e AS (SELECT conv_id, max(start + n) AS whole FROM ln GROUP BY 1)
SELECT conv_id, turn, start::BIGINT AS start, coalesce(nxt, whole)::BIGINT AS stop FROM m JOIN e USING (conv_id)""")
def article_spans(spark, sf_dir):
    """STR-04: each marker's span in the joined text, from it to the next marker or the end."""
    from pyspark.sql import Window

    upto = Window.partitionBy("conv_id").orderBy("turn")
    n = F.char_length("text").cast("bigint")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", n.alias("n")).withColumn("start", F.sum(F.col("n") + 1).over(upto) - F.col("n") - 1)
    ends = rows.groupBy("conv_id").agg(F.max(F.col("start") + F.col("n")).alias("whole"))
    marks = rows.where("role = 'user'").withColumn("nxt", F.lead("start").over(upto))
    return marks.join(ends, "conv_id").select("conv_id", "turn", "start", F.coalesce("nxt", "whole").alias("stop"))
