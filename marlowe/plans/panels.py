"""Graded and overlap-weighted metric panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlowe.operators import metrics, retrieve
from marlowe.plans.corpus import SPANS, weights
from marlowe.plans.ranking import BASE, Base, okapi, rounded, top
from marlowe.plans.registry import query, table
from marlowe.sources.writers import kept

GRADES = "CASE WHEN f = 1 THEN 5 WHEN f >= 0.6 THEN 3 WHEN f >= 0.5 THEN 2 WHEN f >= 0.4 THEN 1 END"
GRADED = f"""WITH {BASE}, run AS ({top(okapi(), 100)}), f AS (SELECT qid, doc_id, count(*) / any_value(nq) AS f FROM po JOIN (SELECT *, count(*) OVER (PARTITION BY qid) AS nq FROM qt) q USING (term) GROUP BY ALL),
g AS (SELECT qid, doc_id, {GRADES} AS grade FROM f WHERE f >= 0.4), ks AS (SELECT * FROM (VALUES (1), (5), (10), (20), (100)) v(k)),
w AS (SELECT *, least(grade / 5 * (count(*) OVER (PARTITION BY qid) / count(*) OVER (PARTITION BY qid, grade)), 5) * grade AS gain FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC) AS pos FROM w)
SELECT qid, k, round((SELECT coalesce(sum(gain), 0) FROM run JOIN w USING (qid, doc_id) WHERE run.qid = x.qid AND rank <= x.k) / (SELECT sum(gain) FROM o WHERE o.qid = x.qid AND pos <= x.k), 6) AS ra_nwg,
  round((SELECT count(*) FROM run JOIN w USING (qid, doc_id) WHERE run.qid = x.qid AND rank <= x.k AND grade >= 4) / nullif(least(x.k, high), 0), 6) AS n_recall4
FROM (SELECT qid, k, count_if(grade >= 4) AS high FROM w, ks GROUP BY ALL) x"""


@query(GRADED)
def graded_panel(spark, sf_dir):
    """Grades from the share of an item's distinct tokens that a document holds."""
    b = Base(spark, sf_dir)
    shares = retrieve.shares(b.tokens, b.terms, 0.4)
    grades = kept(shares.withColumnRenamed("share", "f").select("qid", "doc_id", F.expr(GRADES).alias("grade")), "grades")
    return rounded(metrics.graded(b.bm25(100), grades))


@query(f"""WITH {SPANS}, ks AS (SELECT * FROM (VALUES (1), (3), (10)) v(k)), x AS (SELECT doc_id, k, count(DISTINCT qid) AS n FROM q, ks GROUP BY ALL),
h AS (SELECT doc_id, k, qid, chunk + 1 AS rank, weight FROM w JOIN ks ON chunk + 1 <= k),
a AS (SELECT doc_id, k, qid, sum(weight) AS s, min(rank) AS first FROM h GROUP BY ALL), aa AS (SELECT doc_id, k, sum(least(1, s)) AS cov, sum(s) AS s, sum(1 / first) AS rr FROM a GROUP BY ALL),
u AS (SELECT doc_id, k, rank, sum(weight) AS gain FROM h GROUP BY ALL), uu AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY gain DESC, rank) AS best FROM u),
d AS (SELECT doc_id, k, sum(gain / log2(rank + 1)) / sum(gain / log2(best + 1)) AS ndcg FROM uu GROUP BY ALL)
SELECT x.doc_id AS qid, x.k, round(coalesce(cov / n, 0), 6) AS recall, round(coalesce(s / x.k, 0), 6) AS precision, round(coalesce(rr / n, 0), 6) AS rr, round(coalesce(ndcg, 0), 6) AS ndcg
FROM x LEFT JOIN aa ON aa.doc_id = x.doc_id AND aa.k = x.k LEFT JOIN d ON d.doc_id = x.doc_id AND d.k = x.k""")
def weighted_panel(spark, sf_dir):
    """Each document's chunks in text order as its run, the items that it holds as its articles."""
    w = weights(spark, sf_dir)
    unit = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("unit")
    run = w.select(F.col("doc_id").alias("qid"), unit, (F.col("chunk") + 1).alias("rank")).distinct()
    gold = w.select(F.col("doc_id").alias("qid"), F.col("qid").alias("article"))
    return rounded(metrics.weighted(run, w.select(unit, F.col("qid").alias("article"), "weight"), gold, [1, 3, 10]))


@query("SELECT conv_id, round(coalesce(sum(v * p) / nullif(sum(v), 0), 0), 6) AS context_precision FROM (SELECT conv_id, v, avg(v) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT conv_id, turn, (role = 'user')::INT AS v FROM conversations)) GROUP BY conv_id")
def context_precision(spark, sf_dir):
    """Precision up to each positive verdict, averaged over them; 0 without one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").cast("int").alias("v"))
    p = F.avg("v").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    out = c.withColumn("p", p).groupBy("conv_id").agg(F.coalesce(F.sum(F.col("v") * F.col("p")) / F.nullif(F.sum("v"), F.lit(0)), F.lit(0.0)).alias("context_precision"))
    return rounded(out)
