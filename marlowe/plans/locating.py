"""Articles in texts. A customer's orders, a line each, stand in for a law; some lines are article markers, and some orders known articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators import anchors, locate
from marlowe.plans.registry import query, table

NO = "o_orderkey % 9 || CASE WHEN o_orderkey % 5 = 0 THEN 'Bis' ELSE '' END"
LINES = f"""ln AS (SELECT o_custkey AS law, o_orderkey AS k, o_orderkey % 4 <> 0 AS marker, {NO} AS no, CASE WHEN o_orderkey % 4 <> 0 THEN 'Art. ' || {NO} || '. ' || o_orderpriority ELSE 'voir Art. 5, ' || o_orderstatus END AS line FROM orders),
art AS (SELECT o_custkey AS law, o_orderkey AS id, o_orderkey // 4 % 9 || CASE WHEN o_orderkey % 4 = 0 THEN 'bis' ELSE '' END AS no FROM orders),
ex AS (SELECT law, lower(no) AS no, max(id) AS id FROM art GROUP BY ALL), le AS (SELECT law, regexp_extract(no, '^[0-9]+') AS lead, max(id) AS id FROM art GROUP BY ALL HAVING count(*) = 1)"""


def lines(spark, sf_dir) -> DataFrame:
    no = F.concat((F.col("o_orderkey") % 9).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "Bis").otherwise(""))
    line = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("Art. "), no, F.lit(". "), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("voir Art. 5, "), F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), line.alias("line"))


def articles(spark, sf_dir) -> DataFrame:
    no = F.concat((F.floor(F.col("o_orderkey") / 4) % 9).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "bis").otherwise(""))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("article"), no.alias("no"))


def joined(rows: DataFrame, *by) -> DataFrame:
    return rows.groupBy("doc", *by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(f"""WITH {LINES}, p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY law ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length(line) + 1) OVER (PARTITION BY law) - 1 AS whole FROM ln),
m AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY law ORDER BY k), whole) AS stop FROM p WHERE marker)
SELECT law AS doc, coalesce(ex.id, le.id) AS article, m.no AS no, start::BIGINT AS start, stop::BIGINT AS stop FROM m LEFT JOIN ex ON ex.law = m.law AND ex.no = lower(m.no) LEFT JOIN le ON le.law = m.law AND le.lead = regexp_extract(m.no, '^[0-9]+') WHERE coalesce(ex.id, le.id) % 7 <> 0""".replace("SELECT law AS doc", "SELECT m.law AS doc"))
def located_articles(spark, sf_dir):
    """STR-04: exact number, else the only article with its leading integer, of those allowed."""
    known = articles(spark, sf_dir)
    out = locate.spans(joined(lines(spark, sf_dir)), known, known.where("article % 7 <> 0"))
    return out.withColumn("start", F.col("start").cast("bigint")).withColumn("stop", F.col("stop").cast("bigint"))


@query(f"""WITH {LINES}, f AS (SELECT law, k // 64 AS node, no, min(k) AS k FROM ln WHERE marker GROUP BY ALL), r AS (SELECT f.law, node, f.no, k, coalesce(ex.id, le.id) AS id FROM f LEFT JOIN ex ON ex.law = f.law AND ex.no = lower(f.no) LEFT JOIN le ON le.law = f.law AND le.lead = regexp_extract(f.no, '^[0-9]+')),
d AS (SELECT law, node, id, min(k) AS k FROM r WHERE id IS NOT NULL GROUP BY ALL), n AS (SELECT DISTINCT law, k // 64 AS node FROM ln)
SELECT law AS doc, node, coalesce((SELECT string_agg(id, ',' ORDER BY k) FROM d WHERE d.law = n.law AND d.node = n.node), '') AS articles, coalesce((SELECT string_agg(no, ',' ORDER BY k) FROM r WHERE r.law = n.law AND r.node = n.node AND id IS NOT NULL), '') AS numbers FROM n""")
def own_text_links(spark, sf_dir):
    """STR-11, first pass: a node is the lines of 64 order keys, each behind heading marks."""
    rows = lines(spark, sf_dir).withColumn("node", F.floor(F.col("k") / 64)).withColumn("line", F.concat(F.lit("## "), F.col("line")))
    out = locate.own_links(joined(rows, "node").withColumn("label", F.lit("Section")), articles(spark, sf_dir))
    return out.select("doc", "node", F.array_join(F.transform("articles", lambda x: x.cast("string")), ",").alias("articles"), F.array_join("numbers", ",").alias("numbers"))


TALK = """tx AS (SELECT conv_id AS doc, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1),
ar AS (SELECT conv_id AS doc, turn, CASE WHEN turn % 5 = 1 THEN replace(text, ' ', '  ') WHEN turn % 7 = 3 THEN 'zz' || text ELSE text END AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL)"""
TOKENS = "len(regexp_extract_all(lower({}), '" + tx.TOKEN + "'))"


@query(f"""WITH RECURSIVE {TALK}, s AS (SELECT doc, 0::BIGINT AS i, 0::BIGINT AS frm, NULL::BIGINT AS place, 0::BIGINT AS turn, '' AS a FROM tx UNION ALL
SELECT doc, i, CASE WHEN place >= 0 THEN place + length(a) ELSE frm END, place, turn, a FROM (SELECT *, CASE WHEN exact > 0 THEN frm + exact - 1 WHEN near > 0 THEN frm + near - 1 ELSE -1 END AS place FROM (
SELECT s.doc, ar.i, s.frm, ar.turn, ar.a, strpos(substr(text, s.frm + 1), substr(ar.a, 1, 100)) AS exact, strpos(trim(regexp_replace(substr(text, s.frm + 1), '\\s+', ' ', 'g')), trim(regexp_replace(substr(ar.a, 1, 100), '\\s+', ' ', 'g'))) AS near FROM s JOIN ar ON ar.doc = s.doc AND ar.i = s.i + 1 JOIN tx ON tx.doc = s.doc)))
SELECT doc, turn AS article, place, {TOKENS.format('substr(text, 1, place)')} AS start_token, {TOKENS.format('substr(text, 1, place)')} + {TOKENS.format('a')} AS end_token FROM s JOIN tx USING (doc) WHERE place >= 0""")
def anchored_ranges(spark, sf_dir):
    """STR-07: a conversation's turns as articles of their joined text, some with other white space and some that it doesn't hold."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("doc"), F.col("turn").cast("bigint").alias("k"), F.col("text").alias("line"))
    text = F.when(F.col("k") % 5 == 1, F.replace("line", F.lit(" "), F.lit("  "))).when(F.col("k") % 7 == 3, F.concat(F.lit("zz"), F.col("line"))).otherwise(F.col("line"))
    out = anchors.token_ranges(joined(c), c.select("doc", F.col("k").alias("pos"), F.col("k").alias("article"), text.alias("text")))
    return out.withColumnRenamed("at", "place").select("doc", "article", *[F.col(n).cast("bigint").alias(n) for n in ("place", "start_token", "end_token")])
