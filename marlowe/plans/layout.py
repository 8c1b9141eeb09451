"""Words, regions and rectangles. Conversations' turns stand in for a document's pages, eight words a line and eight lines a block;
order lines for retrieved items."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlowe.operators import layout
from marlowe.plans.registry import query, table

WORDS = r"""pg AS (SELECT conv_id AS doc, turn AS page, coalesce(text, '') AS text, sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM conversations),
ws AS (SELECT doc, page, coalesce(off, 0) AS off, text, regexp_extract_all(text, '[^ \t\n\r]+') AS w, string_split_regex(text, '[^ \t\n\r]+') AS s FROM pg),
wx AS (SELECT doc, page, off, i - 1 AS n, w[i] AS word, list_sum(list_transform(s[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:i - 1], lambda x: length(x))), 0) AS spot FROM ws, unnest(range(1, len(w) + 1)) AS t(i)),
wd AS (SELECT doc, page, n, word, n // 64 AS block, n // 8 AS line, (50 * (n % 8))::DOUBLE AS x0, (12 * (n // 8))::DOUBLE AS y0, (50 * (n % 8) + 6 * length(word))::DOUBLE AS x1, (12 * (n // 8) + 10)::DOUBLE AS y1, (off + spot)::BIGINT AS start, (off + spot + length(word))::BIGINT AS stop FROM wx)"""
BOXES = WORDS + """, tot AS (SELECT doc, max(stop) AS whole FROM wd GROUP BY doc), rg AS (SELECT doc, k AS region, 300 * k + 17 AS r0, 300 * k + 250 AS r1 FROM tot, unnest(range(0, whole // 300 + 1)) AS t(k)),
bx AS (SELECT doc, region, page, block, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rg JOIN wd USING (doc) WHERE start < r1 AND stop > r0 GROUP BY ALL)"""


def words_of(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    w = c.select("doc", "page", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), 0)).alias("n", "word"))
    at, row = F.col("n") % 8, F.floor(F.col("n") / 8)
    box = [(50.0 * at).alias("x0"), (12.0 * row).alias("y0"), (50.0 * at + 6 * F.char_length("word")).alias("x1"), (12.0 * row + 10).alias("y1")]
    return c, w.select("*", F.floor(F.col("n") / 64).alias("block"), row.alias("line"), *box)


def index_of(spark, sf_dir):
    return layout.word_index(*words_of(spark, sf_dir))


def boxes_of(spark, sf_dir):
    index = index_of(spark, sf_dir)
    regions = index.groupBy("doc").agg(F.max("stop").alias("whole")).select("doc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("whole") / 300))).alias("region"))
    return layout.line_boxes(regions.select("doc", "region", (300 * F.col("region") + 17).alias("start"), (300 * F.col("region") + 250).alias("stop")), index)


@query(f"WITH {WORDS} SELECT doc, page, n::BIGINT AS n, word, start, stop FROM wd")
def word_places(spark, sf_dir):
    """STR-32: where each word of a page is in the document's text."""
    return index_of(spark, sf_dir).select("doc", "page", F.col("n").cast("bigint").alias("n"), "word", "start", "stop")


@query(f"WITH {BOXES} SELECT doc, region, page, block::BIGINT AS block, line::BIGINT AS line, x0, y0, x1, y1 FROM bx")
def region_boxes(spark, sf_dir):
    """STR-32: the box of each line that a region of the text touches."""
    return boxes_of(spark, sf_dir).select("doc", "region", "page", "block", "line", "box.*")


HOLE = (120.0, 30.0, 250.0, 75.0)


@query(f"""WITH {BOXES}, i AS (SELECT *, greatest(x0, {HOLE[0]}) AS a, greatest(y0, {HOLE[1]}) AS b, least(x1, {HOLE[2]}) AS c, least(y1, {HOLE[3]}) AS d FROM bx), s AS (SELECT *, a < c AND b < d AS meets FROM i),
p AS (SELECT doc, region, page, line, 'whole' AS part, x0, y0, x1, y1 FROM s WHERE NOT meets UNION ALL SELECT doc, region, page, line, 'shared', a, b, c, d FROM s WHERE meets
 UNION ALL SELECT doc, region, page, line, 'rest', x0, y0, x1, b FROM s WHERE meets AND y0 < b UNION ALL SELECT doc, region, page, line, 'rest', x0, d, x1, y1 FROM s WHERE meets AND d < y1
 UNION ALL SELECT doc, region, page, line, 'rest', x0, b, a, d FROM s WHERE meets AND x0 < a UNION ALL SELECT doc, region, page, line, 'rest', c, b, x1, d FROM s WHERE meets AND c < x1)
SELECT doc, region, page, line::BIGINT AS line, part, x0, y0, x1, y1 FROM p""")
def rectangle_parts(spark, sf_dir):
    """STR-33: each line's box split by another rectangle into what they share and what is left."""
    hole = layout.rect(*map(F.lit, HOLE))
    b = boxes_of(spark, sf_dir).withColumn("shared", layout.intersection(F.col("box"), hole))
    named = lambda name, parts: F.transform(parts, lambda p: F.struct(F.lit(name).alias("part"), p.alias("r")))
    rest = layout.without(F.col("box"), hole)
    parts = F.when(F.col("shared").isNull(), named("whole", rest)).otherwise(F.concat(named("shared", F.array("shared")), named("rest", rest)))
    return b.select("doc", "region", "page", "line", F.explode(parts).alias("p")).select("doc", "region", "page", "line", "p.part", "p.r.*")


@query("""WITH it AS (SELECT l_orderkey AS qid, l_suppkey AS doc, l_linenumber AS region, l_linenumber AS rank, CASE WHEN l_partkey % 3 = 0 THEN 10 * l_partkey END AS s, CASE WHEN l_partkey % 3 = 0 THEN 10 * l_partkey + 7 END AS e, l_partkey % 20 AS article,
 [l_partkey % 20, l_partkey % 7] AS articles, l_partkey % 4 = 1 AS has_node, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 9 END AS page FROM lineitem), g AS (SELECT o_orderkey AS qid, list(DISTINCT o_custkey % 20) AS gold FROM orders WHERE o_custkey % 10 > 0 GROUP BY 1),
sp AS (SELECT s_suppkey AS doc, a AS article, 100 * a + 1 AS s2, 100 * a + 50 AS e2 FROM supplier, unnest(range(0, 10)) AS t(a)),
m AS (SELECT it.*, s2, e2, CASE WHEN g.gold IS NOT NULL AND NOT list_has_any(articles, g.gold) THEN 'wrong_retrieved' ELSE 'retrieved' END AS kind FROM it LEFT JOIN g USING (qid) LEFT JOIN sp USING (doc, article))
SELECT qid, doc, region, rank, coalesce(CASE WHEN s > 0 AND e > 0 THEN s ELSE s2 END, 0)::BIGINT AS start, coalesce(CASE WHEN s > 0 AND e > 0 THEN e ELSE e2 END, 0)::BIGINT AS stop, NULL::BIGINT AS page, kind AS category FROM m
UNION ALL SELECT qid, doc, region, rank, 0, 0, page, kind || '_node_page' FROM m WHERE has_node AND page IS NOT NULL""")
def region_classes(spark, sf_dir):
    """STR-33: retrieved items as regions, right or wrong by the query's gold, and the page bands of nodes."""
    k = F.col("l_partkey")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("region"), F.col("l_linenumber").alias("rank"),
        F.when(k % 3 == 0, 10 * k).alias("start"), F.when(k % 3 == 0, 10 * k + 7).alias("stop"), (k % 20).alias("article"), F.array(k % 20, k % 7).alias("articles"),
        F.when(k % 4 == 1, k).alias("node"), F.when(k % 5 > 0, k % 9).alias("page"),
    )
    gold = table(spark, sf_dir, "orders").where("o_custkey % 10 > 0").select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % 20).alias("article"))
    spans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("article"))
    return layout.regions_of(items, gold, spans.select("doc", "article", (100 * F.col("article") + 1).alias("start"), (100 * F.col("article") + 50).alias("stop")))
