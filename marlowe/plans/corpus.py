"""Corpus construction and structure queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators import contain, etl, structure
from marlowe.plans.ranking import QRELS, TOK, qrels, rounded
from marlowe.plans.registry import query, table

HREF = 'href="([^"]+)"'


@query("SELECT line, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> '' AND length(line) <= 149 GROUP BY line HAVING count(*) >= 3")
def header_footer_lines(spark, sf_dir):
    return etl.repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""WITH m AS (SELECT *, sum((role = 'user')::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS part FROM conversations)
SELECT conv_id, part::BIGINT AS part, min(turn) AS first_at, max(turn) AS last_at, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM m GROUP BY conv_id, part""")
def marker_sessionise(spark, sf_dir):
    return etl.sessions(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", "text")


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages),
r AS (SELECT doc_id AS id, lang, n_chars AS number FROM documents), a AS (SELECT lang, number, min(id) AS x FROM r GROUP BY ALL HAVING count(DISTINCT id) = 1), b AS (SELECT number, min(id) AS y FROM r GROUP BY ALL HAVING count(DISTINCT id) = 1)
SELECT page_id, l.lang, l.number, coalesce(x, y) AS linked, CASE WHEN x IS NOT NULL THEN 'same_law' WHEN y IS NOT NULL THEN 'anywhere' END AS step FROM l LEFT JOIN a ON a.lang = l.lang AND a.number = l.number LEFT JOIN b ON b.number = l.number""")
def ladder_link(spark, sf_dir):
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)")
    left = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"), number.alias("number"))
    right = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("number"))
    return etl.ladder(left, right, [("same_law", ["lang", "number"]), ("anywhere", ["number"])], "id")


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) SELECT source, arg_max(lang, (n, lang)) AS dominant, max(n) AS n FROM c GROUP BY source")
def dominant_mode(spark, sf_dir):
    c = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("dominant"), F.max("n").alias("n"))


@query("SELECT doc_id, quality::BIGINT AS quality, 'labelled' AS status FROM labels UNION ALL SELECT doc_id, NULL, 'missed' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def append_missing_antijoin(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.lit("labelled").alias("status"))
    missed = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left_anti").withColumn("status", F.lit("missed"))
    return labels.unionByName(missed, allowMissingColumns=True)


CITED = f"raw AS (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS x FROM pages), e AS (SELECT page_id, target, min(i) AS pos FROM (SELECT page_id, unnest(x) AS target, generate_subscripts(x, 1) AS i FROM raw) GROUP BY ALL)"


def cited(spark, sf_dir):
    return etl.citations(table(spark, sf_dir, "pages"), HREF, id_col="page_id", text_col="html")


@query(f"WITH {CITED} SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS first_at FROM e")
def citation_edges(spark, sf_dir):
    return cited(spark, sf_dir)


@query(f"WITH {CITED}, n AS (SELECT page_id::VARCHAR AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS n_cites, sum(i)::BIGINT AS n_cited_by FROM n GROUP BY node")
def inverse_adjacency(spark, sf_dir):
    return etl.degrees(cited(spark, sf_dir).withColumn("page", F.col("page_id").cast("string")), "page", "target")


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY (text IS NOT NULL) DESC, n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r = 1")
def canonical_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars", F.col("text").isNotNull().alias("has"))
    return etl.canonical(rows, ["source", "lang"], [F.col("has"), F.col("n_chars"), F.col("doc_id")]).drop("has")


@query("SELECT doc_id, gold FROM (SELECT d.doc_id, coalesce(l.quality = 1, false) AS gold, row_number() OVER (PARTITION BY md5(text) ORDER BY coalesce(l.quality = 1, false) DESC, d.doc_id) AS r FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE r = 1")
def gt_anchored_dedup(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).join(gold, "doc_id", "left").select("doc_id", "key", F.coalesce("gold", F.lit(False)).alias("gold"))
    return etl.canonical(rows, ["key"], [F.col("gold"), -F.col("doc_id")]).drop("key")


@query("""WITH n AS (SELECT item_id, text, unnest(list_distinct(list_append(list_transform(range(0, greatest(length(text) - 80, 0)::BIGINT + 1, 60), lambda i: substr(text, i + 1, 80)), substr(text, greatest(length(text) - 79, 1), 80)))) AS needle FROM benchmark),
h AS (SELECT n.item_id, n.needle, max(contains(d.text, n.needle)::INT) AS found, FROM n CROSS JOIN documents d GROUP BY ALL), w AS (SELECT b.item_id, max(contains(d.text, b.text)::INT) AS whole FROM benchmark b CROSS JOIN documents d GROUP BY ALL)
SELECT h.item_id, count(*) AS n_needles, sum(found)::BIGINT AS n_found, CASE WHEN any_value(whole) = 1 THEN 'IN_TEXT' WHEN sum(found) > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM h JOIN w USING (item_id) GROUP BY h.item_id""")
def drift_status(spark, sf_dir):
    """ETL-28: items whose whole text, or some of whose needles, a document holds; any number of items."""
    return drift(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def drift(docs, items):
    n = items.select("item_id", F.explode(etl.needles(F.col("text"))).alias("p")).withColumn("probe", F.struct("item_id", F.lit(False).alias("all"), F.col("p").alias("needle")))
    whole = items.select("item_id", F.col("text").alias("p")).withColumn("probe", F.struct("item_id", F.lit(True).alias("all"), F.lit("").alias("needle")))
    hits = contain.holders(docs, n.select("probe", "p").unionByName(whole.select("probe", "p"))).select("probe").distinct()
    found = hits.groupBy("probe.item_id").agg(F.count_if(~F.col("probe.all")).alias("n_found"), F.max("probe.all").alias("whole"))
    out = n.groupBy("item_id").agg(F.count("*").alias("n_needles")).join(found, "item_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return out.select("item_id", "n_needles", "n_found", F.when(F.coalesce("whole", F.lit(False)), "IN_TEXT").when(F.col("n_found") > 0, "PARTIAL").otherwise("MISSING").alias("status"))


GRAM = "unnest(list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4))) AS g"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
x AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, {GRAM.format("x")} FROM p) GROUP BY ALL), y AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, {GRAM.format("y")} FROM p) GROUP BY ALL),
xy AS (SELECT conv_id, turn, sum(x.n * y.n) AS v FROM x JOIN y USING (conv_id, turn, g) GROUP BY ALL), xx AS (SELECT conv_id, turn, sum(n * n) AS v FROM x GROUP BY ALL), yy AS (SELECT conv_id, turn, sum(n * n) AS v FROM y GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN xx.v > 0 AND yy.v > 0 THEN coalesce(xy.v, 0) / sqrt(xx.v) / sqrt(yy.v) END, 6) AS cosine FROM p LEFT JOIN xx USING (conv_id, turn) LEFT JOIN yy USING (conv_id, turn) LEFT JOIN xy USING (conv_id, turn)""")
def char4gram_cosine(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return rounded(etl.ngram_cosine(c.join(after, ["conv_id", "turn"]), ["conv_id", "turn"], "text", "y"))


@query("""WITH s AS (SELECT source, list_sort(list_distinct(list(CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END))) AS found FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source)
SELECT source, CASE WHEN found = ['clean'] THEN 'exact' WHEN found = ['unlabelled'] THEN 'not_present' WHEN NOT list_contains(found, 'unlabelled') THEN 'partial' ELSE 'mixed' END AS category FROM s""")
def extraction_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    clean, toxic, none = (F.max(F.coalesce(c, F.lit(False))) for c in (F.col("toxic") == 0, F.col("toxic") == 1, F.col("toxic").isNull()))
    s = d.groupBy("source").agg(clean.alias("c"), toxic.alias("t"), none.alias("n"))
    return s.select("source", F.when(F.expr("c AND NOT t AND NOT n"), "exact").when(F.expr("n AND NOT c AND NOT t"), "not_present").when(F.expr("NOT n"), "partial").otherwise("mixed").alias("category"))


@query(f"""WITH t AS (SELECT doc_id, {TOK.format("text")} AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, 1 + ceil(greatest(len(t) - 128, 0) / 96)::BIGINT)) AS chunk FROM t WHERE len(t) > 0)
SELECT doc_id, chunk, chunk * 96 AS start_token, least(chunk * 96 + 128, len(t)) AS end_token, array_to_string(t[chunk * 96 + 1 : chunk * 96 + 128], ' ') AS text FROM c""")
def sliding_chunks(spark, sf_dir):
    return structure.sliding_chunks(table(spark, sf_dir, "documents"), tx.tokens(F.col("text")))


SPANS = f"""q AS ({QRELS}), sp AS (SELECT qid, q.doc_id, instr(lower(d.text), lower(b.text)) - 1 AS span_start, length(lower(b.text)) AS len, length(d.text) AS n FROM q JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = qid),
ch AS (SELECT *, i * 300 AS start_char, least(i * 300 + 400, n) AS end_char FROM (SELECT qid, doc_id, span_start, span_start + len AS span_end, len, n, unnest(range(0, 1 + ceil(greatest(n - 400, 0) / 300)::BIGINT)) AS i FROM sp)),
w AS (SELECT doc_id, i AS chunk, qid, (least(end_char, span_end) - greatest(start_char, span_start)) / len AS weight FROM ch WHERE span_start < end_char AND span_end > start_char)"""


def weights(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    held = qrels(docs, items).join(items.select(F.col("item_id").alias("qid"), F.lower("text").alias("q")), "qid")
    both = held.join(docs.select("doc_id", "text"), "doc_id")
    start = F.position(F.col("q"), F.lower("text"))
    spans = both.select("doc_id", "qid", (start - 1).alias("span_start"), (start - 1 + F.char_length("q")).alias("span_end"))
    chunks = structure.char_chunks(docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi"))
    return structure.overlap_weights(chunks, spans, "qid")


@query(f"WITH {SPANS} SELECT doc_id, chunk, qid, round(weight, 6) AS weight FROM w")
def overlap_weights(spark, sf_dir):
    return rounded(weights(spark, sf_dir))


@query(f"WITH {SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, qid ORDER BY weight DESC, chunk) AS rank FROM w) SELECT doc_id, qid, k, round(least(1, sum(weight)), 6) AS coverage FROM r JOIN (VALUES (1), (2), (5)) v(k) ON rank <= k GROUP BY ALL")
def coverage_at_k(spark, sf_dir):
    return rounded(structure.coverage(weights(spark, sf_dir), ["doc_id", "qid"], [F.col("weight").desc(), F.col("chunk")], [1, 2, 5]))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS anchor FROM conversations WHERE role <> 'system'")
def forward_fill_link(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.select("conv_id", "turn", structure.forward_fill(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).alias("anchor"))


PATHS = r"""p AS (SELECT list_filter(string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/'), lambda x: x <> '') AS p FROM pages),
i AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p), n AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS node, CASE WHEN i > 1 THEN array_to_string(p[1:i - 1], '/') END AS parent, i - 1 AS depth FROM i)"""


def url_nodes(spark, sf_dir):
    bare = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return structure.prefix_nodes(table(spark, sf_dir, "pages").select(bare.alias("path")), "path")


@query(f"WITH {PATHS} SELECT * FROM n")
def prefix_tree(spark, sf_dir):
    return url_nodes(spark, sf_dir)


@query(f"""WITH {PATHS}, f AS (SELECT parent, count(*) AS fan FROM n WHERE parent IS NOT NULL GROUP BY parent)
SELECT count(*) AS n_nodes, count_if(parent IS NULL)::BIGINT AS n_roots, max(depth) AS depth, (SELECT count(*) FROM f) AS n_inner, round((SELECT avg(fan) FROM f), 6) AS fan_mean, round((SELECT median(fan) FROM f), 6) AS fan_median,
round((SELECT quantile_cont(fan, 0.9) FROM f), 6) AS fan_p90, (SELECT max(fan) FROM f) AS fan_max, count(*) - (SELECT count(*) FROM f) AS n_leaves FROM n""")
def tree_stats(spark, sf_dir):
    return rounded(structure.tree_stats(url_nodes(spark, sf_dir)))


@query(f"WITH {PATHS}, a AS (SELECT node AS anchor, depth FROM n WHERE length(node) % 2 = 0) SELECT n.node, arg_max(anchor, a.depth) AS anchor FROM n LEFT JOIN a ON starts_with(n.node, anchor || '/') GROUP BY n.node")
def ancestor_link(spark, sf_dir):
    nodes = url_nodes(spark, sf_dir)
    return structure.nearest_ancestor(nodes, nodes.where(F.char_length("node") % 2 == 0).select(F.col("node").alias("anchor")))
