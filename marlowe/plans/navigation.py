"""Trees, padded and re-ranked pools, judge answers and coverage summaries as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlowe.operators import navigate, retrieve
from marlowe.plans.corpus import SPANS, weights
from marlowe.plans.ranking import TWO, Base, rounded
from marlowe.plans.registry import query, table

SEGMENTS = "list_filter(string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/'), lambda x: x <> '')"


def segments():
    return F.filter(F.split(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), "/"), lambda x: x != "")


@query(f"WITH p AS (SELECT page_id, {SEGMENTS} AS p FROM pages), i AS (SELECT page_id, p[1:len(p) - 1] AS p FROM p) SELECT page_id, array_to_string(list_filter(p, lambda x, i: i = 1 OR x <> p[i - 1]), ' > ') AS chain FROM i")
def header_chain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(navigate.header_chain(segments()), " > ").alias("chain"))


@query(f"SELECT p[1] AS top, CASE WHEN len(p) > 2 THEN p[2] ELSE '_ungrouped' END AS middle, count(*) AS n_leaves FROM (SELECT {SEGMENTS} AS p FROM pages) GROUP BY ALL")
def grouped_tree(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", segments().alias("p"))
    return navigate.grouped_tree(p.select("page_id", F.get("p", F.lit(0)).alias("host"), F.when(F.size("p") > 2, F.get("p", F.lit(1))).alias("dir")), "host", "dir", "page_id")


@query("SELECT conv_id, count(*) AS n, min(turn) AS first, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def joined_turns(spark, sf_dir):
    return navigate.joined_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"WITH {SPANS}, t AS (SELECT sp.doc_id, sp.qid, coalesce(sum(weight), 0) AS total FROM sp LEFT JOIN w USING (doc_id, qid) GROUP BY ALL) SELECT doc_id, qid, round(total, 6) AS total, CASE WHEN total <= 0 THEN 'missing' WHEN abs(total - 1) <= 0.05 THEN 'ok' ELSE 'warning' END AS bucket FROM t")
def coverage_buckets(spark, sf_dir):
    b = Base(spark, sf_dir)
    return rounded(navigate.coverage_buckets(weights(spark, sf_dir), b.qrels(), ["doc_id", "qid"]))


@query(f"WITH {SPANS}, c AS (SELECT DISTINCT doc_id, i FROM ch) SELECT count(*) AS n_chunks, (SELECT count(*) FROM (SELECT DISTINCT doc_id, chunk FROM w)) AS annotated, round(100 * (SELECT count(*) FROM (SELECT DISTINCT doc_id, chunk FROM w)) / count(*), 4) AS annotated_pct, (SELECT count(DISTINCT qid) FROM w) AS covered, (SELECT count(DISTINCT qid) FROM sp) AS located FROM c")
def annotation_coverage(spark, sf_dir):
    """Chunks of 400 characters every 300, of documents that hold an item."""
    b, w = Base(spark, sf_dir), weights(spark, sf_dir)
    held = b.qrels()
    n = F.char_length("text")
    chunks = b.docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.sum(1 + F.ceil(F.greatest(n - 400, F.lit(0)) / 300)).alias("n_chunks"))
    marked = w.select("doc_id", "chunk").distinct().agg(F.count("*").alias("annotated"))
    covered, located = w.agg(F.countDistinct("qid").alias("covered")), held.agg(F.countDistinct("qid").alias("located"))
    out = chunks.crossJoin(marked).crossJoin(covered).crossJoin(located)  # one row each
    return out.select("n_chunks", "annotated", F.round(100 * F.col("annotated") / F.col("n_chunks"), 4).alias("annotated_pct"), "covered", "located")


@query(f"{TWO}, u AS (SELECT qid, doc_id, 0 AS tier, rank AS pos FROM d WHERE rank <= 5 UNION ALL SELECT qid, doc_id, 1, rank FROM s WHERE rank <= 20), o AS (SELECT qid, doc_id, min(tier * 1000 + pos) AS o FROM u GROUP BY ALL), r AS (SELECT qid, doc_id, (o // 1000)::INT AS tier, row_number() OVER (PARTITION BY qid ORDER BY o, doc_id) AS rank FROM o) SELECT * FROM r WHERE rank <= 20")
def tiered_padding(spark, sf_dir):
    """Five documents by vector, padded to 20 by BM25."""
    b = Base(spark, sf_dir)
    out = navigate.tiered([retrieve.top_k(b.dense(5), 5), b.bm25(20)], 20)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"{TWO}, m AS (SELECT s.qid, s.doc_id, d.score, s.rank AS pos FROM s LEFT JOIN d USING (qid, doc_id) WHERE s.rank <= 50) SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, pos) AS rank FROM m")
def pool_rerank(spark, sf_dir):
    """BM25's first 50 by vector score where the vector run has one, the rest after them."""
    b = Base(spark, sf_dir)
    dense = retrieve.top_k(b.dense(100), 100).withColumn("score", F.round("score", 6))
    return navigate.rerank_pool(b.bm25(50), dense).withColumn("rank", F.col("rank").cast("bigint"))


@query("WITH g AS (SELECT source, nullif(regexp_extract(text, '[0-9]'), '')::INT AS d, CASE WHEN d > 3 THEN 3 ELSE d END AS g FROM documents) SELECT source, count(*) AS n, round(avg(g), 6) AS mean_grade, round(avg(g) / 3, 6) AS scaled, round(avg((g >= 2)::INT), 6) AS relevant FROM g WHERE g IS NOT NULL GROUP BY source")
def judge_grades(spark, sf_dir):
    return rounded(navigate.grade_means(table(spark, sf_dir, "documents"), "source", "text"))


@query("SELECT role, round(avg((trim(coalesce(text, '')) = '' OR contains(lower(text), 'sorry') OR contains(lower(text), 'cannot'))::INT), 6) AS abstained FROM conversations GROUP BY role")
def abstention_rate(spark, sf_dir):
    out = table(spark, sf_dir, "conversations").groupBy("role").agg(F.avg(navigate.abstains(F.col("text"), ["sorry", "cannot"]).cast("int")).alias("abstained"))
    return rounded(out)


@query("SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '(?i)(?:article|art[.]) ?[0-9]+'), ',') AS refs, array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}'), ',') AS dates, array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]{5,}'), ',') AS numbers FROM documents")
def query_signals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *navigate.signals(F.col("text")))


@query("WITH t AS (SELECT count(DISTINCT event_type) AS n FROM events), u AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id), c AS (SELECT count(*) AS n_common FROM u, t WHERE u.n = t.n) SELECT event_type, count(DISTINCT user_id) AS n_units, any_value(n_common) AS n_common FROM events, c GROUP BY event_type")
def unit_intersection(spark, sf_dir):
    """Units of each system, and those that all systems have."""
    pairs = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    every = pairs.agg(F.countDistinct("event_type").alias("n_all"))
    common = pairs.groupBy("user_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(every)).agg(F.count_if(F.col("n") == F.col("n_all")).alias("n_common"))
    return pairs.groupBy("event_type").agg(F.count("user_id").alias("n_units")).crossJoin(F.broadcast(common))


@query("WITH c AS (SELECT source, doc_id, text IS NOT NULL AND regexp_matches(text, '[0-9]') AS touched, n_chars FROM documents) SELECT source, count(*) AS n, round(100 * avg(touched::INT), 4) AS touched_pct, round(median(n_chars) FILTER (touched), 4) AS median_chars, round(quantile_cont(n_chars, 0.9) FILTER (touched), 4) AS p90_chars FROM c GROUP BY source")
def touched_summary(spark, sf_dir):
    c = table(spark, sf_dir, "documents").withColumn("touched", F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)))
    n = F.when(F.col("touched"), F.col("n_chars"))
    return rounded(c.groupBy("source").agg(F.count("*").alias("n"), (100 * F.avg(F.col("touched").cast("int"))).alias("touched_pct"), F.percentile(n, F.lit(0.5)).alias("median_chars"), F.percentile(n, F.lit(0.9)).alias("p90_chars")), 4)
