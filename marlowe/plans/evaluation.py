"""Unit-level evaluation, threshold calibration and the remaining relational shapes.

Units are documents; each lies in two articles, one of five neighbours (weight 0.75) and one of seven (0.25).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from marlowe.operators import retrieve, units
from marlowe.plans.ranking import BASE, QRELS, UNIT, Base, okapi, rounded, shown, top
from marlowe.plans.ranking import units as user_means
from marlowe.plans.registry import query, table

CUTS = [1, 5, 10]
ART = f"""WITH {BASE}, run AS ({top(okapi(), 100)}), ql AS ({QRELS}), ln AS (SELECT doc_id, doc_id // 5 AS article, 0.75::DOUBLE AS weight FROM documents UNION ALL SELECT doc_id, -1 - doc_id // 7, 0.25 FROM documents),
gd AS (SELECT DISTINCT qid, article FROM ql JOIN ln USING (doc_id)), pr AS (SELECT DISTINCT article FROM ln JOIN documents USING (doc_id) WHERE lang = 'en'), ks AS (SELECT * FROM (VALUES (1), (5), (10)) v(k)),
af AS (SELECT qid, article, max(score) AS score, min(rank) AS first_unit FROM run JOIN ln USING (doc_id) GROUP BY ALL),
ar AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_unit, article) AS rank FROM af)"""
SETS = """SELECT qid, k, round(h / n_gold, 6) AS recall, (h > 0)::DOUBLE AS hit, round(h / (n_gold + least(k, n_run) - h), 6) AS jaccard FROM
(SELECT g.qid, k, count(DISTINCT g.article) AS n_gold, count(DISTINCT a.article) FILTER (a.rank <= k) AS h, (SELECT count(*) FROM ar WHERE ar.qid = g.qid) AS n_run FROM {} g JOIN ks ON true LEFT JOIN ar a ON a.qid = g.qid AND a.article = g.article GROUP BY g.qid, k)"""


class Units:
    def __init__(self, spark, sf_dir):
        self.base = b = Base(spark, sf_dir)
        self.run = shown(b.bm25(100)).withColumnRenamed("doc_id", "unit")
        self.links = self.held(b.docs)
        self.present = self.held(b.docs.where("lang = 'en'"))

    @cached_property
    def gold(self):
        """Made when asked for, as judgements are written at once."""
        return self.base.qrels().withColumnRenamed("doc_id", "unit").join(self.links, "unit").select("qid", "article").distinct()

    @staticmethod
    def held(docs):
        both = F.array(F.struct(F.expr("doc_id DIV 5").alias("article"), F.lit(0.75).alias("weight")), F.struct((-1 - F.expr("doc_id DIV 7")).alias("article"), F.lit(0.25).alias("weight")))
        return docs.select(F.col("doc_id").alias("unit"), F.inline(both))

    def articles(self):
        return units.article_run(self.run, self.links)


@query(f"{ART} SELECT * FROM ar")
def article_run(spark, sf_dir):
    return units.article_run(*(lambda u: (u.run, u.links))(Units(spark, sf_dir))).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT doc_id AS unit, doc_id // 5 AS article, 0.75::DOUBLE AS weight FROM documents")
def best_article(spark, sf_dir):
    return units.best_article(Units.held(table(spark, sf_dir, "documents")))


@query(f"{ART} SELECT r.qid, r.doc_id AS unit, round(coalesce(sum(weight) FILTER (g.article IS NOT NULL), 0), 6) AS strict, (count(g.article) > 0)::DOUBLE AS lenient FROM run r JOIN ln USING (doc_id) LEFT JOIN gd g ON g.qid = r.qid AND g.article = ln.article WHERE r.qid IN (SELECT qid FROM gd) GROUP BY ALL")
def unit_relevance(spark, sf_dir):
    u = Units(spark, sf_dir)
    return rounded(units.unit_relevance(u.run, u.links, u.gold))


@query(f"{ART} {SETS.format('gd')}")
def article_set_metrics(spark, sf_dir):
    u = Units(spark, sf_dir)
    return rounded(units.set_metrics(u.articles(), u.gold, CUTS))


@query(f"{ART}, eg AS (SELECT * FROM gd WHERE article IN (SELECT article FROM pr)) SELECT k, count(*) AS n_evaluable, round(avg(recall), 5) AS recall, round(avg(hit), 5) AS hit, round(avg(jaccard), 5) AS jaccard FROM ({SETS.format('eg')}) GROUP BY k")
def effective_metrics(spark, sf_dir):
    u = Units(spark, sf_dir)
    m = rounded(units.set_metrics(u.articles(), units.effective_gold(u.gold, u.present), CUTS))
    return rounded(m.groupBy("k").agg(F.count("*").alias("n_evaluable"), *[F.avg(c).alias(c) for c in ("recall", "hit", "jaccard")]), 5)


@query(f"""{ART}, c AS (SELECT q.qid, k, count(a.article) AS n_articles, count(g.article) AS n_gold FROM (SELECT DISTINCT qid FROM gd) q JOIN ks ON true LEFT JOIN af a ON a.qid = q.qid AND a.first_unit <= k LEFT JOIN gd g ON g.qid = a.qid AND g.article = a.article GROUP BY q.qid, k)
SELECT qid, k, n_articles, n_gold, n_articles - n_gold AS n_distractors, CASE WHEN n_articles > 0 THEN round(n_gold / n_articles, 6) ELSE 0 END AS precision, CASE WHEN n_articles > 0 THEN round(k / n_articles, 6) END AS units_per_article FROM c""")
def unit_context(spark, sf_dir):
    u = Units(spark, sf_dir)
    return rounded(units.unit_context(u.run, u.links, u.gold, CUTS))


@query(f"{ART} SELECT gd.qid, CASE WHEN count(first_unit) = count(*) THEN max(first_unit) END AS units FROM gd LEFT JOIN af USING (qid, article) GROUP BY gd.qid")
def units_to_cover(spark, sf_dir):
    u = Units(spark, sf_dir)
    return units.units_to_cover(u.run, u.links, u.gold)


@query(f"""{ART}, m AS (SELECT gd.qid, gd.article, a.article IS NOT NULL AS found, count(*) OVER (PARTITION BY gd.qid) AS n_gold, count(a.article) OVER (PARTITION BY gd.qid) = 0 AS entire_miss FROM gd LEFT JOIN (SELECT * FROM ar WHERE rank <= 2) a USING (qid, article))
SELECT qid, article, n_gold, CASE WHEN article IN (SELECT article FROM pr) THEN 'BEYOND_POOL' ELSE 'ABSENT' END AS miss_class, entire_miss FROM m WHERE NOT found""")
def missed_gold(spark, sf_dir):
    u = Units(spark, sf_dir)
    return units.missed_gold(u.articles(), u.gold, u.present, 2)


@query(f"""{ART}, g AS (SELECT gd.qid, count(*) AS n, count(a.article) AS hits, count_if(a.article IS NULL AND gd.article IN (SELECT article FROM pr)) AS rest, (SELECT count(*) FROM ar WHERE ar.qid = gd.qid AND ar.rank <= 2) AS n_head, (SELECT count(*) FROM pr) AS n_all
FROM gd LEFT JOIN (SELECT * FROM ar WHERE rank <= 2) a USING (qid, article) GROUP BY gd.qid)
SELECT qid, round(hits / n, 6) AS head_recall, round((hits + CASE WHEN n_all > n_head THEN rest * greatest(0, least(100, n_all) - n_head) / (n_all - n_head) ELSE 0 END) / n, 6) AS expected_recall FROM g""")
def padding_expectation(spark, sf_dir):
    u = Units(spark, sf_dir)
    return rounded(units.padding_expectation(u.articles(), u.gold, u.present, 2, 100))


@query(f"{ART} SELECT a.qid, round(count(g.article) / count(*), 6) AS achieved, round(least((SELECT count(*) FROM gd WHERE gd.qid = a.qid), count(*)) / count(*), 6) AS ceiling FROM ar a LEFT JOIN gd g ON g.qid = a.qid AND g.article = a.article WHERE a.rank <= 10 AND a.qid IN (SELECT qid FROM gd) GROUP BY a.qid")
def precision_ceiling(spark, sf_dir):
    u = Units(spark, sf_dir)
    return rounded(units.precision_ceiling(u.articles(), u.gold, 10))


@query("""WITH r AS (SELECT (n_chars % 1000) / 1000 AS s, toxic AS y FROM documents LEFT JOIN labels USING (doc_id)), t AS (SELECT i / 20 AS tau FROM range(1, 20) v(i)),
a AS (SELECT tau, round(count_if((s >= tau)::INT = y) / count(y), 4) AS accuracy, round(count_if(s < tau) / count(*), 4) AS negative_share FROM r, t GROUP BY tau)
SELECT round(tau, 6) AS tau, accuracy, negative_share, row_number() OVER (ORDER BY negative_share >= 0.1 DESC, accuracy DESC, tau) = 1 AS chosen FROM a""")
def calibrate_threshold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rounded(units.calibrate_threshold(d.withColumn("s", F.col("n_chars") % 1000 / 1000), "s", "toxic", [i / 20 for i in range(1, 20)]))


@query("SELECT round(count_if(quality = toxic) / count(*), 6) AS accuracy, round(count_if(quality = 1 AND toxic = 1) / nullif(count_if(quality = 1), 0), 6) AS precision, round(count_if(quality = 1 AND toxic = 1) / nullif(count_if(toxic = 1), 0), 6) AS recall FROM labels")
def evaluator_accuracy(spark, sf_dir):
    both, said, true = (F.count_if(F.expr(e)) for e in ("quality = 1 AND toxic = 1", "quality = 1", "toxic = 1"))
    rows = table(spark, sf_dir, "labels")
    return rounded(rows.agg((F.count_if(F.col("quality") == F.col("toxic")) / F.count("*")).alias("accuracy"), (both / F.nullif(said, F.lit(0))).alias("precision"), (both / F.nullif(true, F.lit(0))).alias("recall")))


@query(f"WITH {UNIT}, e AS (SELECT min(event_type) AS x, max(event_type) AS y FROM events), d AS (SELECT a.user_id % 3 AS stratum, round(b.v - a.v, 9) AS d FROM u a JOIN u b USING (user_id), e WHERE a.event_type = e.x AND b.event_type = e.y) SELECT stratum, count(*) AS n, round(avg(d), 6) AS mean_delta, count_if(d > 0)::BIGINT AS wins, count_if(d = 0)::BIGINT AS ties, count_if(d < 0)::BIGINT AS losses FROM d GROUP BY stratum")
def stratum_delta(spark, sf_dir):
    """The last event type against the first; which these are stays in the plan."""
    ends = table(spark, sf_dir, "events").agg(F.min("event_type").alias("x"), F.max("event_type").alias("y"))
    u = user_means(spark, sf_dir).crossJoin(F.broadcast(ends)).withColumn("stratum", F.col("user_id") % 3)  # ends is one row
    u = u.withColumn("event_type", F.when(F.col("event_type") == F.col("x"), "first").when(F.col("event_type") == F.col("y"), "last")).drop("x", "y")
    return rounded(units.stratum_delta(u, "event_type", "user_id", "stratum", "v", "first", "last"))


@query("SELECT event_type, count(*) AS n, count_if(value < 10)::BIGINT AS missed, round(100 * count_if(value < 10) / count(*), 4) AS missed_pct FROM events GROUP BY event_type")
def failure_pooling(spark, sf_dir):
    missed = F.count_if(F.col("value") < 10)
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), missed.alias("missed"), (100 * missed / F.count("*")).alias("missed_pct")), 4)


@query("""SELECT p_partkey, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM part LEFT JOIN (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) o ON o.k = p_partkey LEFT JOIN (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) i ON i.k = p_partkey""")
def sql_neighbours(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    out = edges.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("l_suppkey").alias("n_out"))
    into = edges.where("l_suppkey IS NOT NULL").groupBy(F.col("l_suppkey").alias("p_partkey")).agg(F.count("l_partkey").alias("n_in"))
    return table(spark, sf_dir, "part").select("p_partkey").join(out, "p_partkey", "left").join(into, "p_partkey", "left").fillna(0, ["n_out", "n_in"])


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def sql_both_endpoints(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    sellers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left_semi").join(sellers, "l_suppkey", "left_semi")
    return lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS bucket, substr(o_orderdate::VARCHAR, 1, 4) AS year, count(*) AS n FROM orders WHERE regexp_matches(substr(o_orderdate::VARCHAR, 1, 4), '^(19|20)[0-9]{2}$') GROUP BY ALL")
def sql_coalesced_key(spark, sf_dir):
    year = F.substring(F.col("o_orderdate").cast("string"), 1, 4)
    o = table(spark, sf_dir, "orders").select(F.coalesce(F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority").alias("bucket"), year.alias("year"))
    return o.where(F.col("year").rlike("^(19|20)[0-9]{2}$")).groupBy("bucket", "year").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN grouping(source) = 1 THEN 'All' ELSE coalesce(source, '(none)') END AS source, count_if(lang = 'en')::BIGINT AS en, count_if(lang = 'fr')::BIGINT AS fr, count_if(lang = 'de')::BIGINT AS de, count_if(lang = 'es')::BIGINT AS es, count(*) AS total FROM documents GROUP BY ROLLUP (source)")
def sql_unstack_totals(spark, sf_dir):
    out = table(spark, sf_dir, "documents").rollup("source").agg(F.grouping("source").alias("every"), *[F.count_if(F.col("lang") == x).alias(x) for x in ("en", "fr", "de", "es")], F.count("*").alias("total"))
    return out.withColumn("source", F.when(F.col("every") == 1, "All").otherwise(F.coalesce("source", F.lit("(none)")))).drop("every")


@query("SELECT source, lang, arg_min(doc_id, (l.doc_id IS NULL)::INT * 1000000000000 + d.doc_id) AS doc_id FROM (SELECT * FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source, lang".replace("arg_min(doc_id", "arg_min(d.doc_id"))
def canonical_pick(spark, sf_dir):
    """A labelled document of each source and language, else any; the least id."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(known, "doc_id", "left")
    return d.groupBy("source", "lang").agg(F.min_by("doc_id", F.struct(F.col("known").isNull(), "doc_id")).alias("doc_id"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{3,}'))), ',') AS refs FROM documents")
def reference_set(spark, sf_dir):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]{3,}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("refs"))


@query("SELECT doc_id, trim(regexp_extract(coalesce(text, ''), '^[^.!?]*[.!?]?'), ' ') AS sentence FROM documents")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), "^[^.!?]*[.!?]?", 0)).alias("sentence"))
