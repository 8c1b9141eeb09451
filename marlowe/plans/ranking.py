"""Retrieval, fusion and metric queries: benchmark items as questions over documents and embeddings."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators import contain, fuse, metrics, retrieve, stats
from marlowe.plans.registry import query, spread, table
from marlowe.sources.writers import kept

TOK = f"regexp_extract_all(lower({{}}), '{tx.TOKEN}')"
BASE = f"""
tok AS (SELECT doc_id, {TOK.format("text")} AS t FROM documents),
st AS (SELECT count(*)::BIGINT AS n, avg(len(t)) AS avgdl FROM tok),
po AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOK.format("text")}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term)"""
QRELS = "SELECT b.item_id AS qid, d.doc_id, 1 AS grade FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))"


def top(inner: str, k: int) -> str:
    return f"SELECT qid, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({inner})) WHERE rank <= {k}"


def okapi(k1: float = 1.5, b: float = 0.75) -> str:
    return f"""SELECT qt.qid, po.doc_id, sum(qtf * idf * tf * ({k1} + 1) / ({k1} * (1 - {b} + {b} * dl / avgdl) + tf)) AS score
    FROM po JOIN (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st)) i USING (term) JOIN qt USING (term), st GROUP BY ALL"""


#: The stated query set: every id that 50 divides.
STATED = "vec_id % 50 = 0"
VEC_Q = f"SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE {STATED}"
DENSE = f"SELECT qid, vec_id AS doc_id, list_sum(list_transform(range(1, 65), lambda i: q[i]::DOUBLE * embedding[i]::DOUBLE)) AS score FROM embeddings, ({VEC_Q}) WHERE vec_id <> qid"
DOC_DENSE = "SELECT qid, vec_id AS doc_id, list_sum(list_transform(range(1, 65), lambda i: q[i]::DOUBLE * embedding[i]::DOUBLE)) AS score FROM embeddings, (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))"


class Base:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs, self.items = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
        self.vectors = table(spark, sf_dir, "embeddings")
        self.posts, self.stats = retrieve.postings(self.docs), retrieve.collection(self.docs)
        self.terms = retrieve.query_terms(self.items, id_col="item_id")

    @cached_property
    def tokens(self) -> DataFrame:
        """(doc_id, tokens, lang); whole texts go to the tasks, which split them."""
        return retrieve.unsplit(self.docs, "lang")

    @cached_property
    def counts(self) -> DataFrame:
        """The vocabulary with the documents' number and length, written, as each search reads it twice."""
        return kept(retrieve.survey(self.tokens), "vocabulary")

    def best(self, k: int, **options) -> DataFrame:
        """(qid, doc_id, score) with what can be among each item's k best."""
        counts = self.counts.where("term IS NOT NULL").select("term", "df")
        return retrieve.bm25_top(self.tokens, self.terms, retrieve.surveyed(self.counts), k, counts=counts, **options)

    def bm25(self, k: int, **options) -> DataFrame:
        """The run of each item's k best."""
        return retrieve.top_k(self.best(k, **options), k)

    def queries(self) -> DataFrame:
        return self.vectors.join(self.items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))

    def stored(self) -> DataFrame:
        return self.vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))

    def dense(self, k: int | None = None) -> DataFrame:
        return retrieve.dense(self.stored(), self.queries(), k=k)

    def qrels(self) -> DataFrame:
        """Written once, as metrics read them more than once."""
        return kept(qrels(self.docs, self.items), "qrels")


def qrels(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Binary judgements (qid, doc_id, grade): the document holds the whole item, in lower case."""
    found = contain.holders(docs.select("doc_id", F.lower("text").alias("text")), items.select(F.col("item_id").alias("probe"), F.lower("text").alias("p")))
    return found.select(F.col("probe").alias("qid"), "doc_id", F.lit(1).alias("grade"))


def shown(run: DataFrame) -> DataFrame:
    return run.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query(f"WITH {BASE} {top(okapi(), 10)}")
def bm25_topk(spark, sf_dir):
    return shown(Base(spark, sf_dir).bm25(10))


@query(f"WITH {BASE} {top('SELECT qt.qid, po.doc_id, sum(qtf * ln((n + 1) / df) * (1.0 + tf * 2.5 / (1.5 * (1 - 0.75 + 0.75 * dl / avgdl) + tf))) AS score FROM po JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL', 10)}")
def bm25_plus_topk(spark, sf_dir):
    return shown(Base(spark, sf_dir).bm25(10, variant="plus"))


@query(f"WITH {BASE}, c AS (SELECT qid, doc_id, qtf, ln(n + 1) - ln(df + 0.5) AS idf, tf / (1 - 0.75 + 0.75 * dl / avgdl) AS c FROM po JOIN df USING (term) JOIN qt USING (term), st) {top('SELECT qid, doc_id, sum(qtf * idf * (c + 0.5) * 2.5 / (1.5 + c + 0.5)) AS score FROM c GROUP BY ALL', 10)}")
def bm25l_topk(spark, sf_dir):
    return shown(Base(spark, sf_dir).bm25(10, variant="l"))


@query(f"WITH {BASE} {top('SELECT qt.qid, po.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (1.2 * (1 - 0.75 + 0.75 * dl / avgdl) + tf)) AS score FROM po JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL', 10)}")
def fts_or_topk(spark, sf_dir):
    return shown(Base(spark, sf_dir).bm25(10, variant="fts", k1=1.2, b=0.75, distinct_terms=True))


@query(f"WITH {BASE} {top(f'SELECT x.* FROM ({okapi(1.5, 0.25)}) x JOIN documents d ON d.doc_id = x.doc_id WHERE lang = $$en$$', 10)}")
def bm25_filtered_topk(spark, sf_dir):
    b = Base(spark, sf_dir)
    return shown(b.bm25(10, k1=1.5, b=0.25, among=b.tokens.where("lang = 'en'")))


@query(f"""WITH {BASE}, grid AS (SELECT * FROM (VALUES (1.2, 0.25), (1.2, 0.75), (1.5, 0.25), (1.5, 0.75)) g(k1, b)),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st)),
s AS (SELECT k1, b, qid, doc_id, sum(qtf * idf * tf * (k1 + 1) / (k1 * (1 - b + b * dl / avgdl) + tf)) AS score FROM po JOIN i USING (term) JOIN qt USING (term), st, grid GROUP BY ALL)
SELECT k1::DOUBLE AS k1, b::DOUBLE AS b, qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank = 1""")
def bm25_k1_b_grid(spark, sf_dir):
    """All cells from one pass: a batch of documents meets each cell's parameters in its task."""
    b = Base(spark, sf_dir)
    scored = b.best(1, grid=[(k1, bb) for k1 in (1.2, 1.5) for bb in (0.25, 0.75)])
    order = Window.partitionBy("k1", "b", "qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("k1", "b", "qid", "doc_id")


TFIDF = """SELECT a.qid, a.doc_id, dot / sqrt(dn) / sqrt(qn) AS score FROM
(SELECT q.qid, d.doc_id, sum(d.w * q.w) AS dot FROM dw d JOIN qw q USING (term) GROUP BY ALL) a
JOIN (SELECT doc_id, sum(w * w) AS dn FROM dw GROUP BY ALL) b USING (doc_id) JOIN (SELECT qid, sum(w * w) AS qn FROM qw GROUP BY ALL) c USING (qid)"""


@query(f"WITH {BASE}, i AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, st), dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM po JOIN i USING (term)), qw AS (SELECT qid, term, (1 + ln(qtf)) * idf AS w FROM qt JOIN i USING (term)) {top(TFIDF, 10)}")
def tfidf_cosine_topk(spark, sf_dir):
    b = Base(spark, sf_dir)
    return shown(retrieve.top_k(retrieve.tfidf(b.posts, b.terms, b.stats), 10))


def vector_run(spark, sf_dir, k):
    v = table(spark, sf_dir, "embeddings")
    q = v.where(STATED).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return retrieve.dense(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), q, k=k + 1).where("doc_id <> qid")  # a vector finds itself


@query(top(DENSE, 10))
def dense_ip_topk(spark, sf_dir):
    return shown(retrieve.top_k(vector_run(spark, sf_dir, 10), 10))


FETCHED = f"WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS first_rank FROM ({DENSE})) WHERE first_rank <= 500) "


@query(FETCHED + top("SELECT f.qid, f.doc_id, f.score FROM f JOIN embeddings e ON e.vec_id = f.doc_id WHERE label = 3", 5))
def dense_postfilter_topk(spark, sf_dir):
    """After a first cut of 500, as the reference makes it."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    first = retrieve.top_k(vector_run(spark, sf_dir, 500), 500)
    return shown(retrieve.top_k(first.drop("rank").join(labels, "doc_id").where("label = 3"), 5))


@query(f"WITH {BASE}, pool AS ({top(okapi(), 50)}), dn AS ({DOC_DENSE}) {top('SELECT dn.* FROM dn JOIN pool USING (qid, doc_id)', 10)}")
def sgdr_topk(spark, sf_dir):
    b = Base(spark, sf_dir)
    return shown(retrieve.rescore_pool(b.bm25(50), b.stored(), b.queries(), 10))


TWO = f"WITH {BASE}, s AS ({top(okapi(), 100)}), d AS ({top(DOC_DENSE, 100)})"


def two(spark, sf_dir):
    b = Base(spark, sf_dir)
    return b.bm25(100), retrieve.top_k(b.dense(100), 100)


@query(f"{TWO} {top('SELECT qid, doc_id, 1 / (60 + coalesce(s.rank, 101)) + 1 / (60 + coalesce(d.rank, 101)) AS score FROM s FULL JOIN d USING (qid, doc_id)', 20)}")
def rrf_missing_rank(spark, sf_dir):
    return shown(retrieve.top_k(fuse.rrf(list(two(spark, sf_dir)), missing="rank"), 20))


@query(f"{TWO} {top('SELECT qid, doc_id, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM d) GROUP BY ALL', 20)}")
def rrf_zero_missing(spark, sf_dir):
    return shown(retrieve.top_k(fuse.rrf(list(two(spark, sf_dir))), 20))


@query(f"{TWO}, l AS (SELECT *, 0 AS li FROM s UNION ALL SELECT *, 1 FROM d), n AS (SELECT qid, li, max(rank) AS n FROM l GROUP BY ALL), ids AS (SELECT DISTINCT qid, doc_id FROM l) {top('SELECT i.qid, i.doc_id, sum(1 / (60 + coalesce(l.rank, n.n + 1))) AS score FROM ids i JOIN n USING (qid) LEFT JOIN l ON l.qid = i.qid AND l.doc_id = i.doc_id AND l.li = n.li GROUP BY ALL', 20)}")
def ragfusion_rrf(spark, sf_dir):
    return shown(retrieve.top_k(fuse.rrf(list(two(spark, sf_dir)), missing="length"), 20))


@query(f"SELECT qid, doc_id, rank FROM ({TWO}, z AS (SELECT qid, doc_id, greatest(0, score / (max(score) OVER (PARTITION BY qid) + 1e-8)) AS x FROM s) {top('SELECT qid, doc_id, 0.9 * coalesce(d.score, 0) + (1 - 0.9) * coalesce(x, 0) AS score FROM z FULL JOIN d USING (qid, doc_id)', 20)})")
def linear_fusion(spark, sf_dir):
    s, d = two(spark, sf_dir)
    tidy = lambda r: r.withColumn("score", F.round("score", 6))
    return shown(retrieve.top_k(fuse.linear(tidy(d), tidy(s), alpha=0.9), 20)).drop("score")


@query(f"{TWO} SELECT qid, doc_id, d.rank AS dense_rank, d.score AS dense_score, s.rank AS sparse_rank, s.score AS sparse_score FROM d FULL JOIN s USING (qid, doc_id)")
def pool_provenance(spark, sf_dir):
    s, d = two(spark, sf_dir)
    out = rounded(fuse.pool(d, s))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("dense_rank", "sparse_rank")})


@query(f"WITH {BASE}, r AS ({top(okapi(), 50)}) {top('SELECT qid, r.doc_id, r.score * CASE WHEN toxic = 1 THEN 1.3 ELSE 1.0 END * CASE WHEN lang = $$en$$ THEN 1.1 ELSE 1.0 END AS score FROM r JOIN documents USING (doc_id) LEFT JOIN labels l ON l.doc_id = r.doc_id WHERE coalesce(quality, 1) = 1', 10)}")
def boost_filter_rerank(spark, sf_dir):
    b = Base(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    facts = b.docs.select("doc_id", "lang").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 0, "Repealed").alias("status"), (F.col("toxic") == 1).alias("term"), (F.col("lang") == "en").alias("jurisdiction"))
    run = b.bm25(50).withColumn("score", F.round("score", 6))
    return shown(retrieve.top_k(fuse.boost(run, facts, weights={"term": 1.3, "jurisdiction": 1.1}), 10))


CUTS = ", ".join(f"({k})" for k in metrics.CUTS)
SCORES = f"""WITH {BASE}, run AS ({top(okapi(), 100)}), ql AS ({QRELS}), ks AS (SELECT * FROM (VALUES {CUTS}) v(k)),
id AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS pos, count(*) OVER (PARTITION BY qid) AS r FROM ql),
hit AS (SELECT run.qid, rank, grade, row_number() OVER (PARTITION BY run.qid ORDER BY rank) AS nth FROM run JOIN ql USING (qid, doc_id)),
want AS (SELECT qid, k, any_value(r) AS r, sum(CASE WHEN pos <= k THEN grade / log2(pos + 1) END) AS ideal FROM id, ks GROUP BY ALL),
fnd AS (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY grade DESC, rank) AS best FROM hit, ks WHERE rank <= k),
got AS (SELECT qid, k, count(*) AS n, min(rank) AS first, sum(nth / rank) AS precs, sum(grade / log2(rank + 1)) AS dcg, sum(grade / log2(best + 1)) AS best_dcg FROM fnd GROUP BY ALL),
sc AS (SELECT qid, k, coalesce(n / k, 0) AS precision, coalesce(n / r, 0) AS recall, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, coalesce(1 / first, 0) AS rr,
  coalesce(precs / least(r, k), 0) AS ap, coalesce(dcg / ideal, 0) AS ndcg, coalesce(dcg / best_dcg, 0) AS ndcg_retrieved FROM want LEFT JOIN got USING (qid, k))"""
MEANS = ", ".join(f"avg({m}) AS {m}" for m in ("precision", "recall", "hit", "rr", "ap", "ndcg", "ndcg_retrieved"))
ROUND = "* REPLACE ({})"


def rounds(*names: str) -> str:
    return "* REPLACE (" + ", ".join(f"round({n}, 6) AS {n}" for n in names) + ")"


ALL = ("precision", "recall", "hit", "rr", "ap", "ndcg", "ndcg_retrieved")


def scores(spark, sf_dir) -> DataFrame:
    b = Base(spark, sf_dir)
    return metrics.per_query(b.bm25(100), b.qrels())


@query(f"{SCORES} SELECT {rounds(*ALL)} FROM sc")
def per_query_metrics(spark, sf_dir):
    return rounded(scores(spark, sf_dir))


@query(f"{SCORES}, m AS (SELECT k, count(*) AS n_queries, {MEANS} FROM sc GROUP BY k) SELECT {rounds(*ALL)}, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m")
def t1_suite(spark, sf_dir):
    return rounded(metrics.suite(scores(spark, sf_dir)))


@query(f"WITH {BASE}, run AS ({top(okapi(), 100)}), ql AS ({QRELS}) SELECT qid, min(rank) AS first_rank, CASE WHEN count(rank) = count(*) THEN max(rank) END AS last_rank, round(quantile_cont(rank, 0.5), 6) AS median_rank, round(count(rank) / count(*), 6) AS found FROM ql LEFT JOIN run USING (qid, doc_id) GROUP BY qid")
def rank_of_gold(spark, sf_dir):
    b = Base(spark, sf_dir)
    out = rounded(metrics.rank_of_gold(b.bm25(100), b.qrels()))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("first_rank", "last_rank")})


@query(f"""WITH b AS (SELECT item_id AS qid, list_distinct({TOK.format("text")}) AS q FROM benchmark), d AS (SELECT doc_id, list_distinct({TOK.format("text")}) AS t FROM documents)
SELECT qid, doc_id, round(len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))), 6) AS jaccard FROM b, d WHERE len(q) > 0 AND len(t) > 0 AND len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) >= 0.2""")
def jaccard_overlap(spark, sf_dir):
    """Items against documents at 0.2 or more, from shared tokens; only pairs that share one are made."""
    b = Base(spark, sf_dir)
    d = b.posts.groupBy("doc_id").agg(F.count("*").alias("nd"))
    q = b.terms.groupBy("qid").agg(F.count("*").alias("nq"))
    both = b.posts.join(b.terms, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("c"))
    out = both.join(d, "doc_id").join(q, "qid").select("qid", "doc_id", (F.col("c") / (F.col("nd") + F.col("nq") - F.col("c"))).alias("jaccard"))
    return rounded(out.where("jaccard >= 0.2"))


@query(f"WITH n AS (SELECT len({TOK.format('text')}) AS n FROM documents) SELECT count(*) AS n_docs, round(avg(n), 6) AS mean_tokens, round(median(n), 6) AS median_tokens, round(quantile_cont(n, 0.9), 6) AS p90_tokens, max(n)::BIGINT AS max_tokens, round(avg((n > 512)::INT), 6) AS over_512 FROM n")
def token_audit(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.size(tx.tokens(F.col("text"))).alias("n"))
    lengths = n.groupBy("n").agg(F.count("*").alias("docs"))  # a row for each length
    whole = lengths.agg(F.sum("docs").alias("n_docs"), (F.sum(F.col("n") * F.col("docs")) / F.sum("docs")).alias("mean_tokens"), F.max("n").cast("bigint").alias("max_tokens"), (F.sum(F.when(F.col("n") > 512, F.col("docs")).otherwise(0)) / F.sum("docs")).alias("over_512"))
    return rounded(whole.crossJoin(stats.quantiles(n, "n", {"median_tokens": 0.5, "p90_tokens": 0.9}).drop("n")))


LAT = "SELECT event_type, count(value) AS n, avg(value) AS mean_ms, stddev_pop(value) AS std_ms, min(value) AS min_ms, max(value) AS max_ms, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, count(value) / (sum(value) / 1000) AS qps FROM events GROUP BY event_type"


@query(f"SELECT {rounds('mean_ms', 'std_ms', 'min_ms', 'max_ms', 'p50', 'p90', 'p95', 'p99', 'qps')} FROM ({LAT})")
def latency_distribution(spark, sf_dir):
    return rounded(metrics.latency(table(spark, sf_dir, "events"), "event_type", "value"))


UNIT = "u AS (SELECT event_type, user_id, round(avg(value), 9) AS v FROM events GROUP BY ALL)"


def units(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 9).alias("v"))


@query(f"WITH {UNIT}, m AS (SELECT u.event_type, u.v - a.v AS d FROM u JOIN u a USING (user_id) WHERE u.event_type <> 'click' AND a.event_type = 'click') SELECT event_type, count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_pop(d), 6) AS cohens_d, count_if(d > 0)::BIGINT AS wins, count_if(d = 0)::BIGINT AS ties, count_if(d < 0)::BIGINT AS losses FROM m GROUP BY event_type")
def paired_ttest_stats(spark, sf_dir):
    return rounded(stats.paired(units(spark, sf_dir), "event_type", "user_id", "v", "click"))


@query(f"""WITH {UNIT}, m AS (SELECT u.event_type, u.v - a.v AS d FROM u JOIN u a USING (user_id) WHERE u.event_type <> 'click' AND a.event_type = 'click' AND u.v <> a.v),
r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY round(abs(d), 9)) + (count(*) OVER (PARTITION BY event_type, round(abs(d), 9)) - 1) / 2 AS r FROM m)
SELECT event_type, count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 6) AS w_plus, round(sum(CASE WHEN d < 0 THEN r ELSE 0 END), 6) AS w_minus FROM r GROUP BY event_type""")
def wilcoxon_w(spark, sf_dir):
    u = units(spark, sf_dir)
    base = u.where("event_type = 'click'").select("user_id", F.col("v").alias("base"))
    return rounded(stats.wilcoxon(u.where("event_type <> 'click'").join(base, "user_id").withColumn("d", F.col("v") - F.col("base")), "event_type", "d"))


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY l_returnflag""")
def spearman(spark, sf_dir):
    return rounded(stats.spearman(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", "l_returnflag"))


@query("""WITH c AS (SELECT count_if(quality = 0 AND toxic = 0)::BIGINT AS n00, count_if(quality = 0 AND toxic = 1)::BIGINT AS n01, count_if(quality = 1 AND toxic = 0)::BIGINT AS n10, count_if(quality = 1 AND toxic = 1)::BIGINT AS n11 FROM labels),
p AS (SELECT *, (n00 + n11) / (n00 + n01 + n10 + n11) AS po, ((n10 + n11) * (n01 + n11) + (n00 + n01) * (n00 + n10)) / ((n00 + n01 + n10 + n11) * (n00 + n01 + n10 + n11)) AS pe FROM c)
SELECT n00, n01, n10, n11, round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa FROM p""")
def kappa_confusion(spark, sf_dir):
    return rounded(stats.agreement(table(spark, sf_dir, "labels"), "quality", "toxic"))


CELL = "c AS (SELECT date_trunc('day', ts)::VARCHAR AS day, event_type, avg(value) AS v FROM events GROUP BY ALL)"


def cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("string").alias("day"), "event_type").agg(F.avg("value").alias("v"))


@query(f"WITH {CELL}, b AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY round(v, 9) DESC) AS p FROM c), w AS (SELECT event_type, 1 / count(*) OVER (PARTITION BY day) AS share FROM b WHERE p = 1) SELECT event_type, round(sum(share), 6) AS wins FROM w GROUP BY ALL")
def wins_matrix(spark, sf_dir):
    return rounded(stats.wins_matrix(cells(spark, sf_dir), ["day"], "event_type", "v"))


@query(f"WITH {CELL}, b AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY round(v, 9) DESC) AS p FROM c) SELECT event_type, round(avg(p), 6) AS mean_rank, count(*) AS n_cells FROM b GROUP BY ALL")
def mean_rank(spark, sf_dir):
    return rounded(stats.mean_rank(cells(spark, sf_dir), ["day"], "event_type", "v"))


@query("WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) SELECT doc_id, CASE WHEN n_chars >= b THEN 'aligned' WHEN n_chars <= a THEN 'divergent' ELSE 'middle' END AS stratum FROM documents, q")
def lex_strata(spark, sf_dir):
    return stats.lexical_strata(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "stratum")


@query("WITH r AS (SELECT doc_id, source, greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.2)) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS pos FROM documents) SELECT doc_id, source FROM r WHERE pos <= n")
def stratified_sample(spark, sf_dir):
    return stats.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.2)


@query("SELECT flag, round(avg(v), 6) AS macro, round(sum(v * n) / sum(n), 6) AS micro FROM (SELECT l_returnflag AS flag, l_suppkey, avg(l_discount) AS v, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def macro_micro(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_suppkey").agg(F.avg("l_discount").alias("v"), F.count("*").alias("n"))
    return rounded(g.groupBy("flag").agg(F.avg("v").alias("macro"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("micro")))
