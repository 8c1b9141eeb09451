"""Relational shapes, diagnostics, aggregate statistics and derived metrics."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlowe.operators import metrics, stats
from marlowe.operators.inference import POISSON
from marlowe.plans.ranking import SCORES, Base, cells, rounded, scores, units
from marlowe.plans.registry import query, table


@query("SELECT c.source, (SELECT count(DISTINCT lang) FROM documents d WHERE d.source = c.source) AS n_langs, count(*) AS n FROM documents c GROUP BY c.source")
def sql_correlated_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.countDistinct("lang").alias("n_langs"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey IS NOT NULL)")
def sql_not_in(spark, sf_dir):
    """NOT IN over non-null keys, as the anti join that it then is."""
    gone = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(gone, "p_partkey", "left_anti")


@query("SELECT event_id, key, (props ->> key)::BIGINT AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE (props ->> key)::BIGINT >= 50")
def sql_json_each(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return e.select("event_id", "key", F.col("v").cast("bigint").alias("value")).where("value >= 50")


@query("""SELECT sr.r_name AS seller, count(*) FILTER (cr.r_name = 'AFRICA') AS africa, count(*) FILTER (cr.r_name = 'AMERICA') AS america, count(*) FILTER (cr.r_name = 'ASIA') AS asia, count(*) FILTER (cr.r_name = 'EUROPE') AS europe, count(*) FILTER (cr.r_name = 'MIDDLE EAST') AS middle_east
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region cr ON cr.r_regionkey = cn.n_regionkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN region sr ON sr.r_regionkey = sn.n_regionkey GROUP BY sr.r_name""")
def sql_flow_pivot(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier", "nation", "region")}
    place = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = t["customer"].join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("buyer"))
    sellers = t["supplier"].join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("seller"))
    lines = t["lineitem"].select("l_orderkey", "l_suppkey").join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    flow = lines.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return flow.groupBy("seller").agg(*[F.count_if(F.col("buyer") == r).alias(r.lower().replace(" ", "_")) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])


@query("SELECT source, count(*) AS n, count_if(lang = 'fr')::BIGINT AS n_fr, count_if(n_chars > 2000)::BIGINT AS n_long, min(n_chars) AS shortest, round(count_if(lang = 'fr') / count(*), 6) AS fr_share FROM documents GROUP BY source")
def sql_conditional_counts(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "fr").alias("n_fr"), F.count_if(F.col("n_chars") > 2000).alias("n_long"), F.min("n_chars").alias("shortest"), (F.count_if(F.col("lang") == "fr") / F.count("*")).alias("fr_share")))


@query("SELECT coalesce(lang, '(none)') AS lang, round(avg((source IS NOT NULL)::INT), 6) AS with_source, round(avg((l.doc_id IS NOT NULL)::INT), 6) AS with_label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def sql_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("(none)")).alias("lang"), "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return rounded(d.groupBy("lang").agg(F.avg(F.col("source").isNotNull().cast("int")).alias("with_source"), F.avg(F.col("hit").isNotNull().cast("int")).alias("with_label")))


@query("SELECT CASE WHEN grouping(nullif(l_returnflag, 'A')) = 1 THEN '*' ELSE coalesce(nullif(l_returnflag, 'A'), '(none)') END AS flag, CASE WHEN grouping(l_linestatus) = 1 THEN '*' ELSE coalesce(l_linestatus, '(none)') END AS status, count(*) AS n FROM lineitem GROUP BY CUBE (nullif(l_returnflag, 'A'), l_linestatus)")
def sql_crosstab_cube(spark, sf_dir):
    """Totals are known by their grouping, so that a null key is a group of its own."""
    c = table(spark, sf_dir, "lineitem").select(F.nullif("l_returnflag", F.lit("A")).alias("f"), F.col("l_linestatus").alias("s")).cube("f", "s").agg(F.count("*").alias("n"), F.grouping("f").alias("gf"), F.grouping("s").alias("gs"))
    return c.select(F.when(F.col("gf") == 1, "*").otherwise(F.coalesce("f", F.lit("(none)"))).alias("flag"), F.when(F.col("gs") == 1, "*").otherwise(F.coalesce("s", F.lit("(none)"))).alias("status"), "n")


@query("SELECT p_partkey, p_partkey NOT IN (SELECT CASE WHEN l_linenumber = 1 THEN l_partkey END FROM lineitem WHERE l_quantity > 45) AS absent FROM part")
def sql_not_in_nulls(spark, sf_dir):
    """NOT IN a list with nulls: false for what the list has, null for all else."""
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).alias("p_partkey"))
    nulls = listed.agg((F.count_if(F.col("p_partkey").isNull()) > 0).alias("has_null"))
    met = table(spark, sf_dir, "part").select("p_partkey").join(listed.where("p_partkey IS NOT NULL").distinct().withColumn("hit", F.lit(1)), "p_partkey", "left").crossJoin(F.broadcast(nulls))
    return met.select("p_partkey", F.when(F.col("hit") == 1, F.lit(False)).when(~F.col("has_null"), F.lit(True)).alias("absent"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, arg_max(c_name, (c_acctbal, c_custkey)) AS richest, round(quantile_cont(c_acctbal, 0.9), 6) AS p90 FROM customer GROUP BY c_mktsegment")
def sql_argmax(spark, sf_dir):
    return rounded(table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("richest"), F.percentile("c_acctbal", F.lit(0.9)).alias("p90")))


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY round(avg(l_quantity), 6) DESC, l_suppkey LIMIT 10")
def sql_group_top10(spark, sf_dir):
    """A top-10 report: the limit is the feature."""
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.count("*").alias("n"))).orderBy(F.col("mean").desc(), "l_suppkey").limit(10)


@query("WITH a AS (SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, max(doc_id) AS last_id, count(DISTINCT lang) AS langs FROM documents) SELECT *, substr(sha256(n || '|' || chars || '|' || last_id || '|' || langs), 1, 12) AS fingerprint FROM a")
def config_fingerprint(spark, sf_dir):
    a = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("last_id"), F.countDistinct("lang").alias("langs"))
    return a.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", "n", "chars", "last_id", "langs").cast("binary"), 256), 1, 12))


PROFILED = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique, min({c})::VARCHAR AS least FROM {t}" for t, cs in PROFILED.items() for c in cs))
def column_profile(spark, sf_dir):
    """Each column's values are hashed and unpivoted; distinct values are counted by one shuffle for a table."""
    parts = []
    for t, cs in PROFILED.items():
        d = table(spark, sf_dir, t)
        long = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.sha2(F.col(c).cast("string").cast("binary"), 256).alias("v")) for c in cs])).alias("x")).select("x.*")
        n = long.groupBy("col", "v").count().groupBy("col").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("count")).otherwise(0)).alias("non_null"), F.sum(F.when(F.col("v").isNull(), F.col("count")).otherwise(0)).alias("nulls"), F.count("v").alias("n_unique"))
        least = d.agg(*[F.min(c).cast("string").alias(c) for c in cs]).unpivot([], cs, "col", "least")
        parts.append(n.join(least, "col").select(F.lit(t).alias("tbl"), "col", "non_null", "nulls", "n_unique", "least"))
    return reduce(DataFrame.unionByName, parts)


NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"WITH e AS (SELECT *, {NORM} AS norm, embedding[1:32] AS head FROM embeddings) SELECT label::BIGINT AS label, count(*) AS n, min(len(embedding))::BIGINT AS least_dim, max(len(embedding))::BIGINT AS most_dim, round(min(norm), 5) AS least_norm, round(avg(norm), 5) AS mean_norm, round(max(norm), 5) AS most_norm, count(*) - count(DISTINCT head) AS n_repeats FROM e GROUP BY label")
def embedding_profile(spark, sf_dir):
    dot = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("label", F.size("embedding").alias("dim"), F.sqrt(dot).alias("norm"), F.slice("embedding", 1, 32).alias("head"))
    g = e.groupBy("label", "head").agg(F.count("*").alias("c"), F.min("dim").alias("a"), F.max("dim").alias("b"), F.min("norm").alias("x"), F.sum("norm").alias("s"), F.max("norm").alias("y"))
    out = g.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.sum("c").alias("n"), F.min("a").cast("bigint").alias("least_dim"), F.max("b").cast("bigint").alias("most_dim"), F.min("x").alias("least_norm"), (F.sum("s") / F.sum("c")).alias("mean_norm"), F.max("y").alias("most_norm"), (F.sum("c") - F.count("*")).alias("n_repeats"))
    return rounded(out, 5)


@query("SELECT count_if(a AND b)::BIGINT AS both_sides, count_if(a AND NOT b)::BIGINT AS only_documents, count_if(b AND NOT a)::BIGINT AS only_labels, count(*) AS either FROM (SELECT id, max(s) = 1 AS b, min(s) = 0 AS a FROM (SELECT DISTINCT doc_id AS id, 0 AS s FROM documents UNION SELECT DISTINCT doc_id, 1 FROM labels) GROUP BY id)")
def split_overlap(spark, sf_dir):
    sides = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("s")).unionByName(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("s")))
    g = sides.groupBy("doc_id").agg((F.min("s") == 0).alias("a"), (F.max("s") == 1).alias("b"))
    return g.agg(F.count_if(F.expr("a AND b")).alias("both_sides"), F.count_if(F.expr("a AND NOT b")).alias("only_documents"), F.count_if(F.expr("b AND NOT a")).alias("only_labels"), F.count("*").alias("either"))


@query("SELECT source, sum(length(text) - length(replace(text, chr(65533), '')))::BIGINT AS n_bad, count_if(contains(text, chr(65533)))::BIGINT AS n_docs, round(sum(length(text) - length(replace(text, chr(65533), ''))) / sum(length(text)), 6) AS share FROM documents GROUP BY source")
def artefact_scan(spark, sf_dir):
    bad = F.char_length("text") - F.char_length(F.replace("text", F.lit("�"), F.lit("")))
    d = table(spark, sf_dir, "documents").select("source", bad.alias("bad"), F.char_length("text").alias("n"))
    return rounded(d.groupBy("source").agg(F.sum("bad").alias("n_bad"), F.count_if(F.col("bad") > 0).alias("n_docs"), (F.sum("bad") / F.sum("n")).alias("share")))


@query("SELECT source, CASE WHEN count(l.doc_id) = count(*) THEN 'complete' WHEN count(l.doc_id) > 0 THEN 'partial' ELSE 'missing' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def readiness_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return d.groupBy("source").agg(F.when(F.count("hit") == F.count("*"), "complete").when(F.count("hit") > 0, "partial").otherwise("missing").alias("status"))


@query("WITH s AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL), t AS (SELECT user_id, sum(v) AS total FROM s GROUP BY ALL) SELECT user_id, event_type, round(v, 6) AS v, round(v / nullif(total, 0), 4) AS fraction FROM s JOIN t USING (user_id)")
def stage_fractions(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    total = F.sum("v").over(Window.partitionBy("user_id"))
    return s.select("user_id", "event_type", F.round("v", 6).alias("v"), F.round(F.col("v") / F.nullif(total, F.lit(0.0)), 4).alias("fraction"))


@query("SELECT d.doc_id, round((coalesce(0.6 * l.quality, 0) + coalesce(0.3 * (1 - l.toxic), 0) + 0.1 * least(n_chars / 1000, 1)) / (CASE WHEN l.quality IS NULL THEN 0 ELSE 0.6 END + CASE WHEN l.toxic IS NULL THEN 0 ELSE 0.3 END + 0.1), 6)::DOUBLE AS aqs FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars IS NOT NULL")
def aqs_weighted(spark, sf_dir):
    """Weighted mean of the parts that are present, weights renormalised over them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").where("n_chars IS NOT NULL").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    parts = [(0.6, F.col("quality")), (0.3, 1 - F.col("toxic")), (0.1, F.least(F.col("n_chars") / 1000, F.lit(1.0)))]
    top = reduce(lambda a, b: a + b, [F.coalesce(w * x, F.lit(0.0)) for w, x in parts])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNull(), 0.0).otherwise(w) for w, x in parts])
    return d.select("doc_id", F.round(top / weight, 6).alias("aqs"))


@query("WITH c AS (SELECT date_trunc('day', ts)::VARCHAR AS day, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT day, event_type, round((v - avg(v) OVER (PARTITION BY event_type)) / nullif(stddev_samp(v) OVER (PARTITION BY event_type), 0), 6) AS z FROM c")
def zscore_gap(spark, sf_dir):
    w = Window.partitionBy("event_type")
    return rounded(cells(spark, sf_dir).select("day", "event_type", ((F.col("v") - F.avg("v").over(w)) / F.nullif(F.stddev_samp("v").over(w), F.lit(0.0))).alias("z")))


@query("SELECT l_returnflag, l_suppkey, round(avg(l_discount) FILTER (l_linestatus = 'O') - avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS delta FROM lineitem GROUP BY ALL")
def ablation_delta(spark, sf_dir):
    on, off = (F.avg(F.when(F.col("l_linestatus") == s, F.col("l_discount"))) for s in "OF")
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg((on - off).alias("delta")))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def cost_summary(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), "o_totalprice"
    out = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.percentile(p, F.lit(0.95)).alias("p95"), F.sum(p).alias("total"))
    return out.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p95")], F.round("total", 2).alias("total"))


@query("WITH g AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS m, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL) SELECT event_type, round(sum(nullif(m, 0) * n) / sum(CASE WHEN m <> 0 THEN n END), 6) AS mean, round(sum(nullif(p95, 0) * n) / sum(CASE WHEN p95 <> 0 THEN n END), 6) AS p95 FROM g GROUP BY event_type")
def pooled_cost(spark, sf_dir):
    """Means weighted by counts, 0 meaning not recorded; the pooled p95 is the weighted mean of the groups' p95."""
    g = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"))
    return rounded(g.groupBy("event_type").agg(*[(F.sum(F.when(F.col(c) != 0, F.col(c) * F.col("n"))) / F.sum(F.when(F.col(c) != 0, F.col("n")))).alias(c) for c in ("mean", "p95")]))


@query("SELECT item_id, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT item_id, ('0x' || substr(md5('42:' || item_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS h FROM benchmark)")
def hash_split(spark, sf_dir):
    """Train, val and test by a seeded hash of the id: no shuffle, and a row's part doesn't depend on other rows."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("item_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return table(spark, sf_dir, "benchmark").select("item_id", F.when(h < 0.8, "train").when(h < 0.9, "val").otherwise("test").alias("split"))


@query("SELECT user_id, round(max(v) FILTER (event_type = 'click'), 6) AS click, round(max(v) FILTER (event_type = 'error'), 6) AS error FROM (SELECT event_type, user_id, round(avg(value), 9) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def pivot_long_wide(spark, sf_dir):
    return rounded(units(spark, sf_dir).groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.max("v")))


BIN = "CASE WHEN r = 1 THEN '1' WHEN r <= 4 THEN '2-4' WHEN r <= 7 THEN '5-7' ELSE '8+' END"


@query(f"{SCORES} SELECT k, {BIN} AS bin, count(*) AS n, round(avg(recall), 6) AS recall FROM sc JOIN (SELECT qid, count(*) AS r FROM ql GROUP BY qid) c USING (qid) GROUP BY ALL")
def recall_by_gold_bins(spark, sf_dir):
    b = Base(spark, sf_dir)
    qrels = b.qrels()
    gold = qrels.groupBy("qid").agg(F.count("*").alias("r"))
    return rounded(metrics.per_query(b.bm25(100), qrels).join(gold, "qid").groupBy("k", F.expr(BIN).alias("bin")).agg(F.count("*").alias("n"), F.avg("recall").alias("recall")))


@query(f"""{SCORES}, g AS (SELECT qid, CASE WHEN length(text) >= (SELECT quantile_cont(length(text), 0.75) FROM benchmark) THEN 'aligned' WHEN length(text) <= (SELECT quantile_cont(length(text), 0.25) FROM benchmark) THEN 'divergent' ELSE 'middle' END AS stratum FROM (SELECT item_id AS qid, text FROM benchmark))
SELECT stratum, k, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM sc JOIN g USING (qid) GROUP BY ALL""")
def stratified_metrics(spark, sf_dir):
    strata = stats.lexical_strata(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.char_length("text").alias("n")), "n")
    return rounded(scores(spark, sf_dir).join(strata.select("qid", "stratum"), "qid").groupBy("stratum", "k").agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg")))


DRAW = "('0x' || substr(md5(b::VARCHAR || ':' || user_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0"


def copies(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {p} THEN {i}" for i, p in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"


def replicate_means(units: DataFrame, by: str, unit: str, value: str, replicates: int) -> DataFrame:
    """(by, b, mean): Poisson bootstrap means, drawn from a hash of replicate and unit.

    Each task sums its rows' draws into an array with a place for each replicate, so that an array a task and group is
    shuffled and never a row for each replicate.
    """
    schema = f"{by} {units.schema[by].dataType.simpleString()}, b BIGINT, vw DOUBLE, w BIGINT"
    ends = np.array(POISSON)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for group, key, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                u = np.array([int(hashlib.md5(f"{b}:{key}".encode()).hexdigest()[:8], 16) for b in range(replicates)]) / 4294967296.0
                w = np.searchsorted(ends, u, side="right")
                vw, total = sums.setdefault(group, (np.zeros(replicates), np.zeros(replicates, np.int64)))
                vw += v * w
                total += w
        for group, (vw, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([group] * replicates), pa.array(np.arange(replicates)), pa.array(vw), pa.array(total)], names=[by, "b", "vw", "w"])

    parts = units.select(by, unit, value).mapInArrow(run, schema)
    return parts.groupBy(by, "b").agg((F.sum("vw") / F.sum("w")).alias("mean"))


@query(f"""WITH u AS (SELECT event_type, user_id, round(avg(value), 9) AS v FROM events GROUP BY ALL), r AS (SELECT event_type, b, v, {DRAW} AS h FROM (SELECT u.*, b FROM u, range(2000) t(b))),
m AS (SELECT event_type, b, sum(v * w) / sum(w) AS mean FROM (SELECT event_type, b, v, {copies('h')} AS w FROM r) GROUP BY ALL)
SELECT event_type, round(quantile_cont(mean, 0.025), 5) AS low, round(quantile_cont(mean, 0.975), 5) AS high FROM m GROUP BY event_type""")
def bootstrap_ci(spark, sf_dir):
    """95 % percentile interval of the mean over users from 2,000 Poisson bootstrap replicates.

    Each row draws its own number of copies for each replicate from a hash, so replicates are partial sums and no
    resample is ever shuffled; the draws are not those of a generator seeded on one machine.
    """
    means = replicate_means(units(spark, sf_dir), "event_type", "user_id", "v", 2000)
    return rounded(stats.quantiles(means, "mean", {"low": 0.025, "high": 0.975}, "event_type").drop("n"), 5)
