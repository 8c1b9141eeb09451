"""Round trips through the readers and writers: what comes back is what the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlowe.plans.registry import query, table
from marlowe.sources import readers, writers


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL")
def parquet_scan(spark, sf_dir):
    """SRC-02: pruned columns and the null test reach the scan."""
    return readers.parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "text"], not_null="text").select("doc_id", "lang")


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    """SNK-02 and SRC-03: Parquet and JSON lines of the same rows, counted against each other, and the latter reread."""
    folder = writers.scratch(spark, "export")
    rows = table(spark, sf_dir, "conversations")
    writers.export(rows, folder)
    return readers.jsonl(spark, f"{folder}/jsonl", rows.schema)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def csv_round_trip(spark, sf_dir):
    """SRC-04: a header, and columns renamed."""
    folder = writers.scratch(spark, "csv")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows.write.csv(folder, header=True, escape='"')
    return readers.csv(spark, folder, rows.schema, {"n_nationkey": "id", "n_name": "name"})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def resumed_work(spark, sf_dir):
    """SNK-04 and 05: what an appending run has done is not done again."""
    folder = writers.scratch(spark, "done")
    work = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for part in (0, 1):
        writers.append(work.where(F.col("c_custkey") % 4 == 2 * part).select("c_custkey"), folder)
    return writers.pending(work, readers.jsonl(spark, folder, "c_custkey BIGINT"), ["c_custkey"])


@query("SELECT s_suppkey, s_acctbal * 2 AS score FROM supplier")
def cached_scores(spark, sf_dir):
    """SNK-06: the second call scores only what the first has not."""
    folder = writers.scratch(spark, "cache")
    work = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    score = lambda df: df.withColumn("score", F.col("s_acctbal") * 2)
    writers.cached(work.where("s_suppkey % 3 = 0"), folder, ["s_suppkey"], score).count()
    return writers.cached(work, folder, ["s_suppkey"], score)


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size / 50 ELSE 0.0 END AS weight FROM part")
def weight_lookup(spark, sf_dir):
    """SNK-07: a weight table written, reread and looked up; what it lacks weighs nothing."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    held = writers.build_table(part.where("p_size > 25").select("p_partkey", (F.col("p_size") / 50).alias("weight")), writers.scratch(spark, "weights"), ["p_partkey"])
    return writers.weights(held, part.select("p_partkey"), ["p_partkey"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def table_build(spark, sf_dir):
    """SNK-01: a table in ranges of its key."""
    return writers.build_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), writers.scratch(spark, "orders"), ["o_custkey"])


@query("SELECT 'run' AS name, substr(sha256('{\"k\":[5,10],\"tier\":1}'), 1, 12) AS config, count(*) AS n_rows FROM benchmark")
def evaluation_stamp(spark, sf_dir):
    """SNK-11."""
    return writers.stamp(table(spark, sf_dir, "benchmark"), {"tier": 1, "k": [5, 10]}, "run")


@query("SELECT r_regionkey, '{\"r_name\":\"' || r_name || '\",\"_trec_id\":' || r_regionkey || '}' AS value FROM region")
def result_records(spark, sf_dir):
    """SNK-03: private columns stay out, but for one prefix."""
    rows = table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("_private"), F.col("r_regionkey").alias("_trec_id"))
    return writers.result_json(rows).select(F.get_json_object("value", "$._trec_id").cast("bigint").alias("r_regionkey"), "value")


@query("SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 END AS level FROM events")
def concatenated_json_scan(spark, sf_dir):
    """SRC-05: objects one after the other, numbers in typed wrappers, NaN as null."""
    folder = writers.scratch(spark, "objects")
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_id") % 5 == 0, F.lit("NaN")).otherwise((F.col("event_id") % 5).cast("string"))
    e.select(F.concat(F.lit('{"event_id": {"$numberLong": "'), "event_id", F.lit('"}, "user_id": '), "user_id", F.lit(', "level": '), level, F.lit("}"))).write.text(folder)
    return readers.concatenated_json(spark, folder, "event_id BIGINT, user_id BIGINT, level BIGINT")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN event_id WHEN 2 THEN event_id END AS number, CASE WHEN event_id % 5 = 3 THEN 'nam' END AS word, CASE WHEN event_id % 5 = 4 THEN '1,' || event_id END AS ids FROM events")
def dirty_scalars(spark, sf_dir):
    """SRC-06 and 15: booleans, decimals, blanks, junk and lists of ids as text."""
    m, i = F.col("event_id") % 5, F.col("event_id").cast("string")
    raw = F.when(m == 0, " True ").when(m == 1, F.concat(F.lit(" "), i)).when(m == 2, F.concat(i, F.lit(".75"))).when(m == 3, " NaN ")
    ids = F.when(m == 4, F.concat(F.lit("1, x,"), i))
    word = F.when(m == 3, F.lit(" nam ")).when(m == 2, "  nan")
    return table(spark, sf_dir, "events").select("event_id", readers.to_int(raw).alias("number"), readers.to_text(word).alias("word"), F.array_join(readers.int_list(ids), ",").alias("ids"))


@query("SELECT event_type AS qid, array_to_string(list_sort(list(DISTINCT user_id % 20)), ',') AS ids FROM events GROUP BY 1")
def judgement_files(spark, sf_dir):
    """SRC-11: JSON objects from query to ids, in several files that share queries."""
    folder = writers.scratch(spark, "judgements")
    for part in (0, 1):
        rows = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == part).groupBy("event_type").agg(F.collect_set(F.col("user_id") % 20).alias("ids"))
        rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "ids"))))).coalesce(1).write.mode("append").text(folder)
    return readers.judgements(spark, folder).select("qid", F.array_join("ids", ",").alias("ids"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS arm FROM customer")
def latest_records(spark, sf_dir):
    """SRC-12 and 17: of records with one key the last file's stays."""
    folder = writers.scratch(spark, "records")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    c.withColumn("arm", F.lit("first")).write.json(f"{folder}/run-1")
    c.where("id % 3 = 0").withColumn("arm", F.lit("second")).write.json(f"{folder}/run-2")
    rows = spark.read.schema("id BIGINT, arm STRING").json(f"{folder}/*").withColumn("_run", F.regexp_extract(F.input_file_name(), r"/run-(\d+)/", 1).cast("int"))
    return rows.groupBy("id").agg(F.max_by("arm", "_run").alias("arm"))


@query("""WITH m AS (SELECT p_partkey % 30 AS doc, min(p_name) AS title FROM part WHERE p_partkey % 30 <> 7 GROUP BY 1), t AS (SELECT user_id % 30 AS doc, event_id % 40 AS node, list_sort(list(DISTINCT event_type)) AS terms FROM events GROUP BY ALL)
SELECT l_suppkey % 30 AS doc, l_partkey % 40 AS node, any_value(title) AS title, coalesce(array_to_string(any_value(terms), ','), '') AS terms, count(*) AS n FROM lineitem JOIN m ON m.doc = l_suppkey % 30 LEFT JOIN t ON t.doc = l_suppkey % 30 AND t.node = l_partkey % 40 WHERE l_suppkey % 30 <> 1 GROUP BY ALL""")
def node_loader(spark, sf_dir):
    """SRC-07: nodes of declared documents but the first, with the documents' titles and the nodes' terms."""
    nodes = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("doc"), (F.col("l_partkey") % 40).alias("node")).where("doc <> 1").groupBy("doc", "node").agg(F.count("*").alias("n"))
    meta = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).alias("doc"), "p_name").where("doc <> 7").groupBy("doc").agg(F.min("p_name").alias("title"))
    terms = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 30).alias("doc"), (F.col("event_id") % 40).alias("node")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("terms"))
    return nodes.join(meta, "doc").join(terms, ["doc", "node"], "left").select("doc", "node", "title", F.coalesce("terms", F.lit("")).alias("terms"), "n")


@query("SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def embedding_load(spark, sf_dir):
    """SRC-13: vectors from a cache where it has them, else from the table, which then fills it."""
    folder = writers.scratch(spark, "vectors")
    work = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    held = writers.cached(work, folder, ["vec_id"], lambda df: df.withColumn("score", F.col("embedding")))
    return held.select("vec_id", F.size("score").cast("bigint").alias("size"), F.round(F.aggregate("score", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("SELECT p.page_id, p.url, d.source IS NOT NULL AS has_extraction, l.n AS n_definitions FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 3 LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = p.page_id * 3")
def document_discovery(spark, sf_dir):
    """SRC-09: what is there, joined to what is known about it; nothing is lost for want of either."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "source")
    n = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("n_definitions"))
    p = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 3).alias("k"))
    return p.join(d, "k", "left").join(n, "k", "left").select("page_id", "url", F.col("source").isNotNull().alias("has_extraction"), "n_definitions")
