"""Queries over answers of models, texts for retrieval, and loops. Texts made from columns stand in for answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators import agents, fuse, packing, reports, retrieve
from marlowe.operators.retrieve import dot, unit
from marlowe.plans.ranking import BASE, TOK, TWO, Base, okapi, rounded, shown, top, two
from marlowe.plans.registry import query, table
from marlowe.plans.reports import JUDGED, RUNS, gold_of, run_of

FORMS = ["Action: search[{}]", "Action : lookup[{}]", 'action: search("{}")', "Action: search « {} »", "Action: lookup {}\nfin", "Je ne peux pas", "Pensée {}", "Action: finish[done]", "Action : lookup[abc{}]"]


def answers(spark, sf_dir) -> DataFrame:
    text = F.lit(None).cast("string")
    for k, form in enumerate(FORMS):
        head, _, tail = form.partition("{}")
        made = F.concat(F.lit(head), F.col("event_id").cast("string"), F.lit(tail)) if "{}" in form else F.lit(form)
        text = F.when(F.col("event_id") % len(FORMS) == k, made).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", text.alias("answer"))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'search' WHEN 3 THEN 'search' WHEN 4 THEN 'lookup' WHEN 7 THEN 'finish' WHEN 8 THEN 'lookup' END AS verb,
CASE WHEN event_id % 9 IN (0, 1, 2, 3, 4) THEN event_id::VARCHAR END AS argument FROM events""")
def agent_actions(spark, sf_dir):
    """FUS-17: the strict form, then the four permissive ones."""
    return answers(spark, sf_dir).select("event_id", agents.action(F.col("answer")).alias("x")).select("event_id", "x.verb", "x.argument")


@query("""SELECT event_id, CASE event_id % 9 WHEN 5 THEN 'refusal_or_empty' WHEN 6 THEN 'prose_only' WHEN 3 THEN CASE WHEN event_id % 70 >= 60 THEN 'max_tokens_truncation' ELSE 'french_quotes' END
WHEN 2 THEN CASE WHEN event_id % 70 >= 60 THEN 'max_tokens_truncation' ELSE 'wrong_bracket_shape' END WHEN 4 THEN CASE WHEN event_id % 70 >= 60 THEN 'max_tokens_truncation' ELSE 'wrong_bracket_shape' END ELSE 'wrong_bracket_shape' END AS bucket FROM events""")
def null_action_buckets(spark, sf_dir):
    """FUS-19."""
    return answers(spark, sf_dir).select("event_id", agents.null_bucket(F.col("answer"), F.col("event_id") % 70).alias("bucket"))


@query("SELECT page_id, 'un ' || page_id || '|deux|trois' AS paraphrases FROM pages")
def paraphrase_lists(spark, sf_dir):
    """FUS-06."""
    answer = F.concat(F.lit("\n1. un "), F.col("page_id"), F.lit("\n\n2) deux\n 3. trois  \n"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(agents.paraphrases(answer), "|").alias("paraphrases"))


@query(f"WITH {JUDGED}, e AS (SELECT system, qid, count(*) AS n, count(*) FILTER (doc % 11 <> 0) AS parsed, avg(score) FILTER (doc % 11 <> 0) AS m, stddev_pop(score) FILTER (doc % 11 <> 0) AS s, count(DISTINCT score) FILTER (doc % 11 <> 0) <= 1 AS same FROM j WHERE system = 'click' AND rank <= 10 GROUP BY ALL) SELECT count(*) AS n_queries, round(1 - sum(parsed) / sum(n), 6) AS parse_failures, round(avg(m), 6) AS mean_score, round(avg(s), 6) AS mean_spread, round(avg(same::INT), 6) AS all_same FROM e")
def judge_diagnostics(spark, sf_dir):
    """FUS-10."""
    j = reports.judged(run_of(spark, sf_dir), gold_of(spark, sf_dir)).where("system = 'click' AND rank <= 10")
    return rounded(agents.judge_diagnostics(j.withColumn("said", F.when(F.col("doc") % 11 != 0, F.col("score"))), "qid", "said"))


@query(f"WITH {JUDGED}, f AS (SELECT qid, hit, arg_min(doc, (rank, doc)) AS doc FROM j WHERE system = 'click' GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY md5('42:' || qid || ':' || doc), qid) AS pos FROM f) SELECT qid, hit, doc FROM d WHERE pos <= 8")
def few_shot_examples(spark, sf_dir):
    """FUS-22."""
    return agents.few_shot(reports.judged(run_of(spark, sf_dir), gold_of(spark, sf_dir)).where("system = 'click'"), 8)


@query(f"""WITH {RUNS}, q AS (SELECT qid, max(rank) FILTER (system = 'click') AS n FROM run GROUP BY qid), t AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN 1 WHEN qid % 3 = 1 THEN 2 ELSE 3 END AS n, qid % 3 < 2 AS ok FROM q WHERE n IS NOT NULL)
SELECT count(*) AS n_queries, round(avg((ok AND n = 1)::INT), 6) AS at_once, round(avg((ok AND n > 1)::INT), 6) AS corrected, round(avg((NOT ok)::INT), 6) AS never, round(avg(n), 6) AS mean_rounds FROM t""")
def corrective_loop(spark, sf_dir):
    """FUS-14 and 15: a corrective loop over all queries at once, with a judge that accepts by query and round."""
    run = run_of(spark, sf_dir).where("system = 'click'").select("qid", F.col("doc").alias("doc_id"), "score", "rank")
    queries = run.select("qid").distinct().withColumn("query", F.lit("0"))

    def judge(found):
        return found.select("qid", "round").distinct().select("qid", F.when((F.col("round") == F.col("qid") % 3) & (F.col("qid") % 3 < 2), 0.9).otherwise(0.1).alias("confidence"))

    _, trace = agents.loop(queries, lambda q, k: run.join(q.select("qid"), "qid", "left_semi").where(F.col("rank") <= k), judge, lambda q: q.withColumn("query", F.concat("query", F.lit("+"))))
    return rounded(agents.loop_stats(trace))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first, len(v) AS size FROM (SELECT vec_id, list_transform(e, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(e, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM (SELECT vec_id, embedding[1:32] AS e FROM embeddings))")
def matryoshka_vectors(spark, sf_dir):
    """RET-08: the first 32 numbers, made unit again."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", unit(F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double"))).alias("v"))
    return rounded(v.select("vec_id", dot(F.col("v"), F.col("v")).alias("norm"), F.col("v")[0].alias("first"), F.size("v").cast("bigint").alias("size")))


@query("SELECT doc_id, md5('passage: ' || coalesce(text, '')) AS passage FROM documents UNION ALL SELECT item_id, md5('query: ' || coalesce(text, '')) FROM benchmark")
def prefixed_texts(spark, sf_dir):
    """RET-09."""
    passages = table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.prefixed(F.col("text"), "passage: ").cast("binary")).alias("passage"))
    return passages.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.md5(tx.prefixed(F.col("text"), "query: ").cast("binary")).alias("passage")))


@query(f"WITH {BASE} SELECT qid, count(*) AS n_terms, count_if(df.term IS NULL)::BIGINT AS n_unknown FROM qt LEFT JOIN df USING (term) GROUP BY qid")
def unknown_terms(spark, sf_dir):
    """TOK-12."""
    b = Base(spark, sf_dir)
    known = b.posts.select("term").distinct().withColumn("known", F.lit(1))
    return b.terms.join(known, "term", "left").groupBy("qid").agg(F.count("*").alias("n_terms"), F.count_if(F.col("known").isNull()).alias("n_unknown"))


STOP = "['" + "', '".join(tx.FUNCTION_WORDS) + "']"


@query(f"""WITH t AS (SELECT item_id, list_filter({TOK.format("text")}, lambda x, i: list_position({TOK.format("text")}, x) = i) AS u FROM benchmark), f AS (SELECT item_id, u, list_filter(u, lambda x: NOT list_contains({STOP}, x)) AS k FROM t)
SELECT item_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE u END, ' OR ') AS fts FROM f""")
def fts_queries(spark, sf_dir):
    """TOK-13."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.fts_query(F.col("text")).alias("fts"))


@query(f"""WITH {BASE}, w AS (SELECT qid, term FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, term) AS r FROM qt) WHERE r = 1), m AS (SELECT w.qid, po.doc_id, tf, instr(lower(text), w.term) AS pos, text FROM w JOIN po USING (term) JOIN documents d ON d.doc_id = po.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tf DESC, doc_id) AS rank FROM m) SELECT qid, doc_id, tf::BIGINT AS tf, substr(text, greatest(pos - 20, 1), 60) AS snippet FROM r WHERE rank <= 5""")
def fts_snippets(spark, sf_dir):
    """SQL-12: documents that match, by rank, with the text around the first match."""
    from pyspark.sql import Window

    b = Base(spark, sf_dir)
    word = b.terms.groupBy("qid").agg(F.min_by("term", F.struct(-F.length("term"), "term")).alias("term"))
    hits = b.posts.join(F.broadcast(word), "term")  # a row for each query of the stated set
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("tf").desc(), "doc_id"))).where("rank <= 5")
    met = hits.join(b.docs.select("doc_id", "text"), "doc_id").withColumn("pos", F.instr(F.lower("text"), F.col("term")))
    return met.select("qid", "doc_id", "tf", F.substring("text", F.greatest(F.col("pos") - 20, F.lit(1)), F.lit(60)).alias("snippet"))


@query(f"""WITH t AS (SELECT doc_id, {TOK.format("text")} AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.t) AS la, len(b.t) AS lb FROM t a JOIN t b ON b.doc_id = a.doc_id + 1),
s AS (SELECT p.a, p.b, sum(least(x.n, y.n)) AS shared FROM p JOIN c x ON x.doc_id = p.a JOIN c y ON y.doc_id = p.b AND y.term = x.term GROUP BY ALL) SELECT p.a, p.b, round(coalesce(shared, 0) / greatest(la, 1), 6) AS w_db, round(coalesce(shared, 0) / greatest(least(la, lb), 1), 6) AS w_share FROM p LEFT JOIN s USING (a, b)""")
def multiset_overlap(spark, sf_dir):
    """STR-09: shared tokens, repeats counted, over the first text's and the shorter one's length."""
    b = Base(spark, sf_dir)
    n = b.docs.where("text IS NOT NULL").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"))
    pairs = n.select(F.col("doc_id").alias("a"), F.col("n").alias("la"), (F.col("doc_id") + 1).alias("b")).join(n.select(F.col("doc_id").alias("b"), F.col("n").alias("lb")), "b")
    x = b.posts.select(F.col("doc_id").alias("a"), "term", F.col("tf").alias("x"))
    y = b.posts.select((F.col("doc_id") - 1).alias("a"), "term", F.col("tf").alias("y"))
    shared = x.join(y, ["a", "term"]).groupBy("a").agg(F.sum(F.least("x", "y")).alias("s"))
    out = pairs.join(shared, "a", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    return rounded(out.select("a", "b", (F.col("s") / F.greatest("la", F.lit(1))).alias("w_db"), (F.col("s") / F.greatest(F.least("la", "lb"), F.lit(1))).alias("w_share")))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(coalesce(text, '')) WHEN 1 THEN md5(concat_ws(chr(10) || chr(10), source, text)) WHEN 2 THEN md5(concat_ws(chr(10) || chr(10), source, lang, text)) ELSE md5(concat_ws(chr(10) || chr(10), lang, source)) END AS enriched FROM documents")
def enrichment_variants(spark, sf_dir):
    """STR-16: raw, with a header, full, and terms alone; missing parts are elided."""
    m = F.col("doc_id") % 4
    gap = "\n\n"
    text = F.when(m == 0, F.coalesce("text", F.lit(""))).when(m == 1, F.concat_ws(gap, "source", "text")).when(m == 2, F.concat_ws(gap, "source", "lang", "text")).otherwise(F.concat_ws(gap, "lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("enriched"))


WORDS_IN = "len(regexp_extract_all({}, '\\S+'))"


@query(f"""WITH p AS (SELECT doc_id, coalesce(source, '') AS a, coalesce(lang, '') AS b, split_part(coalesce(text, ''), '.', 1) AS c, coalesce(text, '') AS d FROM documents), n AS (SELECT doc_id, {", ".join(f"{WORDS_IN.format(x)} AS {x}" for x in "abcd")} FROM p)
SELECT doc_id, CASE WHEN a + b + c + d <= 120 THEN 'whole' WHEN b + c + d <= 120 THEN 'no_path' WHEN c + d <= 120 THEN 'no_terms' WHEN d <= 120 THEN 'no_summary' ELSE 'tail' END AS step FROM n""")
def truncation_cascade(spark, sf_dir):
    """STR-17: what goes first when a text is too long."""
    c = [F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.split("text", "[.]")[0], F.lit("")), F.coalesce("text", F.lit(""))]
    return table(spark, sf_dir, "documents").select("doc_id", packing.truncated(*c, 120).getField("step").alias("step"))


@query("WITH d AS (SELECT c_nationkey AS n, c_mktsegment AS term, arg_max(c_custkey, c_custkey) AS last FROM customer GROUP BY ALL) SELECT n, string_agg(term || ' : ' || last, chr(10) ORDER BY term) AS block FROM d GROUP BY n")
def defined_terms(spark, sf_dir):
    """STR-18: a definition for each term, the last one winning, as a block of lines."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("term")).agg(F.max("c_custkey").alias("last"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("term", "last"))), lambda x: F.concat(x["term"], F.lit(" : "), x["last"].cast("string")))
    return c.groupBy("n").agg(F.array_join(lines, "\n").alias("block"))


@query("SELECT event_type AS split, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def split_scan(spark, sf_dir):
    """SRC-01: rows of some splits, JSON decoded."""
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select("event_type", F.from_json("props", "k BIGINT").alias("x"))
    return e.groupBy(F.col("event_type").alias("split")).agg(F.count("*").alias("n"), F.sum("x.k").alias("total"))


@query("SELECT user_id % 25 AS doc, event_id % 50 AS node, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS terms FROM events GROUP BY ALL")
def definition_inversion(spark, sf_dir):
    """SRC-08: terms with the places that use them, turned to places with their terms."""
    used = table(spark, sf_dir, "events").groupBy("event_type").agg(F.collect_set(F.struct((F.col("user_id") % 25).alias("doc"), (F.col("event_id") % 50).alias("node"))).alias("used_in"))
    return used.select("event_type", F.explode("used_in").alias("x")).groupBy("x.doc", "x.node").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("terms"))


@query("SELECT coalesce(a.lang, b.lang) AS lang, a.n AS n_documents, b.n AS n_pages FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, count(*) AS n FROM pages GROUP BY 1) b ON a.lang = b.lang")
def attached_catalogs(spark, sf_dir):
    """SRC-16: two catalogues in one query."""
    a = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_documents"))
    b = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")).agg(F.count("*").alias("n_pages"))
    return a.join(b, "lang", "full")


@query("SELECT conv_id, turn, role FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role <> 'system'")
def indexable_rows(spark, sf_dir):
    """STR-14: neither headers nor blanks."""
    return table(spark, sf_dir, "conversations").where("trim(coalesce(text, '')) <> '' AND role <> 'system'").select("conv_id", "turn", "role")


LEMMA = "CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN w[:-2] ELSE w END"


@query(f"SELECT doc_id, md5(array_to_string(list_filter(list_transform({TOK.format('text')}, lambda w: {LEMMA}), lambda w: NOT list_contains({STOP}, w)), ' ')) AS lemmas FROM documents WHERE text IS NOT NULL")
def lemmatised(spark, sf_dir):
    """TOK-02: a dictionary of forms joined to the tokens; forms that it lacks stay. The stand-in dictionary takes a final s off."""
    b = Base(spark, sf_dir)
    forms = b.posts.select("term").distinct().where("length(term) > 3 AND term LIKE '%s'").select("term", F.expr("substr(term, 1, length(term) - 1)").alias("lemma"))
    rows = tx.lemmas(b.docs.where("text IS NOT NULL"), forms, "doc_id", "text")
    return rows.select("doc_id", F.md5(F.array_join("lemmas", " ").cast("binary")).alias("lemmas"))


@query(f"{TWO}, r AS ({top('SELECT qid, doc_id, 1 / (60 + coalesce(s.rank, 101)) + 1 / (60 + coalesce(d.rank, 101)) AS score FROM s FULL JOIN d USING (qid, doc_id)', 50)}) {top('SELECT qid, r.doc_id, r.score * CASE WHEN lang = $$en$$ THEN 1.1 ELSE 1.0 END AS score FROM r JOIN documents USING (doc_id)', 10)}")
def metadata_arm(spark, sf_dir):
    """RET-12: sparse and dense runs fused, then boosted by metadata."""
    fused = retrieve.top_k(fuse.rrf(list(two(spark, sf_dir)), missing="rank"), 50).withColumn("score", F.round("score", 6))
    facts = table(spark, sf_dir, "documents").select("doc_id", "lang")
    boosted = fused.drop("rank").join(facts, "doc_id").withColumn("score", F.col("score") * F.when(F.col("lang") == "en", 1.1).otherwise(1.0))
    return shown(retrieve.top_k(boosted, 10))


SPLIT = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"


@query(f"WITH {BASE}, p AS ({top(okapi(), 20)}), w AS (SELECT qid, doc_id, rank AS first, {SPLIT.format('b.text')} AS q, {SPLIT.format('d.text')} AS t FROM p JOIN benchmark b ON b.item_id = qid JOIN documents d USING (doc_id)), s AS (SELECT *, len(list_intersect(q, t)) / len(q) AS score FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first) AS rank FROM s) SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def hooked_rerank(spark, sf_dir):
    """FUS-07 and 08, UDF-07: a first stage's 20 best re-ranked by a pair scorer, here the share of shared words."""
    b = Base(spark, sf_dir)
    pool = b.bm25(20)
    queries = b.items.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    out = agents.reranked(pool, queries, b.docs.select("doc_id", "text"), agents.overlap_scores, 5)
    return rounded(out.select("qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank")))
