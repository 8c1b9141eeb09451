"""Corrective retrieval by BM25. A benchmark item's first twelve tokens, the first few of them turned round, stand in for a question, and
the question as a phrase in a document for a model's yes: where the turned tokens still stand, no document has it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators import corrective, retrieve
from marlowe.plans.ranking import BASE, TOK, Base, okapi, rounded, top
from marlowe.plans.registry import query
from marlowe.sources.writers import kept

LIMIT = 6
CORPUS = "\n".join(line for line in BASE.splitlines() if not line.startswith("qt AS"))


def machine(words: str, judged: str) -> str:
    """All rounds of all questions as they would be, the round where each ends, and the best one up to it."""
    return f"""WITH {CORPUS}, t0 AS (SELECT item_id AS qid, {TOK.format("text")} AS t, item_id % 5 AS m FROM benchmark), o AS (SELECT qid, list_concat(list_reverse(t[1:m]), t[m + 1:12]) AS w FROM t0),
rq AS (SELECT qid, r AS round, array_to_string({words}, ' ') AS q FROM o, range({LIMIT + 1}) x(r)), qt AS (SELECT qid * 10 + round AS qid, term, count(*) AS qtf FROM (SELECT qid, round, unnest(string_split(q, ' ')) AS term FROM rq) GROUP BY ALL),
run AS (SELECT qid // 10 AS qid, qid % 10 AS round, doc_id, rank FROM ({top(okapi(), 100)})), text AS (SELECT doc_id, ' ' || array_to_string(t, ' ') || ' ' AS p FROM tok),
j AS (SELECT run.qid, run.round, doc_id, {judged} AS hit FROM run JOIN rq USING (qid, round) JOIN text USING (doc_id) WHERE rank <= 20),
n AS (SELECT qid, round, count_if(hit) AS relevant FROM j GROUP BY ALL), s AS (SELECT qid, round, q, coalesce(relevant, 0)::BIGINT AS relevant, coalesce(q = lag(q) OVER (PARTITION BY qid ORDER BY round), false) AS no_change FROM rq LEFT JOIN n USING (qid, round)),
e AS (SELECT qid, coalesce(min(round) FILTER (relevant > 0 OR no_change), {LIMIT}) AS last FROM s GROUP BY qid), tr AS (SELECT s.* FROM s JOIN e USING (qid) WHERE round <= last)"""


PHRASE = "contains(p, ' ' || q || ' ')"
DROPPED = "w[2 * least(r, (len(w) - 1) // 2) + 1:]"
STAGES = "CASE WHEN r = 0 THEN w WHEN r = 1 THEN w[3:] WHEN r % 3 = 2 THEN w[5:8] WHEN r % 3 = 0 THEN w[9:12] ELSE w[1:4] END"


def phrase(text: str, q: str):
    padded = lambda tokens: F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.contains(padded(tx.tokens(F.col(text))), padded(F.split(q, " ")))


def answering(column) -> corrective.Hook:
    return lambda rows: rows.withColumn("answer", column)


def words(name: str):
    return F.split(name, " ")


def opening(n: int, w):
    """The array without its first n items."""
    return F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0)))


def parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, Callable]:
    """Questions, texts, and BM25 over postings that are written once."""
    b = Base(spark, sf_dir)
    posts, about = kept(b.posts, "postings"), kept(b.stats, "collection")
    t, m = tx.tokens(F.col("text")), (F.col("item_id") % 5).cast("int")
    w = F.concat(F.reverse(F.slice(t, F.lit(1), m)), F.slice(t, m + 1, 12 - m))
    questions = b.items.select(F.col("item_id").alias("qid"), F.array_join(w, " ").alias("query"))

    def search(asked: DataFrame, k: int) -> DataFrame:
        terms = retrieve.query_terms(asked, text_col="query", tokenize=lambda q: F.split(q, " "))
        return retrieve.top_k(retrieve.bm25(posts, terms, about), k)

    return questions, b.docs.select("doc_id", "text"), search


def by_document(spark, sf_dir):
    questions, texts, search = parts(spark, sf_dir)
    judge = corrective.each_document(texts, answering(phrase("text", "query")), words=None)
    shorter = F.when(F.size(words("query")) > 2, F.array_join(opening(2, words("query")), " ")).otherwise(F.col("query"))
    return corrective.correct(questions, search, judge, corrective.rewritten(answering(shorter)), partial(kept, name="correction"), limit=LIMIT)


def collective(spark, sf_dir):
    questions, texts, search = parts(spark, sf_dir)
    first = F.array_join(F.slice(words("query"), 1, 3), " ")
    judge = corrective.together(texts, answering(phrase("passages", "query")), lambda rows: rows.withColumn("query", first).withColumn("answer", phrase("passages", "query")), words=None)
    w = words("original")
    aspects = F.array(*[F.array_join(F.slice(w, i, 4), " ") for i in (5, 9, 1)])
    rewrite = corrective.staged(answering(F.array_join(opening(2, w), " ")), answering(aspects), answering(F.col("target")))
    return corrective.correct(questions, search, judge, rewrite, partial(kept, name="correction"), limit=LIMIT)


LENIENT = "CASE WHEN run.round = 0 THEN contains(p, ' ' || q || ' ') ELSE contains(p, ' ' || array_to_string(string_split(q, ' ')[1:3], ' ') || ' ') END"


@query(f"""{machine(DROPPED, PHRASE)}, best AS (SELECT qid, arg_max(round, (relevant, -round)) AS round FROM tr GROUP BY qid)
SELECT run.qid, doc_id, coalesce(hit, false) AS relevant, round, row_number() OVER (PARTITION BY run.qid ORDER BY coalesce(hit, false) DESC, rank) AS rank FROM run JOIN best USING (qid, round) LEFT JOIN j USING (qid, round, doc_id)""")
def crag_run(spark, sf_dir):
    """FUS-14: documents judged one by one; the best round's run, relevant documents first."""
    return by_document(spark, sf_dir)[0]


@query(f"""{machine(DROPPED, PHRASE)}, q AS (SELECT qid, count(*) AS n, arg_min(relevant > 0, round) AS first, arg_max(relevant > 0, round) AS final, bool_or(no_change) AS same, count_if(relevant > 0) AS hits FROM tr GROUP BY qid)
SELECT count(*) AS n_queries, round(avg(n), 6) AS mean_rounds, round(avg(first::INT), 6) AS at_once, round(avg((hits < n)::INT), 6) AS rewritten, round(avg((NOT final AND n >= {LIMIT})::INT), 6) AS by_limit, round(avg(same::INT), 6) AS no_change, round(sum(hits) / sum(n), 6) AS correct_rounds FROM q""")
def crag_stats(spark, sf_dir):
    """FUS-15 over the loop of ``crag_run``."""
    return rounded(corrective.correction_stats(by_document(spark, sf_dir)[1], LIMIT))


@query(f"""{machine(STAGES, LENIENT)} SELECT qid, round, q AS query, least(relevant, 1)::BIGINT AS relevant, relevant > 0 AS correct, no_change FROM tr""")
def collective_trace(spark, sf_dir):
    """DIA-22: documents judged together, strict and then lenient; a rewrite of the whole and then aspects in turn."""
    return collective(spark, sf_dir)[1]
