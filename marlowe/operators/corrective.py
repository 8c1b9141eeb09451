"""Corrective retrieval for all queries at once: retrieve, judge the first results, rewrite the queries that failed.

A query still open is a row of the state (qid, original, query, previous, aspects, at); a round is the same few joins
whatever the number of queries. Hooks take rows and append the column ``answer``: an expression or a model behind
``agents.hooked``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlowe.functions import text as tx

Hook = Callable[[DataFrame], DataFrame]
STATE = ["qid", "original", "query", "previous", "aspects", "at"]


def cut_texts(texts: DataFrame, words: int | None) -> DataFrame:
    """(doc_id, text), null texts empty, those with more words cut and marked."""
    text = F.coalesce("text", F.lit(""))
    return texts.select("doc_id", (text if words is None else tx.first_words(text, words, " …")).alias("text"))


def each_document(texts: DataFrame, says: Hook, words: int | None = 512) -> Callable[[DataFrame, int], DataFrame]:
    """A judge that is asked about one document at a time (original, query, text): ``answer`` is whether it is relevant.

    Texts (doc_id, text) longer than ``words`` are cut and marked; null answers are no.
    """
    shown = cut_texts(texts, words)

    def judge(top: DataFrame, r: int) -> DataFrame:
        said = says(top.join(shown, "doc_id")).where("answer")
        return said.groupBy("qid").agg(F.count("*").alias("relevant"), F.collect_set("doc_id").alias("docs"))  # eval_k at most

    return judge


def together(texts: DataFrame, strict: Hook, lenient: Hook, words: int | None = 300) -> Callable[[DataFrame, int], DataFrame]:
    """A judge that is asked once about all of a query's documents (original, query, passages): strict in round 0, lenient later.

    ``passages`` are the texts in the run's order, numbered, cut to ``words``, with an empty line between. A yes counts as
    one relevant document, and says of none which it is.
    """
    shown = cut_texts(texts, words)

    def judge(top: DataFrame, r: int) -> DataFrame:
        rows = top.join(shown, "doc_id").groupBy("qid", "original", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))  # eval_k at most
        numbered = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n\n")
        said = (lenient if r else strict)(rows.withColumn("passages", numbered).drop("p"))
        none = F.array().cast(f"array<{dict(top.dtypes)['doc_id']}>")
        return said.select("qid", F.coalesce(F.col("answer"), F.lit(False)).cast("bigint").alias("relevant"), none.alias("docs"))

    return judge


def rewritten(says: Hook) -> Callable[[DataFrame, int], DataFrame]:
    """One rewrite for all rounds, from the original and the current query."""

    def rewrite(state: DataFrame, r: int) -> DataFrame:
        return says(state).withColumn("previous", F.col("query")).withColumn("query", F.trim("answer"))

    return rewrite


def staged(statutory: Hook, extract: Hook, focused: Hook) -> Callable[[DataFrame, int], DataFrame]:
    """After round 0 a rewrite of the whole; then aspects of the original (an array, drawn once), one after the other and around again.

    ``focused`` sees the aspect in ``target``. A query without aspects stays as it is, which ends its loop.
    """

    def rewrite(state: DataFrame, r: int) -> DataFrame:
        if r == 0:
            return rewritten(statutory)(state, r)
        if r == 1:
            state = extract(state).withColumn("aspects", F.col("answer")).drop("answer")
        n = F.coalesce(F.size("aspects"), F.lit(0))
        said = focused(state.withColumn("target", F.when(n > 0, F.get("aspects", F.col("at") % n))))
        return said.withColumn("previous", F.col("query")).withColumn("query", F.when(F.col("target").isNull(), F.col("query")).otherwise(F.trim("answer"))).withColumn("at", F.col("at") + 1)

    return rewrite


def correct(queries: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame, int], DataFrame], rewrite: Callable[[DataFrame, int], DataFrame], cut: Callable[[DataFrame], DataFrame], *, eval_k: int = 20, top_k: int = 100, limit: int = 6) -> tuple[DataFrame, DataFrame]:
    """(run, trace) of queries (qid, query).

    ``retrieve(queries, k)`` gives (qid, doc_id, rank); ``judge(top, round)`` gets its first ``eval_k`` with original and
    query, and gives (qid, relevant, docs). A query ends with a relevant document, with a rewrite that changed nothing
    (which is still judged), or after ``limit`` rewrites. Its run is that of the round with the most relevant documents,
    the earliest of equal ones, relevant documents first, each part in the retriever's order. trace: qid, round, query,
    relevant, correct, no_change. ``cut`` writes a table and reads it back (``writers.kept``), so a round's plan doesn't
    hold those before. A query that retrieves nothing has a trace and no run; a null query retrieves nothing.
    """
    text = F.lit(None).cast("string")
    state = cut(queries.select("qid", F.col("query").alias("original"), "query", text.alias("previous"), F.lit(None).cast("array<string>").alias("aspects"), F.lit(0).alias("at")))
    runs, traces = [], []
    for r in range(limit + 1):
        found = cut(retrieve(state.select("qid", "query"), top_k).select("qid", "doc_id", "rank"))
        said = judge(found.where(F.col("rank") <= eval_k).join(state.select("qid", "original", "query"), "qid"), r)
        same = (F.lit(r) > 0) & F.col("query").eqNullSafe(F.col("previous"))
        trace = state.join(said, "qid", "left").select("qid", F.lit(r).alias("round"), "query", F.coalesce("relevant", F.lit(0).cast("bigint")).alias("relevant"), "docs", same.alias("no_change"))
        trace = cut(trace.withColumn("correct", F.col("relevant") >= 1))
        runs.append(found.withColumn("round", F.lit(r)))
        traces.append(trace)
        left = trace.where("NOT correct AND NOT no_change").select("qid")
        if r == limit or left.isEmpty():
            break
        state = cut(rewrite(state.join(left, "qid", "left_semi"), r).select(STATE))
    run, trace = runs[0], traces[0]
    for a, b in zip(runs[1:], traces[1:], strict=True):
        run, trace = run.unionByName(a), trace.unionByName(b)
    best = trace.groupBy("qid").agg(F.max_by(F.struct("round", "docs"), F.struct("relevant", -F.col("round"))).alias("x")).select("qid", "x.round", "x.docs")
    relevant = F.coalesce(F.array_contains("docs", F.col("doc_id")), F.lit(False))
    met = run.join(best, ["qid", "round"]).withColumn("relevant", relevant)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("relevant").desc(), "rank"))
    return met.select("qid", "doc_id", "relevant", "round", place.alias("rank")), trace.drop("docs")


def correction_stats(trace: DataFrame, limit: int) -> DataFrame:
    """One row: queries, mean rounds, shares right at once, ever wrong, wrong after ``limit`` rounds or more, ended without change, and of rounds that were right."""
    last: Column = F.max_by("correct", "round")
    each = trace.groupBy("qid").agg(F.count("*").alias("n"), F.min_by("correct", "round").alias("first"), last.alias("last"), F.max("no_change").alias("same"), F.count_if("correct").alias("right"))
    share = lambda c: F.avg(c.cast("int"))
    return each.agg(
        F.count("*").alias("n_queries"), F.avg("n").alias("mean_rounds"), share(F.col("first")).alias("at_once"), share(F.col("right") < F.col("n")).alias("rewritten"),
        share(~F.col("last") & (F.col("n") >= limit)).alias("by_limit"), share(F.col("same")).alias("no_change"), (F.sum("right") / F.sum("n")).alias("correct_rounds"),
    )
