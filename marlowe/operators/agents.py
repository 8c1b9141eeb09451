"""Model hooks and what surrounds them: parsers of answers and actions, judges and re-rankers, loop statistics.

A hook is a function from a list of strings (or of pairs) to a list of results. It runs on Arrow batches in the
executors; models are loaded by the function itself. Answers are cached by the caller (``sources.writers.cached``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.sources.writers import kept

#: Pairs of a first stage up to which they are broadcast, some 40 MB.
MOST_POOL = 1_000_000
#: An action in the strict form, and the permissive ones in the order in which they are tried.
STRICT = r"(?i)Action\s*:\s*(search|lookup|finish)\[([^\]]*)\]"
PERMISSIVE = [
    r"(?is)Action\s*:\s*(search|lookup|finish)\s*\(\s*[«\"']?\s*(.*?)\s*[»\"']?\s*\)",
    r"(?is)Action\s*:\s*(search|lookup|finish)\s*«\s*(.+?)\s*»",
    r"(?i)Action\s*:\s*(search|lookup|finish)\s*:\s*[«\"']?\s*([^\n\"»']+?)\s*[»\"']?\s*(?:\n|$)",
    r"(?i)Action\s*:\s*(search|lookup|finish)\s+(.+?)\s*(?:\n|$)",
]
#: Phrases of a refusal.
REFUSALS = ["je ne peux", "i cannot", "i'm sorry", "désolé", "ne peux pas"]


def action(answer: Column, permissive: bool = True) -> Column:
    """struct<verb, argument> of the first form that the answer has; nulls where it has none. A lookup's argument must be a number."""
    forms = [STRICT, *PERMISSIVE] if permissive else [STRICT]
    found = reduce(lambda w, p: w.when(answer.rlike(p), F.struct(F.lower(F.regexp_extract(answer, p, 1)).alias("verb"), F.regexp_extract(answer, p, 2).alias("raw"))), forms[1:], F.when(answer.rlike(forms[0]), F.struct(F.lower(F.regexp_extract(answer, forms[0], 1)).alias("verb"), F.regexp_extract(answer, forms[0], 2).alias("raw"))))
    bare = F.regexp_replace(F.trim(found["raw"]), "^[«»\"']+|[«»\"']+$", "")
    argument = F.when(found["verb"] == "search", bare).when((found["verb"] == "lookup") & F.trim(bare).rlike(r"^[+-]?\d+$"), F.trim(bare))
    return F.struct(found["verb"].alias("verb"), argument.alias("argument"))


def null_bucket(answer: Column, tokens: Column) -> Column:
    """Why an answer without an action has none."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    refused = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(p)) for p in REFUSALS])
    tail = F.element_at(F.split(text, "Action"), -1)
    return F.when((text == "") | refused, "refusal_or_empty").when(~text.rlike(r"(?im)^\s*Action\s*:"), "prose_only").when(~F.contains(tail, F.lit("]")) & (tokens >= 60), "max_tokens_truncation").when(text.rlike("«[^»]*»"), "french_quotes").otherwise("wrong_bracket_shape")


def paraphrases(answer: Column, n: int = 4) -> Column:
    """The first n lines, numbers taken off, that have something; without any the first n lines as they are."""
    lines = F.transform(F.split(F.trim(answer), "\n"), lambda x: F.trim(x))
    bare = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+[.)]\s*", ""))), lambda x: x != "")
    return F.when(F.size(bare) > 0, F.slice(bare, 1, n)).otherwise(F.slice(F.filter(lines, lambda x: x != ""), 1, n))


def picks_of(answer: str | None, key: str) -> list[str]:
    """Strings under a key of a JSON answer: fenced or bare, an object or a list of them; [] for anything else."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", answer or "", re.S)
    try:
        found = json.loads((fenced[1] if fenced else answer or "").strip())
    except ValueError:
        return []
    parts = [found] if isinstance(found, dict) else found if isinstance(found, list) else []
    lists = [p.get(key, []) for p in parts if isinstance(p, dict)]
    return [s for x in lists if isinstance(x, list) for s in x if isinstance(s, str)]


def hooked(rows: DataFrame, inputs: list[str], fn: Callable[[list], list], new: str, kind: T.DataType) -> DataFrame:
    """Appends what a hook gives for each row's inputs: strings for one column, tuples for several. Nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_type

    at = [rows.columns.index(c) for c in inputs]
    schema = T.StructType([*rows.schema.fields, T.StructField(new, kind)])
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fn(columns[0] if len(columns) == 1 else list(zip(*columns, strict=True))), arrow)], names=schema.names)

    return rows.mapInArrow(run, schema)


def hashed_vectors(size: int = 64) -> Callable[[list], list]:
    """A stand-in encoder: unit vectors of hashed words, equal texts alike."""
    import zlib

    def encode(texts: list) -> list:
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h >> 31 else -1
            n = float(np.sqrt(v @ v))
            out.append((v / n if n else v).tolist())
        return out

    return encode


def overlap_scores(pairs: list) -> list:
    """A stand-in cross-encoder: the share of the query's words that the text has."""
    sets = [(set((q or "").lower().split()), set((t or "").lower().split())) for q, t in pairs]
    return [len(q & t) / len(q) if q else 0.0 for q, t in sets]


def reranked(run: DataFrame, queries: DataFrame, texts: DataFrame, predict: Callable[[list], list], k: int) -> DataFrame:
    """The k best of a first stage under a pair scorer (qid, query; doc_id, text); of equal scores the first stage's order stays.

    The first stage is written, and its pairs are broadcast to the texts where they are few enough, so that no text is shuffled but a pool's.
    """
    pool = kept(run.select("qid", "doc_id", F.col("rank").alias("first_rank")), "pool")
    met = texts.join(F.broadcast(pool) if pool.count() <= MOST_POOL else pool, "doc_id").join(queries, "qid")
    scored = hooked(met, ["query", "text"], predict, "score", T.DoubleType())
    order = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "first_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank", "first_rank")


def judge_diagnostics(judged: DataFrame, by: str, score: str) -> DataFrame:
    """(n_queries, parse_failures, mean_score, mean_spread, all_same): null scores are parse failures."""
    each = judged.groupBy(by).agg(F.count("*").alias("n"), F.count(score).alias("parsed"), F.avg(score).alias("m"), F.stddev_pop(score).alias("s"), (F.countDistinct(score) <= 1).alias("same"))
    return each.agg(F.count("*").alias("n_queries"), (1 - F.sum("parsed") / F.sum("n")).alias("parse_failures"), F.avg("m").alias("mean_score"), F.avg("s").alias("mean_spread"), F.avg(F.col("same").cast("int")).alias("all_same"))


def few_shot(judged: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """For each class n examples: the first hit and the first miss by rank of each query, picked in the order of a seeded hash."""
    first = judged.groupBy("qid", "hit").agg(F.min_by("doc", F.struct("rank", "doc")).alias("doc"))
    draw = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("qid").cast("string"), F.col("doc").cast("string")).cast("binary"))
    return first.withColumn("draw", draw).withColumn("at", F.row_number().over(Window.partitionBy("hit").orderBy("draw", "qid"))).where(F.col("at") <= n).select("qid", "hit", "doc")


def loop(queries: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], *, k: int = 10, accept: float = 0.5, rounds: int = 3, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """A corrective retrieval loop over all queries at once: (run, trace).

    queries (qid, query). Each round retrieves (qid, doc_id, score, rank) for the queries still open, judges each query's
    run to (qid, confidence), accepts those at ``accept`` or more, and rewrites the others. After the last round the
    most confident run stays, the earliest of equal ones. trace has qid, round, confidence and accepted. ``cut`` may
    checkpoint between rounds; a round is one job whatever the number of queries.
    """
    open_, runs, traces = queries.select("qid", "query"), None, None
    for r in range(rounds):
        run = cut(retrieve(open_, k).select("qid", "doc_id", "score", "rank").withColumn("round", F.lit(r)))
        said = judge(run).select("qid", "confidence")
        trace = cut(open_.select("qid").join(said, "qid", "left").select("qid", F.lit(r).alias("round"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).withColumn("accepted", F.col("confidence") >= accept))
        runs, traces = (run, trace) if runs is None else (runs.unionByName(run), traces.unionByName(trace))
        open_ = rewrite(open_.join(trace.where("NOT accepted").select("qid"), "qid", "left_semi")).select("qid", "query")
    best = traces.groupBy("qid").agg(F.max_by("round", F.struct("confidence", -F.col("round"))).alias("round"))
    return runs.join(best, ["qid", "round"], "left_semi").drop("round"), traces


def loop_stats(trace: DataFrame) -> DataFrame:
    """Shares of a trace: accepted at once, after a correction, never; mean rounds."""
    each = trace.groupBy("qid").agg(F.count("*").alias("n"), F.max("accepted").alias("ok"))
    return each.agg(F.count("*").alias("n_queries"), F.avg((F.col("ok") & (F.col("n") == 1)).cast("int")).alias("at_once"), F.avg((F.col("ok") & (F.col("n") > 1)).cast("int")).alias("corrected"), F.avg((~F.col("ok")).cast("int")).alias("never"), F.avg("n").alias("mean_rounds"))
