"""Loops of all queries at once against a loop a query in Python."""

from functools import partial

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.operators import agents, corrective
from marlowe.sources.writers import kept

TEXTS = {i: " ".join("abcdefgh"[(i * k + k) % 8] for k in range(1, 2 + i % 5)) for i in range(40)} | {40: None}
QUERIES = {q: "".join("abcdefgh"[(q * k + 3) % 8] for k in range(1, 2 + q % 6)) for q in range(25)} | {25: None, 26: "zz"}
CUT = partial(kept, name="test")


def found(query, k):
    """Documents by their number of the query's letters, then by id."""
    hits = sorted((-sum((t or "").count(c) for c in query or ""), d) for d, t in TEXTS.items())
    return [d for n, d in hits if n < 0][:k]


def retrieve(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "doc_id INT, text STRING")
    letters = texts.select("doc_id", F.explode(F.split("text", " ")).alias("c"))

    def search(asked, k):
        scores = asked.select("qid", F.explode(F.split("query", "")).alias("c")).join(letters, "c").groupBy("qid", "doc_id").count()
        return scores.withColumn("rank", F.expr("row_number() OVER (PARTITION BY qid ORDER BY count DESC, doc_id)")).where(F.col("rank") <= k)

    return texts, search


def walk(query, relevant, rewrite, limit, eval_k, top_k):
    """One query by itself: (trace, run)."""
    state, trace, best = {"original": query, "query": query, "previous": None}, [], (-1, None)
    for r in range(limit + 1):
        docs = found(state["query"], top_k)
        n, good = relevant(docs[:eval_k], state, r)
        same = r > 0 and state["query"] == state["previous"]
        trace.append((r, state["query"], n, n >= 1, same))
        if n > best[0]:
            best = (n, (r, [d for d in docs if d in good] + [d for d in docs if d not in good], good))
        if n or same:
            break
        state["previous"], state["query"] = state["query"], rewrite(state, r)
    return trace, best[1]


def same(spark, judge, relevant, hook, rewrite, limit=3, eval_k=4, top_k=9):
    texts, search = retrieve(spark)
    queries = spark.createDataFrame(list(QUERIES.items()), "qid INT, query STRING")
    run, trace = corrective.correct(queries, search, judge(texts), hook, CUT, eval_k=eval_k, top_k=top_k, limit=limit)
    traces, runs = {}, {}
    for t in trace.orderBy("qid", "round").collect():
        traces.setdefault(t.qid, []).append((t.round, t.query, t.relevant, t.correct, t.no_change))
    for t in run.orderBy("qid", "rank").collect():
        runs.setdefault(t.qid, []).append((t.doc_id, t.relevant, t.round))
    for q, text in QUERIES.items():
        steps, (r, docs, good) = walk(text, relevant, rewrite, limit, eval_k, top_k)
        assert traces[q] == steps
        assert runs.get(q, []) == [(d, d in good, r) for d in docs]
    return traces


def test_documents_one_by_one(spark):
    """A document is relevant if the query's first letter is its last word; the rewrite takes that letter off."""
    says = lambda pairs: [bool(q) and bool(t) and t[-1] == q[0] for q, t in pairs]
    judge = lambda texts: corrective.each_document(texts, lambda rows: agents.hooked(rows, ["query", "text"], says, "answer", T.BooleanType()))
    hook = corrective.rewritten(lambda rows: rows.withColumn("answer", F.expr("CASE WHEN length(query) > 1 THEN substr(query, 2) ELSE query END")))

    def relevant(docs, state, r):
        good = [d for d in docs if says([(state["query"], TEXTS[d])])[0]]
        return len(good), good

    traces = same(spark, judge, relevant, hook, lambda s, r: s["query"][1:] if s["query"] and len(s["query"]) > 1 else s["query"])
    assert {len(t) for t in traces.values()} >= {1, 2, 3} and any(t[-1][4] for t in traces.values()) and any(t[-1][3] and len(t) > 1 for t in traces.values())


def test_documents_together_and_aspects(spark):
    """The judge wants the query's last letter among the first words of the passages, later among all words."""
    first = lambda p: [line[4] for line in p.split("\n\n")]
    strict = lambda pairs: [bool(q) and q[-1] in first(p) for q, p in pairs]
    lenient = lambda pairs: [bool(q) and q[0] in p for q, p in pairs]
    ask = lambda fn: lambda rows: agents.hooked(rows, ["query", "passages"], fn, "answer", T.BooleanType())
    judge = lambda texts: corrective.together(texts, ask(strict), ask(lenient), words=3)
    say = lambda e: lambda rows: rows.withColumn("answer", F.expr(e))
    hook = corrective.staged(say("concat(' x', original)"), say("filter(split(original, ''), c -> c NOT IN ('a', 'b'))"), say("concat('y', target, ' ')"))

    def relevant(docs, state, r):
        passages = "\n\n".join(f"[{i}] " + (" ".join((TEXTS[d] or "").split()[:3]) + (" …" if len((TEXTS[d] or "").split()) > 3 else "")) for i, d in enumerate(docs, 1))
        return int(bool(docs) and (lenient if r else strict)([(state["query"], passages)])[0]), []

    def rewrite(s, r):
        if r == 0:
            return None if s["original"] is None else "x" + s["original"]
        aspects = [c for c in s["original"] or "" if c not in "ab"]
        return "y" + aspects[(r - 1) % len(aspects)] if aspects else s["query"]

    traces = same(spark, judge, relevant, hook, rewrite, limit=5)
    assert max(len(t) for t in traces.values()) == 6 and min(len(t) for t in traces.values()) == 1


def test_statistics(spark):
    rows = [(1, 0, True, False), (2, 0, False, False), (2, 1, True, False), (3, 0, False, False), (3, 1, False, True), (4, 0, False, False), (4, 1, False, False), (4, 2, False, False)]
    got = corrective.correction_stats(spark.createDataFrame(rows, "qid INT, round INT, correct BOOLEAN, no_change BOOLEAN"), 3).first()
    assert (got.n_queries, got.mean_rounds, got.at_once, got.rewritten, got.by_limit, got.no_change, got.correct_rounds) == pytest.approx((4, 2, 0.25, 0.75, 0.25, 0.25, 0.25))
