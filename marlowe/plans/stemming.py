"""Retrieval on French stems. No SQL here has the stemmer's rules, so tests hold these queries against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlowe.functions import stems
from marlowe.operators import retrieve
from marlowe.plans.ranking import Base, shown
from marlowe.plans.registry import query, table
from marlowe.sources.writers import kept


@query()
def stemmed_tokens(spark, sf_dir):
    """TOK-03: each document's tokens as stems without stop stems, their number and the md5 of their line."""
    out = stems.stemmed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.size("stems").alias("n_stems"), F.md5(F.array_join("stems", " ").cast("binary")).alias("stems_md5"))


@query()
def stem_bm25_topk(spark, sf_dir):
    """TOK-03 with RET-01: BM25 over stems, which tasks make of their texts and write, as they are read twice; a null text counts as a document without any."""
    b = Base(spark, sf_dir)
    docs = kept(stems.stem_docs(b.tokens), "stems")
    found = kept(retrieve.survey(docs), "stem-vocabulary")
    whole = found.where("term IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "length")])
    stats = whole.select("n", (F.col("length") / F.nullif("n", F.lit(0))).alias("avgdl"))
    counts = found.where("term IS NOT NULL").select("term", "df")
    return shown(retrieve.top_k(retrieve.bm25_top(docs, stems.stem_terms(b.terms), stats, 10, counts=counts), 10))
