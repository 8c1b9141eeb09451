"""Where a law's articles lie in its text, and which articles a node's own text names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlowe.functions import text as tx

#: An article marker at a line's start, and one that may stand behind heading marks.
PLAIN = re.compile(r"^[ \t]*Art\.?\s+([A-Z0-9][A-Z0-9_./-]*)", re.M | re.I)
HEADED = re.compile(r"^[\s#]*Art\.?\s+([A-Z0-9][A-Z0-9_./-]*)", re.M | re.I)
MARKS = "array<struct<start:int,no:string>>"


def marks(pattern: re.Pattern, text: Column) -> Column:
    """The markers of a whole text with their places in code points; none for null."""

    @F.pandas_udf(MARKS)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "no": m[1].rstrip(".")} for m in pattern.finditer(t or "")])

    return find(text)


def known(rows: DataFrame, articles: DataFrame, doc: str, no: str) -> DataFrame:
    """Appends article: that of the same number without accents and case, the greatest of several; else the only one with the same leading integer; else null.

    articles (doc, article, no). Both lookups have a row a key, so rows stay as many as they were.
    """
    held = articles.where(F.col(no).isNotNull() & (F.col(no) != "") & F.col("article").isNotNull())
    exact = held.groupBy(F.col(doc).alias("_d"), tx.match_key(F.col(no)).alias("_k")).agg(F.max("article").alias("_exact"))
    lead = held.where(F.col(no).rlike(r"^\d")).groupBy(F.col(doc).alias("_d2"), F.regexp_extract(no, r"^(\d+)", 1).alias("_l")).agg(F.count("*").alias("_n"), F.max("article").alias("_only")).where("_n = 1").drop("_n")
    met = rows.join(exact, (F.col(doc) == F.col("_d")) & (tx.match_key(F.col(no)) == F.col("_k")), "left").drop("_d", "_k")
    met = met.join(lead, (F.col(doc) == F.col("_d2")) & (F.regexp_extract(no, r"^(\d+)", 1) == F.col("_l")), "left").drop("_d2", "_l")
    return met.withColumn("article", F.coalesce("_exact", "_only")).drop("_exact", "_only")


def spans(texts: DataFrame, articles: DataFrame, allowed: DataFrame | None = None, *, doc: str = "doc", no: str = "no") -> DataFrame:
    """(doc, article, no, start, stop) of texts (doc, text): from a marker to the next one, known or not, or to the end.

    Markers whose number is no known article's go, and so do articles that ``allowed`` (doc, article) doesn't have. An
    article that is marked repeatedly has a span each time. Only markers leave a text's row.
    """
    found = texts.select(doc, F.char_length("text").alias("_size"), marks(PLAIN, F.col("text")).alias("_m"))
    places = F.transform("_m", lambda m, i: F.struct(m["start"].alias("start"), m["no"].alias(no), F.coalesce(F.get(F.col("_m"), i + 1)["start"], F.col("_size")).alias("stop")))
    rows = found.select(doc, F.explode(places).alias("_x")).select(doc, "_x.*")
    out = known(rows, articles, doc, no).where("article IS NOT NULL")
    if allowed is not None:
        out = out.join(allowed.select(doc, "article").distinct(), [doc, "article"], "left_semi")
    return out.select(doc, "article", no, "start", "stop")


def own_links(nodes: DataFrame, articles: DataFrame, *, doc: str = "doc", no: str = "no") -> DataFrame:
    """(doc, node, articles, numbers) of nodes (doc, node, text, label): known articles that the text's markers name, in their order.

    A text without a marker falls back to its label's first, if the label starts with one. numbers are the distinct ones
    that are known, articles the distinct articles. Nodes without any have empty arrays; repeated nodes are one.
    """
    own = marks(HEADED, F.col("text"))
    label = F.slice(marks(PLAIN, F.when(F.col("label").rlike(r"(?i)^\s*Art"), F.col("label"))), 1, 1)
    found = nodes.select(doc, "node", own.alias("_own"), label.alias("_label")).withColumn("_m", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_label")))
    rows = found.select(doc, "node", F.posexplode_outer(F.array_distinct(F.transform("_m", lambda m: m["no"]))).alias("_pos", no))
    met = known(rows, articles, doc, no).groupBy(doc, "node").agg(F.array_sort(F.collect_set(F.when(F.col("article").isNotNull(), F.struct("_pos", "article", F.col(no).alias("no"))))).alias("_x"))
    return met.select(doc, "node", F.array_distinct(F.transform("_x", lambda x: x["article"])).alias("articles"), F.transform("_x", lambda x: x["no"]).alias("numbers"))
