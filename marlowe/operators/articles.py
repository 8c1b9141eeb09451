"""Statute texts: structural markers, articles with their hierarchy, citations with places, and their resolution."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markers of statutes in French and Dutch, their levels (0 the highest), and the article marker.
MARKERS = [
    ("LIVRE", 0, r"^\s*LIVRE\s+(?:[IVX]+|\d+)\b"),
    ("TITRE", 0, r"(?i)^\s*TITRE\s+(?:[IVX]+|\d+)\b"),
    ("CHAPITRE", 1, r"(?i)^\s*CHAPITRE\s+(?:[IVX]+|\d+|[Ii]er)\b"),
    ("SECTION", 2, r"^\s*(?:Section|SECTION)\s+(?:\d+(?:re|ère|e)?|[IVX]+)\b"),
    ("SOUS-SECTION", 3, r"(?i)^\s*(?:Sous-section|SOUS-SECTION)\s+\d+\b"),
    ("BOEK", 0, r"^\s*BOEK\s+(?:[IVX]+|\d+)\b"),
    ("TITEL", 0, r"(?i)^\s*TITEL\s+(?:[IVX]+|\d+)\b"),
    ("HOOFDSTUK", 1, r"(?i)^\s*HOOFDSTUK\s+(?:[IVX]+|\d+|[Ii])\b"),
    ("AFDELING", 2, r"^\s*(?:Afdeling|AFDELING)\s+\d+\b"),
    ("ONDERAFDELING", 3, r"(?i)^\s*(?:Onderafdeling|ONDERAFDELING)\s+\d+\b"),
]
LEVELS = ["law_title", "chapter_title", "section_title", "subsection_title"]
ARTICLE = r"(?i)^\s*Art\.?\s+([A-Z0-9][A-Z0-9_./-]*)"

#: The five kinds of citation. Each has the groups that hold article numbers; relative ones have none.
CITATIONS = [
    (re.compile(r"\bart(?:icle)?s?\s+(\d[\w./-]*)\s+(?:et|à|jusqu[’']au?)\s+(\d[\w./-]*)", re.I), (1, 2)),
    (re.compile(r"\bl[’']?art(?:icle)?\.?\s+(\d[\w./-]*)\s+de\s+la\s+(?:loi|arrêté|décret)", re.I), (1,)),
    (re.compile(r"\bart(?:icle)?s?\.?\s+([A-Z0-9][A-Z0-9_./-]*(?:bis|ter|quater|quinquies)?)", re.I), (1,)),
    (re.compile(r"\bdu\s+présent\s+(?:code|titre|chapitre|article)", re.I), ()),
    (re.compile(r"\b(?:l[’']alínéa|l[’']article)\s+précédent\b", re.I), ()),
]
HIT = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("size", T.IntegerType()), ("kind", T.IntegerType()), ("group", T.IntegerType()), ("raw", T.StringType()), ("article_no", T.StringType()))]))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first pattern that the text has."""
    return reduce(lambda w, r: w.when(text.rlike(r[1]), r[0]), rules[1:], F.when(text.rlike(rules[0][1]), rules[0][0])).otherwise(F.lit(otherwise))


def marked(lines: DataFrame, text: str = "text", size: str | None = None, body: str | None = None) -> DataFrame:
    """Appends marker, level and article_no to lines, null where a line is none. With font sizes only lines of at least the body's, less one, can be markers."""
    big = F.lit(True) if size is None else F.col(size) >= F.col(body) - 1
    marker = F.when(big, first_match(F.col(text), [(n, p) for n, _, p in MARKERS]))
    level = reduce(lambda w, m: w.when(F.col("marker") == m[0], m[1]), MARKERS, F.when(F.lit(False), 0))
    number = F.rtrim(F.regexp_extract(F.col(text), ARTICLE, 1), F.lit("."))
    return lines.withColumn("marker", marker).withColumn("level", level).withColumn("article_no", F.nullif(number, F.lit("")))


def articles(lines: DataFrame, by: str, order: str, text: str = "text", page: str | None = None, cut_mark: str = "...") -> DataFrame:
    """Articles of marked lines: one row from each article marker to the next or to the next structural marker.

    Gives by, part, article_no, text (lines joined), truncated (the text ends in ``cut_mark``), first_page, last_page, the
    titles of ``LEVELS`` (a title holds until one of its own or a higher level comes), path and depth. Lines outside articles
    are left out. Windows are by document, whose lines fit a task.
    """
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_start", F.max(F.when(F.col("article_no").isNotNull() | F.col("marker").isNotNull(), F.col(order))).over(upto))
    for k, name in enumerate(LEVELS):
        rows = rows.withColumn(f"_at{k}", F.max(F.when(F.col("level") == k, F.struct(F.col(order).alias("o"), F.trim(F.col(text)).alias("t")))).over(upto))
    for k, name in enumerate(LEVELS):
        above = F.greatest(*[F.coalesce(F.col(f"_at{j}.o"), F.lit(-1)) for j in range(k)], F.lit(-1), F.lit(-1)) if k else F.lit(-1)
        rows = rows.withColumn(name, F.when(F.col(f"_at{k}.o") > above, F.col(f"_at{k}.t")))
    number = F.max(F.when(F.col(order) == F.col("_start"), F.col("article_no")))
    pages = F.col(page) if page else F.lit(None).cast("int")
    held = rows.where("_start IS NOT NULL").groupBy(by, F.col("_start").alias("part"))
    out = held.agg(number.alias("article_no"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_lines"), F.min(pages).alias("first_page"), F.max(pages).alias("last_page"), *[F.max(n).alias(n) for n in LEVELS])
    out = out.where("article_no IS NOT NULL").withColumn("text", F.array_join(F.transform("_lines", lambda x: x["t"]), "\n")).drop("_lines")
    path = F.filter(F.array(*LEVELS), lambda x: x.isNotNull())
    return out.withColumn("truncated", F.endswith(F.rtrim(F.col("text")), F.lit(cut_mark))).withColumn("path", F.array_join(path, " > ")).withColumn("depth", F.size(path))


@F.pandas_udf(HIT)
def hits(texts: pd.Series) -> pd.Series:
    """Every match of every kind in a text with its place; a number each for kinds with several. Null texts have none."""

    def of(text: str) -> list[tuple]:
        found = ((m, kind, groups) for kind, (pattern, groups) in enumerate(CITATIONS) for m in pattern.finditer(text))
        return [(m.start(), m.end() - m.start(), kind, g, m[0], m[g] if g else None) for m, kind, groups in found for g in groups or (0,)]

    return texts.map(lambda t: of(t or ""))


def disjoint(spans: Column) -> Column:
    """Of spans (start, size, ..) those that a sweep from the left keeps: each that begins at or behind the end of the last one kept.

    At one start the longest comes first, then the fields that follow in the spans' own order.
    """
    row = lambda s: F.struct(s["start"].alias("start"), (-s["size"]).alias("short"), s.alias("span"))
    ordered = F.array_sort(F.transform(spans, row))
    kept = F.filter(ordered, lambda x: F.lit(False))
    sweep = F.aggregate(ordered, F.struct(F.lit(0).alias("end"), kept.alias("kept")), lambda s, x: F.when(x["start"] >= s["end"], F.struct((x["start"] - x["short"]).alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s))
    return F.transform(sweep["kept"], lambda x: x["span"])


def citations(docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, start, end, raw, article_no, is_relative): one row for each citation; null and empty texts have none.

    Matches are found in Arrow batches, as places need Python's patterns; overlaps are settled in the row. Nothing is shuffled.
    """
    found = docs.select(F.col(id_col).alias("id"), hits(F.col(text_col)).alias("h")).select("id", F.posexplode(disjoint(F.col("h"))).alias("pos", "c"))
    return found.select("id", "pos", "c.start", (F.col("c.start") + F.col("c.size")).alias("end"), "c.raw", "c.article_no", (F.col("c.group") == 0).alias("is_relative"))


def leading_int(no: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(no), r"^(\d+)", 1), F.lit(""))


def base_no(no: Column) -> Column:
    """The number without a hyphened paragraph, regional qualifiers taken off first; null if it has none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(F.trim(no), r"_[A-Z][A-Z_]+$", ""), r"^(.+?)-\d+$", 1), F.lit(""))


def file_of(url: Column, host: str) -> Column:
    """What follows the host, slashes as underscores; the whole of another address."""
    return F.replace(F.element_at(F.split(url, re.escape(host)), -1), F.lit("/"), F.lit("_"))


def publication_no(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, r"(?i)_(\d{8,12})_[FN](?:_\w+)?\.pdf$", 1), F.lit(""))


def referenced_no(reference: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.trim(reference), r"(?i)^Art\.\s+(.+?)\s*,", 1)), F.lit(""))


def resolve(citing: DataFrame, rows: DataFrame, key) -> DataFrame:
    """Appends target and step to (.., source_id, law, article_no), by rows (id, law, no), null where nothing fits.

    Steps: the number within the law (the last id of several); its leading integer, as a number, there; its base there; the
    number anywhere, if one article but the citing one has it; its leading integer anywhere, likewise. ``key`` normalises
    numbers. No step gives the citing article. Each step's lookup has a row for each key, so hot numbers are reduced first.
    """
    numbers = rows.select("id", "law", key(F.col("no")).alias("k"))
    local = numbers.groupBy("law", "k").agg(F.max("id").alias("t"))
    world = numbers.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    out = citing.withColumns({"_k1": key(F.col("article_no")), "_k2": key(leading_int(F.col("article_no"))), "_k3": key(base_no(F.col("article_no")))})
    for i in (1, 2, 3):
        out = out.join(local.select(F.col("law"), F.col("k").alias(f"_k{i}"), F.col("t").alias(f"_t{i}")), ["law", f"_k{i}"], "left")
        out = out.withColumn(f"_t{i}", F.when(F.col(f"_t{i}") != F.col("source_id"), F.col(f"_t{i}")))
    for i, k in ((4, "_k1"), (5, "_k2")):
        one = F.when(F.col("n") == 1, F.col("low")).when((F.col("n") == 2) & (F.col("low") == F.col("source_id")), F.col("high")).when((F.col("n") == 2) & (F.col("high") == F.col("source_id")), F.col("low"))
        out = out.join(world.withColumnRenamed("k", k), k, "left").withColumn(f"_t{i}", F.when(one != F.col("source_id"), one)).drop("n", "low", "high")
    step = reduce(lambda w, i: w.when(F.col(f"_t{i}").isNotNull(), i), (2, 3, 4, 5), F.when(F.col("_t1").isNotNull(), 1))
    return out.select(*citing.columns, F.coalesce(*[F.col(f"_t{i}") for i in range(1, 6)]).alias("target"), step.alias("step"))


def lookups(rows: DataFrame, by: str, no: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(by, number, value), the greatest value of several, and (by, lead, values): all values of a leading integer, ascending."""
    exact = rows.groupBy(by, F.col(no).alias("number")).agg(F.max(value).alias(value))
    lead = rows.withColumn("lead", leading_int(F.col(no))).where("lead IS NOT NULL").groupBy(by, "lead").agg(F.array_sort(F.collect_list(value)).alias("found"))
    return exact, lead
