"""Words, regions and rectangles of pages: places of words in a document's text, boxes of regions by line, rectangle algebra.

Rectangles are structs x0, y0, x1, y1 with y growing downwards. All but the search for words is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
#: Characters of a cell of the interval join: a word lies in one or two, a region in as many as it is long.
CELL = 256


def found_in(text: str | None, words: list[str | None]) -> list[int | None]:
    """Where each word begins: the first match after the last word found, else the first in the whole text; null if there is none or the word is empty."""
    text, out, after = text or "", [], 0
    for w in words:
        at = text.find(w, after) if w else -1
        at = text.find(w) if w and at < 0 else at
        out.append(at if at >= 0 else None)
        after = at + len(w) if at >= 0 else after
    return out


def word_index(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Words (doc, page, n, word, ..) that their page's text (doc, page, text) has, with start and stop in the document's text.

    That is the pages' texts in order of page with two characters between. A page's words are searched in order of n, in one
    row for the page; characters are code points. Words of a page without a row, and those not found, are left out.
    """
    size = F.char_length(F.coalesce("text", F.lit("")))
    upto = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offset = pages.select("doc", "page", "text", F.coalesce(F.sum(size + 2).over(upto), F.lit(0)).alias("offset"))
    rest = [c for c in words.columns if c not in ("doc", "page")]
    held = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("n", *[c for c in rest if c != "n"]))).alias("w"))

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, lists in batches:
            yield pd.Series([found_in(t, list(x)) for t, x in zip(text, lists, strict=True)])

    at = held.join(offset, ["doc", "page"]).withColumn("at", places("text", F.transform("w", lambda x: x["word"])))
    each = at.select("doc", "page", "offset", F.explode(F.arrays_zip("w", "at")).alias("z")).where("z.at IS NOT NULL")
    start = F.col("offset") + F.col("z.at")
    return each.select("doc", "page", *[F.col(f"z.w.{c}").alias(c) for c in rest], start.alias("start"), (start + F.char_length("z.w.word")).alias("stop"))


def cells(start: Column, stop: Column) -> Column:
    return F.sequence(F.floor(start / CELL), F.floor((stop - 1) / CELL))


def line_boxes(regions: DataFrame, index: DataFrame) -> DataFrame:
    """(doc, region, page, block, line, box): for each line that a region [start, stop) overlaps, the box around the words it overlaps there.

    The interval join meets on cells of the text, so it is an equi-join; a pair that shares several cells is taken in the first.
    Empty regions and those that no word overlaps have no rows.
    """
    r = regions.where("start < stop").select("doc", "region", F.col("start").alias("r0"), F.col("stop").alias("r1")).select("*", F.explode(cells(F.col("r0"), F.col("r1"))).alias("cell"))
    w = index.where("start < stop").select("doc", "page", "block", "line", "x0", "y0", "x1", "y1", "start", "stop").select("*", F.explode(cells(F.col("start"), F.col("stop"))).alias("cell"))
    first = F.greatest(F.floor(F.col("r0") / CELL), F.floor(F.col("start") / CELL))
    met = r.join(w, ["doc", "cell"]).where((F.col("start") < F.col("r1")) & (F.col("stop") > F.col("r0")) & (F.col("cell") == first))
    sides = met.groupBy("doc", "region", "page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return sides.select("doc", "region", "page", "block", "line", rect("x0", "y0", "x1", "y1").alias("box"))


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def intersection(a: Column, b: Column) -> Column:
    """The part that two rectangles share, null if it has no area."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), rect(x0, y0, x1, y1))


def without(a: Column, b: Column) -> Column:
    """What is left of a: itself where b shares nothing, else up to four parts, above and below b over a's whole width, then left and right of it."""
    shared = intersection(a, b)
    over, under = rect(a["x0"], a["y0"], a["x1"], shared["y0"]), rect(a["x0"], shared["y1"], a["x1"], a["y1"])
    left, right = rect(a["x0"], shared["y0"], shared["x0"], shared["y1"]), rect(shared["x1"], shared["y0"], a["x1"], shared["y1"])
    parts = F.filter(F.array(over, under, left, right), lambda p: (p["x0"] < p["x1"]) & (p["y0"] < p["y1"]))
    return F.when(shared.isNull(), F.array(a.cast(RECT))).otherwise(parts)


def without_all(a: Column, holes: Column) -> Column:
    """What is left of a once every rectangle of ``holes`` is taken away: parts that don't overlap."""
    return F.aggregate(holes, F.array(a.cast(RECT)), lambda parts, hole: F.flatten(F.transform(parts, lambda p: without(p, hole))))


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def regions_of(items: DataFrame, gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Regions of retrieved items: (qid, doc, region, rank, start, stop, page, category).

    items: (qid, doc, region, rank, start, stop, article, articles, node, page); gold: (qid, article); spans: (doc, article,
    start, stop). A place that is missing or 0 comes from the span of the item's article, else it is 0. An item whose articles
    meet none of the query's gold is ``wrong_retrieved``; otherwise, and where a query has no gold, it is ``retrieved``. An item
    with a node and a page is a band on that page besides, of the same class with ``_node_page``.
    """
    wanted = gold.groupBy("qid").agg(F.collect_set("article").alias("gold"))
    places = spans.select("doc", "article", F.col("start").alias("_s"), F.col("stop").alias("_e"))
    met = items.join(wanted, "qid", "left").join(places, ["doc", "article"], "left")
    start, stop = (F.when(F.col(c) != 0, F.col(c)) for c in ("start", "stop"))
    whole = start.isNotNull() & stop.isNotNull()
    start, stop = F.when(whole, start).otherwise(F.coalesce("_s", start)), F.when(whole, stop).otherwise(F.coalesce("_e", stop))
    wrong = F.col("gold").isNotNull() & ~F.arrays_overlap(F.filter(F.coalesce("articles", F.array()), lambda x: x.isNotNull()), "gold")
    kind = F.when(wrong, "wrong_retrieved").otherwise("retrieved")
    text = F.struct(F.coalesce(start, F.lit(0)).cast("bigint").alias("start"), F.when(start.isNull(), 0).otherwise(F.coalesce(stop, start)).cast("bigint").alias("stop"), F.lit(None).cast("bigint").alias("page"), kind.alias("category"))
    band = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("stop"), F.col("page").cast("bigint").alias("page"), F.concat(kind, F.lit("_node_page")).alias("category"))
    both = F.when(F.col("node").isNotNull() & F.col("page").isNotNull(), F.array(text, band)).otherwise(F.array(text))
    return met.select("qid", "doc", "region", "rank", F.explode(both).alias("r")).select("qid", "doc", "region", "rank", "r.*")
