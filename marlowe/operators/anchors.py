"""Token ranges of articles in a law's text, found by the articles' first characters."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators.chunking import WORD

ANCHOR = 100


class Squeezed:
    """A text with each run of white space as one space and none at its ends, and the places that its characters come to."""

    def __init__(self, text: str):
        parts = text.split()
        self.text, self.raw, self.new, at, new = " ".join(parts), [], [], 0, 0
        for p in parts:
            at = text.index(p, at)
            self.raw.append(at)
            self.new.append(new)
            at, new = at + len(p), new + len(p) + 1

    def place(self, at: int) -> int:
        """Where the rest of the text from ``at`` on starts."""
        i = bisect_left(self.raw, at + 1) - 1  # the word that starts at or before it
        if i >= 0 and at - self.raw[i] < (self.new[i + 1] - 1 if i + 1 < len(self.new) else len(self.text)) - self.new[i]:
            return self.new[i] + at - self.raw[i]
        return self.new[i + 1] if i + 1 < len(self.new) else len(self.text)


def places(text: str, anchors: Iterable[tuple[str, int]]) -> list[int]:
    """Where each anchor lies, searched from the end of the last article found (anchor and length of the article); -1 where it doesn't.

    An anchor that isn't there is sought with white space squeezed on both sides; its place is then the search's start
    and its distance in the squeezed rest. The text is squeezed once, however many anchors are missing.
    """
    out, start, loose = [], 0, None
    for anchor, size in anchors:
        at = text.find(anchor, start)
        if at < 0:
            loose = loose or Squeezed(text)
            base = loose.place(start)
            at = loose.text.find(" ".join(anchor.split()), base)
            at = start + at - base if at >= 0 else -1
        out.append(at)
        if at >= 0:
            start = at + size
    return out


def token_ranges(texts: DataFrame, articles: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, article, at, start_token, end_token) of texts (doc, text) and articles (doc, pos, article, text), in the order of pos and article.

    An article begins after as many tokens as the text before it has, and is as long as its own text; what isn't found
    has no row. Null texts have no articles and null articles are none; an empty one lies where the search stands.
    Documents are unique. Of an article only its first hundred characters, length and number of tokens are shuffled; a
    document's search goes forward through its one text, so it is one task's, the documents spread over all.
    """
    brief = articles.where("text IS NOT NULL").select(doc, F.struct("pos", "article", F.substring("text", 1, ANCHOR).alias("anchor"), F.char_length("text").alias("size"), F.size(tx.tokens(F.col("text"))).alias("n")).alias("_a"))
    held = texts.where("text IS NOT NULL").join(brief.groupBy(doc).agg(F.array_sort(F.collect_list("_a")).alias("_as")), doc)

    @F.pandas_udf("array<struct<at:int,token:int>>")
    def find(texts: pd.Series, anchors: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for text, a, s in zip(texts, anchors, sizes, strict=True):
            starts = [m.start() for m in WORD.finditer(text)]
            out.append([{"at": at, "token": bisect_left(starts, at)} if at >= 0 else {"at": None, "token": None} for at in places(text, zip(a, map(int, s), strict=True))])
        return pd.Series(out)

    found = held.withColumn("_f", find(F.col("text"), F.transform("_as", lambda a: a["anchor"]), F.transform("_as", lambda a: a["size"])))
    rows = found.select(doc, F.explode(F.arrays_zip(F.col("_as").alias("a"), F.col("_f").alias("f"))).alias("_x")).where("_x.f.at IS NOT NULL")
    return rows.select(doc, F.col("_x.a.article").alias("article"), F.col("_x.f.at").alias("at"), F.col("_x.f.token").alias("start_token"), (F.col("_x.f.token") + F.col("_x.a.n")).alias("end_token"))
