"""Enrichment of texts within a budget of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlowe.operators.retrieve import let


def truncated(path: Column, terms: Column, digest: Column, body: Column, most: int) -> Column:
    """struct<text, step>: path, terms, summary and body while all fit ``most`` words; path, then terms, then the summary go, then the body's tail."""

    def words(c: Column) -> Column:
        return F.regexp_count(c, F.lit(r"\S+"))

    steps = [("whole", [path, terms, digest, body]), ("no_path", [terms, digest, body]), ("no_terms", [digest, body]), ("no_summary", [body])]
    out = F.struct(F.array_join(F.slice(F.split(body, r"\s+"), 1, most), " ").alias("text"), F.lit("tail").alias("step"))

    def kept(name: str, parts: list[Column], otherwise: Column) -> Column:
        text = F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])
        return let(text, lambda t: F.when(words(t) <= most, F.struct(t.alias("text"), F.lit(name).alias("step"))).otherwise(otherwise))

    for name, parts in reversed(steps):
        out = kept(name, parts, out)
    return out
