"""Chunks by token budgets, as table functions: each gives a text's chunks with their places in characters and tokens.

What is counted is a function of a text, so a model's tokenizer can be the measure; words of ``functions.text`` are by default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.functions import text as tx

CHUNK = "chunk INT, text STRING, start_char INT, end_char INT, start_token INT, end_token INT"
BLANK_LINES, AFTER_SENTENCE = re.compile(r"\n\n+"), re.compile(r"(?<=[.!?])\s+")
WORD = re.compile(tx.TOKEN)

Span = tuple[int, int]


def count_words(text: str) -> int:
    return sum(1 for _ in WORD.finditer(text))


def paragraphs(text: str) -> list[Span]:
    """What lies between blank lines, if it isn't all white space."""
    edges = [0, *[x for m in BLANK_LINES.finditer(text) for x in m.span()], len(text)]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if text[a:b].strip()]


def sentences(text: str, start: int, end: int) -> list[Span]:
    """The sentences of a part of a text, the white space after each included: together they are the part."""
    ends = [m.end() for m in AFTER_SENTENCE.finditer(text[start:end])]
    edges = [start, *[start + e for e in ends if e < end - start], end]
    return list(zip(edges, edges[1:])) if start < end else []


def runs(spans: list[Span], fits: Callable[[list[Span]], bool]) -> Iterator[list[Span]]:
    """Spans from left to right in runs that fit; one that doesn't fit by itself is a run alone."""
    run: list[Span] = []
    for s in spans:
        if run and not fits([*run, s]):
            yield run
            run = []
        run.append(s)
    if run:
        yield run


def sentence_runs(text: str, start: int, end: int, most: int, count: Callable[[str], int]) -> Iterator[Span]:
    for run in runs(sentences(text, start, end), lambda r: count(text[r[0][0] : r[-1][1]]) <= most):
        yield run[0][0], run[-1][1]


def recursive(text: str, most: int, count: Callable[[str], int]) -> Iterator[tuple[str, int, int]]:
    """(text, start, end): paragraphs together while their tokens fit, joined by a blank line; one of more tokens as runs of its sentences."""
    sizes = {s: count(text[slice(*s)]) for s in paragraphs(text)}
    for run in runs(list(sizes), lambda r: sum(sizes[s] for s in r) <= most):
        if sizes[run[0]] > most:
            yield from ((text[a:b], a, b) for a, b in sentence_runs(text, *run[0], most, count))
        else:
            yield "\n\n".join(text[slice(*s)] for s in run), run[0][0], run[-1][1]


def numbered(parts: Iterator[tuple[str, int, int]], count: Callable[[str], int]) -> Iterator[tuple]:
    """Rows of CHUNK: texts trimmed, empty ones left out, tokens counted on from chunk to chunk."""
    chunk = at = 0
    for text, start, end in parts:
        if kept := text.strip():
            n = count(kept)
            yield chunk, kept, start, end, at, at + n
            chunk, at = chunk + 1, at + n


def chunker(kind: str, count: Callable[[str], int] = count_words):
    """A table function of (text, most): ``recursive`` chunks or runs of ``sentences``. A null text has no rows."""

    class Chunks:
        def eval(self, text: str, most: int):
            if text:
                parts = recursive(text, most, count) if kind == "recursive" else ((text[a:b], a, b) for a, b in sentence_runs(text, 0, len(text), most, count))
                yield from numbered(parts, count)

    return F.udtf(Chunks, returnType=CHUNK)


def chunks(docs: DataFrame, kind: str, most: int, *, id_col: str = "doc_id", text_col: str = "text", count: Callable[[str], int] = count_words) -> DataFrame:
    """(id, CHUNK's columns) of every text; a text is cut by itself, so nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cut = chunker(kind, count)(F.col("_text").outer(), F.lit(most))
    return rows.lateralJoin(cut).select(F.col("_id").alias(id_col), *[c.split()[0] for c in CHUNK.split(", ")])
