"""Text expressions: tokenisers, normalisers and token-set measures, as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of a token, and the function words that the store tokeniser leaves out.
TOKEN = "[a-zA-Z0-9àâäãæçéèêëîïíìôöóòœùûüúñýÿÀÂÄÃÆÇÉÈÊËÎÏÍÌÔÖÓÒŒÙÛÜÚÑÝŸ]+"
FUNCTION_WORDS = """le la les de du des un une et en au aux à a ce ces cet cette qui que qu se sa son ses il elle ils elles
y ou où est sont par sur sous dans avec pour plus mais donc ni car ne pas non tout tous même aussi""".split()
KEPT_WORDS = ["ne", "pas", "non", "sauf", "sans", "ni"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of token characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


#: A token's characters in UTF-8: those of one byte, and by first byte the second ones of those of two. There are no longer ones.
LETTERS = [c.encode() for c in map(chr, range(0x800)) if re.fullmatch(TOKEN, c)]
ONE_BYTE = np.isin(np.arange(256), [c[0] for c in LETTERS if len(c) == 1])
TWO_BYTES = {x: np.isin(np.arange(256), [c[1] for c in LETTERS if len(c) == 2 and c[0] == x]) for x in sorted({c[0] for c in LETTERS if len(c) == 2})}


def token_lists(lowered: pa.Array) -> pa.ListArray:
    """What ``tokens`` gives for texts that are in lower case already, for use in a task; a null text has an empty list."""
    lowered = pc.fill_null(lowered, "") if lowered.null_count else lowered
    width = np.int64 if pa.types.is_large_string(lowered.type) else np.int32
    ends = np.frombuffer(lowered.buffers()[1] or bytes(8), width)[lowered.offset : lowered.offset + len(lowered) + 1].astype(np.int64)
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = ONE_BYTE.take(data)
    for first, second in TWO_BYTES.items():
        at = np.flatnonzero(data[:-1] == first)
        at = at[second[data[at + 1]]]
        inside[at] = inside[at + 1] = True
    starts, stops = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    starts[:-1] = stops[1:] = inside
    starts[1:-1] &= ~inside[:-1]
    stops[1:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(data))]  # a text ends a token though the next one begins with a letter
    cut = cut[inside[cut] & inside[cut - 1]]
    starts[cut] = stops[cut] = True
    first = np.flatnonzero(starts)
    places = np.concatenate([[0], np.cumsum(np.flatnonzero(stops) - first)]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends).astype(np.int32)), flat)


def store_tokens(text: Column) -> Column:
    """Split at anything but letters, digits and _, without function words; repeats stay."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*FUNCTION_WORDS))


def content_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Tokens without the stop words, of which words with legal force are kept; repeats stay."""
    drop = [w for w in (stop or FUNCTION_WORDS) if w not in KEPT_WORDS]
    return F.filter(tokens(text), lambda w: ~w.isin(*drop))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"none": tokens, "store": store_tokens, "content": content_tokens}


def tidy(text: Column) -> Column:
    """Without soft hyphens and zero-width spaces; runs of blanks as one, three or more line ends as two, trimmed."""
    bare = F.translate(text, "­​", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[ \t]+", " "), "\n{3,}", "\n\n"))


def match_key(text: Column) -> Column:
    """Lower case, trimmed, Latin-1 accents off."""
    marked, plain = "àâäãáåçéèêëîïíìñôöóòõùûüúýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(F.trim(F.lower(text)), marked, plain)


def leading_int(number: Column) -> Column:
    return F.nullif(F.regexp_extract(number, r"^\s*(\d+)", 1), F.lit("")).cast("bigint")


def first_words(text: Column, n: int, more: str = "") -> Column:
    """The first n white-space-separated words, followed by ``more`` if some were cut."""
    words = F.split(F.trim(text), r"\s+")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(more))).otherwise(F.array_join(words, " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays' sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def concat_document(*parts: Column) -> Column:
    """The non-empty parts with single spaces between."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def first_signed_number(answer: Column, low: float = 0.0, high: float = 10.0) -> Column:
    """The first number of a judge's answer, decimal comma allowed, clamped."""
    found = F.nullif(F.regexp_extract(answer, r"(-?\d+(?:[.,]\d+)?)", 1), F.lit(""))
    return F.greatest(F.lit(low), F.least(F.lit(high), F.replace(found, F.lit(","), F.lit(".")).cast("double")))


def yes_no(answer: Column) -> Column:
    """1 for an answer that starts with Oui or yes, 0 for Non or no, else null."""
    word = F.lower(F.regexp_extract(answer, r"^\W*(\w+)", 1))
    return F.when(word.isin("oui", "yes"), 1).when(word.isin("non", "no"), 0)


@F.pandas_udf(T.StringType())
def folded_key(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case, trimmed; null stays null."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().strip())


def cross_references(text: Column) -> Column:
    """Numbers of cited articles by both of the loader's patterns, distinct and sorted."""
    first, second = r"(?i)(?:article|art\.?)\s+([D.]?\s*\d+(?:\.\d+)?)", r"(?i)(?:visé|prévu|conformément)\s+(?:à|par)\s+(?:l['’])?article\s+([D.]?\s*\d+)"
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (first, second)])
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(x))))


def prefixed(text: Column, prefix: str) -> Column:
    """The text after an encoder's prefix; null counts as empty."""
    return F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))


def fts_query(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct terms in order, function words left out unless nothing else is there, joined by OR."""
    terms = F.array_distinct(tokens(text))
    kept = F.filter(terms, lambda w: ~w.isin(*(stop or FUNCTION_WORDS)))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(terms), " OR ")


def lemmas(rows: DataFrame, forms: DataFrame, id_col: str, text_col: str, stop: list[str] | None = None) -> DataFrame:
    """(id, lemmas): a row's tokens in order, each as its lemma by the dictionary (term, lemma), function words left out. Ids are unique."""
    each = rows.select(id_col, F.posexplode_outer(tokens(F.col(text_col))).alias("at", "term")).join(forms, "term", "left")
    word = F.coalesce("lemma", "term")
    kept = F.when(~word.isin(*(stop or FUNCTION_WORDS)), F.struct("at", word.alias("w")))
    return each.groupBy(id_col).agg(F.array_sort(F.collect_list(kept)).alias("x")).select(id_col, F.transform("x", lambda x: x["w"]).alias("lemmas"))
