"""First sentences as columns: by full stops that no abbreviation explains, as a summary line, and by the first mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a full stop that ends no sentence, and the capitals that may begin one.
ABBREVIATIONS = ["art", "al", "cf", "ibid", "op", "cit", "loc", "no", "n°", "vol", "p", "pp", "fig", "tab", "dr", "me", "mme", "mm", "jr", "sr", "etc", "env", "approx", "sect", "par", "§"]
CAPITALS = "A-ZÀÂÉÈÊËÎÏÔÙÛÜ"
#: A summary line's bounds in characters.
LEAST, MOST = 80, 240


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def legal(text: Column) -> Column:
    """Up to the first full stop that white space and a capital follow and no abbreviation precedes; without one, the whole text. Null counts as empty."""
    whole = stripped(F.coalesce(text, F.lit("")))
    word = rf"(?<!(?:^|\s)(?iu:{'|'.join(ABBREVIATIONS)})\.{{0,9}})"
    found = F.regexp_extract(whole, rf"(?sU)^(.*?{word}\.)\s+[{CAPITALS}]", 1)
    return F.when(found != "", found).otherwise(whole)


def summary(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Sentences until there are ``least`` characters, white space as single spaces; what is over ``most`` is cut at a word and ends in an ellipsis. Null counts as empty."""
    line = F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    parts = F.split(line, r"(?<=[.!?]) (?=[A-ZÀ-Ý])")
    head = F.aggregate(parts, F.lit(""), lambda h, p: F.when(h == "", p).when(F.char_length(h) < least, F.concat(h, F.lit(" "), p)).otherwise(h))
    return F.when(F.char_length(head) > most, F.concat(F.regexp_replace(F.substring(head, 1, most), " [^ ]*$", ""), F.lit("…"))).otherwise(head)


def naive(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark, whatever it stands for; the whole text without one. Null counts as empty."""
    return stripped(F.regexp_extract(F.coalesce(text, F.lit("")), "^[^.!?]*[.!?]?", 0))
