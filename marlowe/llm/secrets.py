"""Secret scans in DataFrame operations only: known shapes, and windows of high Shannon entropy.

Spark's functions give a pattern's matches but not their places. Splitting the text at the same pattern gives what
lies between, and running lengths of both give the places. Patterns run only where a cheap test says they can match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlowe.llm import common

#: Fixed values of the contract; access and hex with their least length, which finds the same maximal runs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_TEST = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]


@dataclass(frozen=True)
class Entropy:
    """candidate: runs to look at. Windows of ``width`` characters slide over them; a run is a finding if a window's
    entropy in bits reaches the least of its class, the first whose pattern the whole run matches. allowed: patterns
    of harmless runs, which are suppressed. A run starts at the window's width; "=" ends it but for padding, so that a
    key glued to a name by it is judged by its own characters. Patterns repeat no group, as Java's recurse there."""

    width: int = 20
    candidate: str = r"[A-Za-z0-9+/_-]{20,}={0,2}"
    classes: tuple[tuple[str, str, float], ...] = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("base32", r"^[A-Z2-7=]+$", 3.5), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))
    allowed: tuple[str, ...] = field(default=(r"^[A-Za-z]+$", r"^[a-z_/-]+$", r"^[0-9_/=+-]+$", r"(?i)example|placeholder|xxxx|changeme|lorem", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, combine, zero: Column, piece: int = 128) -> Column:
    """An array's running totals, for an associative ``combine``; array<bigint>.

    Appending copies an array, so pieces of ``piece`` numbers are summed, the few sums are run through, and each piece goes on from its own start.
    """
    none = F.array().cast("array<bigint>")

    def fold(some: Column, start: Column) -> Column:
        state = F.struct(start.alias("now"), none.alias("past"))
        return F.aggregate(some, state, lambda acc, x: let(combine(acc["now"], x), lambda n: F.struct(n.alias("now"), F.concat(acc["past"], F.array(n)).alias("past"))), lambda acc: acc["past"])

    def pieces(all_: Column) -> Column:
        at = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(piece))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(at, lambda k: F.slice(all_, k, F.lit(piece))), lambda parts: let(F.concat(F.array(zero), fold(F.transform(parts, lambda p: F.aggregate(p, zero, combine)), zero)), lambda starts: F.flatten(F.transform(parts, lambda p, i: fold(p, F.get(starts, i))))))

    return let(numbers, pieces)


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of a pattern's leftmost non-overlapping matches; code points, end exclusive."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("bigint"))

    def with_ends(hits: Column) -> Column:
        ends = running(F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: g + F.char_length(h)), lambda x, y: x + y, F.lit(0).cast("bigint"))
        return F.zip_with(hits, ends, lambda h, e: F.struct((e - F.char_length(h)).cast("int").alias("start"), e.cast("int").alias("end"), h.alias("hit")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_ends)


def highest_entropy(run: Column, width: int) -> Column:
    """The largest Shannon entropy, in bits, of the windows of ``width`` characters of a run at least that long.

    H = log2(w) - S/w, where S sums n log2 n over the window's character counts n. The counts are kept: sliding by one
    takes one from that of the character that goes, adds one to that of the one that comes, and changes S by their terms.
    """
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])

    def of_codes(codes: Column) -> Column:
        first = F.slice(codes, 1, width)
        counts = F.transform(F.sequence(F.lit(1).cast("bigint"), F.array_max(codes)), lambda c: F.size(F.filter(first, lambda x: x == c)))
        start = let(counts, lambda held: let(F.aggregate(held, F.lit(0.0), lambda s, n: s + F.get(terms, n)), lambda s: F.struct(held.alias("counts"), s.alias("s"), s.alias("least"))))

        def slide(acc, x):
            gone, come = x["gone"], x["come"]
            a, b = F.get(acc["counts"], (gone - 1).cast("int")), F.get(acc["counts"], (come - 1).cast("int"))
            counts = F.transform(acc["counts"], lambda n, i: n + F.when(i + 1 == come, 1).when(i + 1 == gone, -1).otherwise(0))
            s = acc["s"] - F.get(terms, a) + F.get(terms, a - 1) - F.get(terms, b) + F.get(terms, b + 1)
            return F.when(gone == come, acc).otherwise(let(s, lambda t: F.struct(counts.alias("counts"), t.alias("s"), F.least(acc["least"], t).alias("least"))))

        steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - width), F.slice(codes, F.lit(width + 1), F.size(codes)), lambda g, c: F.struct(g.alias("gone"), c.alias("come")))
        return F.log2(F.lit(float(width))) - F.aggregate(steps, start, slide, lambda acc: acc["least"]) / width

    codes = let(F.split(run, ""), lambda chars: let(F.array_distinct(chars), lambda letters: F.transform(chars, lambda ch: F.array_position(letters, ch))))
    return let(codes, of_codes)


def spans_of(text: Column, rules: Entropy = Entropy()) -> Column:
    """array<struct<start, kind, end>>, kind a position in KINDS, by start and kind; null text has none."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def found(test: str, pattern: str, kind: int, keep=None) -> Column:
        got = places(text, pattern)
        got = F.filter(got, keep) if keep else got
        got = F.transform(got, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
        return F.when(text.rlike(test), got).otherwise(none)

    def long_enough(x):
        return F.char_length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6

    def secretive(x):
        run = x["hit"]
        harmless = F.lit(False)
        for p in rules.allowed:
            harmless = harmless | run.rlike(p)
        bound = F.lit(99.0)
        for _, p, least in reversed(rules.classes):
            bound = F.when(run.rlike(p), F.lit(least)).otherwise(bound)
        return F.when(harmless, F.lit(False)).otherwise(F.round(highest_entropy(run, rules.width), 9) >= bound)

    parts = [found(ASSIGN_TEST, ASSIGN, 0, long_enough), found(ACCESS, ACCESS, 1), found(HEX, HEX, 2), found(rules.candidate, rules.candidate, 3, secretive)]
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Entropy = Entropy()) -> DataFrame:
    """(id, found) for every row, found an array of (start, kind, end) in code points, as ``spans_of`` gives them.

    Null and empty texts have none. A text of any length, with runs of any length and any number of matches, is scanned
    whole, in time in proportion to its length (running totals come in pieces of 128). Repeated rows are scanned alike;
    other columns are left out, whatever their names. An empty table gives an empty one.
    The entropy kind adds to the known shapes and never takes one away; allow-lists hold for it alone.
    """
    rows = common.pick(docs, id=id_col, text=text_col)
    return rows.select("id", spans_of(F.coalesce("text", F.lit("")), rules).alias("found"))


def joined(found: Column, base_only: bool = False) -> Column:
    """kind:start:end, comma-joined."""
    some = F.filter(found, lambda x: x["kind"] < 3) if base_only else found
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def redact(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced by ``mask``; overlapping spans are merged. Null stays null."""

    def rebuilt(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: x["end"].cast("bigint")), lambda x, y: F.greatest(x, y), F.lit(0).cast("bigint"))
        return let(F.split(text, ""), lambda chars: let(F.concat(F.array(F.lit(0).cast("bigint")), reach), lambda from_: F.concat(F.array_join(F.zip_with(spans, F.slice(from_, F.lit(1), F.size(spans)), lambda x, at: F.when(x["start"] >= at, F.concat(F.array_join(F.slice(chars, at.cast("int") + 1, (x["start"] - at).cast("int")), ""), F.lit(mask))).otherwise("")), ""), F.array_join(F.slice(chars, F.element_at(from_, -1).cast("int") + 1, F.size(chars)), ""))))

    return F.when(F.size(found) > 0, let(found, rebuilt)).otherwise(text)
