"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints within ``max_bits`` of each other are found so. The 64 bits are split into m partitions, correlated bits
together. If thresholds t_1..t_m sum to max_bits - m + 1, any two fingerprints within max_bits differ in at most t_i
bits of some partition i; -1 leaves a partition out. For each m, dynamic programming allots the thresholds at the least
estimated cost (bucket rows and candidate pairs), from counts over all fingerprints; the cheapest m is used. Any choice
is exact. A partition with t = 0 makes one bucket key, its bits; one with t = 1 makes a key for each of its bits, the
others' values. Fingerprints are compared within buckets, and only as many links as hold a bucket together are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.llm import common

BITS = 64
#: Cost of a bucket row that is shuffled, in compared pairs.
ROW = 50.0


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text, A-Z in lower case; a shorter text is one shingle, no word none."""
    got = text.encode().lower().split() if text else []  # bytes.split() takes space and 9 to 13, lower() A-Z
    if not got:
        return np.zeros(0, np.uint64)
    if len(got) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(got), 42)], np.uint64)
    line = b" ".join(got)
    end = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    start = (np.r_[0, end[:-1] + 1])[: len(got) - words + 1].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter([one(line[a:b], 42) for a, b in zip(start, end[words - 1 :].tolist(), strict=True)], np.uint64, len(start))


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """Bit b is 1 if over half of the hashes have it; as a signed 64-bit number. 0 without hashes."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, h.size, 255):  # 255 bytes can't overflow
        lanes = np.unpackbits(h[i : i + 255].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        total += lanes.sum(axis=0).view(np.uint8)
    return int(np.packbits(total * 2 > h.size, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", words: int = 3) -> DataFrame:
    """Appends fp (a signed 64-bit fingerprint) to every row; null and empty texts have 0. Other columns pass through."""
    if any(c.lower() == "fp" for c in docs.columns):
        raise ValueError("the input already has fp")
    return common.per_text(docs, text_col, [("fp", T.LongType())], lambda texts: [pa.array([fingerprint(t, words) for t in texts], pa.int64())])


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_occurrence(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many have both bit i and bit j; a row of sums leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = bit_matrix(batch.column(0).to_numpy()).astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.r_[both.ravel(), n].astype(np.int64))], names=["at", "n"])

    rows = distinct.select("fp").mapInArrow(run, "at INT, n BIGINT").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size: each starts from the first bit left over and takes the bits most correlated with it."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (round(float(phi[b, group].mean()), 6), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


@dataclass
class Plan:
    groups: list[list[int]]
    thresholds: list[int]
    cost: float

    def masks(self) -> list[int]:
        """One mask for each bucket key."""
        keys = []
        for bits, t in zip(self.groups, self.thresholds, strict=True):
            keys += [mask_of(bits)] if t == 0 else [mask_of([x for x in bits if x != b]) for b in bits] if t == 1 else []
        return keys


def allot(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (keys of the dicts) with the given sum at the least cost, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in options.items():
                if s + t not in after or c + more < after[s + t][0]:
                    after[s + t] = (c + more, [*chosen, t])
        best = after
    return best.get(total, (float("inf"), []))


def plan(distinct: DataFrame, max_bits: int, most_parts: int = 5) -> Plan:
    """The cheapest partitions and thresholds for these fingerprints.

    Pairs that agree in a partition are counted exactly over all rows. Those within one bit of each other there are
    estimated from that count and the bits' marginal rates.
    """
    n, both = co_occurrence(distinct)
    p = np.diag(both) / max(1, n)
    apart = 2 * p * (1 - p)
    layouts = {m: correlated_groups(n, both, m) for m in range(max(1, (max_bits + 2) // 2), max(most_parts, max_bits + 1) + 1)}
    masks = [(m, i, mask_of(g)) for m, groups in layouts.items() for i, g in enumerate(groups)]
    keys = F.explode(F.array(*[F.struct(F.lit(m * 100 + i).alias("part"), F.col("fp").bitwiseAND(F.lit(x)).alias("value")) for m, i, x in masks])).alias("k")
    same = distinct.select(keys).select("k.*").groupBy("part", "value").count().groupBy("part").agg(F.sum(F.expr("CAST(count AS DOUBLE) * (count - 1) / 2")).alias("pairs"))
    pairs = {r["part"]: r["pairs"] for r in same.collect()}  # a row for each partition
    plans = []
    for m, groups in layouts.items():
        costs = []
        for i, g in enumerate(groups):
            zero = pairs.get(m * 100 + i, 0.0)
            odds = float(np.sum(apart[g] / np.maximum(1 - apart[g], 1e-9)))
            costs.append({-1: 0.0, 0: ROW * n + zero, 1: ROW * n * len(g) + zero * (len(g) + odds)})
        cost, chosen = allot(costs, max_bits - m + 1)
        plans.append(Plan(groups, chosen, cost))
    return min((x for x in plans if x.thresholds), key=lambda x: x.cost)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits. Of signed numbers numpy counts the absolute value's bits, so they count as unsigned."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning(values: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever values within max_bits of each other connect: breadth first over those not yet reached."""
    out, rest = [], values
    while rest.size > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and rest.size:
            v = frontier.pop()
            near = apart(rest, v) <= max_bits
            if near.any():
                found = rest[near]
                out.append((np.full(found.size, v, np.int64), found))
                frontier.extend(found)
                rest = rest[~near]
    return out


def compare(max_bits: int, small: int = 12):
    """A mapInArrow function over rows sorted by (key, value, block): links within each run of equal keys."""

    def links(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """group: the run that each row is in, ascending."""
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), group.size])
        each = np.repeat(size, size)
        few_at = each <= small
        g, f, found = group[few_at], fps[few_at], []
        for d in range(1, small):
            if g.size <= d:
                break
            near = np.flatnonzero((g[d:] == g[:-d]) & (apart(f[d:], f[:-d]) <= max_bits))
            found.append((f[near], f[near + d]))
        big, values = group[~few_at], fps[~few_at]
        for run in np.split(values, np.flatnonzero(big[1:] != big[:-1]) + 1) if big.size else []:
            found += spanning(np.unique(run), max_bits)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.array([c.to_numpy() for c in batch.columns], np.int64)], axis=1)
            new = (held[:4, 1:] != held[:4, :-1]).any(axis=0)
            last = np.flatnonzero(new)[-1] + 1 if new.any() else 0  # the last run may go on
            if last:
                a, b = links(np.r_[0, new[: last - 1].cumsum()], held[4, :last])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held = held[:, last:]
        if held.shape[1] > 1:
            a, b = links(np.zeros(held.shape[1], np.int64), held[4])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_links(distinct: DataFrame, max_bits: int = 3, block: int = 1024) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints that links within max_bits connect.

    Buckets of over ``block`` rows are split by a hash; each pair of blocks is a task's group of its own, so no group
    holds over two blocks however large a bucket is.
    """
    chosen = plan(distinct, max_bits)
    masks = chosen.masks()
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])).alias("k")
    keyed = distinct.select("fp", keys).select("k.*", "fp")
    crowd = keyed.groupBy("slot", "value").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block))
    placed = keyed.join(crowd, ["slot", "value"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    paired = placed.select("slot", "value", "own", "fp", other).select("slot", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    dealt = paired.repartition("slot", "value", "low", "high").sortWithinPartitions("slot", "value", "low", "high")
    return dealt.mapInArrow(compare(max_bits), "a BIGINT, b BIGINT").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of ``links`` reaches, by alternating large and small stars.

    Rounds are logarithmic in the size of a component; each ends in a checkpoint. Nodes without links are left out.
    """
    edges = common.cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = common.cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max(F.col("v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, mark (a hash of the text), fp, root and component_id for every row."""
    texts = common.pick(docs, doc_id=id_col, text=text_col).withColumn("mark", F.xxhash64("text"))
    rows = common.cut(fingerprints(texts, words=words).select("doc_id", "mark", "fp"))
    distinct = common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct, max_bits, block)).withColumnRenamed("node", "fp")
    known = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(first, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, fp, component_id for every row: the least id that links of at most ``max_bits`` bits reach, itself included.

    Null and empty texts have fingerprint 0 and link like any other; texts of any length count whole. Repeated rows stay
    and share their component; null ids get their component's least id, or null if it has none. Other columns are left
    out, whatever their names; an empty table gives an empty one. Copies share a fingerprint and never meet as pairs:
    links are between distinct fingerprints only.
    """
    return linked(docs, id_col=id_col, text_col=text_col, words=words, max_bits=max_bits, block=block).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_bits: int = 3, similarity: tuple[int, int] | None = (4, 5), most_broadcast: int = 1_000_000, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, one of each, with their own columns.

    That is the row of the least id, of the least text hash if the id stands on several texts; null ids come last. Rows
    go by id and text, so an id whose other text is a copy stays with this one.

    Without ``similarity`` (a numerator and a denominator) groups are what links of at most ``max_bits`` bits connect.
    With it, fingerprints only propose: their links and those of ``jaccard``'s prefix filter, which misses no pair, are
    verified on the sets of shingles, and groups are what pairs of at least that Jaccard similarity connect. What goes is
    broadcast if it has ``most_broadcast`` rows (some 16 MB) at most, else joined by a shuffle.
    """
    from marlowe.llm import jaccard  # it builds on this module

    if similarity:
        found = jaccard.near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, max_bits=max_bits, least=similarity, most_broadcast=most_broadcast, **options)
    else:
        found = linked(docs, id_col=id_col, text_col=text_col, words=words, max_bits=max_bits, **options).select("doc_id", "mark", "root")
    found = common.cut(found)
    kinds = found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = kinds.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.struct(F.col("mark").isNull(), "mark").alias("mark"))).alias("first"))
    judged = common.cut(kinds.join(first, "root").select("doc_id", "mark", "n", (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & F.col("first.mark.mark").eqNullSafe(F.col("mark"))).alias("stays")))
    gone = judged.where("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    twice = judged.where("stays AND n > 1").limit(1).count() > 0
    names = docs.columns
    at = {c: f"_{next(i for same in (lambda x: x == c, lambda x: x.lower() == c.lower()) for i, x in enumerate(names) if same(x))}" for c in (id_col, text_col)}  # noqa: B023
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))]).withColumn("mark", F.xxhash64(at[text_col]))
    gone = F.broadcast(gone) if gone.count() <= most_broadcast else gone
    left = plain.join(gone, F.col(at[id_col]).eqNullSafe(F.col("gone_id")) & F.col("mark").eqNullSafe(F.col("gone_mark")), "left_anti")
    if twice:
        left = left.dropDuplicates([at[id_col], "mark"])
    return left.drop("mark").toDF(*names)
