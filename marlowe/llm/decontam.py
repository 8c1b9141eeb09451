"""Benchmark decontamination: passages of a benchmark in documents, whole or with edits, by q-gram lemma filtering.

Texts are compared in lower case, each white-space character as a space. An item of n characters with k edits keeps
at least n - q + 1 - kq of its q-grams, in order, on diagonals (place in document minus place in item) that span k + 1
at most. So shared q-grams are counted in bands of diagonals, each 2w wide and overlapping the next by
half, w the largest edit budget; bands with too few are dropped, the others verified by banded alignment, many at once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.llm import common

GOLDEN = np.uint32(0x9E3779B1)
TABLE_BITS = 22
#: Pairs of equal q-grams that are counted at a time; one q-gram's may be more.
PAIRS = 1 << 20
FOUND = "doc_id BIGINT, item_id BIGINT, start BIGINT, end BIGINT, edits INT"


def normal(text: str) -> np.ndarray:
    """Code points in lower case, white space as spaces, one for each of the text's."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    x = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    return np.where((x <= 13) & (x >= 9) | (x == 0x85) | (x == 0xA0), np.uint32(32), x)


def qgrams(x: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of each q-gram, built by doubling; equal q-grams have equal hashes."""
    if x.size < q:
        return np.zeros(0, np.uint32)
    out, width, power, done = None, 1, 0x01000193, 0
    part, left = x, q
    while left:
        if left & 1:
            piece = part[done : done + x.size - q + 1]
            out = piece if out is None else out * np.uint32(power) + piece
            done += width
        left >>= 1
        if left:
            part = part[: part.size - width] * np.uint32(power) + part[width:]
            width, power = 2 * width, power * power % (1 << 32)
    return out


@dataclass
class Items:
    """A block of benchmark items, ready for the filter."""

    ids: list[int]
    texts: list[np.ndarray]
    q: int
    share: float

    def __post_init__(self):
        self.n = np.array([t.size for t in self.texts], np.int64)
        self.k = np.array([max(0, min(int(self.share * n), (n - self.q) // self.q)) for n in self.n], np.int64)
        self.need = self.n - self.q + 1 - self.k * self.q
        grams = [qgrams(t, self.q) for t in self.texts]
        hashes = np.concatenate([np.zeros(0, np.uint32), *grams])
        item = np.repeat(np.arange(len(grams)), [g.size for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(g.size) for g in grams]])
        order = np.argsort(hashes, kind="stable")
        self.gram, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.gram * GOLDEN) >> np.uint32(32 - TABLE_BITS)] = True
        self.width = int(self.k.max(initial=0)) + 1
        self.short = [(i, t) for i, t in enumerate(self.texts) if 0 < t.size < self.q]

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Rows (item, diagonal band) whose shared q-grams meet the item's bound."""
        g = qgrams(x, self.q)
        if not g.size or not self.gram.size:
            return np.zeros((0, 2), np.int64)
        at = np.flatnonzero(self.table[(g * GOLDEN) >> np.uint32(32 - TABLE_BITS)])
        k = np.searchsorted(self.gram, g[at])
        k[k == self.gram.size] = 0
        same = self.gram[k] == g[at]
        at, k = at[same], k[same]
        n, most = self.count[k], int(self.n.max())
        if not n.size:
            return np.zeros((0, 2), np.int64)
        if n.sum() <= PAIRS:
            row = np.repeat(self.first[k] - n.cumsum() + n, n) + np.arange(n.sum())
            keys = self.item[row] * (1 << 40) + (np.repeat(at, n) - self.place[row] + most) // self.width + 1
            keys, counts = np.unique(np.concatenate([keys, keys - 1]), return_counts=True)
            return self.enough(keys, counts)
        cut = np.searchsorted(n.cumsum(), np.arange(PAIRS, n.sum() + PAIRS, PAIRS))  # slices of some PAIRS equal pairs
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in zip(np.r_[0, cut[:-1] + 1], cut + 1, strict=True):
            if not (size := n[i:j]).sum():
                continue
            end = size.cumsum()
            row = np.repeat(self.first[k[i:j]] - end + size, size) + np.arange(end[-1])
            band = (np.repeat(at[i:j], size) - self.place[row] + most) // self.width
            new, times = np.unique(self.item[row] * (1 << 40) + band + 1, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
        keys, back = np.unique(np.concatenate([keys, keys - 1]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, counts])).astype(np.int64)
        return self.enough(keys, counts)

    def enough(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(item, band) of the keys item * 2**40 + band + 1 whose counts meet the item's bound."""
        item = keys >> 40
        enough = counts >= self.need[item]
        return np.stack([item[enough], keys[enough] - (item[enough] << 40) - 1], axis=1)

    def exact(self, x: np.ndarray, found: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
        """Unedited passages, which need no alignment, and the bands that hold none. A band's places of an item overlap."""
        out, rest, text = [], [], x.tobytes() if len(found) else b""
        for item, band in found.tolist():
            low = band * self.width - int(self.n.max())
            n, at = int(self.n[item]), max(0, low) * 4
            end = max(0, low + 2 * self.width - 1 + n) * 4
            at = text.find(self.texts[item].tobytes(), at, end)
            while at >= 0 and at % 4:
                at = text.find(self.texts[item].tobytes(), at + 1, end)
            if at >= 0:
                out.append((item, at // 4, at // 4 + n, 0))
            else:
                rest.append((item, band))
        return out, np.array(rest, np.int64).reshape(-1, 2)

    def find(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the passages in a document; of overlapping ones of an item the best, then first."""
        out = []
        for i, t in self.short:
            text, part = x.tobytes(), t.tobytes()
            at = text.find(part)
            while at >= 0:
                if at % 4 == 0:
                    out.append((i, at // 4, at // 4 + t.size, 0))
                at = text.find(part, at + (4 if at % 4 == 0 else 1))
        whole, found = self.exact(x, self.candidates(x))
        out += whole
        if len(found):
            out += self.verify(x, found)
        best, taken = [], {}
        for hit in sorted(out, key=lambda h: (h[3], h[1], h[2])):
            places = taken.setdefault(hit[0], [])  # ascending and apart
            i = bisect.bisect(places, (hit[1], hit[2]))
            if (i == 0 or places[i - 1][1] <= hit[1]) and (i == len(places) or hit[2] <= places[i][0]):
                places.insert(i, (hit[1], hit[2]))
                best.append(hit)
        return sorted(best, key=lambda h: (h[0], h[1]))

    def verify(self, x: np.ndarray, found: np.ndarray, at_once: int = 64) -> list[tuple[int, int, int, int]]:
        """Alignment within the band's diagonals, all candidates of a group row by row; a free start and end in the text."""
        out = []
        for part in np.array_split(found, -(-len(found) // at_once)):
            item, low = part[:, 0], part[:, 1] * self.width - int(self.n.max()) - self.width
            wide, rows = 4 * self.width + 1, int(self.n[item].max())
            c = np.arange(wide)
            far = np.int32(1 << 20)
            cost = np.zeros((len(part), wide), np.int32)
            start = low[:, None] + c
            cost[(start < 0) | (start > x.size)] = far
            top = np.full(len(part), far, np.int32)
            stop, began = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for r in range(rows):
                # cell c of row r ends at text place low + r + 1 + c
                place = low[:, None] + r + c
                live = (place >= 0) & (place < x.size)
                ch = np.array([self.texts[i][r] if r < self.n[i] else 0 for i in item], np.uint32)
                same = live & (x[np.clip(place, 0, x.size - 1)] == ch[:, None])
                across = np.where(live, cost + np.where(same, 0, 1).astype(np.int32), far)
                down = np.concatenate([cost[:, 1:] + 1, np.full((len(part), 1), far, np.int32)], axis=1)
                down_start = np.concatenate([start[:, 1:], start[:, -1:]], axis=1)
                new = np.minimum(across, down)
                new_start = np.where(across <= down, start, down_start)
                key = (new.astype(np.int64) - c) * wide + c
                reach = np.minimum.accumulate(np.where(new >= far, np.int64(1) << 40, key), axis=1)
                src = np.where(reach < np.int64(1) << 40, reach % wide, c)
                slid = np.take_along_axis(new, src, axis=1) + (c - src).astype(np.int32)
                slid = np.where(live, slid, new)  # nothing is inserted outside the text
                cost, start = np.minimum(new, slid), np.where(slid < new, np.take_along_axis(new_start, src, axis=1), new_start)
                done = np.flatnonzero(self.n[item] == r + 1)
                if done.size:
                    at = cost[done].argmin(axis=1)
                    top[done], stop[done], began[done] = cost[done, at], low[done] + r + 1 + at, start[done, at]
            for j in np.flatnonzero(top <= self.k[item]):
                out.append((int(item[j]), int(began[j]), int(stop[j]), int(top[j])))
        return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark, the stated query set, in blocks of ``chars`` characters at most (or one longer item), streamed in id order."""
    rows = common.pick(benchmark, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL").orderBy("id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r[1]) > chars:
            yield block
            block, size = [], 0
        block.append((int(r[0]), r[1]))
        size += len(r[1])
    if block:
        yield block


def finder(spark, block: list[tuple[int, str]], q: int, share: float):
    """The block's broadcast, and a function that gives its items, made once in a Python worker's task."""
    held, kept = spark.sparkContext.broadcast([(i, normal(t)) for i, t in block]), {}

    def items() -> Items:
        if "items" not in kept:
            kept["items"] = Items([i for i, _ in held.value], [t for _, t in held.value], q, share)
        return kept["items"]

    return held, items


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 10, share: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the passages of benchmark items in documents, places in code points.

    An item of n characters may have min(share n, n/q - 1) edits, at least 0; edits are single characters inserted,
    removed or changed. Items shorter than q must occur exactly, empty and null ones never do. Null and empty texts
    have no passages; texts of any length are searched whole, their equal q-grams counted in slices. Repeated rows give
    repeated results; a document gives one row for each item and place, and of overlapping places of an item the one
    with the fewest edits, then the first. Other columns are left out. Empty tables give an empty one.

    The benchmark goes to the executors in blocks of ``block_chars`` characters, some 40 bytes each. If there are several,
    each is a pass over the documents whose passages are written to the shared folder before the next block is sent, so
    that one block is in memory at a time.
    """
    spark, rows = docs.sparkSession, common.pick(docs, doc_id=id_col, text=text_col)
    rows, folder, out = rows.withColumn("doc_id", F.col("doc_id").cast("bigint")), common.fresh_dir(spark, "leaks"), None
    blocks = blocks_of(benchmark, item_col, item_text_col, block_chars)
    block, after = next(blocks, None), next(blocks, None)
    several = after is not None
    while block:
        held, items = finder(spark, block, q, share)

        def run(batches, items=items):
            for batch in common.slices(batches):
                got = [(d, items().ids[i], a, b, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i, a, b, e in items().find(normal(t))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], kinds[c]) for c in range(5)], names=["doc_id", "item_id", "start", "end", "edits"])

        out = rows.mapInArrow(run, FOUND)
        if several:
            out.write.mode("append").parquet(folder)
            held.destroy()
        block, after = after, next(blocks, None)
    return spark.createDataFrame([], FOUND) if out is None else spark.read.schema(FOUND).parquet(folder) if several else out


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 10, share: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` without any passage of the benchmark, as ``leaks`` finds them, with their own columns.

    Each row is judged by its own text, so ids don't matter and nothing is shuffled; null and empty texts stay, repeated
    rows stay or go together. A benchmark of one block is one pass. For one of several the texts' digests with passages
    are gathered block by block, as ``leaks`` does, and their rows left out by a join.
    """
    spark, names, plain = docs.sparkSession, docs.columns, docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    at = ([i for i, n in enumerate(names) if n == text_col] or [i for i, n in enumerate(names) if n.lower() == text_col.lower()])[0]
    blocks = blocks_of(benchmark, item_col, item_text_col, block_chars)
    block, after = next(blocks, None), next(blocks, None)
    if block and not after:
        _, items = finder(spark, block, q, share)

        def run(batches):
            for batch in common.slices(batches):
                yield batch.filter(pa.array([not t or not items().find(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        return plain.mapInArrow(run, plain.schema).toDF(*names)
    folder, texts = common.fresh_dir(spark, "leaking"), plain.select(F.sha2(f"_{at}", 256).alias("digest"), F.col(f"_{at}").alias("text"))
    while block:
        held, items = finder(spark, block, q, share)

        def marked(batches, items=items):
            for batch in common.slices(batches):
                hit = pa.array([bool(t) and bool(items().find(normal(t))) for t in batch.column(1).to_pylist()], pa.bool_())
                yield batch.select([0]).filter(hit)

        texts.mapInArrow(marked, "digest STRING").write.mode("append").parquet(folder)
        held.destroy()
        block, after = after, next(blocks, None)
        if not block:
            gone = spark.read.schema("digest STRING").parquet(folder).distinct()
            plain = plain.withColumn("digest", F.sha2(f"_{at}", 256)).join(gone, "digest", "left_anti").drop("digest")
    return plain.toDF(*names)
