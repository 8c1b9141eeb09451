"""Exact top-k inner products from an impact-ordered index, a score at a time.

The index is a table of shards of some thousand vectors. In a shard every dimension has its postings in the order of
their quantised components; equal ones are a segment. A query's impacts are its own component times a segment's bound, so
segments come by descending impact from the high end of a dimension where the query is positive, from the low end where it
is negative. All dimensions go down to one impact at a time. A vector not yet met in a dimension can't gain more there than
that impact, or than the dimension's highest if it is less; with what it has gathered this bounds its score. A shard is done
when few vectors' bounds reach the k-th best exact score known; those are rescored on their exact components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlowe.llm import common

SHARD = "shard BIGINT, n INT, dims INT, wide BOOLEAN, ids BINARY, has_id BINARY, exact BINARY, order BINARY, segments BINARY, lows BINARY, ends BINARY, steps BINARY, asked BINARY"
#: Levels that a dimension's components are quantised to.
LEVELS = 128
#: Impacts down to which all segments are processed before bounds are looked at, in parts of a middling product; None is the end.
STOPS = (0.5, 0.0, -0.25, -0.5, -1.0, -2.0, -4.0, None)
LONG = 2**63 - 1


def most_exact(dims: int) -> int:
    """Components from this on might take sums of products, and the count kept beside them, beyond 64 bits; Python's integers score such."""
    return 2 ** max(1, (61 - 2 * dims.bit_length()) // 2)


def integers(vectors: list[list[float] | None], scale: int) -> tuple[list[int], np.ndarray, bool]:
    """The places of the vectors that take part, their components as floor(scale * x), shorter ones filled with 0, and whether some are too large for 64-bit sums."""
    at = [i for i, v in enumerate(vectors) if v is not None and not any(x is None for x in v) and np.isfinite(np.asarray(v, np.float64)).all()]
    dims = max((len(vectors[i]) for i in at), default=0)
    values = np.zeros((len(at), dims))
    for k, i in enumerate(at):
        values[k, : len(vectors[i])] = vectors[i]
    values = np.floor(values * scale)
    wide = bool(values.size) and np.abs(values).max() >= most_exact(dims)
    return at, values, wide


def build(vectors: DataFrame, folder: str, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, every: int = 100, rows: int = 8192) -> DataFrame:
    """Writes the index to ``folder`` and returns it: a row for each shard of ``rows`` vectors at most.

    Its vectors whose id ``every`` divides are the queries. Null vectors and those with a null or a component that isn't finite are left out.
    """
    plain = common.pick(vectors, id=id_col, vector=vector_col).withColumn("id", F.col("id").cast("bigint")).withColumn("vector", F.col("vector").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, rows):
            at, values, wide = integers(batch.column(1).to_pylist(), scale)
            ids = [batch.column(0)[i].as_py() for i in at]
            n, dims = values.shape
            if not n:
                continue
            has = np.array([i is not None for i in ids])
            exact = values.astype(np.float64 if wide else np.int32)
            step = np.maximum(1, np.ceil((values.max(0, initial=0) - values.min(0, initial=0)) / LEVELS)) if dims else np.ones(0)
            level = np.floor(values / step)
            order = np.argsort(level, axis=0, kind="stable").astype(np.uint16 if n <= 65536 else np.uint32)
            asked = np.array([i for i, x in enumerate(ids) if x is not None and x % every == 0], np.int32)
            segments, lows, ends = [], [], []  # of a segment all components lie in low .. low + step - 1
            for j in range(dims):
                found, size = np.unique(level[:, j], return_counts=True)
                segments.append(found.size)
                lows.append(found * step[j])
                ends.append(size.cumsum())
            numbers = [np.concatenate([*x, []]).astype(np.int64) if not wide else np.zeros(0, np.int64) for x in ([segments], lows, ends, [step])]
            cells = [number, n, dims, wide, np.array([x or 0 for x in ids], np.int64).tobytes(), has.tobytes(), exact.tobytes(), np.ascontiguousarray(order.T).tobytes(), *[x.tobytes() for x in numbers], asked.tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 9]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])
            number += 1

    plain.mapInArrow(run, SHARD).write.parquet(folder)
    return vectors.sparkSession.read.parquet(folder)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, the last one smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Shard:
    """A row of the index in a task."""

    def __init__(self, row: dict):
        self.number, n, d, self.wide = row["shard"], row["n"], row["dims"], row["wide"]
        self.ids, self.has = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["has_id"], bool)
        self.exact = np.frombuffer(row["exact"], np.float64 if self.wide else np.int32).reshape(n, d)
        self.order = np.frombuffer(row["order"], np.uint16 if n <= 65536 else np.uint32).reshape(d, n).astype(np.intp)
        segments, lows, ends, steps = (np.frombuffer(row[c], np.int64) for c in ("segments", "lows", "ends", "steps"))
        cuts = np.cumsum(segments)[:-1]
        self.lows, self.ends = np.split(lows, cuts), [np.append(0, x) for x in np.split(ends, cuts)]
        self.sizes = [x[1:] - x[:-1] for x in self.ends]
        self.highs = [x + s - 1 for x, s in zip(self.lows, steps, strict=False)]
        self.n, self.dims = n, d
        self.floats, self.most = self.exact.astype(np.float64), int(np.abs(self.exact).max(initial=0))
        self.middling = float(np.abs(self.exact).mean()) if self.exact.size else 0.0

    def score(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products with the vectors at ``at``; those beyond 64 bits become the nearest long."""
        d = min(self.dims, query.size)
        if self.wide or np.abs(query).max(initial=0) >= most_exact(d):
            q = [int(x) for x in query[:d]]
            sums = [sum(int(x) * y for x, y in zip(v, q, strict=True)) for v in self.exact[at, :d]]
            return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], np.int64)
        if self.most * int(np.abs(query[:d]).max(initial=0)) * d < 2**53:
            return (self.floats[at, :d] @ query[:d]).astype(np.int64)
        return self.exact[at, :d].astype(np.int64) @ query[:d].astype(np.int64)

    def best(self, query: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all vectors, but for ``own``, that may be among the k best and reach ``least``."""
        d = min(self.dims, query.size)
        if self.wide or np.abs(query).max(initial=0) >= most_exact(d) or self.n <= 8 * k or not query[:d].any():
            at = np.arange(self.n)
            return self.cut(at[at != own], query, k, least)
        q = [int(x) for x in query[:d]]
        used = [j for j in range(d) if q[j]]
        impacts = [q[j] * (self.highs[j] if q[j] > 0 else self.lows[j]) for j in used]  # by segment, ascending where q is positive
        top, bottom = np.array([max(i[0], i[-1]) for i in impacts]), min(min(int(i[0]), int(i[-1])) for i in impacts)
        # what a vector has gathered, and below it in as many bits as that takes, the dimensions it was met in
        bits = len(used).bit_length()
        gathered, left = np.zeros(self.n, np.int64), [[0, i.size] for i in impacts]
        middling = self.middling * float(np.abs(query[:d]).mean())
        for part in STOPS:
            to = bottom if part is None else max(bottom, int(part * middling))
            for j, impact, open_ in zip(used, impacts, left, strict=True):
                if q[j] > 0:
                    first, last = int(np.searchsorted(impact, to)), open_[1]
                    open_[1] = min(first, last)
                else:
                    first, last = open_[0], int(np.searchsorted(-impact, -to, side="right"))
                    open_[0] = max(first, last)
                if first < last:
                    rows = self.order[j, self.ends[j][first] : self.ends[j][last]]
                    np.add.at(gathered, rows, np.repeat((impact[first:last] << bits) + 1, self.sizes[j][first:last]))
            waiting = top < to  # dimensions not yet begun: no vector was met in them
            met = gathered & ((1 << bits) - 1)
            bound = (gathered >> bits) + to * (int((~waiting).sum()) - met) + int(top[waiting].sum())
            if own >= 0:
                bound[own] = -LONG
            if least is None:
                first = np.argpartition(-bound, 4 * k)[: 4 * k]
                least = int(np.sort(self.score(query, first[first != own]))[-k])
            may = np.flatnonzero(bound >= least)
            if may.size <= max(8 * k, self.n // 4) or to == bottom:
                break
        return self.cut(may[may != own], query, k, least)

    def cut(self, at: np.ndarray, query: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of ``at``; kept are the k best, the lesser id first among equals, null ids last, then the lesser place."""
        score = self.score(query, at)
        if least is not None:
            at, score = at[score >= least], score[score >= least]
        first = np.lexsort((at, self.ids[at], ~self.has[at], -score.astype(np.float64) if self.wide else -score))[:k]
        return at[first], score[first]


def queries_in(index: DataFrame) -> DataFrame:
    """(shard, place, query_id, q) of the vectors that the index's shards have as queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["asked"], np.int32)
                ids = np.frombuffer(row["ids"], np.int64)
                exact = np.frombuffer(row["exact"], np.float64 if row["wide"] else np.int32).reshape(row["n"], row["dims"]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * at.size, pa.int64()), pa.array(at), pa.array(ids[at]), pa.array([x.tobytes() for x in exact[at]], pa.binary())], names=["shard", "place", "query_id", "q"])

    return index.select("shard", "n", "dims", "wide", "ids", "exact", "asked").mapInArrow(run, "shard BIGINT, place INT, query_id BIGINT, q BINARY")


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024, rows: int = 8192, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, every row but its own a candidate.

    Queries go to the shards ``block`` at a time, each block one pass over the index; of a task's shards each query keeps k
    rows, which are ranked by query at the end. Nothing is left out unless a bound proves it.

    Null vectors, empty ones' components and vectors that hold a null, NaN or infinity: the last two and the first take no
    part, an empty vector scores 0 as shorter ones count as filled with 0. Null ids are candidates, after all others among
    equal scores, and no queries. A repeated id is several rows: each is a query with ranks of its own and a candidate for the
    others. Scores beyond 64 bits become the nearest long. An empty table gives no rows; other columns don't matter.
    """
    spark = vectors.sparkSession
    folder = common.fresh_dir(spark, "impacts")
    index = build(vectors, f"{folder}/shards", id_col=id_col, vector_col=vector_col, scale=scale, every=every, rows=rows)
    asked = queries_in(index).withColumn("number", F.monotonically_increasing_id())
    asked.write.parquet(f"{folder}/queries")
    asked = spark.read.parquet(f"{folder}/queries")
    fields = "shard BIGINT, place INT, query_id BIGINT, vec_id BIGINT, v_shard BIGINT, v_place INT, score BIGINT"
    out = spark.createDataFrame([], fields)
    for i, some in enumerate(blocks(asked, block)):
        out = out.unionByName(search(index, some, k, fields)) if i else search(index, some, k, fields)
    first = Window.partitionBy("shard", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "v_shard", "v_place")
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocks(asked: DataFrame, block: int) -> Iterator[pa.Table]:
    """The queries, ``block`` at most at a time: ranges of their numbers whose sizes are counted first."""
    parts = asked.groupBy(F.shiftright("number", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task that wrote some
    run: list[int] = []
    held = 0
    for r in [*parts, None]:
        if run and (r is None or held + r["n"] > block):
            some = asked.where(F.shiftright("number", 33).isin(run))
            if held <= block:
                yield some.drop("number").toArrow()
            else:  # one task's own are more than a block
                for at in range(0, held, block):
                    place = F.col("number").bitwiseAND(F.lit(2**33 - 1))
                    yield some.where((place >= at) & (place < at + block)).drop("number").toArrow()
            run, held = [], 0
        if r is not None:
            run, held = [*run, r["part"]], held + r["n"]


def search(index: DataFrame, queries: pa.Table, k: int, fields: str) -> DataFrame:
    """The k best of each task's shards for each of the queries, which all workers get."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        vectors = [np.frombuffer(x, np.float64) for x in asked.column("q").to_pylist()]
        homes = list(zip(asked.column("shard").to_pylist(), asked.column("place").to_pylist(), strict=True))
        found: list[list[tuple]] = [[] for _ in vectors]
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                shard = Shard(row)
                for i, (q, (home, place)) in enumerate(zip(vectors, homes, strict=True)):
                    least = found[i][k - 1][0] if len(found[i]) >= k else None
                    at, score = shard.best(q, place if home == shard.number else -1, k, None if least is None else -least)
                    new = [(-int(s), not bool(shard.has[a]), int(shard.ids[a]), shard.number, int(a)) for a, s in zip(at, score, strict=True)]
                    found[i] = sorted(found[i] + new)[:k]
        names = [x.split()[0] for x in fields.split(", ")]
        for i in range(0, len(vectors), 1000):
            rows = [(*homes[j], asked.column("query_id")[j].as_py(), None if none else v, s, p, -score) for j in range(i, min(i + 1000, len(vectors))) for score, none, v, s, p in found[j]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    return index.mapInArrow(run, fields)
