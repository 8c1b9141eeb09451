"""What SimHash groups need to be exact in the Jaccard similarity of word shingles: a second source of candidates, and verification.

A similarity of 0.8 changes some ten of 64 bits, more than any pigeonhole can look for at the documents' number. So the
fingerprints' links are candidates only, and a prefix filter, which misses no pair at any threshold, gives the others.
Two sets of similarity t at least share l shingles among the first n - ceil(t n) + l of each, in any order that all
sets use (prefix filter; l grows with the set, so that a passage in two long texts proposes nothing). Shingles that
are common in a sample come last, so that a line which many documents hold links few of them; the sample moves work
only, never results. Pairs that share a shingle of few sets are counted; in one of many sets all hang on the first,
and whatever hangs together is verified. Candidates form groups; inside these every pair is compared on the full sets
until it is known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.llm import common
from marlowe.llm.simhash import components, majority, near_links, shingle_hashes

#: Numerator and denominator of the least similarity.
LEAST = (4, 5)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit number that equal sets share; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64)) if shingles.size else 0


def common_shingles(texts: DataFrame, words: int, rows: int = 16_384, share: int = 16, least: int = 4, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least ``least`` of a sample hold, the ``most`` commonest of them, ascending, and how many hold them.

    The sample is about one text in ``share``, ``rows`` at least, so that it grows with the corpus.
    """
    rate = min(1.0, max(rows / max(1, texts.count()), 1 / share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    some = texts.where(common.seeded(F.col("mark"), 5) < rate).select("text").mapInArrow(run, "shingle BIGINT")
    often = some.groupBy("shingle").count().where(F.col("count") >= least).orderBy(F.col("count").desc(), "shingle").limit(most).toPandas()
    keys = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], often["count"].to_numpy(np.int64)[order]


def shared_at_least(n):
    """How many shingles of their prefixes two similar sets share, the smaller one having n."""
    return 1 + n // 20


def prefix(shingles: np.ndarray, often: np.ndarray, counts: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The shingles of which two sets of similarity ``least`` share ``shared_at_least``: rare ones first, then by hash."""
    n = shingles.size
    keep = min(n, n + (-least[0] * n // least[1]) + shared_at_least(n)) if n else 0
    rank = np.zeros(n, np.int64)
    if often.size and n:
        at = np.minimum(np.searchsorted(often, shingles), often.size - 1)
        rank = np.where(often[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[:keep]]


def signatures(texts: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """doc_id, mark, sid, fp, size and prefix (its hashes' bytes) for each row of doc_id, text, mark."""
    often, counts = common_shingles(texts, words)
    shared = texts.sparkSession.sparkContext.broadcast((often, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = shared.value
        for batch in common.slices(batches):
            lists = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            sets = [np.unique(h) for h in lists]
            new = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([majority(h) for h in lists], pa.int64()), pa.array([s.size for s in sets], pa.int64()), pa.array([prefix(s, often, counts, least).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *new], names=["doc_id", "mark", "sid", "fp", "size", "prefix"])

    return texts.select("doc_id", "text", "mark").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, mark BIGINT, sid BIGINT, fp BIGINT, size BIGINT, prefix BINARY")


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of (shingle, size, sid) for each shingle of a prefix; a set that repeats within a batch counts once."""
    for batch in common.slices(batches):
        one = {s: (n, p) for s, n, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        held = [np.frombuffer(p, np.int64) for _, p in one.values()]
        times = [h.size for h in held]
        sid, size = np.repeat(np.array(list(one), np.int64), times), np.repeat(np.array([n for n, _ in one.values()], np.int64), times)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(size), pa.array(sid)], names=["shingle", "size", "sid"])


def proposals(least: tuple[int, int], most: int = 192, hold: int = 4096):
    """Rows sorted by shingle, size and set, to rows (a, b, need): a pair is a candidate if it comes ``need`` times or more.

    A run has one shingle and sizes without a gap of more than ``least`` allows. Runs of up to ``most`` sets give all their
    pairs that sizes allow; of longer ones each set hangs on the first, with need 0. At most ``hold`` rows are held.
    """

    def edges(x: np.ndarray, run: np.ndarray, centre: np.int64 | None) -> list[np.ndarray]:
        size = np.bincount(run, minlength=1)
        long = (size > most)
        long[0] |= centre is not None
        first = x[2][np.r_[0, np.cumsum(size)[:-1]]]
        if centre is not None:
            first[0] = centre
        hot = long[run]
        out = [np.stack([first[run[hot]], x[2][hot], np.zeros(hot.sum(), np.int64)])]
        y, r = x[:, ~hot], run[~hot]
        for d in range(1, most):
            if r.size <= d:
                break
            near = np.flatnonzero((r[d:] == r[:-d]) & (least[1] * y[1][:-d] >= least[0] * y[1][d:]))
            out.append(np.stack([y[2][near], y[2][near + d], shared_at_least(y[1][near])]))
        return out

    def batch_of(parts: list[np.ndarray]) -> pa.RecordBatch:
        a, b, need = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        some = a != b
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[some]), pa.array(np.maximum(a, b)[some]), pa.array(need[some])], names=["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = np.zeros((3, 0), np.int64), None  # the last run so far; if it is a long one its first set, and of its rows the last
        for batch in batches:
            x = np.concatenate([held, np.array([c.to_numpy() for c in batch.columns], np.int64)], axis=1)
            x = x[:, np.r_[True, (x[:, 1:] != x[:, :-1]).any(axis=0)]] if x.size else x
            if not x.size:
                continue
            new = (x[0][1:] != x[0][:-1]) | (least[1] * x[1][:-1] < least[0] * x[1][1:])
            at = np.r_[0, new.cumsum()]
            last = int(np.flatnonzero(at == at[-1])[0])
            if last:
                yield batch_of(edges(x[:, :last], at[:last], centre))
                centre = None
            held = x[:, last:]
            if centre is not None or held.shape[1] > hold:
                centre = held[2, 0] if centre is None else centre
                yield batch_of(edges(held, np.zeros(held.shape[1], np.int64), centre))
                held = held[:, -1:]
        if held.shape[1] > 1:
            yield batch_of(edges(held, np.zeros(held.shape[1], np.int64), centre))

    return run


def connected(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links (positions) that connect whatever pairs of similarity ``least`` connect: breadth first over those not yet reached."""
    size = np.array([s.size for s in sets], np.int64)
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by_name = owner[np.argsort(column, kind="stable")]
    start = np.r_[0, np.cumsum(np.bincount(column, minlength=names.size))]
    at = np.r_[0, np.cumsum(size)]
    left, out = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], frontier = False, [seed]
        while frontier and left.any():
            v = frontier.pop()
            own = column[at[v] : at[v + 1]]
            lengths = start[own + 1] - start[own]
            holders = by_name[np.repeat(start[own] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())]
            shared = np.bincount(holders, minlength=len(sets))
            found = np.flatnonzero(left & (least[1] * shared >= least[0] * (size + size[v] - shared)))
            left[found] = False
            out += [(v, int(x)) for x in found]
            frontier.extend(found.tolist())
    return out


def verify(words: int, least: tuple[int, int]):
    """A mapInArrow function over (root, low, high, sid, text) sorted by the first three: the links of each group."""

    def links(sids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        got = [(sids[i], sids[j]) for i, j in connected(sets, least)] if len(sids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sids, sets = None, [], []
        for batch in common.slices(batches):
            for *key, sid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    yield links(sids, sets)
                    now, sids, sets = key, [], []
                sids.append(sid)
                sets.append(shingle_set(text, words))
        yield links(sids, sets)

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_bits: int = 3, least: tuple[int, int] = LEAST, block: int = 1_000_000, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, mark and root for every row: rows share a root if links of similarity ``least`` connect them.

    mark is a hash of the text. Texts of fewer words are one shingle; null texts and those without a word are one group.
    Candidates come from fingerprints at most ``max_bits`` apart and from the prefix filter. Groups of over ``block`` shingles are split by a hash, each pair of parts being a group of its own.
    """
    texts = common.pick(docs, doc_id=id_col, text=text_col).withColumn("mark", F.xxhash64("text"))
    rows = common.cut(signatures(texts, words, least))
    keyed = rows.where("size > 0").select("sid", "size", "prefix").mapInArrow(spread, "shingle BIGINT, size BIGINT, sid BIGINT")
    dealt = keyed.repartition("shingle").sortWithinPartitions("shingle", "size", "sid")
    marked = common.cut(rows.where("size > 0").groupBy("fp").agg(F.min("sid").alias("sid")))
    alike = near_links(marked.select("fp"), max_bits)
    firsts = marked.select(F.col("fp").alias("f"), F.col("sid").alias("s"))
    bits = alike.join(firsts, F.col("a") == F.col("f")).select("b", F.col("s").alias("a2")).join(firsts, F.col("b") == F.col("f")).select(F.col("a2").alias("a"), F.col("s").alias("b"))
    same = rows.where("size > 0").select("fp", "sid").distinct().join(marked.select("fp", F.col("sid").alias("a")), "fp").where("a <> sid").select("a", F.col("sid").alias("b"))
    shared = dealt.mapInArrow(proposals(least), "a BIGINT, b BIGINT, need BIGINT").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    prefixes = shared.where("n >= need").select("a", "b")
    close = components(prefixes.unionByName(bits).unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    one = rows.where("size > 0").groupBy("sid").agg(F.min("mark").alias("mark"), F.first("size").alias("size"))
    wanted = common.cut(one.join(close, F.col("sid") == F.col("node")).select("mark", "sid", "size", "root"))
    blocks = wanted.groupBy("root").agg(F.ceil(F.sum("size") / block).alias("blocks"))
    placed = wanted.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks"))).select("mark", "sid", "root", "own", "blocks")
    placed = F.broadcast(placed) if wanted.count() <= most_broadcast else placed
    held = texts.select("text", "mark").join(placed, "mark").dropDuplicates(["sid"])
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    paired = held.select("root", "own", "sid", "text", other).select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "sid", "text")
    sorted_groups = paired.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    roots = components(sorted_groups.mapInArrow(verify(words, least), "a BIGINT, b BIGINT").distinct()).withColumnRenamed("node", "sid")
    named = F.broadcast(roots) if roots.count() <= most_broadcast else roots
    return rows.select("doc_id", "mark", "sid").join(named, "sid", "left").select("doc_id", "mark", F.coalesce("root", "sid").alias("root"))
