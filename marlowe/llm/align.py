"""Alignment of two tokenizers over the same bytes: groups between common token ends, and links of overlapping tokens.

A text's bytes get one label each: ``.`` no token ends there, ``a`` one of A, ``b`` one of B, ``x`` both. A pattern scans the
label string for spans up to each ``x``; the labels in a span tell how many tokens of A and of B the group has.

Both tokenizers cut before a space that stands between two other characters, so such chunks can be aligned by themselves. A
worker aligns each distinct chunk once and keeps the outcome; a document is put together from its chunks' outcomes.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.llm import common
from marlowe.llm.pretokens import BYTES, default_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPAN = re.compile(rb"[^x]*x")
LABELS = np.frombuffer(b".abx", np.uint8)
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside white space, or at the end: then cuts aren't simply the spaces.
UNEVEN = re.compile(r" \s|\s | \Z")
#: A link's ids in one number: A's times this plus B's.
PAIR = 1 << 16
FOUND = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType()), ("_pair", T.ArrayType(T.LongType())), ("_times", T.ArrayType(T.LongType()))]


class Store:
    """Lists of numbers end to end, looked up by their place."""

    def __init__(self):
        self.start, self.size, self.flat, self.n, self.end = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int64), 0, 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        while self.n + size.size > self.size.size:
            self.start, self.size = np.resize(self.start, 2 * self.start.size), np.resize(self.size, 2 * self.size.size)
        while self.end + flat.size > self.flat.size:
            self.flat = np.resize(self.flat, 2 * self.flat.size)
        self.flat[self.end : self.end + flat.size] = flat
        self.size[self.n : self.n + size.size] = size
        self.start[self.n : self.n + size.size] = self.end + np.cumsum(size) - size
        self.n, self.end = self.n + size.size, self.end + flat.size

    def of(self, places: np.ndarray) -> np.ndarray:
        """The lists at ``places``, end to end."""
        size = self.size[places]
        end = size.cumsum()
        return self.flat[np.repeat(self.start[places] - end + size, size) + np.arange(end[-1] if end.size else 0)]


class Aligner:
    """Aligns texts. ``most`` chunks of ``longest`` characters at most are kept between batches; then the memory of them starts anew."""

    def __init__(self, a_path: str, b_path: str, most: int = 500_000, longest: int = 80):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {chr(c): b for b, c in BYTES.items()}
        vocab = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        tokens = [vocab.get(i, "") for i in range(max(vocab) + 1)]
        self.a_bytes = [bytes([back[c] for c in t]) if all(c in back for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.shown = [str(i) for i in range(max(len(tokens), len(pieces)))]
        #: Chunks can stand alone if no piece of B goes on after a space and A splits by its pattern.
        self.local = not any(re.search("[^▁]▁", p) for p in pieces) and b'"use_regex":true' in self.a.pre_tokenizer.__getstate__().replace(b" ", b"")
        self.most, self.longest = most, longest
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.text: list[str] = []
        self.sizes, self.links = Store(), Store()

    def align(self, chunks: list[str]) -> bool:
        """Aligns chunks, which begin with a space, as one text, and appends each one's outcome; False, and nothing appended, if a tokenizer doesn't give that text back."""
        raw = "".join(chunks).encode()
        a = np.array(self.a.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(raw[1:].decode()), np.int64)
        a_list, b_list = a.tolist(), b.tolist()
        if b"".join([self.a_bytes[i] for i in a_list]) != raw or b"".join([self.b_bytes[i] for i in b_list]) != raw:
            return False
        label = np.zeros(len(raw), np.uint8)
        label[self.a_size[a].cumsum() - 1] += 1
        label[self.b_size[b].cumsum() - 1] += 2
        ends = np.cumsum([len(c.encode()) for c in chunks])
        if (label[ends - 1] != 3).any():
            return False
        groups, i, j = [], 0, 0
        for span in SPAN.findall(LABELS[label[label > 0]].tobytes()):  # inner bytes, of no end, say nothing here
            if span == b"x":
                groups.append(f"{self.shown[a_list[i]]}|{self.shown[b_list[j]]}")
                i, j = i + 1, j + 1
            else:
                both = span.count(b"x")
                m, n = i + span.count(b"a") + both, j + span.count(b"b") + both
                groups.append(f"{','.join([self.shown[x] for x in a_list[i:m]])}|{','.join([self.shown[x] for x in b_list[j:n]])}")
                i, j = m, n
        # every byte that ends a token is one link: of the tokens of A and of B that it lies in
        upto = [np.cumsum(x) for x in ((label & 1) > 0, label > 1, label == 3, label > 0)]
        at = np.flatnonzero(label)
        links = a[upto[0][at] - (label[at] & 1)] * PAIR + b[upto[1][at] - (label[at] > 1)]
        counts = np.stack([np.diff(x[ends - 1], prepend=0) for x in upto], 1)
        edges = [0, *upto[2][ends - 1].tolist()]
        self.text += [";".join(groups[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
        self.sizes.add(counts.ravel(), np.full(len(chunks), 4))
        self.links.add(links, counts[:, 3])
        return True

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        whole = " " + text
        if not self.local or "▁" in text:
            return [whole]
        parts = CUT.split(whole) if UNEVEN.search(whole) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0][:1] == " " else [" " + p for p in parts]

    def learn(self, bags: list[list[str]]) -> dict[str, int]:
        """The numbers of all chunks of a batch; those that a tokenizer doesn't give back have -1."""
        known, passing = self.code, {}
        new = [c for c in dict.fromkeys([c for bag in bags for c in bag]) if c not in known]
        short, long = [c for c in new if len(c) <= self.longest], [c for c in new if len(c) > self.longest]
        first = len(self.text)
        if short and self.align(short):
            known.update(zip(short, range(first, first + len(short)), strict=True))
        else:
            long = new
        for c in long:
            passing[c] = len(self.text) - 1 if self.align([c]) else -1
        return passing

    def rows(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns of FOUND for a batch of texts."""
        if len(self.text) > self.most:
            self.forget()
        bags = [self.chunks(t) for t in texts]
        passing = self.learn(bags)
        known, codes, sha = self.code, [], []
        for i, bag in enumerate(bags):
            mine = [known[c] if c in known else passing[c] for c in bag]
            if -1 in mine:  # of a text that isn't given back nothing counts, however its chunks are cut
                mine = [len(self.text) - 1] if self.align([" " + texts[i]]) else []
            codes.append(mine)
            sha.append(hashlib.sha256(";".join([self.text[c] for c in mine]).encode()).hexdigest() if mine else "")
        flat = np.array([c for mine in codes for c in mine], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(mine) for mine in codes])
        size = np.zeros((len(texts), 4), np.int64)
        np.add.at(size, row, self.sizes.of(flat).reshape(-1, 4))
        pair, times = np.unique(np.repeat(row, self.links.size[flat]) * PAIR**2 + self.links.of(flat), return_counts=True)
        ends = np.append(0, np.bincount(pair // PAIR**2, minlength=len(texts)).cumsum()).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64))) for x in (pair % PAIR**2, times)]
        return [*[pa.array(size[:, k]) for k in range(4)], pa.array(sha, pa.string()), *lists]


@lru_cache(maxsize=1)
def shared(a_path: str, b_path: str) -> Aligner:
    """A Python worker's aligner, kept between tasks."""
    return Aligner(a_path, b_path)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): the documents that hold each pair linked, and whether no pair with its A id is in more of them."""
    counts = common.cut(aligned.select(F.explode("_pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    most = counts.groupBy(F.floor(F.col("pair") / PAIR).alias("_a")).agg(F.max("count").alias("_most"))  # a row for each id of A at most
    return counts.withColumn("_a", F.floor(F.col("pair") / PAIR)).join(F.broadcast(most), "_a").select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def least_count(counts: DataFrame, most: int) -> int:
    """The least power of two that no more than ``most`` pairs' counts reach, from the counts' histogram by powers."""
    sizes = {r["e"]: r["n"] for r in counts.groupBy((F.length(F.bin("count")) - 1).alias("e")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    held = 0
    for e in sorted(sizes, reverse=True):
        held += sizes[e]
        if held > most:
            return 2 ** (e + 1)
    return 0


def align(docs: DataFrame, *, text_col: str = "text", a_path: str | None = None, b_path: str | None = None, most_broadcast: int = 1_000_000) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row, with all its columns but the text.

    The pairs that most documents hold, ``most_broadcast`` of 17 bytes at most, are sent to all workers. What a document
    links beyond them goes on as rows of (row, pair, times), joined by a shuffle and summed by row: no such pair is in more
    documents than each of those sent.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte (U+2581 is a space to B), have no tokens:
    zeros and an empty string. Texts of any length count whole; equal rows count as a document each; an empty table stays
    empty; names that clash with the new ones are a ValueError.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if clash := [c for c in docs.columns if c != text_col and c.lower() in (*new, "_pair", "_times", "_row", "_rest")]:
        raise ValueError(f"the input already has {clash}")
    a_path, b_path = a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model")
    kept = [c for c in docs.columns if c != text_col]
    found = common.per_text(docs, text_col, FOUND, lambda texts: shared(a_path, b_path).rows(texts)).drop(text_col)
    aligned = common.cut(found.withColumn("_row", F.monotonically_increasing_id()))  # from here on the rows' numbers are fixed
    counts = common.cut(pair_counts(aligned))
    least = least_count(counts, most_broadcast)
    often = counts.where(F.col("count") >= least).toArrow()  # most_broadcast rows at most
    order = np.argsort(often.column("pair").to_numpy())
    held = docs.sparkSession.sparkContext.broadcast(tuple(often.column(c).to_numpy()[order] for c in ("pair", "count", "best")))

    where = {c: aligned.columns.index(c) for c in ("_pair", "_times")}
    rest_type = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    out_fields = [f for f in aligned.schema.fields if f.name not in where]
    schema = T.StructType([*out_fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("_rest", rest_type)])

    def looked_up(batches):
        pairs, count, best = held.value
        for batch in common.slices(batches, 1024):
            lists = {c: batch.column(i) for c, i in where.items()}
            sizes = lists["_pair"].value_lengths().to_numpy(zero_copy_only=False)
            pair, times = (lists[c].flatten().to_numpy() for c in ("_pair", "_times"))
            row = np.repeat(np.arange(sizes.size), sizes)
            at = np.minimum(np.searchsorted(pairs, pair), max(0, pairs.size - 1))
            known = pairs[at] == pair if pairs.size else np.zeros(pair.size, bool)
            n = np.where(known, times, 0)
            sums = [np.zeros(sizes.size, np.int64), np.zeros(sizes.size, np.int64)]
            if pairs.size:
                np.add.at(sums[0], row, n * best[at])
                np.add.at(sums[1], row, n * count[at])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=sizes.size))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(pair[~known]), pa.array(times[~known])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i not in where.values()], pa.array(sums[0]), pa.array(sums[1]), rest], names=schema.names)

    out = aligned.mapInArrow(looked_up, schema)
    if least:
        out = common.cut(out)
        rare = out.select(F.col("_row").alias("_r"), F.explode("_rest").alias("x")).select("_r", "x.pair", "x.times").join(counts.where(F.col("count") < least), "pair")
        more = rare.groupBy("_r").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum"))
        out = out.join(more, F.col("_row") == F.col("_r"), "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return out.select(*kept, *new)
