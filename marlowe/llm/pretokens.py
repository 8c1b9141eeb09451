"""Token counts and ids by pre-token: the pieces of each distinct pre-token are found once and then looked up.

The class splits texts exactly as the tokenizer file says: added tokens first, then the library's own normaliser,
then the split pattern. Only distinct pre-tokens go through the library's merge loop.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The classes of the tokenizer file's split pattern over Latin-1, for the built-in engine. A word can't
#: begin with an apostrophe, so words may come first.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
GENERAL = regex.compile(r"[\p{L}]+|'(?:s|t|re|ve|m|ll|d)|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
LATIN = re.compile(rf"[{LATIN_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{LATIN_NUMBERS}]|[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+")
#: Bytes to the characters that stand for them in a byte-level vocabulary: printable ones themselves, the rest from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Pre-token to its code; what is missing is looked up in the generation before or made."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, pretoken: str) -> int:
        code = self[pretoken] = self.make(pretoken)
        return code


class Pretokens:
    """Splits texts and looks pre-tokens up. ``most`` bounds each of the memo's two generations.

    When the young generation is full it becomes the old one, and what neither has used since is forgotten.
    """

    def __init__(self, path: str, most: int = 120_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.normalizer, self.most = self.tok.model, self.tok.normalizer, most
        if "'s|'t|'re|'ve|'m|'ll|'d|[" not in self.tok.pre_tokenizer.__getstate__().decode():
            raise ValueError("this splitter follows tokenizer files with the word-end pattern only")
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        self.mark = os.path.commonprefix(list(self.added))  # a text without what all added tokens begin with has none
        self.old: dict[str, int] = {}
        self.young = Memo(self.make)
        self.start, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.n = self.end = 0

    def pieces(self, pretoken: str) -> list[int]:
        """The ids of one pre-token, by the library's merge loop."""
        if pretoken in self.added:
            return [self.added[pretoken]]
        return [t.id for t in self.model.tokenize(pretoken if pretoken.isascii() and pretoken.isprintable() else pretoken.encode().decode("latin-1").translate(BYTES))]

    def make(self, pretoken: str) -> int:
        if (code := self.old.get(pretoken)) is not None:
            return code
        ids = self.pieces(pretoken)
        while self.n >= self.start.size:
            self.start, self.size = np.resize(self.start, 2 * self.n), np.resize(self.size, 2 * self.n)
        while self.end + len(ids) > self.flat.size:
            self.flat = np.resize(self.flat, 2 * self.flat.size)
        self.start[self.n], self.size[self.n] = self.end, len(ids)
        self.flat[self.end : self.end + len(ids)] = ids
        self.n, self.end = self.n + 1, self.end + len(ids)
        return self.n - 1

    def ids_of(self, code: np.ndarray) -> np.ndarray:
        size = self.size[code]
        end = size.cumsum()
        return self.flat[np.repeat(self.start[code] - end + size, size) + np.arange(end[-1] if end.size else 0)]

    def rotate(self) -> None:
        """Between texts: keeps the young generation as the old one, codes renumbered."""
        if len(self.young) <= self.most:
            return
        code = np.fromiter(self.young.values(), np.int64, len(self.young))
        flat, size = self.ids_of(code), self.size[code]
        self.flat, self.size, self.start = flat, size, size.cumsum() - size
        self.n, self.end = code.size, flat.size
        self.old, self.young = dict(zip(self.young, range(code.size), strict=True)), Memo(self.make)

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token's string comes as itself."""
        if self.cut is None or (self.mark and self.mark not in text):
            return self.plain(text)
        return [x for part in self.cut.split(text) if part for x in ([part] if part in self.added else self.plain(part))]

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")  # Latin-1 is composed and lower-cases within itself
            except UnicodeEncodeError:
                return GENERAL.findall(self.normalizer.normalize_str(text))
        return LATIN.findall(text.lower())

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text: its pre-tokens' frequencies joined to the number of pieces that each has."""
        out = []
        for t in texts:
            bag = Counter(self.split(t)) if t else {}
            code = np.fromiter(map(self.young.__getitem__, bag), np.int64, len(bag))
            out.append(int(self.size[code] @ np.fromiter(bag.values(), np.int64, len(bag))))
            self.rotate()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text as uint32."""
        words = self.split(text) if text else []
        ids = self.ids_of(np.fromiter(map(self.young.__getitem__, words), np.int64, len(words)))
        self.rotate()
        return ids


@lru_cache(maxsize=1)
def shared(path: str) -> Pretokens:
    """A Python worker's memo for a tokenizer file; workers are reused, so later tasks find what earlier ones learnt."""
    return Pretokens(path)


def pretoken_table(docs: DataFrame, *, text_col: str = "text", path: str | None = None, most: int = 100_000) -> DataFrame:
    """(pretoken, docs, pieces) for each distinct pre-token of the texts: how many texts have it, into how many pieces it goes.

    Tasks send each of theirs about once (they hold ``most`` at a time), so that the shuffle moves distinct pre-tokens
    and not texts; each is then split into pieces once in all. Null and empty texts have none.
    """
    path = path or default_path()

    def distinct(batches):
        tok, seen = shared(path), Counter()
        for batch in common.slices(batches):
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(set(tok.split(t)))
                if len(seen) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "docs"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "docs"])

    def pieces(batches):
        tok = shared(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(tok.pieces(p)) for p in batch.column(0).to_pylist()], pa.int64())], names=["pretoken", "docs", "pieces"])

    found = common.pick(docs, text=text_col).mapInArrow(distinct, "pretoken STRING, docs BIGINT").groupBy("pretoken").agg(F.sum("docs").alias("docs"))
    return found.mapInArrow(pieces, "pretoken STRING, docs BIGINT, pieces BIGINT")


def count_tokens(docs: DataFrame, *, text_col: str = "text", path: str | None = None, limit: int = 2048, most_broadcast: int = 400_000) -> DataFrame:
    """n_bytes (UTF-8), n_tokens and over_limit for every row, with all its columns but the text; no document's ids are ever built.

    Each distinct pre-token is counted once, in ``pretoken_table``. The ``most_broadcast`` (some 10 MB) that most texts
    have are sent to all workers, and joined there to each document's pre-token frequencies. If there are more, what a
    document has of the others goes on as rows of (row, pretoken, frequency), joined to the table by a shuffle and summed by
    row: these are rare, so that no key of that join is a hot one.

    Null counts as empty: 0, 0, false. Texts of any length count whole. Rows stand alone, repeats included; an empty table
    stays empty; clashing names are a ValueError.
    """
    path, new = path or default_path(), ["n_bytes", "n_tokens", "over_limit"]
    if clash := [c for c in docs.columns if c != text_col and c.lower() in (*new, "_row", "_rest")]:
        raise ValueError(f"the input already has {clash}")
    table = common.cut(pretoken_table(docs, text_col=text_col, path=path))
    often = table.orderBy(F.col("docs").desc(), "pretoken").limit(most_broadcast).select("pretoken", "pieces").toArrow()  # most_broadcast rows at most
    held = docs.sparkSession.sparkContext.broadcast(dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True)))
    whole = table.count() <= most_broadcast
    where = docs.columns.index(text_col)
    kept = [f for i, f in enumerate(docs.schema.fields) if i != where]
    rest_type = T.ArrayType(T.StructType([T.StructField("pretoken", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([*kept, T.StructField("_row", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("_rest", rest_type)])

    def run(batches):
        tok, known = shared(path), held.value
        arrow_rest = pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int64())]))
        for batch in common.slices(batches):
            size, count, rest = [], [], []
            for t in batch.column(where).to_pylist():
                bag = Counter(tok.split(t)) if t else {}
                size.append(len(t.encode()) if t else 0)
                count.append(sum([n * known[p] for p, n in bag.items() if p in known]))
                rest.append([] if whole else [{"pretoken": p, "n": n} for p, n in bag.items() if p not in known])
            columns = [c for i, c in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(rest, arrow_rest)], names=schema.names)

    counted = docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, schema)
    names = [f.name for f in kept]
    if not whole:
        counted = common.cut(counted)  # from here on the rows' numbers are fixed
        rare = counted.select("_row", F.explode("_rest").alias("x")).select(F.col("_row").alias("_r"), "x.pretoken", "x.n").join(table.select("pretoken", "pieces"), "pretoken")
        more = rare.groupBy("_r").agg(F.sum(F.col("n") * F.col("pieces")).alias("_more"))
        counted = counted.join(more, F.col("_row") == F.col("_r"), "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("_more", F.lit(0)))
    return counted.select(*names, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
