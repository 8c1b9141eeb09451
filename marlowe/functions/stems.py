"""French stems by the published Snowball rules: suffixes are cut or changed where they lie in the word's regions RV, R1 and R2.

Stems are made once for each distinct term and joined back, so the rules' cost doesn't grow with the number of tokens. Where texts
are split in tasks (``stem_lists``) a worker stems each distinct term of a tile, and remembers the last ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.functions import text as tx

VOWELS = frozenset("aeiouyâàëéêèïîôûù")

#: The suffixes of the published rules, by what is done with them.
STANDARD = {s: rule for rule, suffixes in {
    "drop": "ance iqUe isme able iste eux ances iqUes ismes ables istes",
    "ation": "atrice ateur ation atrices ateurs ations",
    "log": "logie logies",
    "u": "usion ution usions utions",
    "ent": "ence ences",
    "ement": "ement ements",
    "ité": "ité ités",
    "if": "if ive ifs ives",
    "eau": "eaux",
    "al": "aux",
    "euse": "euse euses",
    "issement": "issement issements",
    "ant+": "amment",
    "ent+": "emment",
    "ment": "ment ments",
}.items() for s in suffixes.split()}
I_VERBS = frozenset("îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split())
VERBS = {s: rule for rule, suffixes in {
    "ions": "ions",
    "cut": "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez",
    "e": "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions",
}.items() for s in suffixes.split()}
RESIDUAL = frozenset("ion ier ière Ier Ière e ë".split())


def longest(word: str, suffixes, low: int = 0) -> str | None:
    """The longest of the suffixes that the word ends in, none of it before ``low``."""
    for n in range(min(8, len(word) - low), 0, -1):
        if word[-n:] in suffixes:
            return word[-n:]
    return None


class Word:
    """A word with its regions; vowels that count as consonants are upper case while it is worked on."""

    def __init__(self, word: str):
        self.w = self.marked(word)
        self.rv = self.rv_of()
        self.r1 = self.after_consonant(0)
        self.r2 = self.after_consonant(self.r1)

    @staticmethod
    def marked(word: str) -> str:
        c, i = list(word), 0
        vowel = lambda k: k < len(c) and c[k] in VOWELS
        while i < len(c):
            following = c[i + 1] if i + 1 < len(c) else ""
            if vowel(i) and following and following in "ui" and vowel(i + 2):
                c[i + 1], i = following.upper(), i + 3
            elif vowel(i) and following == "y":
                c[i + 1], i = "Y", i + 2
            elif c[i] == "y" and vowel(i + 1):
                c[i], i = "Y", i + 2
            elif c[i] == "q" and following == "u":
                c[i + 1], i = "U", i + 2
            else:
                i += 1
        return "".join(c)

    def rv_of(self) -> int:
        w = self.w
        if len(w) >= 3 and (w[0] in VOWELS and w[1] in VOWELS or w[:3] in ("par", "col", "tap")):
            return 3
        return next((i + 1 for i in range(1, len(w)) if w[i] in VOWELS), len(w))

    def after_consonant(self, start: int) -> int:
        """Past the first consonant that follows a vowel, both from ``start`` on."""
        w = self.w
        v = next((i for i in range(start, len(w)) if w[i] in VOWELS), len(w))
        return next((i + 1 for i in range(v + 1, len(w)) if w[i] not in VOWELS), len(w))

    def ends(self, *before: str, at: int | None = None) -> str | None:
        """Which of the suffixes the word ends in, from ``at`` on at the earliest."""
        return next((b for b in before if self.w.endswith(b) and (at is None or len(self.w) - len(b) >= at)), None)

    def swap(self, suffix: str, by: str = "") -> None:
        self.w = self.w[: len(self.w) - len(suffix)] + by

    def drop_or(self, suffix: str, by: str) -> None:
        """Takes a suffix off in R2, and puts ``by`` in its place elsewhere."""
        self.swap(suffix, "" if self.ends(suffix, at=self.r2) else by)

    def standard(self) -> bool:
        """Nouns, adjectives and adverbs; true if the word is done. Adverbs in -ment go on to the verbs."""
        s = longest(self.w, STANDARD)
        if s is None:
            return False
        rule, at = STANDARD[s], len(self.w) - len(s)
        in_rv, in_r1, in_r2 = at >= self.rv, at >= self.r1, at >= self.r2
        before = self.w[at - 1] if at else ""
        if rule in ("ant+", "ent+"):
            if in_rv:
                self.swap(s, rule[:-1])
            return False
        if rule == "ment":
            if before in VOWELS and at - 1 >= self.rv:
                self.swap(s)
            return False
        allowed = {"ement": in_rv, "eau": True, "al": in_r1, "euse": in_r1 or in_r2, "issement": in_r1 and before != "" and before not in VOWELS}.get(rule, in_r2)
        if not allowed:
            return False
        self.swap(s, {"log": "log", "u": "u", "ent": "ent", "eau": "eau", "al": "al"}.get(rule, "" if rule != "euse" or in_r2 else "eux"))
        if rule == "ation" and self.ends("ic"):
            self.drop_or("ic", "iqU")
        elif rule == "ité":
            if self.ends("abil"):
                self.drop_or("abil", "abl")
            elif self.ends("ic"):
                self.drop_or("ic", "iqU")
            elif self.ends("iv", at=self.r2):
                self.swap("iv")
        elif rule == "if" and self.ends("at", at=self.r2):
            self.swap("at")
            if self.ends("ic"):
                self.drop_or("ic", "iqU")
        elif rule == "ement":
            if self.ends("iv"):
                if self.ends("iv", at=self.r2):
                    self.swap("iv")
                    if self.ends("at", at=self.r2):
                        self.swap("at")
            elif self.ends("eus"):
                if self.ends("eus", at=self.r1):
                    self.drop_or("eus", "eux")
            elif b := self.ends("abl", "iqU"):
                if self.ends(b, at=self.r2):
                    self.swap(b)
            elif b := self.ends("ièr", "Ièr", at=self.rv):
                self.swap(b, "i")
        return True

    def i_verb(self) -> bool:
        s = longest(self.w, I_VERBS, self.rv)
        at = len(self.w) - len(s or "")
        if s is None or at - 1 < self.rv or self.w[at - 1] in VOWELS:
            return False
        self.swap(s)
        return True

    def verb(self) -> bool:
        s = longest(self.w, VERBS, self.rv)
        if s is None or VERBS[s] == "ions" and len(self.w) - 4 < self.r2:
            return False
        self.swap(s)
        if VERBS[s] == "e" and self.ends("e", at=self.rv):
            self.swap("e")
        return True

    def residual(self) -> None:
        if len(self.w) > 1 and self.w[-1] == "s" and self.w[-2] not in "aiouès":
            self.swap("s")
        s = longest(self.w, RESIDUAL, self.rv)
        if s == "ion":
            if len(self.w) - 3 >= self.r2 and self.ends("sion", "tion", at=self.rv):
                self.swap("ion")
        elif s == "ë":
            if self.ends("guë", at=self.rv):
                self.swap("ë")
        elif s:
            self.swap(s, "" if s == "e" else "i")

    def stem(self) -> str:
        if self.standard() or self.i_verb() or self.verb():
            self.w = self.w[:-1] + {"Y": "i", "ç": "c"}.get(self.w[-1:], self.w[-1:])
        else:
            self.residual()
        if self.ends("enn", "onn", "ett", "ell", "eill"):
            self.w = self.w[:-1]
        tail = len(self.w.rstrip("".join(set(self.w) - VOWELS))) if self.w else 0
        if 0 < tail < len(self.w) and self.w[tail - 1] in "éè":
            self.w = self.w[: tail - 1] + "e" + self.w[tail:]
        return self.w.lower()


def stem(word: str) -> str:
    """The stem of a word in lower case; an empty word stays empty."""
    return Word(word).stem()


@F.pandas_udf(T.StringType())
def stem_udf(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of terms; null stays null."""
    for w in words:
        yield w.map(lambda x: None if x is None else stem(x))


def forms(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term."""
    return terms.select("term").where("term IS NOT NULL").distinct().withColumn("stem", stem_udf("term"))


def stop_stems(stop: list[str] | None = None) -> list[str]:
    return sorted({stem(w) for w in (stop or tx.FUNCTION_WORDS)})


#: Terms whose stems a worker remembers.
MOST_KNOWN = 1_000_000
KNOWN: dict[str, str | None] = {}


@cache
def usual_stops() -> frozenset[str]:
    return frozenset(stop_stems())


def known_stem(term: str) -> str | None:
    """The stem of a term, null if a stop word has it too; remembered."""
    if term not in KNOWN:
        if len(KNOWN) >= MOST_KNOWN:
            KNOWN.clear()
        s = stem(term)
        KNOWN[term] = None if s in usual_stops() else s
    return KNOWN[term]


def stem_lists(texts: pa.Array) -> pa.Array:
    """Lists of the stems of texts in lower case, without those of stop words; null texts have none."""
    lists = tx.token_lists(texts)
    n, coded = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
    names = [known_stem(t) for t in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    stays = np.array([s is not None for s in names], bool)[code]
    ends = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()).take(pa.array(code[stays])))


def stem_docs(docs: DataFrame, *, rows: int = 512) -> DataFrame:
    """Documents (doc_id, tokens) whose tokens are texts in lower case, with lists of stems in their place: tasks split and stem their own texts."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), stem_lists(part.column(1))], names=["doc_id", "tokens"])

    kept = docs.select("doc_id", "tokens")
    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], T.StructField("tokens", T.ArrayType(T.StringType()))]))


def stemmed(rows: DataFrame, id_col: str, text_col: str, *, stop: list[str] | None = None, keep_stops: bool = False) -> DataFrame:
    """(id, stems): a row's tokens in order, each as its stem, without those that are the stem of a stop word. Ids are unique; null texts have none."""
    each = rows.select(id_col, F.posexplode_outer(tx.tokens(F.col(text_col))).alias("at", "term"))
    met = each.join(forms(each), "term", "left")
    kept = F.col("stem").isNotNull() & (F.lit(keep_stops) | ~F.col("stem").isin(stop_stems(stop)))
    return met.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(kept, F.struct("at", "stem")))).alias("x")).select(id_col, F.transform("x", lambda x: x["stem"]).alias("stems"))


def stem_postings(posts: DataFrame, *, stop: list[str] | None = None) -> DataFrame:
    """Postings (term, doc_id, tf, dl) by stem in place of term, stop stems left out, lengths counted anew.

    Terms of a document that share a stem add up. The vocabulary is stemmed once and joined; a term that very many documents
    have is one key of that join, which broadcasts the vocabulary as long as it is small and splits hot keys otherwise.
    """
    found = forms(posts).where(~F.col("stem").isin(stop_stems(stop)))
    by_stem = posts.join(found, "term").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    sizes = by_stem.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    return by_stem.join(sizes, "doc_id").select("term", "doc_id", "tf", "dl")


def stem_terms(terms: DataFrame, *, stop: list[str] | None = None) -> DataFrame:
    """Query terms (qid, term, qtf) by stem."""
    found = forms(terms).where(~F.col("stem").isin(stop_stems(stop)))
    return terms.join(found, "term").groupBy("qid", F.col("stem").alias("term")).agg(F.sum("qtf").alias("qtf"))
