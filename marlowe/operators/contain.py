"""Which documents hold which texts: an equi-join on a token that a holder must have, then the comparison itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators.retrieve import cells, unsplit
from marlowe.sources.writers import kept

#: Bytes of texts without an inner token that are broadcast at a time, and distinct terms up to which they prune tokens as a broadcast.
MOST_BYTES, MOST_TERMS = 16_000_000, 500_000
#: Bytes of candidates (a document's id and a term) up to which they are broadcast to the texts.
MOST_PAIRS = 64_000_000


def keyed(probes: DataFrame) -> DataFrame:
    """Probes (probe, p) with term: the longest of p's tokens but the first and the last, which may be parts of a holder's. Null if p has none."""
    t = tx.tokens(F.col("p"))
    inner = F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0)))
    return probes.withColumn("term", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("term")))).getField("term"))


def having(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term): the ``terms`` (term), which go to the tasks, among documents' (doc_id, tokens), split or not; a batch has each once a row."""
    values = pa.array([r["term"] for r in terms.toLocalIterator()], pa.string())  # MOST_TERMS at most
    held = tokens.sparkSession.sparkContext.broadcast(values)

    def run(batches):
        for batch in batches:
            for low, _, _, row, term, _ in cells(batch.column(1), held.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(low + row)), held.value.take(pa.array(term))], names=["doc_id", "term"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, term STRING")


def holders(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct (doc_id, probe) where a text of docs (doc_id, text) holds p of probes (probe, p), character by character.

    A holder has p's key term as a token. So documents' distinct tokens are pruned by the key terms in their tasks, joined to the probes, and
    only documents with a candidate are compared; no document meets all probes. The candidates are written, and broadcast where they are
    few enough, so that no text is shuffled. Probes without a key term, of a word or two,
    are broadcast in blocks of bounded bytes. Null texts hold nothing and null probes are held nowhere; an empty probe is held
    by every text. Any number of probes will do.
    """
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    known = keyed(probes.where("p IS NOT NULL").select("probe", "p"))
    terms = known.where("term IS NOT NULL").select("term").distinct()
    prunes = terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    if prunes:
        have = having(unsplit(texts), terms)
    else:
        have = texts.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).join(terms, "term", "left_semi")
    have, long = kept(have.distinct(), "candidates"), known.where("term IS NOT NULL")
    few = (have.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0) <= MOST_PAIRS and (long.agg(F.sum(F.octet_length("p") + 16)).first()[0] or 0) <= MOST_BYTES
    pairs = texts.join(F.broadcast(have), "doc_id").join(F.broadcast(long), "term") if few else texts.join(have.join(long, "term"), "doc_id")
    out = pairs.where(F.contains("text", F.col("p"))).select("doc_id", "probe")
    short = known.where("term IS NULL").select("probe", "p")
    size = short.agg(F.sum(F.octet_length("p") + 16)).first()[0] or 0
    blocks = -(-size // MOST_BYTES)
    for k in range(blocks):
        mine = short.where(F.pmod(F.xxhash64("probe", "p"), F.lit(blocks)) == k).agg(F.collect_list(F.struct("probe", "p")).alias("block"))
        met = texts.crossJoin(F.broadcast(mine))  # one row of about MOST_BYTES
        out = out.unionByName(met.select("doc_id", F.explode(F.filter("block", lambda x: F.contains(F.col("text"), x["p"]))).alias("x")).select("doc_id", "x.probe"))
    return out.distinct()
