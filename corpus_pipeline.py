"""From documents to token files: language ID, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents. ``run`` writes each stage's rows to the shared folder and rereads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlowe.llm import common, decontam, langid, mixing, simhash, tokenfile

#: No stage but the mix can be told in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is accepted; null texts, those without a letter and those below the calibrated threshold go.

    Without labelled rows to learn from none is accepted. Repeated rows stay or go together.
    """
    model = langid.train(docs, learn=F.pmod(common.crc32_text(F.col("id")), F.lit(4)) != 2)
    return langid.identify(docs, model).where("lang_accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group; links are a Jaccard similarity of 0.8 at least on five-word shingles.

    Null and empty texts are one group, repeated rows another each; null ids come last in a group. Empty tables stay empty.
    """
    return simhash.one_of_each(docs, words=5, similarity=(4, 5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark, in any order; null and empty texts have none, repeated rows stay or go together."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, up to three times; those that it doesn't take go.

    Null sources are one source, null texts have size 0. Of equal rows as many are taken as fit; an empty table stays empty.
    """
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold for each document: repeated rows have a row each, null and empty texts the end id alone, null ids come first."""
    folder = common.fresh_dir(spark, "pipeline-tokens")
    tokenfile.write(docs, folder)
    return tokenfile.read(spark, folder)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing_sources), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. A stage's folder goes when the next one has written its own, and its checkpoints with it."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = common.fresh_dir(spark, f"pipeline-{name}")
        with common.passing_checkpoints(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if read:
            common.remove(spark, read)
        docs, read = spark.read.parquet(folder), folder
    out = STAGES[-1][1](spark, docs, sf_dir)
    common.remove(spark, read)  # the token files are written
    return out
