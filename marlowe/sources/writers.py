"""Sinks: checked exports, resumable and cached work, small tables as text, fingerprints of settings."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(df: DataFrame, folder: str) -> int:
    """Writes Parquet and JSON lines, rereads both and returns the row count; raises if they differ."""
    df.write.mode("overwrite").parquet(f"{folder}/parquet")
    spark = df.sparkSession
    back = spark.read.parquet(f"{folder}/parquet")
    back.write.mode("overwrite").json(f"{folder}/jsonl")
    n, m = back.count(), spark.read.text(f"{folder}/jsonl").count()
    if n != m:
        raise RuntimeError(f"{n} rows in Parquet, {m} in JSON lines")
    return n


def append(df: DataFrame, folder: str) -> None:
    """Adds records to a folder of JSON lines; earlier files are never rewritten."""
    df.write.mode("append").json(folder)


def result_json(df: DataFrame, *, keep: str = "_trec_") -> DataFrame:
    """Each row as JSON without the private columns, those that start with _ but not with ``keep``."""
    shown = [c for c in df.columns if not c.startswith("_") or c.startswith(keep)]
    return df.select(F.to_json(F.struct(*shown)).alias("value"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work that a resumed run still has to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(work: DataFrame, folder: str, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, score) for all work: only what the cache in ``folder`` lacks is scored, and then added to it.

    Keys should name everything that a score depends on, such as query, document, variant and length limit.
    """
    spark = work.sparkSession
    unique = work.dropDuplicates(keys)
    missing = pending(unique, spark.read.parquet(folder), keys) if exists(spark, folder) else unique
    score(missing).select(*keys, "score").write.mode("append").parquet(folder)
    return work.select(*keys).join(spark.read.parquet(folder).dropDuplicates(keys), keys)


def fingerprint(settings: dict) -> str:
    """The first 12 digits of the SHA-256 of the settings as canonical JSON; key order doesn't matter."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]


def text_table(df: DataFrame, style: str = "markdown", *, most_rows: int = 2000) -> str:
    """A small result as markdown, csv, tsv or latex; raises beyond ``most_rows`` rather than cut."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"over {most_rows} rows: write it as a table instead")
    body = [["" if v is None else str(v) for v in r] for r in rows]
    if style == "markdown":
        return "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |" for line in [df.columns, ["-"] * len(df.columns), *body])
    if style == "latex":
        marks = str.maketrans({c: "\\" + c for c in "&%$#_{}"})
        return "\n".join(" & ".join(x.translate(marks) for x in line) + r" \\" for line in [df.columns, *body])
    mark = {"csv": ",", "tsv": "\t"}[style]
    return "\n".join(mark.join('"' + x.replace('"', '""') + '"' if any(c in x for c in (mark, '"', "\n")) else x for x in line) for line in [df.columns, *body])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``; where that is unset, a local one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marlowe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from there, so that later plans don't repeat what led to it."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def build_table(df: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Writes a table whose files are ranges of the keys, sorted within, so that scans for a key skip files and row groups; rereads it."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def weights(table: DataFrame, pairs: DataFrame, keys: list[str], default: float = 0.0) -> DataFrame:
    """Looks the weight of each pair up in a weight table; pairs without one have the default."""
    return pairs.join(table.select(*keys, "weight"), keys, "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def stamp(df: DataFrame, settings: dict, name: str) -> DataFrame:
    """One row that says what was run: name, settings' fingerprint and rows."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(fingerprint(settings)).alias("config"), "n_rows")
