"""Readers: JSON lines, CSV with renames, concatenated extended JSON, result folders, judgement files, dirty scalars."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, columns: list[str], *, not_null: str | None = None) -> DataFrame:
    """The named columns, and only rows with ``not_null``; both reach the scan."""
    rows = spark.read.parquet(path).select(*columns)
    return rows.where(F.col(not_null).isNotNull()) if not_null else rows


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A row for each line; blank and malformed lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def csv(spark: SparkSession, path: str, schema: T.StructType | str, rename: dict[str, str] | None = None) -> DataFrame:
    """With a header and quoted line breaks; columns renamed."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"').withColumnsRenamed(rename or {})


def records(text: str) -> Iterator[str]:
    """The top-level objects of concatenated JSON, as text: braces are balanced outside strings, escapes are honoured.

    Text between objects is ignored and an unfinished last object is left out.
    """
    depth, start, quoted, escaped = 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : i + 1]


def unwrap(value):
    """Typed wrappers such as ``{"$numberLong": "3"}`` as plain values; NaN becomes null."""
    if isinstance(value, dict):
        if len(value) == 1:
            ((key, inner),) = value.items()
            if key in ("$numberInt", "$numberLong"):
                return int(inner)
            if key in ("$numberDouble", "$numberDecimal"):
                number = float(inner)
                return None if number != number else number
            if key in ("$oid", "$date"):
                return unwrap(inner)
        return {k: unwrap(v) for k, v in value.items()}
    if isinstance(value, list):
        return [unwrap(v) for v in value]
    return None if isinstance(value, float) and value != value else value


def concatenated_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of files that hold objects one after the other or in one array, with typed wrappers; bad objects are skipped.

    A file is read by one task, as an object's limits can only be known from the file's start: many files of
    moderate size spread, one very large file doesn't.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                held = []
                for r in records(text):
                    try:
                        held.append(json.dumps(unwrap(json.loads(r)), ensure_ascii=False))
                    except ValueError:
                        continue
                    if len(held) == 1000:
                        yield pd.DataFrame({"record": held})
                        held = []
                if held:
                    yield pd.DataFrame({"record": held})

    found = spark.read.text(path, wholetext=True).mapInPandas(run, "record STRING")
    return found.select(F.from_json("record", kind).alias("r")).select("r.*")


def to_int(value: Column) -> Column:
    """A dirty scalar's text as a long: true and false as 1 and 0, whole decimals cut, NaN, blanks and junk null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text == "true", 1).when(text == "false", 0).when(text.rlike(r"^[+-]?\d{1,18}$"), text.cast("bigint")).when(text.rlike(r"^[+-]?\d{1,15}\.\d+$"), text.cast("double").cast("bigint"))


def to_text(value: Column) -> Column:
    """Trimmed; blanks, nan and null as null."""
    text = F.trim(value.cast("string"))
    return F.when(F.lower(text).isin("", "nan", "null", "none"), None).otherwise(text)


def to_box(value: Column) -> Column:
    """Four numbers from an array written as text; null if there aren't four."""
    numbers = F.regexp_extract_all(value, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)).cast("array<double>")
    return F.when(F.size(numbers) == 4, numbers)


def int_list(value: Column) -> Column:
    """The text ``1, 2,x,3`` as [1, 2, 3]: items of digits only."""
    return F.transform(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("bigint"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ids) from JSON objects that map a query to its ids; files that share a query are merged, ids distinct and sorted.

    Files whose names start with _ or are schema.json are left out.
    """
    name = F.substring_index(F.input_file_name(), "/", -1)
    files = spark.read.text(path, wholetext=True).where(~name.startswith("_") & (name != "schema.json"))
    pairs = files.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("qid", "some")).select("qid", F.explode("some").alias("id"))
    return pairs.groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def results(spark: SparkSession, path: str, schema: str, keys: list[str], *, need: str) -> DataFrame:
    """Result records of a folder; unparsable ones and those without ``need`` are skipped, of equal keys the last file's stays."""
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED").where(F.col(need).isNotNull())
    whole = F.struct(*rows.columns)
    return rows.withColumn("_file", F.input_file_name()).groupBy(*keys).agg(F.max_by(whole, "_file").alias("x")).select("x.*")
