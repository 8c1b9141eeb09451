"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the corpus contracts: runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``new=old`` projections by exact name, so that an extra ``DOC_ID`` or a repeated column can't clash.

    An exact match wins over one in another case, the first over later ones.
    """
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])

    def at(name: str) -> int:
        for same in (lambda x: x == name, lambda x: x.lower() == name.lower()):
            for i, x in enumerate(names):
                if same(x):
                    return i
        raise ValueError(f"no column {name!r} among {names}")

    return plain.select(*[F.col(f"_{at(old)}").alias(new) for new, old in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: ``spark.checkpoint.dir``, or where unset the context's own.

    Where there is neither, a local master gets a new local folder; on a cluster that is a ValueError, as each machine would write to its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="marlowe-")
            spark.sparkContext.setCheckpointDir(found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + at[5:] if at.startswith("file:/") and not at.startswith("file://") else at


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``fresh_dir`` named, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_checkpoints(spark: SparkSession):
    """Within it checkpoints go to a folder of their own, which is deleted at the end: what they led to must be written by then."""
    outer, folder = shared_dir(spark), fresh_dir(spark, "checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    try:
        yield
    finally:
        spark.sparkContext.setCheckpointDir(outer)
        remove(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, without copies, so that few texts at a time become Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_text(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], rows: Callable[[list[str | None]], list]) -> DataFrame:
    """Appends ``fields``, computed by ``rows`` from each Arrow batch of texts, to all columns of ``df``.

    ``rows`` returns one pyarrow array or list for each field. Names in ``fields`` must not be in ``df``.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    where = df.columns.index(text)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for _, t in fields]
        for batch in slices(batches):
            new = rows(batch.column(where).to_pylist())
            new = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def crc32_text(column: Column) -> Column:
    """crc32 of a column's text form, null for null."""
    return F.crc32(column.cast("string").cast("binary"))


def seeded(column: Column, seed: int, digits: int = 13) -> Column:
    """A uniform number in [0, 1) from a column's text form, the same in any engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint").cast("double") / F.lit(float(16**digits))


#: Labels up to which their counts are broadcast.
MOST_LABELS = 100_000


def bounded_sample(labelled: DataFrame, key: str, label: str, most: int, seed: int, made: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """``most`` rows at most, the labels as even as their counts allow; which rows, the key's hash decides.

    Each label, of any number of them, is thinned to its even share, about 0.95 of ``most`` in all; should the thinned
    rows be more, those with the least hashes stay, so that reruns agree. ``made`` changes the thinned rows before they
    are ranked, to what is small enough for the driver; it keeps the columns _draw and ``key``.
    """
    counts = cut(labelled.groupBy(F.col(label).alias("_label")).count())
    kinds = counts.count()
    counts = F.broadcast(counts) if kinds <= MOST_LABELS else counts
    if not kinds:
        return made(labelled.withColumn("_draw", F.lit(0.0))).drop("_draw").limit(0)
    rate = F.lit(most / kinds * 0.95) / F.col("count")
    met = labelled.withColumn("_draw", seeded(F.col(key), seed)).join(counts, F.col(label) == F.col("_label"))
    return made(met.where(F.col("_draw") < rate).select(*labelled.columns, "_draw")).orderBy("_draw", key).limit(most).drop("_draw")
