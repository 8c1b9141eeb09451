"""A Merkle manifest of a data set: a tree of three-way runs for each source, and one more over the sources' roots.

Built bottom-up, a persisted level at a time: each row of a level is a run, with its children's digests and its own. Proofs
go top-down: a level joins its runs to their own proofs, and each child puts its siblings before the proof that it inherits.
Rows are (tree, pos, n, h): the tree's key, the node's place in its level, the level's length, the digest in hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlowe.llm import common

WAY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field's part of a leaf: - for null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(parts: Column) -> Column:
    return F.sha2(parts.cast("binary"), 256)


def leaf(**values: Column) -> Column:
    return digest(F.concat(*[field(values[f]) for f in FIELDS]))


def ranked(nodes: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """Adds pos (from 0) and n to rows of (tree, ..), each tree's in the given order, without a task for a whole tree.

    Rows are dealt by ranges of tree and order, sorted and written; a row's place is its place in its file plus the
    tree's rows in the files before it. Rows that are alike in all of ``order`` must be alike in what is kept of them:
    a hash of the row's number comes last, which spreads a great many of them over several ranges.
    """
    spark = nodes.sparkSession
    keys = [F.col("tree"), *order, F.xxhash64(F.col("_any"))]
    dealt = nodes.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_any")
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn("_part", F.shiftright("_at", 33))
    each = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))  # a row for each tree and file
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    return rows.join(starts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n of them."""
    count = 0
    while n > 1:
        n, count = -(-n // WAY), count + 1
    return count


def build(leaves: DataFrame, folder: str) -> list[DataFrame]:
    """The levels above the leaves (tree, pos, n, h), lowest first, each written to ``folder``: (tree, pos, n, h, kids)."""
    spark, levels, below = leaves.sparkSession, [], leaves
    for i in range(levels_of(leaves.agg(F.max("n")).first()[0] or 0)):
        run = F.col("pos").alias("at"), F.col("h").alias("h")
        runs = below.where("n > 1").groupBy("tree", F.floor(F.col("pos") / WAY).alias("pos"), F.ceil(F.col("n") / WAY).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*run))), lambda x: x["h"]).alias("kids"))
        runs.withColumn("h", digest(F.array_join("kids", ""))).write.parquet(f"{folder}/{i}")
        below = spark.read.parquet(f"{folder}/{i}")
        levels.append(below)
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, h): what remains of each tree."""
    out = leaves.where("n = 1").select("tree", "h")
    for x in levels:
        out = out.unionByName(x.where("n = 1").select("tree", "h"))
    return out


def with_siblings(kids: Column, slot: Column, proof: Column) -> Column:
    """A child's proof: the run's others, those before it and those after, then the run's own proof."""
    left, right = F.slice(kids, F.lit(1), slot), F.slice(kids, slot + 2, F.lit(WAY))
    return F.concat(F.array(F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))), proof)


def push(levels: list[DataFrame], top: DataFrame, folder: str) -> DataFrame | None:
    """(tree, pos, kids, proof) of the runs over the leaves, from ``top`` (tree, proof): the proof of each tree's root.

    None if no tree has two leaves. A level's proofs are written once the level above has its own.
    """
    spark, below = levels[0].sparkSession if levels else None, None
    for i in reversed(range(len(levels))):
        runs = levels[i]
        rooted = runs.where("n = 1").join(top, "tree").select("tree", "pos", "kids", "proof")
        if below is not None:
            handed = below.select("tree", "kids", "proof", F.col("pos").alias("up")).select("tree", "up", "proof", "kids", F.posexplode("kids").alias("slot", "_h"))
            handed = handed.select("tree", (F.col("up") * WAY + F.col("slot")).alias("pos"), with_siblings(F.col("kids"), F.col("slot"), F.col("proof")).alias("proof"))
            rooted = rooted.unionByName(runs.where("n > 1").select("tree", "pos", "kids").join(handed, ["tree", "pos"]))
        rooted.write.parquet(f"{folder}/{i}")
        below = spark.read.parquet(f"{folder}/{i}")
    return below


def prove(leaves: DataFrame, levels: list[DataFrame], top: DataFrame, folder: str) -> DataFrame:
    """The leaves, with all their columns, and proof: array<struct<l, r>> from the lowest run to the root."""
    alone = leaves.where("n = 1").join(top, "tree")
    if not levels:
        return alone
    runs = push(levels, top, folder).select("tree", F.col("pos").alias("_up"), F.col("kids").alias("_kids"), F.col("proof").alias("_proof"))
    found = leaves.where("n > 1").withColumn("_up", F.floor(F.col("pos") / WAY)).join(runs, ["tree", "_up"])
    slot = (F.col("pos") % WAY).cast("int")
    return alone.unionByName(found.withColumn("proof", with_siblings(F.col("_kids"), slot, F.col("_proof"))).drop("_up", "_kids", "_proof"))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["l"], s["r"])), ""))


def manifest(docs: DataFrame, *, tampered: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, check, subroot, root, proof) of every row, each source's leaves in ascending order of doc_id.

    ``check`` is the leaf's digest with the text that ``tampered`` gives (a column over doc_id and text; none: the text
    itself). Null ids come first, of equal ids the lesser digest; repeated rows are leaves of their own. Null fields, the
    source too, are - in the leaf; null is a source by itself and comes before the others, empty texts are 0: and long ones
    count whole. An empty table gives no rows. Columns beyond the five that a leaf takes are left out, whatever their names.
    """
    spark = docs.sparkSession
    folder = common.fresh_dir(spark, "merkle")
    rows = common.pick(docs, **{f: f for f in FIELDS})
    values = {f: F.col(f) for f in FIELDS}
    checked = F.col("text") if tampered is None else tampered
    rows.select(F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source")).alias("tree"), "doc_id", leaf(**values).alias("h"), leaf(**(values | {"text": checked})).alias("check")).write.parquet(f"{folder}/digests")
    leaves = ranked(spark.read.parquet(f"{folder}/digests"), [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("check").asc()], f"{folder}/leaves")
    levels = build(leaves.select("tree", "pos", "n", "h"), f"{folder}/up")
    subroots = tops(leaves, levels)
    over = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "h"), [F.col("of").asc()], f"{folder}/subroots")
    over_levels = build(over.select("tree", "pos", "n", "h"), f"{folder}/over")
    root = tops(over, over_levels)
    proved = prove(over, over_levels, root.select("tree", F.array().cast("array<struct<l:string,r:string>>").alias("proof")), f"{folder}/over-proofs").select(F.col("of").alias("tree"), F.col("h").alias("subroot"), "proof", F.col("tree").alias("_all"))
    proved.join(root.select(F.col("tree").alias("_all"), F.col("h").alias("root")), "_all").drop("_all").write.parquet(f"{folder}/sources")
    sources = spark.read.parquet(f"{folder}/sources")
    out = prove(leaves, levels, sources.select("tree", "proof"), f"{folder}/proofs").join(sources.select("tree", "subroot", "root"), "tree")
    return out.select(F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1)).alias("source"), "doc_id", F.col("h").alias("leaf"), "check", "subroot", "root", "proof")
