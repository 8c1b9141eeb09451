"""Mixing sources to target weights, by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlowe.llm import common

BINS = 1024
#: Sources up to which their table, some 60 bytes a source, is broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000


def cyclic_weights(source: Column, cycle: int = 3) -> Column:
    """1, 2, .., cycle, repeating, over the sources in code-point order, null last."""
    return F.pmod(F.row_number().over(Window.orderBy(source.isNull(), source)) - 1, F.lit(cycle)) + 1


def water_fill(sources: DataFrame, *, epochs: int = 3) -> DataFrame:
    """Appends target to rows of (source, source_size, weight): a weighted share of all sizes, ``epochs`` x size at most.

    Clamping sources at their caps and sharing the excess by weight until no other source is above its own ends where
    exactly the sources with the least cap/weight are clamped. So with sources in that order, the level for the k first
    clamped is what they leave of the total over the weights of the others, and the fewest clamped sources whose
    level fits the next one's cap is the answer: running sums instead of rounds. All sizes zero: all targets zero.
    """
    ranked = sources.withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    ranked = ranked.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    fits = F.col("left_words") / F.col("left_weight") <= F.col("cap") / F.col("weight")
    first = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("left_words").alias("lw"), F.col("left_weight").alias("lg")))).over(whole)
    out = ranked.withColumn("level", first)
    after = F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"))
    start = F.struct(F.col("level.r").alias("r"), F.col("level.z").alias("z"), F.col("level.s").alias("s"))
    filled = F.col("weight") * F.col("level.lw") / F.col("level.lg")
    target = F.when(F.col("level").isNull() | (after < start), F.col("cap").cast("double")).otherwise(F.least(filled, F.col("cap").cast("double")))
    return out.withColumn("target", target).select(*sources.columns, "target")


def small(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed row for each source, marked for broadcast if its count says that it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def facts(docs: DataFrame, *, seed: int, bins: int) -> DataFrame:
    """Adds size, cls (its number of binary digits), draw (from id and text) and bin to rows of (id, text, source, ..)."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("bigint"))
    own = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return sized.withColumn("cls", F.length(F.bin("size"))).withColumn("draw", common.seeded(own, seed)).withColumn("bin", F.floor(F.col("draw") * bins).cast("int"))


def taken_by_default() -> Column:
    """Whether a document is within its class's bins, or within the groups of the next bin that fit."""
    inside = F.struct("draw", "size") <= F.struct(F.col("full.draw"), F.col("full.size"))
    return (F.col("bin") <= F.col("last_bin")) | F.coalesce((F.col("bin") == F.col("next_bin")) & inside, F.lit(False))


def fill(rows: DataFrame, *, epochs: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """From facts: a row for each source and size class that says which documents get the fractional repetition, and the exceptions.

    Documents of one source, draw and size are a group: equal rows, chance aside. The first table has source, cls,
    source_size, target, whole, last_bin, next_bin, full (the last group of next_bin that fits whole) and part (the one
    after it, of which k fit). The second has the groups (s, d, z) that are taken in part: those whose number among n is
    over low and at most high. It has a row for each class, and ``rounds`` for each source, at most.
    """
    binned = common.cut(rows.groupBy("source", "cls", "bin").agg(F.sum("size").alias("words")))  # sources x classes x bins rows at most
    sources = binned.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = water_fill(sources.withColumn("weight", cyclic_weights(F.col("source")).cast("bigint")), epochs=epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(F.lit(0)).cast("bigint")
    targets = targets.withColumn("whole", whole).withColumn("share", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s")
    inside = Window.partitionBy("source", "cls")
    running = binned.withColumn("running", F.sum("words").over(inside.orderBy("bin"))).withColumn("class_words", F.sum("words").over(inside))
    met = running.join(small(common.cut(targets)), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    met = met.withColumn("room", F.col("share") * F.col("class_words") / F.greatest("source_size", F.lit(1)))
    fits = F.col("running") <= F.col("room")
    facts_of = [F.first(c).alias(c) for c in ("source_size", "target", "whole", "share", "room")]
    bins_taken = met.groupBy("source", "cls").agg(*facts_of, F.coalesce(F.max(F.when(fits, F.col("bin"))), F.lit(-1)).alias("last_bin"), F.min(F.when(~fits, F.col("bin"))).alias("next_bin"), F.coalesce(F.max(F.when(fits, F.col("running"))), F.lit(0)).alias("got"))
    bins_taken = common.cut(bins_taken)
    edge = small(bins_taken.select(F.col("source").alias("s"), F.col("cls").alias("c"), F.col("next_bin").alias("b"), (F.col("room") - F.col("got")).alias("left_room")))
    groups = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c")) & (F.col("bin") == F.col("b"))).groupBy("s", "c", "draw", "size").agg(F.count("*").alias("n"), F.first("left_room").alias("left_room"))
    groups = groups.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("s", "c").orderBy("draw", "size")))
    some = F.floor((F.col("left_room") - F.col("upto") + F.col("n") * F.col("size")) / F.col("size")).cast("bigint")
    kept = F.col("upto") <= F.col("left_room")
    edges = groups.groupBy("s", "c").agg(F.max(F.when(kept, F.struct("draw", "size"))).alias("full"), F.min(F.when(~kept, F.struct("draw", "size", some.alias("k")))).alias("part"), F.coalesce(F.max(F.when(kept, F.col("upto"))), F.lit(0)).alias("more"))
    edges = small(common.cut(edges))
    taken = bins_taken.join(edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c")), "left").drop("s", "c")
    taken = common.cut(taken.withColumn("got", F.col("got") + F.coalesce("more", F.lit(0)) + F.coalesce(F.col("part.k") * F.col("part.size"), F.lit(0))))
    missing = taken.groupBy("source").agg(F.first("whole").alias("whole"), (F.first("share") - F.sum("got")).alias("missing"))
    classes = small(taken.select(F.col("source").alias("s"), F.col("cls").alias("c"), "last_bin", "next_bin", "full", "part", "whole"))
    met = rows.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c")))
    change = F.when(taken_by_default(), -1).otherwise(1).cast("bigint")
    in_part = F.coalesce((F.col("draw") == F.col("part.draw")) & (F.col("size") == F.col("part.size")), F.lit(False))
    open_rows = met.withColumn("sign", change).where(((F.col("sign") < 0) | (F.col("whole") < epochs)) & (F.col("size") > 0) & ~in_part).select("source", "size", "draw", "sign")
    exceptions = taken.where("part.k > 0").select(F.col("source").alias("s"), F.col("part.draw").alias("d"), F.col("part.size").alias("z"), F.lit(0).cast("bigint").alias("low"), F.col("part.k").alias("high"))
    missing, changed = common.cut(missing.select(F.col("source").alias("s"), "missing")), None
    for _ in range(rounds):
        gap = F.abs(F.col("sign") * F.col("size") - F.col("missing"))
        near = open_rows.join(small(missing), F.col("source").eqNullSafe(F.col("s"))).where(gap < F.abs("missing"))
        if changed is not None:
            near = near.join(small(changed.select(F.col("source").alias("s2"), F.col("draw").alias("d2"), F.col("size").alias("z2"))), F.col("source").eqNullSafe(F.col("s2")) & (F.col("draw") == F.col("d2")) & (F.col("size") == F.col("z2")), "left_anti")
        best = near.groupBy("source").agg(F.min(F.struct(gap.alias("gap"), F.col("draw"), F.col("size"), F.col("sign"))).alias("best"))
        best = common.cut(best.select("source", "best.draw", "best.size", "best.sign"))
        words = best.select("source", (F.col("size") * F.col("sign")).alias("words"))
        missing = common.cut(missing.join(small(words), F.col("source").eqNullSafe(F.col("s")), "left").select("s", (F.col("missing") - F.coalesce("words", F.lit(0))).alias("missing")))
        changed = best if changed is None else common.cut(changed.unionByName(best))
    if changed is not None:
        one, rest = F.lit(1).cast("bigint"), F.lit(2**62).cast("bigint")
        exceptions = exceptions.unionByName(changed.select(F.col("source").alias("s"), F.col("draw").alias("d"), F.col("size").alias("z"), F.when(F.col("sign") < 0, one).otherwise(one - 1).alias("low"), F.when(F.col("sign") < 0, rest).otherwise(one).alias("high")))
    exceptions = common.cut(exceptions)
    sized = rows.join(small(exceptions), group_key()).groupBy("s", "d", "z", "low", "high").agg(F.count("*").alias("n"))
    return taken.select("source", "cls", "source_size", "target", "whole", "last_bin", "next_bin", "full"), common.cut(sized)


def group_key() -> Column:
    return F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("d")) & (F.col("size") == F.col("z"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds number, from 1, among the rows of a group, by the whole hash of all columns; rows that are equal in all come in any order.

    A group may be a large part of all rows, so it is numbered in pieces of a 256th of its hashes, and equal rows in
    pieces by the input's partitions: no order but that of equal rows depends on these.
    """
    keys = ["s", "d", "z"]
    placed = common.cut(rows.withColumn("_hash", F.xxhash64(*rows.columns)).withColumns({"_byte": F.shiftrightunsigned("_hash", 56), "_part": F.spark_partition_id()}))
    counts = placed.groupBy(*keys, "_byte", "_hash", "_part").agg(F.count("*").alias("_rows"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_rows").over(upto(*keys, "_byte").orderBy("_hash", "_part")), F.lit(0))
    bytes_ = counts.groupBy(*keys, "_byte").agg(F.sum("_rows").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(upto(*keys).orderBy("_byte")), F.lit(0)))  # 256 rows a group at most
    same = lambda *by: F.col("s").eqNullSafe(F.col("_s")) & reduce(lambda a, c: a & (F.col(c) == F.col(f"_{c}_")), by, F.lit(True))
    known = lambda df, *by: df.select(F.col("s").alias("_s"), *[F.col(c).alias(f"_{c}_") for c in by], *[c for c in df.columns if c not in ("s", *by)])
    starts = counts.withColumn("_inside", inside).join(known(bytes_, "d", "z", "_byte"), same("d", "z", "_byte")).select(*keys, "_hash", "_part", (F.col("_before") + F.col("_inside")).alias("_start"))
    local = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_hash", "_part").orderBy("_byte")))
    met = local.join(known(starts, "d", "z", "_hash", "_part"), same("d", "z", "_hash", "_part"))
    return met.withColumn("number", F.col("_start") + F.col("_at")).select(*rows.columns, "number")


def copies(rows: DataFrame, taken: DataFrame, exceptions: DataFrame, *, epochs: int) -> DataFrame:
    """Appends source_size, target and copies to facts, whatever other columns they have."""
    known = small(taken.withColumnsRenamed({"source": "s0", "cls": "c0"}))
    met = rows.join(known, F.col("source").eqNullSafe(F.col("s0")) & (F.col("cls") == F.col("c0"))).withColumn("_by_default", taken_by_default())
    met = met.select(*rows.columns, "source_size", "target", "whole", "_by_default").join(small(exceptions), group_key(), "left")

    def counted(some: DataFrame, number: Column) -> DataFrame:
        extra = F.when(F.col("low").isNull(), F.col("_by_default")).otherwise((number > F.col("low")) & (number <= F.col("high"))).cast("bigint")
        n = F.least(F.col("whole") + extra, F.lit(epochs).cast("bigint"))
        return some.withColumn("copies", n).select(*rows.columns, "source_size", "target", "copies")

    if exceptions.where("n > 1").limit(1).count() == 0:
        return counted(met, F.lit(1))
    repeated = F.coalesce(F.col("n"), F.lit(1)) > 1
    return counted(met.where(~repeated), F.lit(1)).unionByName(counted(numbered(met.where(repeated)), F.col("number")))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 3, seed: int = 17, bins: int = BINS, rounds: int = 3) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row: how often the mix takes each document.

    size counts a text's words (null and empty: 0). Weights are ``cyclic_weights``, targets ``water_fill``'s. A source
    whose target is e times its size takes each document floor(e) times, and for the fractional repetition once more
    those whose seeded hashes fall into the first of ``bins`` bins, class of like sizes by class, as far as they fit the
    fraction; of the first bin that doesn't fit those in the order of their hashes that do. Up to ``rounds`` single
    documents of a source are then added or left out again, each the one whose words come closest to what is missing or
    too much. No document is taken over ``epochs`` times. Reruns agree, in whatever order rows come.

    Null sources are one source of their own, the last. Hashes are of id and text, so null and repeated ids with
    different texts are dealt with one by one. Rows of one source, id and text (or of equal hashes and sizes) are a group
    that may be taken in part, as many as fit. An empty table stays empty. Other columns are left out. Texts of any
    length count whole. Sums are pre-aggregated before they are shuffled, and the tables that meet the documents have
    rows for sources, not documents.
    """
    rows = facts(common.pick(docs, id=id_col, text=text_col, source=source_col), seed=seed, bins=bins).drop("text")
    rows = common.cut(rows)
    return copies(rows, *fill(rows, epochs=epochs, rounds=rounds), epochs=epochs).select("id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 3, seed: int = 17, bins: int = BINS, rounds: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan_mix`` takes it, with their own columns only.

    Of rows with one source, id and text that differ elsewhere, a hash of all columns says which are taken.
    """
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    keys = common.pick(docs, id=id_col, text=text_col, source=source_col).columns

    def at(name: str) -> Column:
        exact = [i for i, n in enumerate(docs.columns) if n == name] or [i for i, n in enumerate(docs.columns) if n.lower() == name.lower()]
        return F.col(f"_{exact[0]}")

    rows = facts(plain.withColumns(dict(zip(keys, map(at, (id_col, text_col, source_col)), strict=True))), seed=seed, bins=bins).drop("text")
    known = common.cut(rows.select("id", "source", "size", "cls", "draw", "bin"))
    every = copies(rows, *fill(known, epochs=epochs, rounds=rounds), epochs=epochs)
    return every.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*plain.columns).toDF(*docs.columns)
