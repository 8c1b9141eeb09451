"""Corpus construction: repeated lines, sessions, link ladders, citation edges, canonical rows, drift, n-gram likeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 149, least: int = 3) -> DataFrame:
    """(line, n_docs): trimmed non-empty lines of at most ``longest`` characters that stand in ``least`` documents or more.

    Lines are made distinct within a document before they are shuffled, so the count needs no second distinct.
    """
    line = F.explode(F.array_distinct(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)))).alias("line")
    some = docs.select(id_col, line).where((F.col("line") != "") & (F.char_length("line") <= longest)).distinct()
    return some.groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def sessions(rows: DataFrame, by: str, order: str, starts: Column, text_col: str) -> DataFrame:
    """Groups of rows from each marker to the next: (by, part, first_at, last_at, n, text), texts joined by line ends in order.

    Rows before the first marker make part 0.
    """
    part = F.sum(starts.cast("bigint")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumn("part", part).groupBy(by, "part")
    out = held.agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))).alias("all"))
    return out.select(by, "part", "first_at", "last_at", "n", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("text"))


def ladder(left: DataFrame, right: DataFrame, steps: list[tuple[str, list[str]]], target: str) -> DataFrame:
    """Links each left row at the first step whose keys meet exactly one target: adds ``linked`` and ``step``, null where none does.

    Keys are column names that both sides have. The right side is reduced to its unique keys before each join.
    """
    out = left
    for i, (_, keys) in enumerate(steps):
        unique = right.groupBy(*keys).agg(F.min(target).alias(f"_t{i}"), F.max(target).alias("_other")).where(F.col(f"_t{i}") == F.col("_other")).drop("_other")
        out = out.join(unique, keys, "left")
    linked = F.coalesce(*[F.col(f"_t{i}") for i in range(len(steps))])
    step = reduce(lambda w, i: w.when(F.col(f"_t{i}").isNotNull(), steps[i][0]), range(1, len(steps)), F.when(F.col("_t0").isNotNull(), steps[0][0]))
    return out.select(*left.columns, linked.alias("linked"), step.alias("step"))


def citations(docs: DataFrame, pattern: str, *, id_col: str, text_col: str) -> DataFrame:
    """(id, target, first_at): each target once, in the order in which it is first cited."""
    found = docs.select(id_col, F.posexplode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)))).alias("first_at", "target"))
    return found.select(id_col, "target", F.col("first_at").cast("bigint"))


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """For every node: how many it cites and is cited by; one shuffle over both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("n_cites"), F.sum("x.i").alias("n_cited_by"))


def canonical(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is greatest in ``order``; an aggregate, so a hot key is reduced before it is shuffled."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("x")).select("x.*")


def ngrams(text: Column, n: int = 4) -> Column:
    """All runs of n characters, repeats included; none for shorter texts."""
    last = F.char_length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_cosine(pairs: DataFrame, keys: list[str], a: str, b: str, n: int = 4) -> DataFrame:
    """Cosine of the n-gram counts of columns a and b for each row of unique ``keys``; null if either is too short."""
    grams = reduce(DataFrame.unionByName, [pairs.select(*keys, F.explode(ngrams(F.col(c), n)).alias("g"), F.lit(s).alias("side")) for s, c in enumerate((a, b))])
    counts = grams.groupBy(*keys, "g").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = counts.groupBy(*keys).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    some = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx")) / F.sqrt(F.col("yy")))
    return pairs.select(*keys).join(sums, keys, "left").select(*keys, some.alias("cosine"))


def needles(text: Column, width: int = 80, stride: int = 60) -> Column:
    """Pieces of ``width`` characters at every stride, and the tail; the whole text if it is shorter."""
    n = F.char_length(text)
    at = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), F.lit(stride))
    return F.array_distinct(F.concat(F.transform(at, lambda i: F.substring(text, i + 1, F.lit(width))), F.array(F.substring(text, F.greatest(n - width + 1, F.lit(1)), F.lit(width)))))


def numbered(ordered: DataFrame, *order: str, new: str = "id") -> DataFrame:
    """Appends ids from 1 to rows that are sorted by range partitions: one row a partition meets on a single task, never the rows."""
    marked = ordered.withColumn("_p", F.spark_partition_id())
    counts = marked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return marked.join(F.broadcast(before), "_p").withColumn(new, F.col("_before") + local).drop("_p", "_before")  # a row for each partition


def id_map(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n_sharing, bijective): how many rows share each value of b."""
    return pairs.join(pairs.groupBy(b).agg(F.count("*").alias("n_sharing")), b).withColumn("bijective", F.col("n_sharing") == 1).select(a, b, "n_sharing", "bijective")


def null_text_class(no: Column) -> Column:
    """Why an article has no text, by its number; null numbers are other."""
    return F.when(F.contains(no, F.lit("_REGION")) | F.contains(no, F.lit("_COMMUNAUTE")), "regional_variant").when(F.contains(no, F.lit("-")), "range_header").otherwise("other")


def sanitised(rows: DataFrame, *, drop: list[str], column: str, values: list) -> DataFrame:
    """Without some columns and without the rows of some values; rows of a null value stay."""
    return rows.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))).drop(*drop)


def gold_buckets(edges: DataFrame, keys: list[str], target: str, *, strict: Column, lenient: Column) -> DataFrame:
    """For each key: its distinct targets, those under two conditions, and the strictest condition that all (linked: some) meet."""
    one = edges.groupBy(*keys, target).agg(F.max(F.coalesce(strict, F.lit(False))).alias("s"), F.max(F.coalesce(lenient, F.lit(False))).alias("l"))
    n, s, le = F.count("*"), F.count_if("s"), F.count_if("l")
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("s"), F.col(target)))), ",")
    out = one.groupBy(*keys).agg(n.alias("n_gold"), s.alias("n_strict"), le.alias("n_lenient"), F.nullif(names, F.lit("")).alias("strict"))
    bucket = F.when(F.col("n_strict") == F.col("n_gold"), "strict").when(F.col("n_lenient") == F.col("n_gold"), "lenient").when(F.col("n_lenient") > 0, "linked").otherwise("none")
    return out.withColumn("bucket", bucket)
