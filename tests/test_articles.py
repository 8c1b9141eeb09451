"""Hand-checked citations, resolution steps, titles and keys."""

import random

from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators import articles as art


def test_citations_and_overlaps(spark):
    text = "Selon l'article 3 de la loi, les articles 12 à 15 et art. L4-2, du présent titre; l’article précédent."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "rien"), (5, "art. 7bis art 8")], "id INT, text STRING")
    got = sorted((r["id"], r["pos"], r["raw"], r["article_no"], r["is_relative"]) for r in art.citations(df).collect())
    want = [("l'article 3 de la loi", "3", False), ("articles 12 à 15", "12", False), ("art. L4-2", "L4-2", False), ("du présent titre", None, True), ("l’article précédent", None, True)]
    assert got == [(1, k, *w) for k, w in enumerate(want)] + [(5, 0, "art. 7bis", "7bis", False), (5, 1, "art 8", "8", False)]
    assert all(text[r["start"] : r["end"]] == r["raw"] for r in art.citations(df.where("id = 1")).collect())


def test_overlapping_spans(spark):
    """Against a greedy choice of the next free span, over all orders of a few."""
    rng = random.Random(2)
    rows = [(i, [(rng.randint(0, 12), rng.randint(0, 6), k) for k in range(rng.randint(0, 7))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i INT, s ARRAY<STRUCT<start:INT,size:INT,k:INT>>")
    for r in df.select("i", "s", art.disjoint(F.col("s")).alias("d")).collect():
        left, want, free = [tuple(x) for x in r["s"]], [], 0
        while left := [x for x in left if x[0] >= free]:
            best = min(left, key=lambda x: (x[0], -x[1], x[2]))
            want.append(best)
            left.remove(best)
            free = best[0] + best[1]
        assert [tuple(x) for x in r["d"]] == want


def test_resolution_steps(spark):
    rows = spark.createDataFrame([(1, "a", "1"), (2, "a", "42"), (3, "a", "1.1.1"), (4, "b", "7"), (5, "b", "8"), (6, "c", "8"), (7, "c", "9bis"), (8, "c", "9")], "id BIGINT, law STRING, no STRING")
    citing = spark.createDataFrame([(9, "a", "1"), (9, "a", "42bis"), (9, "a", "1.1.1-3"), (9, "a", "7"), (9, "a", "7ter"), (9, "a", "8"), (5, "a", "8"), (1, "a", "1"), (9, None, "9"), (9, "a", None)], "source_id BIGINT, law STRING, article_no STRING")
    got = art.resolve(citing, rows, lambda c: F.lower(F.trim(c))).collect()
    found = {(r["source_id"], r["law"], r["article_no"]): (r["target"], r["step"]) for r in got}
    assert len(got) == 10 and found == {(9, "a", "1"): (1, 1), (9, "a", "42bis"): (2, 2), (9, "a", "1.1.1-3"): (1, 2), (9, "a", "7"): (4, 4), (9, "a", "7ter"): (4, 5), (9, "a", "8"): (None, None), (5, "a", "8"): (6, 4), (1, "a", "1"): (None, None), (9, None, "9"): (8, 4), (9, "a", None): (None, None)}


def test_titles_reset_and_lines_outside_articles(spark):
    lines = ["avant", "TITRE II", "CHAPITRE 1", "Art. 1.", "corps", "TITRE III", "reste", "Art. 2", "fin ..."]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc STRING, line INT, text STRING")
    got = sorted(art.articles(art.marked(df), "doc", "line").collect(), key=lambda r: r["part"])
    assert [(r["article_no"], r["text"], r["path"], r["depth"], r["truncated"]) for r in got] == [("1", "Art. 1.\ncorps", "TITRE II > CHAPITRE 1", 2, False), ("2", "Art. 2\nfin ...", "TITRE III", 1, True)]
    assert art.articles(art.marked(df.limit(0)), "doc", "line").count() == 0
    small = df.selectExpr("*", "8 AS size", "10 AS body")
    assert art.marked(small, size="size", body="body").where("marker IS NOT NULL").count() == 0


def test_keys(spark):
    df = spark.createDataFrame([("L1111-1_COMMUNAUTE_GERMANOPHONE", " École É̀ ﬁ "), ("42bis", None)], "no STRING, t STRING")
    assert [tuple(r) for r in df.select(art.base_no(F.col("no")), art.leading_int(F.col("no")), tx.folded_key("t")).collect()] == [("L1111", None, "ecole e fi"), (None, "42", None)]
