"""Which documents hold which texts, against brute force; and drift over more items than any block once held."""

import random

from marlowe.operators import contain
from marlowe.plans.corpus import drift


def test_holders_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["la", "loi", "Article", "décret", "x1", "é", "...", "zz-top", "mot"]
    texts = [(i, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 40)))]) if i % 9 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    probes = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(200)]
    probes += [(900 + i, t[rng.randint(0, 5) : -2]) for i, (_, t) in enumerate(texts[:80]) if t] + [(800, ""), (801, None), (802, "la"), (803, "la")]
    want = {(d, p) for d, t in texts if t is not None for p, q in probes if q is not None and q in t}
    got = contain.holders(spark.createDataFrame(texts, "doc_id INT, text STRING").repartition(3), spark.createDataFrame(probes, "probe INT, p STRING")).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    none = spark.createDataFrame([], "probe INT, p STRING")
    assert contain.holders(spark.createDataFrame(texts, "doc_id INT, text STRING"), none).count() == 0


def test_short_probes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(contain, "MOST_BYTES", 60)
    texts = [(i, f"mot{i} deux{i % 7} fin") for i in range(40)]
    probes = [(i, f"deux{i}") for i in range(20)]
    got = contain.holders(spark.createDataFrame(texts, "doc_id INT, text STRING"), spark.createDataFrame(probes, "probe INT, p STRING")).collect()
    assert set(map(tuple, got)) == {(d, p) for d, t in texts for p, q in probes if q in t}


def test_drift_of_many_items(spark):
    items = spark.range(25_000).selectExpr("id AS item_id", "concat('item number ', id, ' has the words alpha', id, ' beta gamma', id % 7, ' and some more words up to a hundred characters or so, end ', id) AS text")
    docs = items.where("item_id % 5 = 0").selectExpr("item_id AS doc_id", "CASE WHEN item_id % 10 = 0 THEN concat('x ', text, ' y') ELSE substr(text, 1, 90) END AS text")
    got = {r["status"]: r["count"] for r in drift(docs, items).groupBy("status").count().collect()}
    assert got == {"IN_TEXT": 2500, "PARTIAL": 2500, "MISSING": 20_000}


def test_texts_are_not_shuffled(spark, capsys):
    """Only candidates move: the plan's one shuffle is that of the distinct results. An id may repeat, and a null one holds nothing."""
    texts = spark.createDataFrame([(1, "le mot rare ici"), (1, "un autre texte"), (2, "rare mot"), (None, "le mot rare ici")], "doc_id INT, text STRING")
    probes = spark.createDataFrame([(7, "le mot rare"), (8, "le mot rare"), (None, "un autre texte")], "probe INT, p STRING")
    out = contain.holders(texts, probes)
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert set(map(tuple, out.collect())) == {(1, 7), (1, 8), (1, None)}
