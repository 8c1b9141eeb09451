"""Hand-checked cases of unit-level evaluation, padded pools and judge answers: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from marlowe.operators import navigate, units
from marlowe.plans import evaluation

RUN, LINKS, GOLD = "qid INT, unit STRING, rank INT, score DOUBLE", "unit STRING, article INT, weight DOUBLE", "qid INT, article INT"


def tables(spark):
    run = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.9), (1, "c", 3, 0.1), (2, "a", 1, 0.5)], RUN)
    links = spark.createDataFrame([("a", 7, 0.5), ("b", 8, 1.0), ("b", 7, 0.25), ("c", 9, 1.0)], LINKS)
    return run, links, spark.createDataFrame([(1, 8), (1, 9), (1, 10), (1, 8), (2, 7), (3, 7)], GOLD)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_articles_and_sets(spark):
    run, links, gold = tables(spark)
    articles = units.article_run(run, links)
    assert rows(articles, "qid", "article", "rank") == [(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 7, 1)]
    got = {(r.qid, r.k): (r.recall, r.hit, r.jaccard) for r in units.set_metrics(articles, gold, [2]).collect()}
    assert got == {(1, 2): (1 / 3, 1.0, 1 / 4), (2, 2): (1.0, 1.0, 1.0), (3, 2): (0.0, 0.0, 0.0)}
    assert rows(units.units_to_cover(run, links, gold), "qid", "units") == [(1, None), (2, 1), (3, None)]
    assert rows(units.missed_gold(articles, gold, links, 2), "qid", "article", "miss_class", "entire_miss") == [(1, 10, "ABSENT", False), (1, 9, "BEYOND_POOL", False), (3, 7, "BEYOND_POOL", True)]
    assert rows(units.unit_context(run, links, gold, [1]), "qid", "n_articles", "n_gold", "precision", "units_per_article") == [(1, 1, 0, 0.0, 1.0), (2, 1, 1, 1.0, 1.0), (3, 0, 0, 0.0, None)]
    assert rows(units.unit_relevance(run, links, gold), "qid", "unit", "strict", "lenient")[1] == (1, "b", 1.0, 1.0)


def test_empty_run(spark):
    run, links, gold = tables(spark)
    none = run.where("false")
    assert {r.recall for r in units.set_metrics(units.article_run(none, links), gold, [1]).collect()} == {0.0}
    assert units.precision_ceiling(units.article_run(none, links), gold, 10).count() == 0
    assert rows(units.padding_expectation(units.article_run(none, links), gold, links, 1, 10), "qid", "expected_recall") == [(1, 2 / 3), (2, 1.0), (3, 1.0)]


def test_threshold(spark):
    data = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.6, 1), (0.9, 1), (0.9, None), (None, None)], "s DOUBLE, y INT")
    got = units.calibrate_threshold(data, "s", "y", [0.2, 0.5, 0.6]).where("chosen").collect()
    assert [(r.tau, r.accuracy, r.negative_share) for r in got] == [(0.5, 1.0, 0.5)]
    assert units.calibrate_threshold(data.where("false"), "s", "y", [0.5]).first().accuracy is None


def test_tiers_and_pool(spark):
    form = "qid INT, doc_id INT, score DOUBLE, rank INT"
    a, b = spark.createDataFrame([(1, 5, 0.9, 1)], form), spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2), (1, 7, 0.7, 3), (2, 6, 0.1, 1)], form)
    assert rows(navigate.tiered([a, b], 2), "qid", "doc_id", "tier", "rank") == [(1, 5, 0, 1), (1, 6, 1, 2), (2, 6, 1, 1)]
    new = spark.createDataFrame([(1, 7, 0.3)], "qid INT, doc_id INT, score DOUBLE")
    assert rows(navigate.rerank_pool(b, new), "qid", "rank", "doc_id") == [(1, 1, 7), (1, 2, 5), (1, 3, 6), (2, 1, 6)]


def test_judge_answers_and_chains(spark):
    d = spark.createDataFrame([("Grade: 7", 0), ("none", 1), (None, 2), ("2/3", 3)], "t STRING, i INT")
    assert [r.g for r in d.select("i", navigate.first_digit(F.col("t"), 0, 3).alias("g")).orderBy("i").collect()] == [3, None, None, 2]
    assert [r.a for r in d.select("i", navigate.abstains(F.col("t"), ["none"]).alias("a")).orderBy("i").collect()] == [False, True, True, False]
    p = spark.createDataFrame([(["x", "x", "y", "z"], 0), ([], 1), (None, 2), (["x"], 3)], "p ARRAY<STRING>, i INT")
    assert [r.c for r in p.select("i", navigate.header_chain(F.col("p")).alias("c")).orderBy("i").collect()] == [["x", "y"], [], None, []]


def test_a_run_of_articles_makes_no_judgements(spark, monkeypatch):
    def refuse(self):
        raise AssertionError("judgements were made")

    monkeypatch.setattr(evaluation.Base, "qrels", refuse)
    assert evaluation.article_run(spark, "/root/testdata/sf0.001").columns == ["qid", "article", "score", "first_unit", "rank"]
