import json
import os

import pytest
from pyspark.sql import functions as F

from marlowe.sources import readers, writers


def test_records_balance_braces_outside_strings():
    assert list(readers.records('[{"a": "}{\\""}, {"b": {"c": 1}}] {"open": 1')) == ['{"a": "}{\\""}', '{"b": {"c": 1}}']


def test_concatenated_json_unwraps_and_skips_bad_objects(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": {"$numberInt": "7"}, "v": {"$numberDouble": "NaN"}}{"id": bad}{"id": {"$numberLong": "8"}, "v": 1.5}')
    rows = readers.concatenated_json(spark, str(tmp_path / "x.json"), "id BIGINT, v DOUBLE").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(7, None), (8, 1.5)]


def test_dirty_scalars(spark):
    d = spark.createDataFrame([("true", "nan"), ("12", " x "), ("3.9", ""), ("NaN", None), (None, "null"), ("x", "y")], "a STRING, b STRING")
    got = [tuple(r) for r in d.select(readers.to_int(F.col("a")), readers.to_text(F.col("b"))).collect()]
    assert got == [(1, None), (12, "x"), (3, None), (None, None), (None, None), (None, "y")]
    row = spark.range(1).select(readers.to_box(F.lit("[1, 2.5, -3, 4]")), readers.to_box(F.lit("[1]")), readers.int_list(F.lit("1, 2,x,3"))).first()
    assert tuple(row) == ([1.0, 2.5, -3.0, 4.0], None, [1, 2, 3])


def test_jsonl_csv_judgements_results(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\nbroken\n')
    assert sorted(r.id for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id BIGINT").where("id IS NOT NULL").collect()) == [1, 2]
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines ""q"""\n')
    assert tuple(readers.csv(spark, str(tmp_path / "a.csv"), "id BIGINT, name STRING", {"name": "label"}).first()) == (1, 'two\nlines "q"')
    folder = tmp_path / "gt"
    folder.mkdir()
    (folder / "a.json").write_text('{"q1": [3, 1], "q2": [5]}')
    (folder / "b.json").write_text('{"q1": [2, 3]}')
    (folder / "schema.json").write_text('{"q9": [1]}')
    assert {r.qid: r.ids for r in readers.judgements(spark, str(folder)).collect()} == {"q1": [1, 2, 3], "q2": [5]}
    runs = tmp_path / "runs"
    runs.mkdir()
    for name, body in {"1.json": {"s": "a", "x": 1}, "2.json": {"s": "a", "x": 2}, "3.json": {"s": "b"}}.items():
        (runs / name).write_text(json.dumps(body))
    (runs / "4.json").write_text("{nope")
    assert [tuple(r) for r in readers.results(spark, str(runs), "s STRING, x BIGINT", ["s"], need="x").collect()] == [("a", 2)]


def test_export_cache_resume_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a|b"), (2, None)], "id BIGINT, t STRING")
    assert writers.export(d, str(tmp_path / "out")) == 2
    assert [r.id for r in writers.pending(d, d.where("id = 1"), ["id"]).collect()] == [2]
    calls = []

    def score(x):
        calls.append(x.count())
        return x.withColumn("score", F.col("id") * 1.0)

    for _ in range(2):
        assert sorted(tuple(r) for r in writers.cached(d, str(tmp_path / "cache"), ["id"], score).collect()) == [(1, 1.0), (2, 2.0)]
    assert calls == [2, 0]
    assert writers.text_table(d) == "| id | t |\n| - | - |\n| 1 | a\\|b |\n| 2 |  |"
    with pytest.raises(ValueError):
        writers.text_table(d, most_rows=1)
    assert writers.fingerprint({"a": 1, "b": 2}) == writers.fingerprint({"b": 2, "a": 1})
    writers.append(d, str(tmp_path / "log"))
    writers.append(d, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4 and os.path.isdir(tmp_path / "log")
    assert json.loads(writers.result_json(d.withColumn("_x", F.lit(1)).withColumn("_trec_y", F.lit(2)).limit(1)).first().value) == {"id": 1, "t": "a|b", "_trec_y": 2}
