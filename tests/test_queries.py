"""Every query that has SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from marlowe.plans import agents, analysis, articles, corpus, correction, evaluation, inference, layout, locating, navigation, panels, passages, ranking, registry, reports, stemming, storage, trees, walks  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in registry.QUERIES.items() if n in registry.SQL and f.__module__.endswith(("agents", "analysis", "articles", "corpus", "correction", "evaluation", "inference", "layout", "locating", "navigation", "panels", "passages", "ranking", "reports", "stemming", "storage", "trees", "walks"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return repr([round(float(v), 5) if isinstance(v, float) else v for v in row])


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    mine = registry.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    answer = duck.execute(registry.SQL[name])
    theirs = [c[0] for c in answer.description]
    assert sorted(theirs) == columns
    assert sorted(key(r[c] for c in columns) for r in mine.collect()) == sorted(key(r[theirs.index(c)] for c in columns) for r in answer.fetchall())
