"""Texts that are split in their tasks against the regular expression, and what is written and shuffled for a search."""

import random
import re

import pyarrow as pa

from marlowe.functions import text as tx
from marlowe.operators import contain, retrieve
from marlowe.plans import ranking

SF = "/root/testdata/sf0.001"


def test_lists_are_what_the_regular_expression_finds():
    rng = random.Random(5)
    alphabet = "ab9éœÿ×÷ßœŸñ \n.-_’ł日😀́"
    texts = [None, "", "a", "é", "a", "é ", " é", *["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]]
    want = [re.findall(tx.TOKEN, t or "") for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        assert tx.token_lists(column).to_pylist() == want
        assert tx.token_lists(column.slice(7, 500)).to_pylist() == want[7:507]
        assert tx.token_lists(column.slice(0, 2)).to_pylist() == [[], []] and tx.token_lists(column.slice(0, 0)).to_pylist() == []


def corpus(spark):
    texts = ["L'Été à l'œuvre", "ÉTÉ été 3bis", "", None, "İstanbul ÀÇ", "rien", "été l"]
    docs = spark.createDataFrame([*enumerate(texts * 30)], "doc_id BIGINT, text STRING").repartition(3)
    return docs, spark.createDataFrame([(1, "été l'œuvre"), (2, "stanbul àç"), (3, "nulle part")], "qid BIGINT, text STRING")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_unsplit_texts_give_what_tokens_give(spark):
    docs, queries = corpus(spark)
    terms, stats = retrieve.query_terms(queries), retrieve.collection(docs)
    split, whole = retrieve.tokenised(docs), retrieve.unsplit(docs)
    assert rows(retrieve.vocabulary(whole, rows=7)) == rows(retrieve.vocabulary(split, rows=7)) == rows(retrieve.document_counts(retrieve.postings(docs)))
    assert rows(retrieve.surveyed(retrieve.survey(whole))) == rows(retrieve.surveyed(retrieve.survey(split))) == rows(stats)
    assert rows(retrieve.surveyed(retrieve.survey(whole.limit(0)))) == rows(retrieve.collection(docs.limit(0))) == [(0, None)]
    assert rows(retrieve.surveyed(retrieve.survey(whole.where("tokens IS NULL")))) == [(30, None)]
    for k in (3, 500):
        want = rows(retrieve.top_k(retrieve.bm25_top(split, terms, stats, k), k))
        assert want and rows(retrieve.top_k(retrieve.bm25_top(whole, terms, stats, k), k)) == want
    assert rows(retrieve.shares(whole, terms, 0.4)) == rows(retrieve.shares(split, terms, 0.4))
    assert rows(contain.having(whole, terms)) == rows(contain.having(split, terms))


def test_a_search_writes_no_texts(spark, monkeypatch):
    """Only the vocabulary is written, not a token of each text."""
    written = []
    monkeypatch.setattr(ranking, "kept", lambda df, name: written.append(df.columns) or df)
    assert ranking.rrf_zero_missing(spark, SF).count() > 0
    assert written == [["term", "df", "length", "n"]]
