"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import corpus_pipeline
from marlowe.llm import simhash

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_firsts(texts):
    sets, root = {i: shingles(t or "") for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if j < i and (a == b or 5 * len(a & b) >= 4 * len(a | b) > 0):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted({find(i) for i in texts})


def corpus(rng, n=12):
    """Groups of copies with more and more edits, a line that all share, short and odd texts."""
    texts, line = [], "this very line stands in every text of the lot"
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 40, 120, 400]))]
        for edits in (0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w) + (" " + line if rng.random() < 0.7 else ""))
    texts += ["", None, "a", "A", "a b c d e", "a b c d", "a b c d e f"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_stage_keeps_what_brute_force_keeps(spark):
    texts = corpus(random.Random(4))
    want = slow_firsts(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], SCHEMA)
    assert 10 < len(want) < len(texts) - 10
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs, block=300, most_broadcast=0).collect()) == want  # split groups, shuffled joins
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_rows_go_by_id_and_text(spark):
    far = " ".join(f"v{i}" for i in range(30))
    rows = [(1, "one copy of a text that is here twice"), (2, "one copy of a text that is here twice"), (2, far), (None, "nobody knows this one's id at all"), (None, "nobody knows this one's id at all"), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for similarity in ((4, 5), None):
        got = {tuple(r) for r in simhash.one_of_each(docs, similarity=similarity).collect()}
        assert got == {(1, rows[0][1]), (2, far), (None, rows[3][1]), (3, None)}, similarity
