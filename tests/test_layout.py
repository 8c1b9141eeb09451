"""Places of words, boxes of regions and rectangle algebra: by hand, against brute force, and by areas."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlowe.operators import layout

WORDS = "doc INT, page INT, n INT, word STRING, block INT, line INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"


def word(doc, page, n, text, line=0):
    return (doc, page, n, text, 0, line, 10.0 * n, 20.0 * line, 10.0 * n + 8, 20.0 * line + 9)


def test_words_are_searched_forward_and_then_from_the_start(spark):
    pages = spark.createDataFrame([(1, 0, "to be or not to be"), (1, 1, "é𝄞 be"), (1, 2, None), (2, 5, "x")], "doc INT, page INT, text STRING")
    words = [word(1, 0, n, w) for n, w in enumerate(["to", "be", "not", "or", "to", "", "gone", "be"])] + [word(1, 1, 0, "𝄞"), word(1, 1, 1, "be"), word(1, 2, 0, "none"), word(3, 0, 0, "nopage"), word(2, 5, 0, None)]
    got = {(r["page"], r["n"]): (r["start"], r["stop"]) for r in layout.word_index(pages, spark.createDataFrame(words, WORDS)).collect()}
    # "or" lies before the end of "not", so it is found from the start; the next "to" is then searched behind it
    assert got == {(0, 0): (0, 2), (0, 1): (3, 5), (0, 2): (9, 12), (0, 3): (6, 8), (0, 4): (13, 15), (0, 7): (16, 18), (1, 0): (21, 22), (1, 1): (23, 25)}
    assert layout.word_index(pages, spark.createDataFrame([], WORDS)).count() == 0


def test_boxes_equal_brute_force_without_a_nested_loop(spark):
    rng = random.Random(8)
    index, at = [], 0
    for n in range(1500):
        size = rng.choice([1, 3, 9, 700])
        index.append((n % 2, n // 200, n // 64, n // 8, 5.0 * (n % 8), 9.0 * (n // 8), 5.0 * (n % 8) + size, 9.0 * (n // 8) + 8, at, at + size))
        at += size + rng.randint(0, 3)
    regions = [(rng.randint(0, 1), i, s := rng.randint(0, at), s + rng.choice([-5, 0, 1, 40, 3000])) for i in range(300)] + [(0, 999, 0, at * 2), (7, 1, 0, 50)]
    df = layout.line_boxes(spark.createDataFrame(regions, "doc INT, region INT, start INT, stop INT"), spark.createDataFrame(index, "doc INT, page INT, block INT, line INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, start INT, stop INT"))
    want = {}
    for d, r, s, e in regions:
        for doc, page, block, line, x0, y0, x1, y1, a, b in index:
            if d == doc and s < e and a < e and b > s:
                k = (d, r, page, block, line)
                o = want.get(k, (x0, y0, x1, y1))
                want[k] = (min(o[0], x0), min(o[1], y0), max(o[2], x1), max(o[3], y1))
    assert {tuple(r)[:5]: tuple(r["box"]) for r in df.collect()} == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


side = st.integers(-6, 6)
rects = st.tuples(side, side, st.integers(1, 6), st.integers(1, 6)).map(lambda r: (r[0], r[1], r[0] + r[2], r[1] + r[3]))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(rects, st.lists(rects, max_size=4)), min_size=20, max_size=40))
def test_what_is_left_covers_exactly_the_rest(spark, cases):
    df = spark.createDataFrame([(i, list(map(float, a)), [list(map(float, h)) for h in holes]) for i, (a, holes) in enumerate(cases)], "i INT, a ARRAY<DOUBLE>, h ARRAY<ARRAY<DOUBLE>>")
    made = lambda x: layout.rect(x[0], x[1], x[2], x[3])
    out = df.select("i", layout.without_all(made(F.col("a")), F.transform("h", made)).alias("left"), layout.area(made(F.col("a"))).alias("area"))
    for r in out.collect():
        a, holes = cases[r["i"]]
        inside = lambda x, y, q: q[0] <= x < q[2] and q[1] <= y < q[3]
        points = [(x, y) for x in range(a[0], a[2]) for y in range(a[1], a[3])]
        assert r["area"] == len(points)
        for x, y in points:  # unit squares: each left one lies in exactly one part
            assert sum(inside(x, y, q) for q in r["left"]) == (not any(inside(x, y, h) for h in holes))
        assert all(q[0] >= a[0] and q[1] >= a[1] and q[2] <= a[2] and q[3] <= a[3] for q in r["left"])


def test_rectangles_by_hand(spark):
    a, cases = (0.0, 0.0, 10.0, 10.0), [(2.0, 3.0, 4.0, 5.0), (10.0, 0.0, 12.0, 10.0), (-1.0, -1.0, 20.0, 20.0), (5.0, -2.0, 15.0, 4.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    hole, whole = layout.rect("a", "b", "c", "d"), layout.rect(*map(F.lit, a))
    got = {r["i"]: (r["s"] and tuple(r["s"]), [tuple(x) for x in r["w"]]) for r in df.select("i", layout.intersection(whole, hole).alias("s"), layout.without(whole, hole).alias("w")).collect()}
    assert got[0] == ((2, 3, 4, 5), [(0, 0, 10, 3), (0, 5, 10, 10), (0, 3, 2, 5), (4, 3, 10, 5)])
    assert got[1] == (None, [a]) and got[2] == (a, [])
    assert got[3] == ((5, 0, 10, 4), [(0, 4, 10, 10), (0, 0, 5, 4)])


def test_regions_by_hand(spark):
    items = [(1, 1, 1, 1, 5, 9, 3, [3, 4], None, None), (1, 1, 2, 2, 0, 9, 3, [8], "n", 2), (1, 1, 3, 3, None, None, 9, [], None, 4), (2, 1, 4, 1, 5, None, None, None, "m", 0)]
    df = spark.createDataFrame(items, "qid INT, doc INT, region INT, rank INT, start BIGINT, stop BIGINT, article BIGINT, articles ARRAY<BIGINT>, node STRING, page INT")
    gold = spark.createDataFrame([(1, 4), (1, 5)], "qid INT, article BIGINT")
    spans = spark.createDataFrame([(1, 3, 100, 200)], "doc INT, article BIGINT, start BIGINT, stop BIGINT")
    got = sorted((r["region"], r["start"], r["stop"], r["page"] if r["page"] is not None else -1, r["category"]) for r in layout.regions_of(df, gold, spans).collect())
    assert got == [(1, 5, 9, -1, "retrieved"), (2, 0, 0, 2, "wrong_retrieved_node_page"), (2, 100, 200, -1, "wrong_retrieved"), (3, 0, 0, -1, "wrong_retrieved"), (4, 0, 0, 0, "retrieved_node_page"), (4, 5, 5, -1, "retrieved")]
