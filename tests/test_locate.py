"""Places of articles and own-text links, by hand."""

from marlowe.operators import locate

ARTICLES = [("L", 1, "1"), ("L", 2, "2bis"), ("L", 3, "3-a"), ("L", 4, "3-b"), ("L", 5, "É4"), ("L", 6, "6"), ("L", 7, "6"), ("L", 8, None), ("L", 9, ""), ("M", 10, "1")]


def located(spark, texts, allowed=None):
    arts = spark.createDataFrame(ARTICLES, "doc STRING, article INT, no STRING")
    ok = allowed and spark.createDataFrame(allowed, "doc STRING, article INT")
    rows = locate.spans(spark.createDataFrame(texts, "doc STRING, text STRING, no STRING"), arts, ok).collect()
    return sorted((r.doc, r.start, r.stop, r.article, r.no) for r in rows)


def test_spans(spark):
    """Exact, unique leading integer, ambiguous leading integer, unknown; a clashing column named as the number's."""
    text = "Titre é\nArt. 1. un\n  ART 2 deux\nvoir Art. 1 ici\nart. 3 trois\nArt. e4: quatre\nArt. 6. six\nArt. 77\nArt. 1 encore"
    at = [text.index(x) for x in ("Art. 1. un", "  ART 2", "art. 3", "Art. e4", "Art. 6", "Art. 77", "Art. 1 enc")] + [len(text)]
    rows = [("L", text, "x"), ("M", "Art. 1", None), ("N", "Art. 1", None), ("L2", None, None), ("L", "", None)]
    want = [("L", at[0], at[1], 1, "1"), ("L", at[1], at[2], 2, "2"), ("L", at[3], at[4], 5, "e4"), ("L", at[4], at[5], 7, "6"), ("L", at[6], at[7], 1, "1"), ("M", 0, 6, 10, "1")]
    assert located(spark, rows) == want
    assert located(spark, rows, [("L", 1), ("M", 1), ("L", 1)]) == [w for w in want if w[:1] == ("L",) and w[3] == 1]
    assert located(spark, []) == []


def test_own_links(spark):
    nodes = [("L", 1, "##### Art. 2. x\nArt. 77\n # Art. 1\nArt. 2bis\nArt. 1.", "Art. 6"), ("L", 2, "voir Art. 1", "Art. 6bis Art. 1"), ("L", 3, "rien", "Voir Art. 1"), ("L", 4, None, None), ("X", 5, "Art. 1", "Art. 1"), ("L", 6, "Art. 99", "Art. 1"), ("L", 4, None, None)]
    arts = spark.createDataFrame(ARTICLES, "doc STRING, article INT, no STRING")
    got = {r.node: (r.articles, r.numbers) for r in locate.own_links(spark.createDataFrame(nodes, "doc STRING, node INT, text STRING, label STRING"), arts).collect()}
    # 6bis has no row of its own, and two rows share its leading integer; a text that names the unknown only doesn't fall back
    assert got == {1: ([2, 1], ["2", "1", "2bis"]), 2: ([], []), 3: ([], []), 4: ([], []), 5: ([], []), 6: ([], [])}
    assert locate.own_links(spark.createDataFrame([], "doc STRING, node INT, text STRING, label STRING"), arts).count() == 0
