"""Sentences by hand, chunks by hand and by their places, on odd texts and a tokenizer's count."""

import random

from pyspark.sql import functions as F

from marlowe.functions import sentences
from marlowe.operators import chunking


def first(spark, f, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    return [r[1] for r in sorted(df.select("i", f(F.col("t"), **options)).collect())]


def test_first_sentences(spark):
    legal = ["Selon art. Premier du code. Puis rien.", "Voir Cf. Art. Deux. Fin", "La n° 4 et al. Les autres. Non.", "Prix 3.5 euros. et plus. Oui.", "Bon! Vrai? Oui. Ça", "Voir p.ex. Dupont. Fin", "  rien ", None, "", "Fin.\n\nÉtat.", "Etc... Puis. Oui", "smart. Puis"]
    want = ["Selon art. Premier du code.", "Voir Cf. Art. Deux.", "La n° 4 et al. Les autres.", "Prix 3.5 euros. et plus.", "Bon! Vrai? Oui. Ça", "Voir p.ex.", "rien", "", "", "Fin.", "Etc... Puis.", "smart."]
    assert first(spark, sentences.legal, legal) == want
    assert first(spark, sentences.summary, ["Court. Mot\n" + "mot " * 100, "Un. deux. Trois. Quatre.", None, "x" * 30], least=7, most=20) == ["Court. Mot mot mot…", "Un. deux.", "", "x" * 20 + "…"]
    assert first(spark, sentences.summary, ["Art. Cinq dit. Le reste."], least=10) == ["Art. Cinq dit."]
    assert first(spark, sentences.naive, ["Selon art. 5. Oui", " Quoi ? Oui", "rien ", None]) == ["Selon art.", "Quoi ?", "rien", ""]


def rows(spark, texts, kind, most, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").selectExpr("*", "1 AS chunk", "'x' AS start_char")
    out = {}
    for r in sorted(chunking.chunks(df, kind, most, **options).collect()):
        out.setdefault(r["doc_id"], []).append(tuple(r)[2:])
    return out


def test_chunks_by_hand(spark):
    text = "Un deux.\n\nTrois quatre cinq.\n\n\n \n\nSix. Sept huit! Neuf dix onze douze treize. Fin\n\nA"
    got = rows(spark, [text, None, "", " \n\n ", "... !!"], "recursive", 5)
    a, b, c = text.index("Six"), text.index("Neuf"), text.index("Fin")
    assert got[0] == [
        ("Un deux.\n\nTrois quatre cinq.", 0, 28, 0, 5),
        ("Six. Sept huit!", a, b, 5, 8),
        ("Neuf dix onze douze treize.", b, c, 8, 13),
        ("Fin", c, c + 3, 13, 14),
        ("A", len(text) - 1, len(text), 14, 15),
    ]
    assert got[4] == [("... !!", 0, 6, 0, 0)] and set(got) == {0, 4}
    assert rows(spark, ["Un deux. Trois. Quatre cinq six sept. Huit"], "sentences", 3)[0] == [("Un deux. Trois.", 0, 16, 0, 3), ("Quatre cinq six sept.", 16, 38, 3, 7), ("Huit", 38, 42, 7, 8)]


def test_chunks_give_the_text_back(spark):
    rng = random.Random(9)
    words = ["mot", "Un", "deux.", "Trois!", "é𝄞", "?", "x.y", "fin.\n", "\n\n", "\n\n\n", " "]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(150)]
    for kind in ("recursive", "sentences"):
        got = rows(spark, texts, kind, 6)
        for i, t in enumerate(texts):
            mine, tokens, end = got.get(i, []), 0, 0
            for text, a, b, ta, tb in mine:
                assert a >= end and not t[end:a].strip() and ta == tokens  # nothing but white space lies between
                same = (lambda x: x.split()) if kind == "recursive" else (lambda x: x.strip())  # blank lines between paragraphs become one
                assert same(text) == same(t[a:b]) and tb - ta == chunking.count_words(text)
                tokens, end = tb, b
            assert not t[end:].strip()
            if kind == "sentences":
                for k, (_, a, b, _, _) in enumerate(mine):  # as many sentences as fit, and no fewer
                    cut = chunking.sentences(t, a, len(t))
                    assert chunking.count_words(t[a:b]) <= 6 or b == cut[0][1]
                    assert k == len(mine) - 1 or chunking.count_words(t[a : next(e for _, e in cut if e > b)]) > 6 or not t[b : next(e for _, e in cut if e > b)].strip()


def test_chunks_by_another_count(spark):
    got = rows(spark, ["aaaa bbbb. cc dd. e"], "sentences", 11, count=len)
    assert [x[0] for x in got[0]] == ["aaaa bbbb.", "cc dd. e"] and got[0][-1][-1] == 18
