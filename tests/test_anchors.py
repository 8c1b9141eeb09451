"""Anchors against a search that squeezes the rest of the text anew each time."""

import random

from marlowe.operators import anchors
from marlowe.operators.chunking import count_words


def brute(text, articles):
    out, start = [], 0
    for a in articles:
        at = text.find(a[:100], start)
        if at < 0:
            near = " ".join(text[start:].split()).find(" ".join(a[:100].split()))
            at = start + near if near >= 0 else -1
        out.append(at)
        if at >= 0:
            start = at + len(a)
    return out


def cases(n):
    """Texts of few words with odd white space; articles cut out of them, squeezed, stretched, repeated, moved and foreign."""
    rng = random.Random(9)
    for _ in range(n):
        text = rng.choice(["", " ", "\n"]) + "".join(rng.choice(["ab", "a", "é", "Art"]) + rng.choice([" ", "  ", "\n", " \t "]) for _ in range(rng.randrange(60)))
        articles, at = [], 0
        while at < len(text):
            size = rng.randrange(1, 40)
            part = text[at : at + size]
            articles.append(rng.choice([part, part, " ".join(part.split()), part.replace(" ", "  "), part + "zz", "zz", "", part * 30]))
            at += rng.choice([size, size, size // 2 + 1])
        yield text, articles


def test_places():
    seen = set()
    for text, articles in cases(3000):
        got = anchors.places(text, [(a[:100], len(a)) for a in articles])
        assert got == brute(text, articles)
        seen |= {x < 0 for x in got}
    assert seen == {True, False}


def test_ranges(spark):
    some = list(cases(40))
    texts = [(i, t) for i, (t, _) in enumerate(some)] + [(90, None), (91, "sans")]
    rows = [(i, k, k * 10, a) for i, (_, arts) in enumerate(some) for k, a in enumerate(arts)] + [(90, 0, 0, "a"), (92, 0, 0, "a"), (91, 0, 0, None), (91, 1, 5, "sans"), (91, 2, 6, "sans")]
    got = anchors.token_ranges(spark.createDataFrame(texts, "doc INT, text STRING"), spark.createDataFrame(rows, "doc INT, pos INT, article INT, text STRING")).collect()
    want = [(91, 5, 0, 0, 1)]
    for i, (text, arts) in enumerate(some):
        want += [(i, k * 10, at, count_words(text[:at]), count_words(text[:at]) + count_words(a)) for k, (a, at) in enumerate(zip(arts, brute(text, arts), strict=True)) if at >= 0]
    assert sorted(map(tuple, got)) == sorted(want)
