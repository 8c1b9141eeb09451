"""Exact top-k, token alignment and Merkle manifests: brute force written apart from the code under test, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlowe.llm import align, common, impacts, merkle, pretokens, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>"
DOCS = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING"


def best(rows, k=10, every=100):
    """{(query's place): [(vec_id, score)]} over (vec_id, vector) rows, in Python's integers."""
    whole = [(i, v, [int(np.floor(1024 * float(x))) for x in w]) for i, (v, w) in enumerate(rows) if w is not None and all(x is not None and np.isfinite(x) for x in w)]
    out = {}
    for i, v, w in whole:
        if v is not None and v % every == 0:
            found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(w, x)))), u is None, u or 0) for j, u, x in whole if j != i]
            out[i] = [(None if none else u, -s) for s, none, u in sorted(found)[:k]]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("rows, block, parts", [(8192, 8192, 1), (150, 3, 3), (40, 1, 5)])
def test_topk_equals_brute_force(spark, rows, block, parts):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.2, (700, 24)).astype(np.float32)
    vectors[300:340] = vectors[0]  # ties with each other
    vectors[500:] = np.round(vectors[500:], 1)
    table = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    found = ranked(impacts.top_k(spark.createDataFrame(table, VECTORS).repartition(parts), rows=rows, block=block))
    want = best(table)
    assert set(found) == set(want) == {0, 100, 200, 300, 400, 500, 600}
    for q, rows_ in want.items():
        assert found[q] == [(k + 1, *x) for k, x in enumerate(rows_)]


def test_topk_stops_on_proof(spark):
    """Far fewer exact scores than vectors on clustered data, and still the same answer."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (20, 16))
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 0.05, (4000, 16))).astype(np.float32)
    folder = common.fresh_dir(spark, "proof")
    index = impacts.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS).coalesce(1), folder)
    shard = impacts.Shard(index.first().asDict())
    asked, seen, score = shard.floats[0], [], shard.score
    shard.score = lambda q, at: seen.append(len(at)) or score(q, at)
    at, got = shard.best(asked, 0, 10, None)
    exact = shard.exact.astype(np.int64) @ shard.exact[0].astype(np.int64)
    exact[0] = -(2**62)
    assert got.tolist() == np.sort(exact)[::-1][:10].tolist() and sum(seen) <= 4000 // 4 + 100


def test_topk_on_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [nan, 1.0]), (400, [inf, 0.0]), (None, [3.0, 3.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (500, [1e30, -1e30]), (8, [-1.0, -2.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS VEC_ID2", "'x' AS score", "2 AS rank").repartition(3)
    found = {}
    for r in impacts.top_k(df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = best(rows)
    assert sorted(found) == [0, 500] and len(found[0]) == 16  # two rows with id 0 are two queries
    assert sorted(found[500]) == [(k + 1, *x) for k, x in enumerate(want[10])]
    assert sorted(found[0], key=repr) == sorted([(k + 1, *x) for i in (0, 1) for k, x in enumerate(want[i])], key=repr)
    assert impacts.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert impacts.top_k(spark.createDataFrame([(100, [1.0])], VECTORS)).count() == 0


def slow_alignment(texts, a_path, b_path):
    """Every text's tokens, groups and links over whole texts, by comparing all token ranges of both sides."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    # bytes to characters: the 188 printable ones are themselves, the others follow from 256 on in order
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    out = []
    for t in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "groups_sha256": ""}
        if t:
            raw = (" " + t).encode()
            x, y = a.encode(" " + t, add_special_tokens=False), b.encode(t)
            xs = [bytes(table[c] for c in s) for s in x.tokens]
            ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
            if b"".join(xs) == raw == b"".join(ys):
                ends = [np.cumsum([len(s) for s in z]) for z in (xs, ys)]
                both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
                groups = ["|".join(",".join(str(i) for i, e in zip(z, es) if lo < e <= hi) for z, es in zip((x.ids, y), ends)) for lo, hi in zip([0, *both], both)]
                links = [(i, j) for i, e, s in zip(x.ids, ends[0], xs) for j, f, u in zip(y, ends[1], ys) if e - len(s) < f and f - len(u) < e]
                row = {"n_a": len(x.ids), "n_b": len(y), "n_groups": len(groups), "links": links, "groups_sha256": hashlib.sha256(";".join(groups).encode()).hexdigest()}
        out.append(row)
    count = {}
    for r in out:
        for p in set(r["links"]):
            count[p] = count.get(p, 0) + 1
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    for r in out:
        links = r.pop("links")
        r |= {"n_links": len(links), "n_best": sum(count[p] == top[p[0]] for p in links), "count_sum": sum(count[p] for p in links)}
    return out


ODD_TEXTS = [None, "", " ", "  ", "a", " a  b ", "x\n\n y\t z \n", "<s> <|endoftext|></s><unk> <0x41>", "é▁ü", "　wide　spaces x", "ﬁ ﬂ Ⅳ é", "日本語のテキスト и русский", "a" * 300 + " b", "​ ﻿  nbsp here", "👩‍👩‍👧 emoji", "don't can't 12345 678", "word " * 3000, "\x1c \x1d x\x85y \x00", "the the the", "the the the"]


@pytest.mark.parametrize("most_broadcast", [1_000_000, 40, 0])
def test_alignment_equals_brute_force(spark, most_broadcast):
    rng = random.Random(3)
    words = ["tokenizer", "the", "Äpfel", "straße", "x1y2", "...", "naïve", "hello,", "(a)", "日本", "\t", "", "\n", "zzzzqq"]
    texts = ODD_TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").selectExpr("doc_id", "text", "'k' AS note").repartition(3)
    got = sorted(align.align(df, most_broadcast=most_broadcast).collect(), key=lambda r: r["doc_id"])
    a, b = pretokens.default_path("byte_bpe_50k.json"), pretokens.default_path("piece_bpe_32k.model")
    for r, want in zip(got, slow_alignment(texts, a, b), strict=True):
        assert {c: r[c] for c in want} == want, texts[r["doc_id"]]
        assert r["note"] == "k"


def test_alignment_of_whole_texts(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    a, b = pretokens.default_path("byte_bpe_50k.json"), pretokens.default_path("piece_bpe_32k.model")
    short = [t if t is None or len(t) < 6000 else None for t in texts]  # the slow side pairs all tokens
    df = spark.createDataFrame(list(enumerate(short)), "doc_id BIGINT, text STRING")
    got = sorted(align.align(df).collect(), key=lambda r: r["doc_id"])
    for r, want in zip(got, slow_alignment(short, a, b), strict=True):
        assert {c: r[c] for c in want} == want
    whole = {r["doc_id"]: r for r in queries.op12_token_alignment(spark, SF).collect()}
    assert len(whole) == len(texts)
    texts_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    one = align.Aligner(a, b)
    one.local = False  # in one piece
    for d, t in texts_of.items():
        assert [whole[d][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")] == [x[0].as_py() for x in one.rows([t])[:5]]


def test_alignment_forgets_and_clashes(spark):
    a, b = pretokens.default_path("byte_bpe_50k.json"), pretokens.default_path("piece_bpe_32k.model")
    small, large = align.Aligner(a, b, most=5), align.Aligner(a, b)
    texts = [f"word{i} other{i} the" for i in range(40)] + ODD_TEXTS
    for i in range(0, len(texts), 7):
        assert [x.to_pylist() for x in small.rows(texts[i : i + 7])] == [x.to_pylist() for x in large.rows(texts[i : i + 7])]
    with pytest.raises(ValueError):
        align.align(spark.createDataFrame([(1, "a", 2)], "doc_id BIGINT, text STRING, N_A INT"))
    assert align.align(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def slow_manifest(rows):
    """{place: (leaf, subroot, root, proof_sha256, folded_root)} of (doc_id, source, lang, n_chars, text) rows."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(d, s, l, n, t):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, l, n, t)])

    def tree(nodes):
        """The root and, for each node, the steps (before, after) up to it."""
        paths, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, p in enumerate(place):
                run = level[p // 3 * 3 : p // 3 * 3 + 3]
                paths[i].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
                place[i] = p // 3
            level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
        return level[0], paths

    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[1], []).append(i)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf(*rows[i])))
        trees[s] = tree([leaf(*rows[i]) for i in groups[s]])
    root, over = tree([trees[s][0] for s in order])
    out = {}
    for k, s in enumerate(order):
        for i, path in zip(groups[s], trees[s][1]):
            d, _, l, n, t = rows[i]
            now = t.replace("\n", "") if d is not None and t is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t
            fold = leaf(d, s, l, n, now)
            for before, after in path + over[k]:
                fold = h(before, fold, after)
            out[i] = (leaf(*rows[i]), trees[s][0], root, h(*[x for p in path + over[k] for x in p]), fold)
    return out


def written(spark, rows, tmp_path, extra=()):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", *extra)
    df.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4, 9, 1, 10, 27, 28, 2, 1, 1, 5, 81]])
def test_manifest_equals_brute_force(spark, tmp_path, sizes):
    rng = random.Random(len(sizes))
    names = [None, "", "é", "z", "Z", "aa", "a", "-", "=x", "日本", "~"]
    rows = [(rng.randint(-50, 10**6), names[k], rng.choice(["en", None]), rng.choice([None, 3, -4]), rng.choice([None, "", "a\nb", "ß\r\n", "no line", "x" * 5000])) for k, n in enumerate(sizes) for _ in range(n)]
    rows.append((None, None, None, None, None))
    got = queries.op13_merkle_manifest(spark, written(spark, rows, tmp_path, ["1 AS LEAF", "'t' AS tree", "2 AS root"]))
    want = sorted((rows[i][0] is not None, rows[i][0] or 0, *x, x[4] == x[2]) for i, x in slow_manifest(rows).items())
    columns = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *[r[c] for c in columns]) for r in got.collect()) == want


def test_manifest_of_repeated_rows_and_none(spark, tmp_path):
    rows = [(7, "s", "en", 1, "a\nb")] * 50 + [(8, "s", "en", 1, "c")] * 3
    got = queries.op13_merkle_manifest(spark, written(spark, rows, tmp_path / "a")).collect()
    assert sorted((r["leaf"], r["proof_sha256"], r["folded_root"]) for r in got) == sorted((x[0], x[3], x[4]) for x in slow_manifest(rows).values())
    assert queries.op13_merkle_manifest(spark, written(spark, [], tmp_path / "b")).count() == 0


def test_manifest_finds_any_change(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"text {i}") for i in range(40)], DOCS)
    out = merkle.manifest(docs, tampered=F.when(F.col("doc_id") == 17, F.lit("text 18")).otherwise(F.col("text")))
    bad = out.where(merkle.fold(F.col("check"), F.col("proof")) != F.col("root")).select("doc_id").collect()
    assert [r[0] for r in bad] == [17] and out.select("root").distinct().count() == 1
