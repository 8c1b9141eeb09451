"""The thirteen registered queries as the driver calls them: columns, types, folds, SQL where there is some, brute force where there is none."""

import hashlib
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from marlowe.llm import html, langid, pretokens, queries, toxicity

SF = "/root/testdata/sf0.001"
SHAPES = {
    "op1_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op2_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op3_html_text": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op4_token_counts": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")],
    "op5_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op6_token_files": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op7_media": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")],
    "op8_decontamination": [("doc_id", "bigint"), ("item_id", "bigint")],
    "op9_secrets": [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")],
    "op11_exact_topk": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")],
    "op12_token_alignment": [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")],
    "op13_merkle_manifest": [("doc_id", "bigint"), *[(c, "string") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", "boolean")],
    "op10_mixing": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", SHAPES)
def test_columns_and_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert [(c, t) for c, t in df.dtypes if c in dict(SHAPES[name])] == SHAPES[name]
    if name not in ("op8_decontamination", "op11_exact_topk"):
        assert df.count() == con.execute(f"SELECT count(*) FROM {'pages' if name == 'op3_html_text' else 'documents'}").fetchone()[0]
    if name in entry.oracle_sql():
        columns = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want))


def test_language_by_brute_force(spark, con, texts):
    rows = con.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    learn = sorted(((str(d), t, y) for d, t, y in rows if fold(d, 4) != 2 and t and y and any(map(str.isalpha, t))), key=lambda r: r[0])
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), learn=queries.F.pmod(queries.common.crc32_text(queries.F.col("id")), queries.F.lit(4)) != 2)
    assert len(learn) > 100 and set(model.langs) == {y for _, _, y in learn}
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SF).collect()}
    for d, t in texts.items():
        want = model.predict(t)
        assert got[d]["lang_pred"] == want[0] and abs(got[d]["score"] - want[1]) < 1e-9 and got[d]["held_out"] == (fold(d, 4) == 2)
    held = [(got[d]["lang_pred"], y) for d, t, y in rows if got[d]["held_out"] and y and t]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_toxicity_by_brute_force(spark, con, texts):
    labels = con.execute("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall()
    learn = sorted((str(d), texts[d], y) for d, y in labels if y is not None and fold(d, 5) != 0 and texts.get(d) is not None)
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert len(learn) > 20
    for d, r in got.items():
        assert r["held_out"] == (fold(d, 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), learn=queries.F.pmod(queries.common.crc32_text(queries.F.col("id")), queries.F.lit(5)) != 0)
    w = model.table()
    for d, t in list(texts.items())[:60]:
        z = sum(float(w[k]) for k in set(toxicity.features(t or "").tolist())) + model.bias
        assert abs(got[d]["score"] - 1 / (1 + 2.718281828459045**-z)) < 1e-6


def test_pages_tokens_and_media_by_brute_force(spark, con, texts):
    from tokenizers import Tokenizer

    tok, model = Tokenizer.from_file(pretokens.default_path()), html.train()
    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    for r in queries.op3_html_text(spark, SF).collect():
        assert r["text"] == html.extract(pages[r["page_id"]], model) and r["n_chars"] == len(r["text"])
    for r in queries.op4_token_counts(spark, SF).collect():
        n = len(tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 2048)
    seen = {}
    for r in queries.op7_media(spark, SF).collect():
        assert seen.setdefault(texts[r["doc_id"]] or "", r[1:]) == r[1:]  # equal texts, equal values
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id BIGINT, text STRING")
    for call in (
        lambda: langid.identify(df.selectExpr("*", "1 AS Lang_Pred"), None),
        lambda: toxicity.score(df.selectExpr("*", "1 AS TOXICITY"), toxicity.fit([], [])),
        lambda: queries.simhash.fingerprints(df.selectExpr("*", "1 AS FP")),
        lambda: pretokens.count_tokens(df.selectExpr("*", "1 AS n_bytes")),
    ):
        with pytest.raises(ValueError):
            call()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING")
    labels = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert queries.media.media_digest(queries.media.text_media(none.select("doc_id", "text"))).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, None)], "doc_id BIGINT, text STRING"), toxicity.train(none, labels)).first()["toxicity"] == 0.5
