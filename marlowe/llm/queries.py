"""The training-data queries: each operator over its whole table, with the columns that the contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlowe.llm import align, common, decontam, html, impacts, langid, media, merkle, mixing, pretokens, secrets, simhash, tokenfile, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    fold = F.pmod(common.crc32_text(F.col("id")), F.lit(4))
    model = langid.train(docs, learn=fold != 2)
    out = langid.identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.pmod(common.crc32_text(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.pick(table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    out = html.main_text(pages, html.train())
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return pretokens.count_tokens(docs)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    fold = F.pmod(common.crc32_text(F.col("id")), F.lit(5))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=fold != 0)
    out = toxicity.score(docs, model)
    held = F.coalesce(F.pmod(common.crc32_text(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.fresh_dir(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), folder)
    return tokenfile.read(spark, folder)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    digested, folder = media.media_digest(media.text_media(docs).drop("text")), common.fresh_dir(spark, "tiles")
    media.write_tiles(digested, folder).write.parquet(f"{folder}/index")
    tiled = media.read_tiles(spark.read.parquet(f"{folder}/index"), folder)
    feature = F.concat("dhash", F.lit(":"), F.substring(F.sha2("tile", 256), 1, 16))
    return tiled.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def number(kind: int):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")

    return found.select(F.col("id").alias("doc_id"), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(secrets.joined(F.col("found"), True), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(common.pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    tampered = F.when(F.pmod(common.crc32_text(F.col("doc_id")), F.lit(2)) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    out = merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered)
    folded = merkle.fold(F.col("check"), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_simhash, op3_html_text, op4_token_counts, op5_toxicity, op6_token_files, op7_media, op8_decontamination, op9_secrets, op10_mixing, op11_exact_topk, op12_token_alignment, op13_merkle_manifest)}


def secrets_sql(rules: secrets.Entropy = secrets.Entropy()) -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    shapes = [secrets.ASSIGN, r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}", rules.candidate]

    def places(kind: int, keep: str) -> str:
        return f"""list_transform(list_filter(list_transform(range(1, len(h{kind}) + 1), lambda i: {{'hit': h{kind}[i],
            's': coalesce(list_sum(list_transform(g{kind}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h{kind}[1:i - 1], lambda x: length(x))), 0)}}), lambda x: {keep}),
            lambda x: {{'start': x.s::BIGINT, 'kind': {kind}, 'end': (x.s + length(x.hit))::BIGINT}})"""

    harmless = " OR ".join(f"regexp_matches(x.hit, {quoted(p)})" for p in rules.allowed)
    bound = "CASE " + " ".join(f"WHEN regexp_matches(x.hit, {quoted(p)}) THEN {least}" for _, p, least in rules.classes) + " ELSE 99 END"
    top = f"list_max(list_transform(range(0, length(x.hit) - {rules.width} + 1), lambda j: list_aggregate(string_split(substr(x.hit, j + 1, {rules.width}), ''), 'entropy')))"
    parts = [places(0, f"length(regexp_extract(x.hit, {quoted(secrets.ASSIGN)}, 2)) >= 6"), places(1, "length(x.hit) >= 20"), places(2, "length(x.hit) >= 24"), places(3, f"NOT ({harmless}) AND round({top}, 9) >= {bound}")]
    found = ", ".join(f"regexp_extract_all(t, {quoted(p)}) AS h{k}, string_split_regex(t, {quoted(p)}) AS g{k}" for k, p in enumerate(shapes))
    names = "['" + "', '".join(secrets.KINDS) + "']"
    line = f"lambda x: {names}[x.kind + 1] || ':' || x.start || ':' || x.end"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED (SELECT doc_id, {found} FROM d),
f AS (SELECT doc_id, list_sort(list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]}))) AS found FROM p)
SELECT doc_id, len(list_filter(found, lambda x: x.kind = 0))::BIGINT AS n_assign, len(list_filter(found, lambda x: x.kind = 1))::BIGINT AS n_access,
  len(list_filter(found, lambda x: x.kind = 2))::BIGINT AS n_hex,
  sha256(coalesce(array_to_string(list_transform(list_filter(found, lambda x: x.kind < 3), {line}), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(found, {line}), ','), '') AS spans
FROM f"""


def mixing_sql(epochs: int = 3, seed: int = 17, bins: int = mixing.BINS, rounds: int = 3) -> str:
    steps, gone = [], "false"
    for r in range(rounds):
        steps.append(f"""
n{r} AS (SELECT l.source, l.draw, l.size, l.size * l.sign AS words, l.sign, row_number() OVER (PARTITION BY l.source ORDER BY abs(l.sign * l.size - m.missing), l.draw, l.size, l.sign) AS k
  FROM open_docs l JOIN m{r} m ON l.source IS NOT DISTINCT FROM m.source
  WHERE abs(l.sign * l.size - m.missing) < abs(m.missing) AND NOT ({gone})),
b{r} AS (SELECT source, draw, size, words, sign FROM n{r} WHERE k = 1),
m{r + 1} AS (SELECT m.source, m.missing - coalesce(b.words, 0) AS missing FROM m{r} m LEFT JOIN b{r} b ON m.source IS NOT DISTINCT FROM b.source)""")
        gone = gone + f" OR EXISTS (SELECT 1 FROM b{r} b WHERE b.source IS NOT DISTINCT FROM l.source AND b.draw = l.draw AND b.size = l.size)"
    added = "".join(f" UNION ALL SELECT source, draw, size, CASE WHEN sign < 0 THEN 1 ELSE 0 END, CASE WHEN sign < 0 THEN 4611686018427387904 ELSE 1 END FROM b{r}" for r in range(rounds))
    by_default = "(g.bin <= y.last_bin OR (g.bin = y.next_bin AND (g.draw < y.full_draw OR (g.draw = y.full_draw AND g.size <= y.full_size)) IS TRUE))"
    return rf"""
WITH f AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw FROM documents),
g AS (SELECT *, length(bin(size)) AS cls, floor(draw * {bins})::INT AS bin, row_number() OVER (PARTITION BY source, draw, size) AS number FROM f),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM g GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight, source_size * {epochs} AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lw,
  (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lg FROM r),
c AS (SELECT min(k) AS k FROM l WHERE lw / lg <= cap / weight),
t AS (SELECT l.source, l.source_size, CASE WHEN c.k IS NULL OR l.k < c.k THEN l.cap::DOUBLE ELSE least(l.weight * e.lw / e.lg, l.cap::DOUBLE) END AS target
  FROM l CROSS JOIN c LEFT JOIN l e ON e.k = c.k),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {epochs})::BIGINT ELSE 0 END AS whole FROM t),
v AS (SELECT *, target - whole * source_size AS share FROM u),
b AS (SELECT source, cls, bin, sum(size)::BIGINT AS words FROM g GROUP BY source, cls, bin),
x AS (SELECT *, sum(words) OVER (PARTITION BY source, cls ORDER BY bin) AS running, sum(words) OVER (PARTITION BY source, cls) AS class_words FROM b),
z AS (SELECT x.*, v.source_size, v.target, v.whole, v.share, v.share * x.class_words / greatest(v.source_size, 1) AS room FROM x JOIN v ON x.source IS NOT DISTINCT FROM v.source),
y0 AS (SELECT source, cls, source_size, target, whole, share, room, coalesce(max(bin) FILTER (running <= room), -1) AS last_bin, min(bin) FILTER (running > room) AS next_bin,
  coalesce(max(running) FILTER (running <= room), 0) AS got FROM z GROUP BY ALL),
e0 AS (SELECT y.source, y.cls, g.draw, g.size, count(*) AS n, y.room - y.got AS left_room FROM g JOIN y0 y ON g.source IS NOT DISTINCT FROM y.source AND g.cls = y.cls AND g.bin = y.next_bin GROUP BY y.source, y.cls, g.draw, g.size, y.room - y.got),
e1 AS (SELECT *, sum(n * size) OVER (PARTITION BY source, cls ORDER BY draw, size) AS upto FROM e0),
e2 AS (SELECT source, cls, max(row(draw, size)) FILTER (upto <= left_room) AS full_group, min(row(draw, size, floor((left_room - upto + n * size) / size))) FILTER (upto > left_room) AS part_group,
  coalesce(max(upto) FILTER (upto <= left_room), 0) AS more FROM e1 GROUP BY source, cls),
y AS (SELECT y0.*, e2.full_group[1] AS full_draw, e2.full_group[2] AS full_size, e2.part_group[1] AS part_draw, e2.part_group[2] AS part_size, e2.part_group[3]::BIGINT AS k,
  got + coalesce(more, 0) + coalesce(e2.part_group[3] * e2.part_group[2], 0) AS have FROM y0 LEFT JOIN e2 ON y0.source IS NOT DISTINCT FROM e2.source AND y0.cls = e2.cls),
open_docs AS (SELECT * FROM (SELECT g.source, g.size, g.draw, y.whole, CASE WHEN {by_default} THEN -1 ELSE 1 END AS sign, coalesce(g.draw = y.part_draw AND g.size = y.part_size, false) AS in_part
    FROM g JOIN y ON g.source IS NOT DISTINCT FROM y.source AND g.cls = y.cls)
  WHERE (sign < 0 OR whole < {epochs}) AND size > 0 AND NOT in_part),
m0 AS (SELECT source, any_value(share) - sum(have) AS missing FROM y GROUP BY source),{",".join(steps)},
special(source, draw, size, low, high) AS (SELECT source, part_draw, part_size, 0, k FROM y WHERE k > 0{added})
SELECT g.id AS doc_id, g.size, y.source_size, y.target,
  (least(y.whole + (CASE WHEN a.low IS NULL THEN {by_default} ELSE g.number > a.low AND g.number <= a.high END)::INT, {epochs}) * g.size)::BIGINT AS taken
FROM g JOIN y ON g.source IS NOT DISTINCT FROM y.source AND g.cls = y.cls
LEFT JOIN special a ON a.source IS NOT DISTINCT FROM g.source AND a.draw = g.draw AND a.size = g.size"""


def topk_sql(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def merkle_sql(depth: int = 24, over: int = 12) -> str:
    """``depth`` and ``over`` levels are written out: enough for 3^24 rows a source and 3^12 sources."""

    def part(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"

    def crc(value: str) -> str:
        table = []
        for x in range(256):
            for _ in range(8):
                x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
            table.append(x)
        step = f"xor(c >> 8, list_extract({table}::BIGINT[], (xor(c, b) & 255) + 1))"
        return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT)"

    def tree(name: str, leaves: str, levels: int) -> str:
        out = [f"{name}0 AS MATERIALIZED (SELECT tree, pos, n, h, ['']::VARCHAR[] AS kids FROM {leaves})"]
        for i in range(levels):
            out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, (n + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h, list(h ORDER BY pos) AS kids FROM {name}{i} WHERE n > 1 GROUP BY tree, pos // 3, n)")
        tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{i} WHERE n = 1" for i in range(levels + 1))
        return ",\n".join([*out, f"{name}top AS MATERIALIZED ({tops})"])

    def proofs(name: str, levels: int, top: str) -> str:
        out = []
        for i in reversed(range(levels + 1)):
            root = f"SELECT x.tree, x.pos, t.proof FROM {name}{i} x JOIN {top} t ON x.tree = t.tree WHERE x.n = 1"
            up = f"""
 UNION ALL SELECT x.tree, x.pos, list_concat([{{'l': array_to_string(u.kids[:x.pos % 3], ''), 'r': array_to_string(u.kids[x.pos % 3 + 2:], '')}}], p.proof)
 FROM {name}{i} x JOIN {name}{i + 1} u ON x.tree = u.tree AND x.pos // 3 = u.pos JOIN {name}p{i + 1} p ON x.tree = p.tree AND x.pos // 3 = p.pos WHERE x.n > 1""" if i < levels else ""
            out.append(f"{name}p{i} AS MATERIALIZED ({root}{up})")
        return ",\n".join(out)

    text = "CASE WHEN " + crc("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    head = " || ".join(part(f) for f in ("doc_id", "source", "lang", "n_chars"))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, sha256({head} || {part('text')}) AS h, sha256({head} || {part('tampered')}) AS checked
  FROM (SELECT *, {text} AS tampered FROM documents)),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, checked) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{tree('a', 'leaves', depth)},
sources AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree::BLOB) - 1 AS pos, count(*) OVER () AS n, h, tree AS source FROM atop),
{tree('b', 'sources', over)},
broot AS (SELECT tree, []::STRUCT(l VARCHAR, r VARCHAR)[] AS proof FROM btop),
{proofs('b', over, 'broot')},
aroot AS MATERIALIZED (SELECT s.source AS tree, p.proof FROM sources s JOIN bp0 p ON s.pos = p.pos),
{proofs('a', depth, 'aroot')},
out AS (SELECT l.doc_id, l.h AS leaf, t.h AS subroot, (SELECT h FROM btop) AS root, sha256(array_to_string(list_transform(p.proof, lambda x: x.l || x.r), '')) AS proof_sha256,
  list_reduce(list_prepend({{'l': l.checked, 'r': ''}}, p.proof), lambda made, side: {{'l': sha256(side.l || made.l || side.r), 'r': ''}}).l AS folded_root
  FROM leaves l JOIN atop t ON l.tree = t.tree JOIN ap0 p ON l.tree = p.tree AND l.pos = p.pos)
SELECT *, folded_root = root AS verified FROM out"""


def oracle_sql() -> dict[str, str]:
    return {"op9_secrets": secrets_sql(), "op10_mixing": mixing_sql(), "op11_exact_topk": topk_sql(), "op13_merkle_manifest": merkle_sql()}
