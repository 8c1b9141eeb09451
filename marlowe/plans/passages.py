"""First sentences and chunks of texts. Documents' texts, behind a line with abbreviations, stand in for articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlowe.functions import sentences
from marlowe.functions import text as tx
from marlowe.operators import chunking
from marlowe.plans.registry import query, table

HEAD = "Voir Art. Premier et al. Les suites, cf. "
SPACE = r"[ \t\n\r\x0b\x0c]"


def headed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(HEAD), "text")).otherwise(F.col("text")).alias("text"))


TEXTS = f"d AS (SELECT doc_id, regexp_replace(coalesce(CASE WHEN doc_id % 2 = 0 THEN '{HEAD}' || text ELSE text END, ''), '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM documents)"
ABBREVIATIONS = "['" + "', '".join(sentences.ABBREVIATIONS) + "']"


@query(f"""WITH {TEXTS}, p AS (SELECT doc_id, t, string_split(regexp_replace(t, '\\.({SPACE}+[{sentences.CAPITALS}])', '.' || chr(1) || '\\1', 'g'), chr(1)) AS p FROM d),
k AS (SELECT doc_id, t, p, list_position(list_transform(p[:-2], lambda x: NOT list_contains({ABBREVIATIONS}, lower(rtrim(regexp_extract(x, '[^ \\t\\n\\r]*$'), '.')))), true) AS k FROM p)
SELECT doc_id, CASE WHEN coalesce(k, 0) > 0 THEN array_to_string(p[:k], '') ELSE t END AS sentence FROM k""")
def first_sentence_legal(spark, sf_dir):
    """ETL-36, the variant that knows abbreviations."""
    return headed(spark, sf_dir).select("doc_id", sentences.legal(F.col("text")).alias("sentence"))


@query(f"""WITH RECURSIVE {TEXTS}, p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '{SPACE}+', ' ', 'g'), '([.!?]) ([A-ZÀ-Ý])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM d),
h(doc_id, p, i, head) AS (SELECT doc_id, p, 1, p[1] FROM p UNION ALL SELECT doc_id, p, i + 1, head || ' ' || p[i + 1] FROM h WHERE length(head) < 80 AND i < len(p)),
f AS (SELECT doc_id, arg_max(head, i) AS head FROM h GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(head) > 240 THEN regexp_replace(head[1:240], ' [^ ]*$', '') || '…' ELSE head END AS sentence FROM f""")
def first_sentence_summary(spark, sf_dir):
    """ETL-36, the summary line of 80 to 240 characters."""
    return headed(spark, sf_dir).select("doc_id", sentences.summary(F.col("text")).alias("sentence"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]{SPACE}+)', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text <> ''),
n AS (SELECT doc_id, list_filter(p, lambda x: x <> '') AS p FROM s), c AS MATERIALIZED (SELECT doc_id, p, list_transform(p, lambda x: len(regexp_extract_all(x, '{tx.TOKEN}'))) AS n, list_transform(p, lambda x: length(x)) AS w FROM n),
g(doc_id, i, chunk, tokens, start_char, end_char, start_token) AS (SELECT doc_id, 1, 0, n[1], 0::BIGINT, w[1], 0::BIGINT FROM c
  UNION ALL SELECT doc_id, i + 1, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN tokens + nx ELSE nx END, CASE WHEN fits THEN start_char ELSE end_char END, end_char + wx, CASE WHEN fits THEN start_token ELSE start_token + tokens END
  FROM (SELECT g.*, n[i + 1] AS nx, w[i + 1] AS wx, tokens + n[i + 1] <= 60 AS fits FROM g JOIN c USING (doc_id) WHERE i < len(n)))
SELECT doc_id, chunk, max(start_char)::INT AS start_char, max(end_char)::INT AS end_char, max(start_token)::INT AS start_token, max(start_token + tokens)::INT AS end_token FROM g GROUP BY doc_id, chunk""")
def sentence_chunks(spark, sf_dir):
    """STR-03: runs of sentences of 60 tokens at most, a longer sentence alone."""
    return chunking.chunks(table(spark, sf_dir, "documents"), "sentences", 60).select("doc_id", "chunk", "start_char", "end_char", "start_token", "end_token")


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, k, p[k] AS p, len(regexp_extract_all(p[k], '{tx.TOKEN}')) > 40 AS big FROM (SELECT conv_id, string_split_regex(text, '\\n\\n+') AS p FROM t), unnest(range(1, len(p) + 1)) AS r(k) WHERE regexp_matches(p[k], '[^ \\t\\n\\r\\x0b\\x0c]')),
s AS (SELECT conv_id, k, big, list_filter(CASE WHEN big THEN string_split(regexp_replace(p, '([.!?]{SPACE}+)', '\\1' || chr(1), 'g'), chr(1)) ELSE [p] END, lambda x: x <> '') AS u FROM p),
u AS (SELECT conv_id, k, big, u[j] AS u, len(regexp_extract_all(u[j], '{tx.TOKEN}')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY k, j) AS i FROM s, unnest(range(1, len(u) + 1)) AS r(j)),
g(conv_id, i, k, big, chunk, tokens, text) AS (SELECT conv_id, i, k, big, 0, n, u FROM u WHERE i = 1
  UNION ALL SELECT conv_id, i, k, big, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN tokens + n ELSE n END, CASE WHEN NOT fits THEN u WHEN big THEN text || u ELSE text || chr(10) || chr(10) || u END
  FROM (SELECT u.*, g.chunk, g.tokens, g.text, g.tokens + u.n <= 40 AND (NOT u.big AND NOT g.big OR u.big AND u.k = g.k) AS fits FROM g JOIN u ON u.conv_id = g.conv_id AND u.i = g.i + 1))
SELECT conv_id, chunk, max(tokens)::INT AS tokens, md5(regexp_replace(arg_max(text, i), '^{SPACE}+|{SPACE}+$', '', 'g')) AS text FROM g GROUP BY conv_id, chunk""")
def recursive_chunks(spark, sf_dir):
    """STR-02: a conversation's turns as paragraphs, together while they have 40 tokens at most, longer ones by their sentences."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    texts = c.select("conv_id", F.array_join(F.transform("x", lambda y: y["text"]), "\n\n").alias("text"))
    out = chunking.chunks(texts, "recursive", 40, id_col="conv_id")
    return out.select("conv_id", "chunk", (F.col("end_token") - F.col("start_token")).alias("tokens"), F.md5(F.col("text").cast("binary")).alias("text"))
