"""Corpus ETL queries over articles: order lines stand in for statutes' articles and lines, with texts made from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlowe.functions import text as tx
from marlowe.operators import articles as art
from marlowe.operators import etl
from marlowe.plans.ranking import rounded
from marlowe.plans.registry import query, table

ART = """art AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 20 AS law, (l_partkey % 60)::VARCHAR || CASE l_returnflag WHEN 'A' THEN 'bis' WHEN 'R' THEN '-1' ELSE '' END AS no,
  l_partkey % 40 AS x, l_suppkey % 60 AS y, l_linenumber AS z FROM lineitem)"""


def stand_in(spark, sf_dir) -> DataFrame:
    no = F.concat((F.col("l_partkey") % 60).cast("string"), F.when(F.col("l_returnflag") == "A", "bis").when(F.col("l_returnflag") == "R", "-1").otherwise(""))
    text = F.concat(F.lit("Voir l'article "), F.col("l_partkey") % 40, F.lit(" de la loi et art. "), F.col("l_suppkey") % 60, F.lit("bis, articles "), F.col("l_linenumber"), F.lit(" et "), F.col("l_linenumber") + 3, F.lit(". Du présent code."))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 20).alias("law"), no.alias("no"), text.alias("text"))


CITES = f"""{ART}, c AS (SELECT id, law, 0 AS pos, 'l''article ' || x || ' de la loi' AS raw, x::VARCHAR AS article_no, false AS is_relative FROM art
UNION ALL SELECT id, law, 1, 'art. ' || y || 'bis', y || 'bis', false FROM art UNION ALL SELECT id, law, 2, 'articles ' || z || ' et ' || (z + 3) || '.', z::VARCHAR, false FROM art
UNION ALL SELECT id, law, 3, 'Du présent code', NULL, true FROM art)"""


@query(f"WITH {CITES} SELECT id, pos, raw, article_no, is_relative FROM c")
def citation_spans(spark, sf_dir):
    """ETL-14 and 15: all five patterns, overlaps resolved."""
    return art.citations(stand_in(spark, sf_dir)).select("id", "pos", "raw", "article_no", "is_relative")


@query(f"""WITH {CITES}, n AS (SELECT id, law, lower(no) AS k FROM art), l AS (SELECT law, k, max(id) AS t FROM n GROUP BY ALL), w AS (SELECT k, list(id) AS ids FROM n GROUP BY k),
q AS (SELECT id, law, pos, article_no, article_no AS k1, nullif(regexp_extract(article_no, '^(\\d+)', 1), '') AS k2 FROM c WHERE NOT is_relative),
r AS (SELECT q.*, nullif(l1.t, q.id) AS t1, nullif(l2.t, q.id) AS t2, list_filter(w1.ids, lambda i: i <> q.id) AS g1, list_filter(w2.ids, lambda i: i <> q.id) AS g2
  FROM q LEFT JOIN l l1 ON l1.law = q.law AND l1.k = k1 LEFT JOIN l l2 ON l2.law = q.law AND l2.k = k2 LEFT JOIN w w1 ON w1.k = k1 LEFT JOIN w w2 ON w2.k = k2)
SELECT id, pos, article_no, coalesce(t1, t2, CASE WHEN len(g1) = 1 THEN g1[1] END, CASE WHEN len(g2) = 1 THEN g2[1] END) AS target,
  CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN len(g1) = 1 THEN 4 WHEN len(g2) = 1 THEN 5 END AS step FROM r""")
def citation_resolution(spark, sf_dir):
    """ETL-16: five steps; the stand-in's cited numbers have no base, which a hand-checked test has."""
    rows = stand_in(spark, sf_dir)
    keyed = rows.withColumn("key", F.concat_ws("|", "id", "law"))  # an order line's number may repeat
    found = art.citations(keyed, id_col="key").where("NOT is_relative")
    found = found.select(F.split("id", "[|]")[0].cast("bigint").alias("source_id"), F.split("id", "[|]")[1].cast("bigint").alias("law"), "pos", "article_no")
    return art.resolve(found, rows, lambda c: F.lower(F.trim(c))).select(F.col("source_id").alias("id"), "pos", "article_no", "target", "step")


LINES = """ln AS (SELECT doc, line, min(page) AS page, min(text) AS text FROM (SELECT l_orderkey AS doc, l_linenumber AS line, l_suppkey % 9 AS page, CASE l_partkey % 7 WHEN 0 THEN 'LIVRE IV. Dispositions' WHEN 1 THEN 'CHAPITRE 2' WHEN 2 THEN '  Section 1re. Champ' WHEN 3 THEN 'Sous-section 3'
  WHEN 4 THEN 'Art. ' || (l_suppkey % 30) || 'bis.' WHEN 5 THEN 'Artikel ...' ELSE 'texte ' || l_suppkey END AS text FROM lineitem) GROUP BY ALL)"""


def lines(spark, sf_dir) -> DataFrame:
    m = F.col("l_partkey") % 7
    text = F.when(m == 0, "LIVRE IV. Dispositions").when(m == 1, "CHAPITRE 2").when(m == 2, "  Section 1re. Champ").when(m == 3, "Sous-section 3").when(m == 4, F.concat(F.lit("Art. "), F.col("l_suppkey") % 30, F.lit("bis."))).when(m == 5, "Artikel ...").otherwise(F.concat(F.lit("texte "), F.col("l_suppkey")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 9).alias("page"), text.alias("text")).groupBy("doc", "line").agg(F.min("page").alias("page"), F.min("text").alias("text"))


MARKED = f"""{LINES}, mk AS (SELECT *, CASE WHEN starts_with(text, 'LIVRE') THEN 'LIVRE' WHEN starts_with(text, 'CHAP') THEN 'CHAPITRE' WHEN contains(text, 'Section') THEN 'SECTION' WHEN starts_with(text, 'Sous') THEN 'SOUS-SECTION' END AS marker,
  CASE WHEN starts_with(text, 'LIVRE') THEN 0 WHEN starts_with(text, 'CHAP') THEN 1 WHEN contains(text, 'Section') THEN 2 WHEN starts_with(text, 'Sous') THEN 3 END AS level, CASE WHEN starts_with(text, 'Art. ') THEN text[6:-2] END AS article_no FROM ln)"""


@query(f"WITH {MARKED} SELECT doc, line, marker, level, article_no FROM mk")
def structural_markers(spark, sf_dir):
    """ETL-05 and 06."""
    return art.marked(lines(spark, sf_dir)).select("doc", "line", "marker", "level", "article_no")


@query(f"""WITH {MARKED}, f AS (SELECT *, max(CASE WHEN article_no IS NOT NULL OR marker IS NOT NULL THEN line END) OVER w AS part, {", ".join(f"max(CASE WHEN level = {k} THEN (line, trim(text)) END) OVER w AS a{k}" for k in range(4))}
  FROM mk WINDOW w AS (PARTITION BY doc ORDER BY line)),
h AS (SELECT *, a0[2] AS t0, CASE WHEN a1[1] > coalesce(a0[1], -1) THEN a1[2] END AS t1, CASE WHEN a2[1] > greatest(coalesce(a0[1], -1), coalesce(a1[1], -1)) THEN a2[2] END AS t2,
  CASE WHEN a3[1] > greatest(coalesce(a0[1], -1), coalesce(a1[1], -1), coalesce(a2[1], -1)) THEN a3[2] END AS t3 FROM f),
g AS (SELECT doc, part, max(CASE WHEN line = part THEN article_no END) AS article_no, string_agg(text, chr(10) ORDER BY line) AS text, min(page) AS first_page, max(page) AS last_page, max(t0) AS law_title, max(t1) AS chapter_title, max(t2) AS section_title, max(t3) AS subsection_title
  FROM h WHERE part IS NOT NULL GROUP BY doc, part)
SELECT *, ends_with(rtrim(text), '...') AS truncated, concat_ws(' > ', law_title, chapter_title, section_title, subsection_title) AS path, (law_title IS NOT NULL)::INT + (chapter_title IS NOT NULL)::INT + (section_title IS NOT NULL)::INT + (subsection_title IS NOT NULL)::INT AS depth FROM g WHERE article_no IS NOT NULL""")
def article_assembly(spark, sf_dir):
    """ETL-07 and 08: titles fill forward and are reset by higher ones."""
    return art.articles(art.marked(lines(spark, sf_dir)), "doc", "line", page="page")


@query(f"WITH {ART} SELECT id, no, nullif(regexp_extract(no, '^(\\d+)', 1), '') AS lead, nullif(regexp_extract(no, '^(.+?)-\\d+$', 1), '') AS base FROM art")
def article_keys(spark, sf_dir):
    """ETL-09, numbers."""
    return stand_in(spark, sf_dir).select("id", "no", art.leading_int(F.col("no")).alias("lead"), art.base_no(F.col("no")).alias("base"))


@query("SELECT page_id, replace(split_part(url, '.example.', -1), '/', '_') AS file, nullif(regexp_extract('x_' || (20000000 + page_id) || '_F.pdf', '_(\\d{8,12})_[FN]', 1), '') AS publication, CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR END AS referenced FROM pages")
def file_keys(spark, sf_dir):
    """ETL-09, files and references."""
    page = F.col("page_id")
    reference = F.concat(F.when(page % 2 == 0, "Art. ").otherwise("Artikel "), page.cast("string"), F.lit(" , Code (Titre)"))
    file = F.concat(F.lit("x_"), (page + 20000000).cast("string"), F.lit("_F.pdf"))
    return table(spark, sf_dir, "pages").select("page_id", art.file_of(F.col("url"), ".example.").alias("file"), art.publication_no(file).alias("publication"), art.referenced_no(reference).alias("referenced"))


@query(f"WITH {ART} SELECT law, no AS number, max(id) AS id FROM art GROUP BY ALL")
def lookup_exact(spark, sf_dir):
    """ETL-10: the last row of a number wins."""
    return art.lookups(stand_in(spark, sf_dir), "law", "no", "id")[0]


@query(f"WITH {ART} SELECT law, regexp_extract(no, '^(\\d+)', 1) AS lead, array_to_string(list(id ORDER BY id), ',') AS found FROM art GROUP BY ALL")
def lookup_leading(spark, sf_dir):
    """ETL-10: all rows of a leading integer."""
    return art.lookups(stand_in(spark, sf_dir), "law", "no", "id")[1].withColumn("found", F.array_join("found", ","))


@query(f"""WITH {ART}, p AS (SELECT p_partkey AS part, p_partkey % 20 AS law, (p_size)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '-2' ELSE '' END AS no FROM part),
k AS (SELECT *, nullif(regexp_extract(no, '^(\\d+)', 1), '') AS lead, nullif(regexp_extract(no, '^(.+?)-\\d+$', 1), '') AS base FROM p), r AS (SELECT DISTINCT law, no, max(id) OVER (PARTITION BY law, no) AS id, regexp_extract(no, '^(\\d+)', 1) AS lead FROM art),
u AS (SELECT law, lead, min(id) AS id FROM r GROUP BY ALL HAVING count(*) = 1)
SELECT part, coalesce(e.id, a.id, b.id, c.id) AS linked, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN a.id IS NOT NULL THEN 'lead' WHEN b.id IS NOT NULL THEN 'base' WHEN c.id IS NOT NULL THEN 'base_lead' END AS step
FROM k LEFT JOIN r e ON e.law = k.law AND e.no = k.no LEFT JOIN u a ON a.law = k.law AND a.lead = k.lead LEFT JOIN r b ON b.law = k.law AND b.no = k.base LEFT JOIN u c ON c.law = k.law AND c.lead = regexp_extract(k.base, '^(\\d+)', 1)""")
def cascading_link(spark, sf_dir):
    """ETL-12: all four steps."""
    rows = stand_in(spark, sf_dir).groupBy("law", "no").agg(F.max("id").alias("id")).withColumn("lead", art.leading_int(F.col("no")))
    no = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "-2").otherwise(""))
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 20).alias("law"), no.alias("no"))
    left = left.withColumn("lead", art.leading_int(F.col("no"))).withColumn("base", art.base_no(F.col("no"))).withColumn("base_lead", art.leading_int(F.col("base")))
    steps = [("exact", "no", "no"), ("lead", "lead", "lead"), ("base", "base", "no"), ("base_lead", "base_lead", "lead")]
    for name, key, other in steps:
        unique = rows.groupBy("law", other).agg(F.min("id").alias(f"_{name}"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        left = left.join(unique.withColumnRenamed(other, key), ["law", key], "left")
    step = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n, _, _ in steps])
    return left.select("part", F.coalesce(*[F.col(f"_{n}") for n, _, _ in steps]).alias("linked"), step.alias("step"))


@query("""WITH e AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS nr, p_brand AS b FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10), m AS (SELECT p_brand, min(p_partkey) AS t FROM part GROUP BY 1)
SELECT o AS order_id, coalesce(array_to_string(list(t ORDER BY nr, t) FILTER (t IS NOT NULL), ','), '') AS ids, count(*) AS n, count(t) AS n_mapped, count(t) > 0 AND count(t) < count(*) AS partial FROM e LEFT JOIN m ON m.p_brand = e.b GROUP BY o""")
def question_id_remap(spark, sf_dir):
    """ETL-22: lists of ids through a canonical map, misses dropped, order kept."""
    part = table(spark, sf_dir, "part")
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("t"))
    canonical = part.where("p_size > 10").join(first, "p_brand").select(F.col("p_partkey").alias("l_partkey"), "t")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(canonical, "l_partkey", "left")
    got = rows.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("l_linenumber", "t")))).alias("x"), F.count("*").alias("n"), F.count("t").alias("n_mapped"))
    return got.select("order_id", F.array_join(F.transform("x", lambda x: x["t"]), ",").alias("ids"), "n", "n_mapped", ((F.col("n_mapped") > 0) & (F.col("n_mapped") < F.col("n"))).alias("partial"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey, c_custkey) AS id, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def stable_ids(spark, sf_dir):
    """ETL-20: from 1 in input order. Ranges are sorted in parallel; a range's first id comes from the counts of those before it."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").repartitionByRange("c_nationkey", "c_custkey").sortWithinPartitions("c_nationkey", "c_custkey")
    return etl.numbered(rows, "c_nationkey", "c_custkey").select("id", "c_custkey")


@query("SELECT doc_id, length(text) AS n_chars, len(regexp_extract_all(text, '\\S+')) AS n_tokens FROM documents")
def char_token_counts(spark, sf_dir):
    """ETL-21, with words as tokens; a tokenizer's ids are counted by the training-data operator."""
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n_tokens"))


@query("""SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count_if(text IS NULL OR text = '') AS n_empty, count_if(lang IS NULL) AS n_no_lang, count(DISTINCT source) AS n_sources, count(DISTINCT md5(text)) AS n_texts,
min(n_chars) AS least_chars, max(n_chars) AS most_chars, count_if(n_chars <> length(text)) AS n_wrong_length, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS n_orphans FROM documents""")
def validation_counts(spark, sf_dir):
    """ETL-23: ten checks, nine of them in one pass."""
    d = table(spark, sf_dir, "documents")
    orphans = table(spark, sf_dir, "labels").join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_orphans"))
    one = d.agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_empty"), F.count_if(F.col("lang").isNull()).alias("n_no_lang"), F.countDistinct("source").alias("n_sources"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("n_texts"), F.min("n_chars").alias("least_chars"), F.max("n_chars").alias("most_chars"), F.count_if(F.col("n_chars") != F.char_length("text")).alias("n_wrong_length"))
    return one.crossJoin(orphans)


@query("WITH g AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(l.doc_id) AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source) SELECT *, n - labelled AS missing, row_number() OVER (ORDER BY n DESC, source) AS place FROM g")
def group_breakdown(spark, sf_dir):
    """ETL-25."""
    from pyspark.sql import Window

    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    g = table(spark, sf_dir, "documents").join(labelled, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count("l").alias("labelled"))
    return g.withColumn("missing", F.col("n") - F.col("labelled")).withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "source")))  # a row for each source


@query("""WITH p AS (SELECT p_partkey AS a, p_size * 100 + p_partkey % 90 AS b FROM part), x AS (SELECT b, count(*) AS n FROM p GROUP BY b) SELECT a, b, n AS n_sharing, n = 1 AS bijective FROM p JOIN x USING (b)""")
def id_map_collisions(spark, sf_dir):
    """ETL-27: an id map, and which of its values several ids share."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_size") * 100 + F.col("p_partkey") % 90).alias("b"))
    return etl.id_map(p, "a", "b")


@query("SELECT md5(text) AS key, arg_max(doc_id, (n_chars, -doc_id)) AS kept, array_to_string(list_sort(list(DISTINCT source)), ',') AS alternates FROM documents WHERE text IS NOT NULL GROUP BY 1")
def longest_with_alternates(spark, sf_dir):
    """ETL-29: the longest row of a key, and the union of what the rows name."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id", "n_chars", "source")
    return d.groupBy("key").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("kept"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("alternates"))


@query("WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '5_REGION_WALLONNE' WHEN 1 THEN '12-14' WHEN 2 THEN '9' END AS no FROM pages) SELECT page_id, CASE WHEN contains(no, '_REGION') THEN 'regional_variant' WHEN contains(no, '-') THEN 'range_header' ELSE 'other' END AS category FROM n")
def null_text_classes(spark, sf_dir):
    """ETL-33."""
    m = F.col("page_id") % 4
    n = table(spark, sf_dir, "pages").select("page_id", F.when(m == 0, "5_REGION_WALLONNE").when(m == 1, "12-14").when(m == 2, "9").alias("no"))
    return n.select("page_id", etl.null_text_class(F.col("no")).alias("category"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source NOT IN ('src1', 'src3') OR source IS NULL")
def sanitised_dump(spark, sf_dir):
    """ETL-34: documents and columns left out of a dump."""
    return etl.sanitised(table(spark, sf_dir, "documents"), drop=["text", "source"], column="source", values=["src1", "src3"])


@query("""WITH e AS (SELECT l_orderkey AS q, l_linestatus AS pdf, l_partkey AS a, l_returnflag AS status FROM lineitem)
SELECT q, pdf, count(DISTINCT a) AS n_gold, count(DISTINCT a) FILTER (status = 'N') AS n_strict, count(DISTINCT a) FILTER (status IN ('N', 'A')) AS n_lenient, array_to_string(list_sort(list(DISTINCT a) FILTER (status = 'N')), ',') AS strict,
CASE WHEN count(DISTINCT a) FILTER (status = 'N') = count(DISTINCT a) THEN 'strict' WHEN count(DISTINCT a) FILTER (status IN ('N', 'A')) = count(DISTINCT a) THEN 'lenient' WHEN count(DISTINCT a) FILTER (status IN ('N', 'A')) > 0 THEN 'linked' ELSE 'none' END AS bucket FROM e GROUP BY ALL""")
def gold_buckets(spark, sf_dir):
    """ETL-31: strict, lenient and linked gold of a question in each document."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linestatus").alias("pdf"), F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("status"))
    return etl.gold_buckets(e, ["q", "pdf"], "a", strict=F.col("status") == "N", lenient=F.col("status").isin("N", "A"))


@query(r"SELECT doc_id, lower(strip_accents(trim(split_part(text, '.', 1)))) AS key FROM documents WHERE text IS NOT NULL")
def normalised_keys(spark, sf_dir):
    """ETL-02: NFKD, without combining marks, lower case, trimmed."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.folded_key(F.split("text", "[.]")[0]).alias("key"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(text, chr(173), ''), chr(8203), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS tidied FROM documents WHERE text IS NOT NULL")
def normalised_texts(spark, sf_dir):
    """ETL-01."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(tx.tidy(F.col("text")).cast("binary")).alias("tidied"))


@query("WITH s AS (SELECT source, n_chars % 7 AS size, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL) SELECT source, arg_max(size, (chars, -size)) AS body FROM s GROUP BY source")
def modal_size(spark, sf_dir):
    """ETL-03: the size that most characters have."""
    s = table(spark, sf_dir, "documents").groupBy("source", (F.col("n_chars") % 7).alias("size")).agg(F.sum("n_chars").alias("chars"))
    return s.groupBy("source").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))


@query(f"WITH {ART}, t AS (SELECT id, x, y, z FROM art) SELECT id, array_to_string(list_sort(list_distinct([x::VARCHAR, y::VARCHAR])), ',') AS refs FROM t")
def cross_reference_set(spark, sf_dir):
    """ETL-35: both patterns, sorted and distinct."""
    return stand_in(spark, sf_dir).select("id", F.array_join(tx.cross_references(F.col("text")), ",").alias("refs"))
