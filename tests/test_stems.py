"""French stems: the published sample vocabulary, regions by hand, and retrieval on stems against plain Python."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from marlowe.functions import stems, text
from marlowe.operators import retrieve
from marlowe.plans import stemming
from marlowe.plans.registry import table

SF = "/root/testdata/sf0.001"
#: The published sample: words and their stems in turn.
SAMPLE = """continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu
continuel continuel continuelle continuel continuellement continuel continuelles continuel continuels continuel continuer continu continuera continu
continuerait continu continueront continu continuez continu continuité continu continuons continuon contorsions contors contour contour
contournait contourn contournant contourn contourne contourn contours contour contractait contract contracté contract contractée contract
contracter contract contractés contract contractions contract contradictoirement contradictoir contradictoires contradictoir contraindre contraindr
contraint contraint contrainte contraint contraintes contraint contraire contrair contraires contrair contraria contrari
main main mains main maintenaient mainten maintenait mainten maintenant mainten maintenir mainten maintenue maintenu maintien maintien
maintint maintint maire mair maires mair mairie mair mais mais maïs maï maison maison maisons maison maistre maistr maitre maitr maître maîtr
maîtres maîtr maîtresse maîtress maîtresses maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeur majeur
majeure majeur major major majordome majordom majordomes majordom majorité major majorités major mal mal malacca malacc malade malad malades malad
maladie malad maladies malad maladive malad""".split()


@pytest.mark.parametrize("word, stem", list(zip(SAMPLE[::2], SAMPLE[1::2])))
def test_published_sample(word, stem):
    assert stems.stem(word) == stem


def test_rules_by_hand():
    """A word for each rule that the sample lacks."""
    want = {"chevaux": "cheval", "bateaux": "bateau", "évidemment": "évident", "vraiment": "vrai", "activement": "activ", "rapidement": "rapid", "heureusement": "heureux", "nationalité": "national", "possibilité": "possibil", "moyennement": "moyen", "quiet": "quiet", "fière": "fier", "été": "été", "logiquement": "logiqu", "": "", "s": "s", "y": "y", "123": "123", "par": "par", "œuvres": "œuvr"}
    assert {w: stems.stem(w) for w in want} == want


def test_regions():
    for word, rv, r1, r2 in [("fameusement", "meusement", "eusement", "ement"), ("parlement", "lement", "lement", "ent"), ("adorer", "rer", "orer", "er"), ("voler", "ler", "er", ""), ("oui", "", "i", "")]:
        w = stems.Word(word)
        assert (w.w[w.rv :].lower(), w.w[w.r1 :].lower(), w.w[w.r2 :].lower()) == (rv, r1, r2), word


def tokens(t):
    return re.findall(text.TOKEN, (t or "").lower())


def kept(t):
    stop = {stems.stem(w) for w in text.FUNCTION_WORDS}
    return [s for s in map(stems.stem, tokens(t)) if s not in stop]


def test_queries_by_plain_python(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    bags = {d: kept(t) for d, t in docs.items()}
    for r in stemming.stemmed_tokens(spark, SF).collect():
        s = bags.pop(r["doc_id"])
        assert (r["n_stems"], r["stems_md5"]) == (len(s), hashlib.md5(" ".join(s).encode()).hexdigest())
    assert not bags
    tf = {d: Counter(kept(t)) for d, t in docs.items()}
    df = Counter(s for c in tf.values() for s in c)
    n, mean = len(docs), sum(c.total() for c in tf.values()) / len(docs)
    raw = {s: math.log(n - x + 0.5) - math.log(x + 0.5) for s, x in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {s: x if x >= 0 else low for s, x in raw.items()}
    found = {}
    for r in sorted(stemming.stem_bm25_topk(spark, SF).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["qid"], []).append((r["doc_id"], r["score"]))
    for q, t in items.items():
        score = {}
        for s, m in Counter(kept(t)).items():
            for d, c in tf.items():
                if c[s]:
                    score[d] = score.get(d, 0) + m * idf[s] * c[s] * 2.5 / (1.5 * (0.25 + 0.75 * c.total() / mean) + c[s])
        best = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
        assert [d for d, _ in found[q]] == [d for d, _ in best] and all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(found[q], best))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Le la les"), (4, "continuellement, MAISONS maisons!")], "doc_id INT, text STRING")
    got = {r["doc_id"]: r["stems"] for r in stems.stemmed(df, "doc_id", "text").collect()}
    assert got == {1: [], 2: [], 3: [], 4: ["continuel", "maison", "maison"]}
    assert {r["doc_id"]: r["stems"] for r in stems.stemmed(df, "doc_id", "text", keep_stops=True).collect()}[3] == ["le", "la", "le"]
    assert stems.stemmed(df.limit(0), "doc_id", "text").count() == 0


def test_tasks_make_the_stems_of_texts(spark, monkeypatch):
    """As the postings added up by stem; terms of a stem are one, however few a worker remembers, and no row for a pair of query and document that share a stem is shuffled."""
    monkeypatch.setattr(stems, "MOST_KNOWN", 3)
    texts = [None, "", "le la les", "continuellement, maisons maison!", "x"]
    assert stems.stem_lists(pa.array(texts)).to_pylist() == [[], [], [], ["continuel", "maison", "maison"], ["x"]]
    assert stems.stem_lists(pa.array(texts).slice(3)).to_pylist() == [["continuel", "maison", "maison"], ["x"]] and stems.stem_lists(pa.array([], pa.string())).to_pylist() == []
    docs = table(spark, SF, "documents")
    found = {r["term"]: r["df"] for r in retrieve.survey(stems.stem_docs(retrieve.unsplit(docs), rows=7)).where("term IS NOT NULL").collect()}
    assert found == {r["term"]: r["df"] for r in retrieve.document_counts(stems.stem_postings(retrieve.postings(docs))).collect()}
    plan = stemming.stem_bm25_topk(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan
