import itertools
import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from minuteworks.operators import segmentation as G
from minuteworks.providers import HashedTrigrams, embed_texts
from minuteworks.sources import packages as K

CAND = st.builds(G.Candidate, st.integers(0, 5), st.integers(0, 3), st.integers(1, 120).map(float), st.just("m"))


def brute(levels):
    best = 0.0
    for pick in itertools.product(*[[None, *lv] for lv in levels]):
        chosen = [c for c in pick if c]
        if all((a.page, a.char) < (b.page, b.char) for a, b in itertools.pairwise(chosen)):
            best = max(best, value(chosen))
    return best


def value(chosen):
    return sum(c.score for c in chosen) - sum(G.SAME_PAGE if a.page == b.page else G.PER_PAGE * (b.page - a.page) for a, b in itertools.pairwise(chosen))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(CAND, max_size=4), max_size=4))
def test_path_is_best_and_rises(levels):
    chosen = [c for c in G.best_path(levels) if c]
    assert all((a.page, a.char) < (b.page, b.char) for a, b in itertools.pairwise(chosen))
    assert abs(value(chosen) - brute(levels)) < 1e-9


def test_heading_patterns():
    assert G.heading_pattern("3").search("3. 2. Stufe des Ausbaus") and not G.heading_pattern("3").search("3.2 Ausbau")
    assert G.heading_pattern("22.3").search("  22 . 3 Ausbau") and G.heading_pattern("19a").search("TOP 19 a Bericht")
    assert not G.anywhere_pattern("5").search("15 und 5.1")


PAGES = [
    "Niederschrift\nTagesordnung\n1 Bericht der Verwaltung\n2 Ausbau der Radwege\n3 Verschiedenes\nA\nB\nC\nD",
    "Öffentlicher Teil\nTOP 1 Bericht der Verwaltung\nDie Verwaltung berichtet über den Stand. Es gibt keine Fragen.\nTOP 2 Ausbau der Radwege\nDer Ausbau wird beraten.",
    "Die Beratung wird fortgesetzt.\nTOP 3 Verschiedenes\nEs gibt nichts zu berichten.\nDie Sitzung wird um 18 Uhr geschlossen.",
    "Anlage 1\nPlan der Radwege",
]
AGENDA = [("1", "Bericht der Verwaltung"), ("2", "Ausbau der Radwege"), ("3", "Verschiedenes"), ("4", "Nicht vorhanden")]


def test_segments_of_a_document(spark):
    pages = spark.createDataFrame([(7, i, t) for i, t in enumerate(PAGES)] + [(8, 0, None)], "document_id long, page_no int, page_text string")
    agenda = spark.createDataFrame([(7, i, k, t) for i, (k, t) in enumerate(AGENDA)] + [(7, 9, None, "x"), (9, 0, "1", "ohne Seiten")], "document_id long, row_index int, top_key string, title string")
    rows = G.segment_documents(pages, agenda).collect()
    by = {(r["seg_type"], r["top_key"]): r for r in rows}
    assert by["top", "2"]["start_page"] == 2 and by["top", "2"]["end_page"] == 3 and "fortgesetzt" in by["top", "2"]["text_full"]
    assert by["top", "4"]["match_method"] == "missing" and by["top", "4"]["start_page"] is None
    assert by["nachwort", None]["text_full"].startswith("Die Sitzung") and by["anhang", None]["start_page"] == 4 and ("vorwort", None) in by
    assert {r["document_id"] for r in rows} == {7}


def test_anchors(spark):
    hints = spark.createDataFrame([(7, 1, 1, "Die Beratung wird"), (7, 2, 1, "gibt es nicht")], "document_id long, ord int, page_no int, anchor string")
    pages = spark.createDataFrame([(7, i, t) for i, t in enumerate(PAGES)], "document_id long, page_no int, page_text string")
    assert {r["ord"]: (r["page_found"], r["char"]) for r in G.anchor_spans(hints, pages).collect()} == {1: (2, 0), 2: (None, None)}


def test_agenda_json(spark):
    item = {"top_key": "1", "name": "A"}
    texts = [json.dumps([item]), json.dumps({"tops": [item, {"title": "ohne"}]}), json.dumps(json.dumps([item])), "kaputt", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    got = [r["a"] for r in df.select("i", K.parse_agenda(F.col("j")).alias("a")).orderBy("i").collect()]
    assert [[(x["key"], x["title"]) for x in (g or [])] for g in got] == [[("1", "A")], [("1", "A")], [("1", "A")], [], [], []]


def test_salvaged_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('Text {"a": 2} Ende',), ("nichts",), (None,), ("{kaputt",)], "t string")
    got = [(r["s"]["value"]["a"] if r["s"]["value"] else None, r["s"]["notes"]) for r in df.select(K.salvage_json(F.col("t"), "a int").alias("s")).collect()]
    assert got[:4] == [(1, None), (2, None), (None, "wrong_shape"), (None, "missing")] and got[4][0] is None


def test_packages_and_logs(spark, tmp_path):
    for name, files in {"p1": [*K.REQUIRED, "ready.done", "a.pdf", "Niederschrift.pdf"], "p2": ["agenda.json"], "p3": ["x.pdf"]}.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        for f in files:
            (tmp_path / "in" / name / f).write_text("{}")
    got = {r["package"].rsplit("/", 1)[1]: (r["pdf"], r["ready"], r["has_files"]) for r in K.discover(spark, str(tmp_path / "in")).collect()}
    assert got == {"p1": ("Niederschrift.pdf", True, True), "p2": (None, False, False)}
    K.write_log(spark.createDataFrame([(1, "a\nb")], "i int, t string"), str(tmp_path / "log"))
    assert any("a\\n" in r["value"] or "a" in r["value"] for r in K.log_tail(spark, str(tmp_path / "log"), 5).collect())


def test_embedding_survives_failures(spark):
    class Fussy(HashedTrigrams):
        def embed(self, texts):
            if len(texts) > 1 or len(texts[0]) > 30:
                raise ValueError("too long")
            return super().embed(texts)

    df = spark.createDataFrame([(1, "ein text mit zwanzig zeichen"), (2, "wort " * 40), (3, "kurz"), (4, None)], "id long, t string")
    got = {r["id"]: r for r in embed_texts(df, "id", "t", Fussy, attempts=2, wait=0.0).collect()}
    assert set(got) == {1, 2} and all(len(r["embedding"]) == 64 and r["error"] is None for r in got.values())
