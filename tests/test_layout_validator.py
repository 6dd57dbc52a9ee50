from minuteworks.operators import layout as L, validator as V
from minuteworks.operators.segmentation import hinted_spans, segment_documents
from pyspark.sql import functions as F

SEG = "id long, document_id long, seg_type string, top_key string, title string, start_page int, start_char int, end_page int, end_char int, text_full string"
FILL = "Ein Satz, der nur Platz braucht und sonst nichts sagt. "


def test_every_rule_fires(spark):
    page = lambda t: (t + FILL * 40)[:1000]
    pages = [
        (1, 1, page("Vorwort. ")), (1, 2, page("1. Haushalt\n")), (1, 3, page("2. Schule\n")), (1, 4, page("Rest ")),
        (2, 1, page("1. Haushalt\n")), (2, 2, page("2. Schule\n")), (3, 1, page("")), (5, 1, page("1. A\n")),
    ]
    rows = [
        (10, 1, "vorwort", None, None, 1, 0, 2, 40, "Vorwort"), (11, 1, "top", "1", "Haushalt", 2, 0, 3, 200, "1. Haushalt\n" + FILL + "\n2. Neubau der Schule\nBerichterstatter: N."),
        (12, 1, "top", "2", "Neubau der Schule", 3, 100, 3, 120, "kurz"), (13, 1, "top", "3", "Straße", 3, 500, 3, 900, "Ohne Marke " + FILL), (14, 1, "nachwort", None, None, 3, 800, 4, 10, "Ende"),
        (20, 2, "top", "1", "Haushalt", 1, 0, 1, 1000, "1. Haushalt\n" + FILL + "\n2. Unterpunkt ohne Bezug"), (21, 2, "top", "2", "Zoologischer Garten", 2, 0, 2, 1000, None), (22, 2, "top", "3", "Fehlt", None, None, None, None, None),
        (30, 3, "top", "1", "A", None, None, None, None, None), (40, 4, "top", "1", "A", 1, 0, 1, 5, "1. A"), (50, 5, "top", "1", "A", 1, 0, 1, 1000, "1. A\n" + FILL),
    ]
    docs = spark.createDataFrame([(1, 3, 2, 50, 3, 700), (2, 3, None, None, None, None), (3, 2, None, None, None, None), (4, 1, None, None, None, None), (5, 1, None, None, None, None)], "id long, tops_total int, content_start_page int, content_start_char int, content_end_page int, content_end_char int")
    issues, reports = V.validate(spark.createDataFrame(rows, SEG), docs, spark.createDataFrame(pages, "document_id long, page_no int, page_text string"))
    found = {(r["issue"], r["document_id"], r["segment_id"]) for r in issues.collect()}
    assert {
        ("NO_PAGES", 4, None), ("NO_TOPS_WITH_SPAN", 3, None), ("TOPS_MISSING_SPAN", 2, None), ("NO_USABLE_TOP_CONTENT", 3, None), ("OUT_OF_BOUNDS_START", 1, 11), ("OUT_OF_BOUNDS_END", 1, 13),
        ("OVERLAP_BETWEEN_TOPS", 1, 12), ("GAP_BETWEEN_TOPS", 1, 13), ("TOP_TOO_SHORT", 1, 12), ("MARKER_NOT_NEAR_START", 1, 13), ("LEAK_NEXT_TOP_EARLY", 1, 11), ("LEAK_NEXT_TOP_EARLY_SUPPRESSED", 2, 20),
        ("VORWORT_OVERLAPS_TOP1", 1, 10), ("NACHWORT_OVERLAPS_LAST_TOP", 1, 14), ("OVERLAP_BETWEEN_SEGMENTS", 1, 11),
    } <= found
    assert not any(d == 5 for _, d, _ in found)
    got = {r["document_id"]: r for r in reports.collect()}
    assert got[5]["recommendation"] == "accept" and got[5]["score"] == 100.0 and got[5]["ok"]
    assert got[1]["recommendation"] == "broken" and got[4]["score"] == 0.0 and got[3]["score"] == 5.0
    # Golden case: one of several items missing, otherwise clean: -15 - (0.90 - share) * 60.
    assert got[2]["recommendation"] == "need_spans" and got[2]["score"] == round(100 - 15 - (0.9 - 2 / 3) * 60, 2)


def test_golden_score_and_trailing_gap(spark):
    pages = spark.createDataFrame([(1, n, f"{n}. Punkt\n" + FILL * 3) for n in (1, 2, 3)] + [(1, 4, "Am Ende steht noch etwas.")], "document_id long, page_no int, page_text string")
    size = len("1. Punkt\n" + FILL * 3)
    rows = [(n, 1, "top", str(n), "Punkt", n, 0, n, size, f"{n}. Punkt\n" + FILL * 3) for n in (1, 2, 3)] + [(4, 1, "top", "4", "Punkt", None, None, None, None, None)]
    issues, reports = V.validate(spark.createDataFrame(rows, SEG), spark.createDataFrame([(1, 4)], "id long, tops_total int"), pages)
    assert {r["issue"] for r in issues.collect()} == {"TOPS_MISSING_SPAN", "TRAILING_GAP_AFTER_LAST_TOP"}
    assert reports.first()["score"] == 76.0 - 6.0


def test_marks_and_blanks_are_no_gap(spark):
    pages = spark.createDataFrame([(1, 1, "1. A\n" + FILL + "\n- 3 -\n"), (1, 2, "\n- 4 -\n2. B\n" + FILL)], "document_id long, page_no int, page_text string")
    a = len("1. A\n" + FILL)
    rows = [(1, 1, "top", "1", "A", 1, 0, 1, a, "1. A\n" + FILL), (2, 1, "top", "2", "B", 2, 7, 2, 7 + len("2. B\n" + FILL), "2. B\n" + FILL)]
    issues, reports = V.validate(spark.createDataFrame(rows, SEG), spark.createDataFrame([(1, 2)], "id long, tops_total int"), pages)
    assert issues.count() == 0 and reports.first()["recommendation"] == "accept"
    empty, none = V.validate(spark.createDataFrame([], SEG), spark.createDataFrame([], "id long, tops_total int"), spark.createDataFrame([], pages.schema))
    assert empty.count() == 0 and none.count() == 0


def test_pipeline_takes_the_better_attempt(spark):
    text = lambda k, t: f"{k}. {t}\n" + FILL * 8
    pages = spark.createDataFrame([(1, 1, "Niederschrift\n" + FILL * 6), (1, 2, text("1", "Bau einer Turnhalle im Norden")), (1, 3, text("2", "Pflege der Grünanlagen am Fluss")), (2, 1, "Ganz anderer Kopf\n" + FILL * 6), (2, 2, "Sache eins\n" + FILL * 8), (2, 3, "Sache zwei\n" + FILL * 8)], "document_id long, page_no int, page_text string")
    agenda = spark.createDataFrame([(1, 1, "1", "Bau einer Turnhalle im Norden"), (1, 2, "2", "Pflege der Grünanlagen am Fluss"), (2, 1, "1", "Unauffindbarer Titel A"), (2, 2, "2", "Verschollener Titel B")], "document_id long, row_index int, top_key string, title string")
    hints = spark.createDataFrame([(2, 1, "1", 2, "Sache eins"), (2, 2, "2", 3, "Sache zwei")], "document_id long, ord int, top_key string, page_no int, anchor string")
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    segments, reports = V.pipeline(agenda, docs, pages, segment_documents, hints)
    attempts = {r["document_id"]: r["attempt"] for r in reports.collect()}
    assert attempts[2] == 2
    tops = {(r["document_id"], r["top_key"]): r for r in segments.where("seg_type = 'top'").collect()}
    assert (tops[2, "1"]["start_page"], tops[2, "2"]["start_page"]) == (2, 3) and tops[2, "1"]["text_full"].startswith("Sache eins")
    assert {r["seg_type"] for r in hinted_spans(agenda.where("document_id = 2"), hints, pages).collect()} == {"vorwort", "top", "nachwort"}


def test_layout_lines_and_rules(spark):
    spans = spark.createDataFrame([(1, 1, 1, 1, "TOP 1", "Arial-Bold", 14.0, 50.0, 100.0, 112.0), (1, 1, 1, 2, "Haushalt", "Arial", 12.0, 90.0, 100.0, 112.0), (1, 1, 2, 1, "Text", "Arial", 10.0, 50.0, 300.0, 310.0), (1, 1, 3, 1, "", "Arial", 10.0, 0.0, 0.0, 0.0)], "document_id long, page_no int, line_no int, span_no int, text string, font string, size double, x0 double, y0 double, y1 double")
    lines = {r["line_no"]: r for r in L.layout_lines(spans).collect()}
    assert lines[1]["text"] == "TOP 1 Haushalt" and round(lines[1]["bold_ratio"], 4) == round(5 / 13, 4) and lines[1]["max_size"] == 14.0 and 3 not in lines
    assert L.median_sizes(spans).first()["median_size"] == 12.0
    shapes = spark.createDataFrame([(1, 1, "line", 20.0, 130.0, 580.0, 131.0, 600.0), (1, 1, "line", 20.0, 130.0, 200.0, 130.0, 600.0), (1, 1, "rect", 10.0, 400.0, 590.0, 409.0, 600.0), (1, 1, "rect", 10.0, 320.0, 590.0, 324.0, 600.0)], "document_id long, page_no int, kind string, x0 double, y0 double, x1 double, y1 double, page_width double")
    got = {r["y"]: r["header_text"] for r in L.rules(shapes, spans).collect()}
    assert got == {130.5: "TOP 1 Haushalt", 322.0: "Text"}


def test_heads_that_name_a_key(spark):
    cases = [("12. Bau", "12", True), ("12.3 Bau", "12", False), ("- 4 - 12) Bau", "12", True), ("Vorlage 2752/2005/4. Text", "4", False), ("Ende. 7.1 Thema", "7.1", True), ("", "1", False), (None, "1", False), ("26.01.2012", "26", False)]
    df = spark.createDataFrame([(i, h, k) for i, (h, k, _) in enumerate(cases)], "i int, h string, k string")
    got = [r["x"] for r in df.select("i", L.mentions_key(F.col("h"), F.col("k")).alias("x")).orderBy("i").collect()]
    assert got == [w for *_, w in cases]


def test_slices_footers_and_starts(spark):
    schema = "document_id long, page_no int, page_text string"
    pages = spark.createDataFrame([
        (1, 1, "Einladung\nTagesordnung\n1. Punkt"), (1, 2, "Kopf\n1. Punkt\nBeschluss der Vorlage"), (1, 3, "- 4 -\nText"), (1, 4, "Anlage 1\nTabelle"), (2, 1, "Tagesordnung"), (2, 2, "1. Punkt gleich oben"), (3, 1, "nur Text"), (4, 1, "Tagesordnung ohne Punkte"), (4, 2, "Seite 2"), (5, 1, None),
    ], schema)
    got = {r["document_id"]: r for r in L.slice_ends(pages).collect()}
    assert (got[1]["agenda_page"], got[1]["top1_page"], got[1]["top1_line"], got[1]["slice_end"], got[1]["contaminated"]) == (1, 2, 2, 2, True) and got[1]["kw_hits"] == ["beschluss", "vorlage"]
    assert (got[2]["slice_end"], got[2]["contaminated"]) == (1, False) and got[3]["slice_end"] == 1 and got[4]["slice_end"] == 1 and got[5]["slice_end"] == 1
    starts = {r["document_id"]: (r["start_page"], r["appendix_page"]) for r in L.content_start(pages).collect()}
    assert starts == {1: (3, 4), 2: (1, None), 3: (1, None), 4: (2, None), 5: (1, None)}
    long = spark.createDataFrame([(1, n, "x" * 300 + ("\nStadt Musterstadt" if n <= 10 else "")) for n in range(1, 25)], schema)
    assert L.footer_transition(long, F.col("page_text").contains("Musterstadt")).first()["appendix_page"] in (9, 10, 11)
    assert L.footer_transition(pages, F.lit(False)).collect() == [(1, 4)]
    text = spark.createDataFrame([("Anlage 0\n" + FILL * 3 + "\nAnlage 1\nTabelle",), (FILL,), (None,)], "t string")
    found = [r[0] for r in text.select(L.inline_appendix(F.col("t"))).collect()]
    assert found == [len("Anlage 0\n" + FILL * 3 + "\n"), None, None] or found == [len("Anlage 0\n" + FILL * 3), None, None]
