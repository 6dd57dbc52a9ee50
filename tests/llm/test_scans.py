from minuteworks.llm import scans as S

DOCS = [(1, "Finanzausschuss"), (2, "Finanzausschuss"), (3, None)]
CLEAN = "Die Verwaltung erläutert die Beleuchtung der Grünanlage. Der Ausschuss nimmt Kenntnis."
SEGS = [
    (1, 1, "Die Verwaltung erläutert die Beleuch-\ntung der Grünanlage. Der Haupt-\nund Finanzausschuss berät."),
    (2, 1, "Die Verwaltung erläutert die\nProtokoll Finanzausschuss, 01.02.2020\nBeleuchtung der Grünanlage.\n- 12 -\nDer Ausschuss nimmt Kenntnis."),
    (3, 2, "Die Verwaltung erläutert\nProtokoll Finanzausschuss, 03.04.2021\ndie Beleuchtung."),
    (4, 2, "Die Verwa1tung erläutert die Griinanlage."),
    (5, 3, "Die Gruenanlage und die Meyer-\nSchulze werden genannt."),
    (6, 3, None), (7, 3, ""),
] + [(10 + i, 2, CLEAN) for i in range(8)]


def noise(spark, rows):
    return S.clean(spark.createDataFrame(rows, "id long, document_id long, text_full string"), spark.createDataFrame(DOCS, "id long, gremium_name string"))


def test_kinds_of_noise(spark):
    found = {}
    for r in noise(spark, SEGS).found.collect():
        found.setdefault(r["segment_id"], set()).add(r["noise"])
    assert found == {1: {"hyphenation"}, 2: {"running_header", "page_number"}, 3: {"running_header"}, 4: {"misread"}}


def test_repair(spark):
    texts = {r["id"]: r["text"] for r in noise(spark, SEGS).texts.collect()}
    assert texts[1] == "Die Verwaltung erläutert die Beleuchtung der Grünanlage. Der Haupt- und Finanzausschuss berät."
    assert texts[2] == CLEAN
    assert texts[4] == "Die Verwaltung erläutert die Grünanlage."
    assert texts[10] == CLEAN and texts[7] == "" and 6 not in texts


def test_empty_and_repeated(spark):
    empty = noise(spark, [])
    assert empty.found.count() == 0 and empty.texts.count() == 0
    assert noise(spark, [SEGS[1], SEGS[1], SEGS[2]]).found.where("segment_id = 2").count() == 2


def test_very_long_text(spark):
    rows = [(1, 1, (CLEAN + "\n") * 4000 + "Seite 7")]
    assert [r["noise"] for r in noise(spark, rows).found.collect()] == ["page_number"]


RUN_ON = [
    (101, 1, "Die Verwaltung erläutert die Beleuch- Protokoll Finanzausschuss, 05.06.2021 tung der Grünanlage. Der Ausschuss nimmt Kenntnis."),
    (102, 2, CLEAN + " Seite 3 von 15 Protokoll Finanzausschuss, 05.06.2021 " + CLEAN),
    (103, 2, CLEAN + " Das Protokoll des Finanzausschusses vom 05.06.2021 liegt vor."),
]


def test_headings_inside_text(spark):
    result = noise(spark, SEGS + RUN_ON)
    found = {}
    for r in result.found.where("segment_id > 100").collect():
        found.setdefault(r["segment_id"], set()).add(r["noise"])
    assert found == {101: {"hyphenation", "running_header"}, 102: {"running_header", "page_number"}}
    texts = {r["id"]: r["text"] for r in result.texts.collect()}
    assert texts[101] == CLEAN and texts[102] == f"{CLEAN} {CLEAN}" and texts[103] == RUN_ON[2][2]


BODY = "Die Verwaltung erläutert die Beleuchtung der Grünanlage und der Ausschuss nimmt\ndavon mit Dank Kenntnis. Weitere Fragen zur Sanierung der Turnhalle werden in der\nnächsten Sitzung beantwortet, teilt die Verwaltung dem Ausschuss mit."


def words_around(i):
    return ("Halle", "Schule", "Brücke", "Straße", "Anlage")[i % 5], ("teuer", "neu", "alt", "schön", "leer")[(i // 2) % 5]


def test_repetition_and_edges_decide_what_a_header_is(spark):
    """A letterhead of any wording inside sentences is found; the same line after a paragraph's end is none."""
    rows = []
    for i in range(12):
        a, b = words_around(i)
        rows.append((i, i % 4, f"Der Ausschuss berät heute lange über die {a}\nFachbereich Bauen und Planen\n{b} gewordene Fläche am Rand. Dann endet die Sitzung."))
        rows.append((100 + i, i % 4, f"{BODY}\nErgebnis der Abstimmung\n\nDie {a} ist {b}."))
    found = {(r["segment_id"], r["noise"]) for r in noise(spark, rows).found.collect()}
    assert found == {(i, "running_header") for i in range(12)}
    once = noise(spark, rows[:1] + rows[1::2]).found.collect()
    assert not once


def test_sequences_decide_what_a_page_number_is(spark):
    """Numbers of a usual style that don't go up are none; unusual ones that go up inside sentences are."""
    rows = [(1, 1, "Es gibt\n12\n7\n9\nPlätze."), (2, 1, "Es gibt\n- 3 -\nPlätze und\n- 4 -\nBänke.")]
    rows += [(10 + i, 2, f"Der Ausschuss berät\nTeil {i}\nüber die Halle und\nTeil {i + 1}\nüber die Brücke.") for i in range(5)]
    rows += [(30 + i, 3, f"{BODY}\nJa: {7 * i % 10}\nNein: {3 * i % 8}") for i in range(8)]
    found = {(r["segment_id"], r["noise"]) for r in noise(spark, rows).found.collect()}
    assert found == {(2, "page_number")} | {(10 + i, "page_number") for i in range(5)}
