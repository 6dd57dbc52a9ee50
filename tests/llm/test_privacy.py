from minuteworks.llm import privacy as V

ROWS = [
    (1, "Bitte an max.muster@mail.example schicken!", {"email"}), (2, "Kontakt: anna_b ät netz punkt test", {"email"}), (3, "Mail: k [at] post [dot] example", {"email"}),
    (4, "Rückruf unter 0176.04.06.90.29.", {"phone"}), (5, "Tel. +49 (0)171 3920095", {"phone"}), (6, "Tel. null eins sieben sechs 04 06 90 72", {"phone"}),
    (7, "Mein Nachweis: IBAN DE00 4968 6280 7737 2114 00", {"id_number"}), (8, "(Steuer-ID 09 624 932 946)", {"id_number"}), (9, "SV-Nummer 12 110829 F 118", {"id_number"}), (10, "Ich habe Reisepass C6MYHFVLV angegeben.", {"id_number"}),
    (11, "Ich wohne Mohnstraße 171c, 2. OG", {"address"}), (12, "Absender: Haselholz-Str. 155-157, 99999 Lindenrode", {"address"}), (13, "Ich heiße Torsten Maschekkewitz und frage.", {"name"}), (14, "gez. dieter klapprodena", {"name"}),
    (15, "Was hat Frau Brandhoff gesagt?", set()), (16, "Was hat Herr Brandhfof gesagt?", set()), (17, "Steht in Drucksache 0398/2021/3 etwas?", set()), (18, "Welche Mittel stehen 2023 unter Haushaltsstelle 0300 221 40?", set()),
    (19, "unter Haushaltsstlele 0300 981 40 für Ort", set()), (20, "Az. 61-2-79 wäre wichtig, Sachkonto 5251000 auch.", set()), (21, "Die Quelle vom 26.04.2019 fehlt.", set()), (22, "@team super Sache", set()), (23, "", set()), (24, None, None),
    (25, "an der Mohnstraße 2019 gebaut", set()), (26, "klapprodena war auch da", {"name"}), (27, "Gruß, Anke Klapprodena", {"name"}), (28, "Gruß, Uwe Klapprodena", {"name"}), (29, "gez. Eva Klapprodena", {"name"}), (30, "Familie Klapprodena bittet um Antwort", {"name"}),
]


def run(spark, rows):
    members = spark.createDataFrame([("Rolf", "Brandhoff"), ("Anke", "Lüderhoff"), (None, None)], "first_name string, last_name string")
    df = spark.createDataFrame([(*r, "t") for r in rows], "id long, query string, types string")
    return {r["id"]: r for r in V.sanitise(df, "id", "query", members, "q", min_bits=1.0).collect()}


def test_types(spark):
    got = run(spark, [(i, t) for i, t, _ in ROWS] + [(1000 + i, "Welche Kosten entstehen durch die Sanierung?") for i in range(100)])
    for i, text, types in ROWS:
        assert (set(got[i]["types"]) if i in got else None) == types, text


def test_text_stays_readable(spark):
    got = run(spark, [(1, "Ruft mich an: 0171 3920-043! Ich wohne Wiesenpfad 168, 2. OG. Gruß, Heike Plagena"), (2, "x " * 50_000 + "a@b.example")])
    assert got[1]["text"] == "Ruft mich an: [PHONE]! Ich wohne [ADDRESS], 2. OG. Gruß, [NAME]"
    assert got[2]["text"].endswith("[EMAIL]")


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    assert len(run(spark, [(1, "Tel. 0171 3920095")] * 3)) == 1


def test_names_in_many_rows_and_over_tables(spark):
    members = spark.createDataFrame([("Rolf", "Brandhoff")], "first_name string, last_name string")
    for others in (60, 2):
        logs = [(i, "Ich heiße Torsten Klapprodena und frage.") for i in range(30)] + [(100 + i, "Welche Kosten entstehen?") for i in range(others)] + [(500, "klapprodena war auch da")]
        df = spark.createDataFrame(logs, "id long, query string")
        comments = spark.createDataFrame([(500, "Danke, klapprodena!")], "id long, comment string")
        got = {(r["source"], r["id"]): r["text"] for r in V.sanitise_tables([(df, "id", "query", "q"), (comments, "id", "comment", "c")], members).where("id = 500").collect()}
        assert got == {("q", 500): "[NAME] war auch da", ("c", 500): "Danke, [NAME]!"}
        assert V.sanitise(df, "id", "query", members, "q").where("id = 500").first()["types"] == ["name"]


def corpus():
    """Names that only some rows address, and closings that no cue covers."""
    names = [a + b for a in ("Damrau", "Huxol", "Sieve", "Vogt", "Ebbke", "Plag", "Jork") for b in ("scheid", "mersen", "lingen", "inger")]
    rows = [(i, f"Welche Kosten entstehen durch die Sanierung der Halle {i}?") for i in range(400)]
    rows += [(1000 + i, f"Frau {n} sagt das auch.") for i, n in enumerate(names)]
    rows += [(2000 + i, f"Was kostet die Halle? gez. Rolf {n}") for i, n in enumerate(names[:20])]
    return rows + [(3000 + i, f"Was kostet die Halle? gez. Rolf {n}kamp") for i, n in enumerate(("Ober", "Unter", "Wester"))]


def test_the_corpus_finds_names_without_cue(spark):
    """Words addressed elsewhere teach a closing, the closing teaches new names; without rounds nobody does."""
    members = spark.createDataFrame([("Rolf", "Brandhoff")], "first_name string, last_name string")
    df = spark.createDataFrame(corpus(), "id long, query string")
    got = {r["id"]: r for r in V.sanitise(df, "id", "query", members).collect()}
    assert all(got[2000 + i]["types"] == ["name"] for i in range(20))
    assert all(got[3000 + i]["text"] == "Was kostet die Halle? gez. [NAME]" for i in range(3))
    assert not any(got[i]["types"] for i in range(400))
    known, given = V.Known({"brandhoff"}), frozenset({"rolf"})
    seeds = {i for i, t in corpus() if any(o[5] for o in V.occurrences(t, [], known, given))}
    assert seeds == {1000 + i for i in range(28)}


def test_company_that_reveals_is_generalised(spark):
    members = spark.createDataFrame([("Rolf", "Brandhoff")], "first_name string, last_name string")
    rows = [(i, f"Frau Sievena vom Kanuverein am Tulpenweg fragt zum {i}. Mal nach der Halle.") for i in range(5)] + [(100 + i, f"Wann kommt die Halle {i}, fragt der Verein?") for i in range(200)]
    got = {r["id"]: r for r in V.sanitise(spark.createDataFrame(rows, "id long, query string"), "id", "query", members).collect()}
    assert got[1]["types"] == ["name"]
    assert "[NAME]" in got[1]["text"] and "Kanuverein" not in got[1]["text"] and "[PLACE]" in got[1]["text"] and "Halle" in got[1]["text"]
    assert got[150]["text"] == rows[55][1]
