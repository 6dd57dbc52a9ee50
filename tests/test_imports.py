from datetime import date

from pyspark.sql import functions as F

from minuteworks.sources import imports as I


def test_core_and_dates(spark):
    core = spark.createDataFrame([(1, "2020-05-01", "17:30", " Rathaus ", "", "2014-2020", 7), (2, "1.5.2020", "x", None, None, None, None)], "document_id int, curated_sitzungsdatum string, curated_uhrzeit_start string, curated_ort string, curated_sitzungstyp string, curated_periodenbezug string, curated_niederschrift_nr int")
    rows = {r["document_id"]: r for r in I.core_rows(core).collect()}
    assert rows[1]["meeting_date"] == date(2020, 5, 1) and rows[1]["start_time"] == "17:30:00" and rows[1]["place"] == "Rathaus" and rows[1]["kind"] is None and rows[1]["number"] == "7"
    assert rows[2]["meeting_date"] is None and rows[2]["start_time"] is None
    docs = spark.createDataFrame([(1, None), (2, date(2019, 1, 1))], "id long, meeting_date date")
    assert {r["id"]: r["meeting_date"] for r in I.with_meeting_dates(docs, I.core_rows(core)).collect()} == {1: date(2020, 5, 1), 2: date(2019, 1, 1)}


def test_child_rows(spark):
    agenda = spark.createDataFrame([(1, [("9.a", "Bericht"), ("10", None)]), (2, [])], "document_id long, agenda array<struct<key:string,title:string>>")
    assert [(r["row_index"], r["top_norm"], r["title_curated"]) for r in I.agenda_rows(agenda).orderBy("row_index").collect()] == [(0, "9.A", "Bericht"), (1, "10", None)]
    people = spark.createDataFrame([(1, [("Mitglied des Rates", "Frau", None, "Müller-Lüde", "BML")])], "document_id long, attendance array<struct<role:string,salutation:string,title:string,last_name:string,faction:string>>")
    row = I.attendance_rows(people).first()
    assert (row["role_curated"], row["name_norm"], len(row["row_hash"])) == ("rat", "müllerlüde", 64)
    seg = spark.createDataFrame([(1, "a\u0000b", "top"), (1, "", "top"), (1, None, "top")], "document_id long, text_full string, type string")
    assert [(r["text_full"], r["content_hash"] is None) for r in I.segment_rows(seg).collect()] == [("ab", False), ("", True), (None, True)]


def test_queue(spark):
    queue = spark.createDataFrame([("p1", "done")], "package_id string, status string")
    jobs = spark.createDataFrame([("p1", "done"), ("p2", "done"), ("p2", "done"), ("p3", "failed")], "package_id string, status string")
    assert [r["package_id"] for r in I.pending(I.enqueue(queue, jobs)).collect()] == ["p2"]


def test_anchors_and_hints(spark):
    df = spark.createDataFrame([("# Titel\nText", "0.8"), ("Text", None), ("* a", "1")], "a string, c string")
    got = [r[0] for r in df.select(I.clean_anchor(F.col("a"), F.col("c"))).collect()]
    assert [(g["anchor"], round(g["confidence"], 3)) for g in got] == [("Text", 0.68), ("Text", 0.0), ("", 0.7)]
    agenda = spark.createDataFrame([(1, 0, "1"), (1, 1, "2"), (1, 2, "3"), (1, 3, "4")], "document_id long, row_index int, top_key string")
    hints = spark.createDataFrame([(1, 0, "1", 5), (1, 1, "2", 3), (1, 2, "2", 9), (1, 3, "4", 8), (1, 4, "x", 1)], "document_id long, ord int, top_key string, page_no int")
    assert [r["page_no"] for r in I.align_hints(agenda, hints).orderBy("row_index").collect()] == [5, 5, None, 8]
