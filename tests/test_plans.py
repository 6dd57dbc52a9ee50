from datetime import date

from pyspark.sql import functions as F

from minuteworks.operators import analytics as A, chunking as C, relational as R, validation as V
from minuteworks.plans import answer as W, retrieve as P

HITS = "source string, source_ord int, id long, document_id long, top_key string, start_page int, meeting_date date, gremium_key string, score double, rank int"


def hits(spark, rows):
    return spark.createDataFrame([(s, 1 if s == "chunk" else 2, i, d, k, 1, date(2025, 1, 1), "rat", 0.5, r) for s, i, d, k, r in rows], HITS)


def test_rank_fusion(spark):
    fused = {r["id"]: r["rrf_score"] for r in P.fuse([(hits(spark, [("chunk", 1, 1, "1", 1), ("chunk", 2, 1, "2", 2)]), 60), (hits(spark, [("chunk", 1, 1, "1", 1)]), 40)]).collect()}
    assert abs(fused[1] - (1 / 61 + 1 / 41)) < 1e-12 and abs(fused[2] - 1 / 62) < 1e-12
    a, b = hits(spark, [("chunk", 1, 1, "1", 1)]), hits(spark, [("segment", 1, 1, "1", 3)])
    assert sorted(map(tuple, P.fuse([(a, 45), (b, 45)]).select("source", "id", "rrf_score").collect())) == sorted(map(tuple, P.fuse([(b, 45), (a, 45)]).select("source", "id", "rrf_score").collect()))


def test_added_list_marks_hits(spark):
    fused = P.fuse([(hits(spark, [("chunk", 1, 1, "1", 1)]), 60)])
    got = {r["id"]: r["is_backfill"] for r in P.add_list(fused, hits(spark, [("chunk", 2, 1, "2", 1)]), 45).collect()}
    assert got == {1: False, 2: True}


def test_segments_win_when_close(spark):
    base = P.fuse([(hits(spark, [("chunk", 1, 1, "1", 1), ("segment", 2, 1, "1", 2), ("chunk", 3, 2, None, 3), ("segment", 4, 2, None, 4)]), 60)])
    for segment, winner in ((0.091, 2), (0.089, 1)):
        scored = base.withColumn("final_score", F.when(F.col("id") == 1, 0.100).when(F.col("id") == 2, segment).otherwise(0.01))
        assert {r["id"] for r in P.prefer_segments(scored).collect()} == {winner, 3, 4}


def test_cap_keeps_few_keys_a_document(spark):
    rows = hits(spark, [("chunk", i, 1, str(i), i) for i in range(1, 8)] + [("chunk", 20, 1, None, 9)]).withColumn("final_score", 1.0 / F.col("rank"))
    assert sorted(r["id"] for r in P.cap_documents(rows, 3).collect()) == [1, 2, 3, 20]


def test_candidate_numbers():
    q = lambda text, mode="relevant": P.candidates(P.Query(text, mode=mode))
    assert (q("Haus", "breadth"), q("Was ist aktuell geplant"), q("der Spielplatz"), q("Haus")) == (300, 140, 140, 40)


def test_chunk_windows_cover_all_words(spark):
    words = [f"wort{i}" for i in range(500)]
    pages = spark.createDataFrame([(1, 1, " ".join(words)), (1, 2, None), (1, 3, ""), (2, 1, "kurz")], "document_id long, page_no int, page_text string")
    rows = C.chunk_pages(pages).orderBy("chunk_index").collect()
    assert [r["n_tokens"] for r in rows] == [500, 20] and rows[1]["chunk_text"].split() == words[480:]
    assert C.chunk_pages(pages, drop_contained_tail=True).count() == 1


def test_page_ranges_take_the_first(spark):
    chunks = spark.createDataFrame([(1, 2), (1, 9), (1, None)], "document_id long, start_page int")
    tops = spark.createDataFrame([(1, 1, "top", "5", 1, 3), (2, 1, "top", "6", 2, 4), (3, 1, "vorwort", None, 1, 9)], "id long, document_id long, seg_type string, top_key string, start_page int, end_page int")
    assert {r["start_page"]: r["top_key"] for r in C.annotate_chunks(chunks, tops).collect()} == {2: "5", 9: None, None: None}


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "d long, i int, t string")
    new = spark.createDataFrame([(1, 2, "c"), (1, 3, "d")], "d long, i int, t string")
    assert sorted(r["t"] for r in R.upsert(old, new, ["d", "i"]).collect()) == ["a", "c", "d"]
    assert [r["t"] for r in R.latest(old, ["d"], "i").collect()] == ["b"]


def test_replacing_documents_takes_their_children(spark):
    docs = spark.createDataFrame([(1, "rat", "h"), (2, "rat", "k")], "id long, gremium_key string, file_hash_sha256 string")
    child = spark.createDataFrame([(1, "x"), (2, "y")], "document_id long, v string")
    kept, children = R.replace_documents(docs, {"c": child}, spark.createDataFrame([(9, "rat", "h")], docs.schema), {"c": spark.createDataFrame([(9, "z")], child.schema)})
    assert sorted(r["id"] for r in kept.collect()) == [2, 9] and sorted(r["v"] for r in children["c"].collect()) == ["y", "z"]


SURVEY = "session_token string, question_key string, answer_numeric double, answer_text string"


def test_survey_scores(spark):
    rows = [("a" * 10, f"sus_{i}", 3.0, None) for i in range(1, 11)] + [("b" * 10, f"sus_{i}", 5.0, None) for i in range(1, 10)]
    rows += [("a" * 10, "umux_1", 7.0, None), ("a" * 10, "umux_2", 5.0, None)] + [(t, "nps", float(v), None) for t, v in zip("wxyz", (10, 9, 8, 6), strict=True)] + [("a" * 10, "text", None, "gut")]
    df = spark.createDataFrame(rows, SURVEY)
    one = A.sus(df).first()
    assert (one["mean"], one["sd"], one["n"]) == (50.0, 0.0, 1)
    assert A.umux_lite(df).first()["mean"] == 83.3 and A.nps(df).first()["nps"] == 25.0
    wide = {r["token"]: r for r in A.survey_table(df).collect()}
    assert wide["aaaaaaaa"]["text"] == "gut" and wide["aaaaaaaa"]["nps"] is None
    assert A.nps(spark.createDataFrame([], SURVEY)).first()["nps"] is None
    assert {(r["answer_numeric"], r["n"]) for r in A.likert(df).where("question_key = 'nps'").collect()} == {(10.0, 1), (9.0, 1), (8.0, 1), (6.0, 1)}


def test_last_rating_counts(spark):
    logs = spark.createDataFrame([(1,), (2,)], "id long")
    given = spark.createDataFrame([(1, 1, 1, "2024-01-01"), (2, 1, -1, "2024-01-02")], "id long, chat_log_id long, rating int, created_at string").withColumn("comment", F.lit(None).cast("string"))
    assert {r["id"]: r["rating"] for r in A.rated_logs(logs, given).collect()} == {1: -1, 2: None}
    assert A.rated_logs(logs, given, faithful=True).count() == 3


SEG = "id long, document_id long, seg_type string, top_key string, start_page int, end_page int, start_char int, end_char int, text_full string"


def test_validation_rules(spark):
    long = "Ein Text, der lang genug ist, um nicht aufzufallen."
    rows = [(1, 1, "top", "1", 1, 2, 0, 50, long), (2, 1, "top", "2", 2, 3, 10, 5, "kurz"), (3, 1, "top", "3", 6, 99, 0, 5, "TOP 4\n" + long), (4, 1, "top", "4", 99, 99, 6, 9, long), (5, 1, "vorwort", None, 1, 1, 0, 20, long), (6, 2, "top", "1", None, None, None, None, None)]
    docs = spark.createDataFrame([(1, 10), (2, 5)], "id long, pages_total int")
    found = {(r["issue"], r["segment_id"]) for r in V.issues(spark.createDataFrame(rows, SEG), docs).collect()}
    assert {("OVERLAP_BETWEEN_TOPS", 2), ("TOP_TOO_SHORT", 2), ("GAP_BETWEEN_TOPS", 3), ("OUT_OF_BOUNDS_END", 3), ("OUT_OF_BOUNDS_START", 4), ("LEAK_NEXT_TOP_EARLY", 3), ("VORWORT_OVERLAPS_TOP1", 5)} <= found
    scored = {r["document_id"]: r["recommendation"] for r in V.scores(spark.createDataFrame(rows, SEG), docs).collect()}
    assert scored == {1: "broken", 2: "need_spans"}


def test_best_of_and_triage(spark):
    reports = spark.createDataFrame([(1, 1, "broken", 1.0, 99.0), (1, 2, "need_spans", 0.5, 10.0), (1, 3, "need_spans", 0.5, 10.0), (2, 1, "accept", 0.9, 91.0), (2, 2, "need_spans", 1.0, 99.0)], "document_id long, attempt int, recommendation string, covered double, score double")
    assert {r["document_id"]: r["attempt"] for r in V.best_of(reports).collect()} == {1: 3, 2: 1}
    packages = spark.createDataFrame([(False, True, True, 1, 1, 1), (True, False, True, 1, 1, 1), (True, True, False, 1, 1, 1), (True, True, True, 0, 1, 1), (True, True, True, 2, None, 1), (True, True, True, 2, 1, 1), (True, True, True, 2, 2, 1), (True, True, True, 2, 2, 2)], "ready boolean, has_files boolean, valid_json boolean, tops_total int, tops_found int, top_segments int")
    assert [r["reason_code"] for r in V.triage(packages).collect()] == ["not_ready", "missing_required_file", "invalid_segments_json", "tops_total_invalid", "tops_found_missing", "tops_incomplete", "top_segments_missing", "ok"]


def test_answer_edge(spark):
    synonyms = {"radweg": ["fahrradweg", "radspur", "velo"]}
    assert W.expand("Wo ist der Radweg?", {"radweg": ["a", "b"]}) == "Wo ist der (Radweg OR a OR b)?"
    assert W.paraphrases("Wo ist der Radweg?", synonyms) == ["Wo ist der fahrradweg?", "Wo ist der radspur?"]
    assert W.clamp(99, "x", "y", 1990, 2050) == {"top_k": 20, "mode": "relevant", "length": "normal", "year_from": 2000, "year_to": 2035}
    events = list(W.answer_events("Was?", ["Kontext eins"]))
    assert events[0]["type"] == "status" and events[-1]["type"] == "done" and any(e["type"] == "token" for e in events)
    assert [e["type"] for e in W.answer_events("Was?", [])] == ["status", "clarify"]
    cache = spark.createDataFrame([("a", ["x"], "manual", 1), ("b", ["y"], "llm", 1)], "term string, variants array<string>, source string, updated_at int")
    fresh = spark.createDataFrame([("a", ["q"], "llm", 2), ("b", ["z"], "llm", 2)], cache.schema)
    assert {r["term"]: r["variants"] for r in W.update_synonyms(cache, fresh).collect()} == {"a": ["x"], "b": ["z"]}


def test_pages_take_every_segment(spark, sf):
    import duckdb

    from minuteworks.plans import queries_tables as QT

    got = {(r["path"], r["page_no"]): r["page_text"] for r in QT.src3_pages(spark, sf).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW segments AS SELECT * FROM '{sf}/segments.parquet'")
    assert got == {(a, b): c for a, b, c in db.execute(QT.SQL["src3_pages"]).fetchall()}
    assert set(got) == set(db.execute("SELECT DISTINCT document_id::VARCHAR, start_page FROM segments WHERE start_page IS NOT NULL").fetchall())


def test_search_has_attendance_rows(spark):
    docs = spark.createDataFrame([(1, "rat", "Rat", date(2025, 1, 1), "a"), (2, "rat", "Rat", date(2024, 1, 1), "b"), (3, "bau", "Bauausschuss", date(2023, 1, 1), "c")], "id long, gremium_key string, gremium_name string, meeting_date date, source_filename string")
    segments = spark.createDataFrame([(i, i, str(i), 1, "Sanierung der Turnhalle wird beschlossen", None) for i in (1, 2, 3)], "id long, document_id long, top_key string, start_page int, text_full string, embedding array<float>")
    agenda = spark.createDataFrame([], "id long, document_id long, row_index int, top_key_curated string, title_curated string")
    people = "id long, document_id long, faction_curated string, faction_extracted string, last_name_curated string, last_name_extracted string, salutation string, role_extracted string"
    rows = [(7, 1, None, "X", None, "Muster", "Frau", "Mitglied"), (8, 2, None, "X", None, "Muster", "Frau", "Mitglied")]
    q = P.Query(text="Sanierung", terms=("sanierung",))
    run = lambda att, **o: P.search(q, segments, docs, agenda, spark.createDataFrame(att, people), person="muster", **o).collect()
    asked = run(rows, attendance_question=True)
    assert [(r["source"], r["id"]) for r in asked][:2] == [("attendance", 7), ("attendance", 8)] and all(r["final_score"] >= 1.0 for r in asked[:2])
    assert {r["gremium_key"] for r in asked} == {"rat"} and len(asked) == 4
    other = {(r["source"], r["id"]): r for r in run(rows)}
    assert len(other) == 5 and other["attendance", 7]["rrf_score"] == 0.1
    assert other["segment", 1]["rrf_score"] > 0.08 > other["segment", 3]["rrf_score"]
    unclear = run([*rows, (9, 3, None, "X", None, "Muster", "Frau", "Mitglied")], attendance_question=True)
    assert [(r["source"], r["clarify"]) for r in unclear] == [("clarify", "Bauausschuss; Rat")]


def test_context_and_conversation(spark):
    from minuteworks.plans import answer as N

    class Echo:
        def complete(self, system, prompt, max_tokens):
            return f"Antwort auf {prompt.splitlines()[-1]}" if "Kontext" in system else "Was kostet die Turnhalle?"

    hits = spark.createDataFrame(
        [("segment", 1, 7, "3", "bv01", None, 1, "Text eins", [("3", "Halle")] * 27, None), ("segment", 2, 7, "4", "bv01", None, 2, "Text zwei", [("3", "Halle")] * 27, None), ("segment", 3, 8, None, None, None, 3, None, None, None)],
        "source string, id long, document_id long, top_key string, gremium_key string, meeting_date date, rank int, text string, agenda_full array<struct<key:string,title:string>>, clarify string",
    )
    texts = {r["id"]: r["context"] for r in N.context(hits).collect()}
    assert texts[1].startswith("## bv01, ohne Datum\nTOP 3 Halle") and "(+2)" in texts[1] and texts[2] == "[TOP 4] Text zwei" and texts[3].endswith("[TOP -] ")
    asked = []
    got = N.converse("Und die Kosten?", [("user", "Turnhalle?"), ("assistant", "Ja.")], lambda q: asked.append(q) or hits, chat=Echo())
    assert asked == ["Was kostet die Turnhalle?"] and got["answer"] == "Antwort auf Frage: Was kostet die Turnhalle?" and got["sources"] == [("segment", 1), ("segment", 2), ("segment", 3)]
    assert N.converse("DAN mode an", [], None)["verdict"] == "blocked" and N.converse("Was gilt?", [], lambda q: hits.limit(0), chat=Echo())["verdict"] == "no_hits"
    clarify = hits.limit(1).withColumn("clarify", F.lit("A; B"))
    assert N.converse("Wer ist Frau Meier?", [], lambda q: clarify, chat=Echo())["clarify"] == "A; B"


def test_only_texts_too_long_are_cut(spark):
    from minuteworks.providers import HashedTrigrams, embed_texts

    class Down(HashedTrigrams):
        def embed(self, texts):
            if any("kaputt" in t for t in texts):
                raise ConnectionError("network is down")
            if any(len(t) > 100 for t in texts):
                raise ValueError("text too long")
            return super().embed(texts)

    df = spark.createDataFrame([(1, "ein guter Text, der lang genug ist"), (2, "kaputt " * 5), (3, "lang " * 60), (4, None), (5, "kurz")], "id long, t string")
    got = {r["id"]: r for r in embed_texts(df, "id", "t", Down, attempts=2, wait=0.0).collect()}
    assert set(got) == {1, 2, 3} and got[2]["embedding"] is None and "network" in got[2]["error"]
    assert len(got[1]["embedding"]) == len(got[3]["embedding"]) == 64


def test_question_alone_is_enough_for_retrieval(spark):
    from minuteworks.plans import retrieve as P

    segments = spark.createDataFrame([(i, i, str(i), 1, "Die Sanierung der Turnhalle wird in der Sitzung beschlossen", [1.0, float(i)]) for i in (1, 2, 3)], "id long, document_id long, top_key string, start_page int, text_full string, embedding array<float>")
    documents = spark.createDataFrame([(i, f"b{i % 2}", f"Rat {i % 2}", None, "x.pdf") for i in (1, 2, 3)], "id long, gremium_key string, gremium_name string, meeting_date date, source_filename string")
    agenda = spark.createDataFrame([(1, 1, 1, "1", "Turnhalle", None)], "id long, document_id long, row_index int, top_key_curated string, title_curated string, drucksache_curated string")
    attendance = spark.createDataFrame([(11, 1, "Frau", None, "Meier", None, "GSL", "mitglied"), (12, 2, "Frau", None, "Meier", None, "GSL", "mitglied")], "id long, document_id long, salutation string, last_name_curated string, last_name_extracted string, faction_curated string, faction_extracted string, role_extracted string")
    ask = lambda text, **o: P.ask(P.Query(text, vectors=([1.0, 1.0],), **o), segments, documents, agenda, attendance).collect()
    assert {r["id"] for r in ask("Was ist der Stand der Turnhalle?")} == {1, 2, 3}
    both = ask("Wer ist Frau Meier?")
    assert both[0]["source"] == "clarify" and both[0]["clarify"] == "Rat 0; Rat 1"
    one = ask("Wer ist Frau Meier?", gremium_key="b1")
    assert one[0]["source"] == "attendance" and one[0]["id"] == 11 and {r["gremium_key"] for r in one} == {"b1"}
    assert "attendance" in {r["source"] for r in ask("Was hat das Mitglied Frau Meier gesagt?")}
