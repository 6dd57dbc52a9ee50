import pytest

from minuteworks.llm import defects as D, language as L

REPORT = "Der Ausschuss nimmt den Bericht zur Sanierung der Turnhalle vom 01.02.2020 zur Kenntnis. Die Fraktion ABC stimmt der Vorlage zu und bittet um Prüfung der Kosten."
FRENCH = "Les habitants du quartier se sont plaints du bruit à plusieurs reprises. La réponse écrite est jointe au procès-verbal pour les membres de la commission."
Q = "Was wurde zur Sanierung der Turnhalle beschlossen?"
CASES = [
    (1, Q, REPORT, None, None), (2, Q, "", None, "empty"), (3, Q, " ", "", "empty"), (4, Q, None, None, "empty"), (5, Q, "<p></p>", None, "empty"), (6, Q, "null", None, "empty"),
    (7, Q, None, "Welches Jahr ist gemeint?", None), (8, Q, "  " + Q + "\n", None, "copies_query"), (9, Q, Q.upper(), None, "copies_query"), (10, Q, f"Sie fragen: {Q}", None, "copies_query"),
    (11, Q, f"Zur Frage „{Q}“: {REPORT}", None, None), (12, Q, "Diese Frage kann ich leider nicht beantworten.", None, "refusal"), (13, Q, "Dazu darf ich keine Auskunft geben. Kann ich sonst etwas für Sie tun?", None, "refusal"),
    (14, Q, REPORT + " Die Verwaltung erklärte, sie könne hierzu noch keine Auskunft geben.", None, None), (15, Q, REPORT + " Die Verwaltung wird beauf", None, "truncated"), (16, Q, REPORT + " Die Frist läuft bis zum 19.", None, "truncated"),
    (17, Q, FRENCH, None, "wrong_language"), (18, Q + " Bitte auf Französisch antworten.", FRENCH, None, None), (19, Q + " Bitte auf Französisch antworten.", REPORT, None, "wrong_language"), (20, Q, REPORT + " [1]", None, None),
    (21, Q, REPORT + "\n\n– TOP 3: Sanierung (vertagt)", None, None), (22, None, REPORT, None, None), (23, None, None, None, "empty"),
]


@pytest.fixture(scope="module")
def tagger(spark, sf):
    return L.train_on(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), rows_per_language=80)


def test_cases(spark, tagger):
    rows = CASES + [(1000 + i, Q, REPORT, None, None) for i in range(300)]
    df = spark.createDataFrame([(*r[:4], "v") for r in rows], "id long, query string, answer string, clarify string, votes string")
    got = {r["id"]: r["first_defect"] for r in D.flag(df, tagger).collect()}
    for case in CASES:
        assert got[case[0]] == case[4], case


def test_several_labels(spark, tagger):
    rows = [(i, Q, REPORT, None) for i in range(200)] + [(900, Q, Q.rstrip("?"), None)]
    r = D.flag(spark.createDataFrame(rows, "id long, query string, answer string, clarify string"), tagger).where("id = 900").first()
    assert r["defects"][:2] == ["copies_query", "truncated"] and len(r["posteriors"]) == 5


def test_empty_table(spark, tagger):
    assert D.flag(spark.createDataFrame([], "id long, query string, answer string, clarify string"), tagger).count() == 0


def test_label_model_finds_the_rare_class():
    post = D.fit({(1, 1, 1): 20, (-1, -1, -1): 950, (0, -1, -1): 30, (1, 1, 0): 5})
    assert post[1, 1, 1] > 0.99 and post[1, 1, 0] > 0.5 and post[-1, -1, -1] < 0.01 and post[0, -1, -1] < 0.5


def test_copies_in_quotations_and_short_questions(spark, tagger):
    answers = {901: f"Sie fragen: „{Q}“", 902: f"Ihre Frage lautet: „{Q}“", 903: f"„{Q}“"}
    rows = [(i, Q, REPORT, None) for i in range(300)] + [(i, Q, a, None) for i, a in answers.items()]
    got = {r["id"]: r["first_defect"] for r in D.flag(spark.createDataFrame(rows, "id long, query string, answer string, clarify string"), tagger).where("id >= 900").collect()}
    assert got == dict.fromkeys(answers, "copies_query")


def test_no_copies_function_is_skipped_where_it_votes():
    cases = ((Q, f"Sie fragen: „{Q}“", ["sie", "fragen"]), ("Wer?", "Sie fragen: Wer?", ["sie", "fragen", "wer"]), ("Wann tagt der Rat", "Wanm tagd der Rad", ["wanm", "tagd", "der", "rad"]))
    got = [D.votes(q, a, None, "de", (None, 0.0), words)[1] for q, a, words in cases]
    assert got[0] == [1, 1, 1, 1] and got[1][0] == 1 and got[2][3] >= 0


def test_functions_are_taken_independently_and_abstain_where_nothing_is():
    v = D.votes(Q, None, "Welches Jahr?", "de", ("de", 0.9), ["welches", "jahr"])
    assert v[2] == [0] * 4 and v[3] == [0] * 3 and v[4][0] == -1
    assert D.votes(Q, None, f"{Q} {Q}", "de", ("de", 0.9), [])[1][0] == 1
    patterns = {tuple(x) for text in ("Das kann ich nicht sagen.", REPORT, "Leider nein.", "Ich habe am 01.02.2020 die Niederschrift gelesen.") for x in [D.refusal_votes(text, text.lower().strip(".").split(), "de")]}
    assert len(patterns) == 4


def test_the_model_decides_against_single_votes(spark, tagger):
    """Some function votes for a refusal in every report; switched off (any vote counts), all would be flagged."""
    noisy = REPORT + " Die Verwaltung erklärte, sie könne hierzu noch keine Auskunft geben."
    rows = [(i, Q, noisy, None) for i in range(300)] + [(1000 + i, Q, "Diese Frage kann ich leider nicht beantworten.", None) for i in range(20)]
    flags = D.flags(spark.createDataFrame(rows, "id long, query string, answer string, clarify string"), tagger)
    got = {r["id"]: r["first_defect"] for r in flags.rows.collect()}
    assert D.refusal_votes(noisy, noisy.lower().split(), "de").count(1) == 1
    assert all(got[i] is None for i in range(300)) and all(got[1000 + i] == "refusal" for i in range(20))


def test_cutoffs_are_validated_on_planted_defects(spark, tagger):
    rows = [(i, f"{Q} {i}", f"{REPORT} Das waren {i} Punkte.", None) for i in range(300)] + [(1000 + i, Q, FRENCH, None) for i in range(9)] + [(2000 + i, Q, "", None) for i in range(9)]
    flags = D.flags(spark.createDataFrame(rows, "id long, query string, answer string, clarify string"), tagger, validation_rows=60)
    assert [c[0] for c in flags.cutoffs] == list(D.DEFECTS)
    for defect, cutoff, precision, recall, cases in flags.cutoffs:
        assert 0.1 <= cutoff <= 0.9
        if defect in ("empty", "copies_query"):
            assert cases > 20 and precision > 0.9 and recall > 0.9


def test_cutoffs_take_every_sound_pair(spark, tagger):
    """Each distinct pair gets each defect: 900 of them, with 400 copies of one that count once."""
    rows = [(i, f"{Q} {i}", f"{REPORT} Das waren {i} Punkte.", None) for i in range(900)] + [(5000 + i, f"{Q} 0", f"{REPORT} Das waren 0 Punkte.", None) for i in range(400)]
    rows += [(2000 + i, Q, "", None) for i in range(20)] + [(3000 + i, f"Qu'est-ce qui a été décidé pour la rue {i} ?", f"{FRENCH} Rue {i}.", None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, query string, answer string, clarify string")
    cutoffs = D.flags(df, tagger).cutoffs
    assert {d: n for d, *_, n in cutoffs} == dict.fromkeys(D.DEFECTS, 920)
    assert cutoffs == D.flags(df.repartition(7), tagger).cutoffs


def test_planted_votes_are_those_of_the_judge(tagger):
    """Votes taken text by text are what the judge says of each planted pair."""
    judge, pairs = D.Judge(tagger, "de", L.LANGUAGES), [(Q, REPORT), ("Qu'est-ce qui a été décidé pour la rue ?", FRENCH)]
    _, langs, wants = judge([q for q, _ in pairs], [a for _, a in pairs], [None] * 2)
    got = D.planted_counts(judge, [(*p, *lang, want) for p, lang, want in zip(pairs, langs, wants, strict=True)], D.np.random.default_rng(1))
    rng, wanted = D.np.random.default_rng(1), D.Counter()
    for i, (q, a) in enumerate(pairs):
        rng.integers(1)
        for d, text in D.planted(q, a, pairs[1 - i][1], rng).items():
            wanted.update((d, k, D.pattern_of(v)) for k, v in enumerate(judge([q], [text], [None])[0][0]))
    assert got == wanted


def test_places_inside_words():
    import re

    for text in (REPORT, FRENCH, "", "a", "ab  cd 1x x1\n½a a_b é b", "Şu iş 3. madde"):
        assert D.inner_places(text).tolist() == [m.start() for m in re.finditer(r"(?<=[^\W\d_])(?=[^\W\d_]|\s[^\W\d_])", text)]


ODD = (REPORT, FRENCH, "", "„Ja“ – l'été d’ici 3. Mai", "İstanbul'da ı ğ ş", "ß ẞ ſ K ĳ ² ½ ٣ a_b ab1c", "日本 Ж \ud800 é", "a\x85b\xa0c\x1cd​e", "’x' 'y’ z''w")


def test_words_by_bytes_are_those_of_the_patterns():
    for text in ODD:
        for t in (text, text.lower()):
            assert D.words_of(t) == L.WORD.findall(t)
            assert D.runs(t, D._PLAIN_BYTES, D.LETTERS_AND_DIGITS) == D.LETTERS_AND_DIGITS.findall(t)
            assert all(D.letters_beyond(t).count(c) == t.count(c) for cs in D.LETTERS.values() for c in cs)


def test_likeness_is_bounded_by_common_subsequences():
    for a, b in (("abcde", "abxde"), (Q, REPORT), ("", "a"), ("aab", "aba"), (Q, Q)):
        blocks = D.difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert sum(x.size for x in blocks) <= D.common_length(a, b) <= min(len(a), len(b))
    assert D.common_length("abcde", "xbxdxe") == 3 and D.common_length("ab", "ba") == 1


def test_only_open_queries_are_put_to_the_tagger(tagger, monkeypatch):
    """Common words or a request tell the language of most queries."""
    judge, put = D.Judge(tagger, "de", L.LANGUAGES), []
    marginals = judge.marginals
    monkeypatch.setattr(judge, "marginals", lambda words: put.append(len(words)) or marginals(words))
    queries = [Q, "Turnhalle Gesamtkosten", "What was the answer to that?", "Turnhalle, please answer in French", ""]
    wants = judge(queries, [REPORT] * 5, [None] * 5)[2]
    assert put == [6] and wants[0] == wants[4] == "de" and wants[2:4] == ["en", "fr"]


def test_last_sentences_that_break_off():
    cases = {"Erst. Bis am 3.": True, "Es gilt bis zum 19": False, "Die Frist läuft bis zum 19.": True, "Siehe Abs.": True, "Nabs.": False, "(Offen. Zu.": False, "Zu. (Offen": True, "Satz. \n „Offen": True, "Zeile (\nzu": False, "am 3.\nEnde": False}
    assert {t: D.cut_short(t) for t in cases} == cases
