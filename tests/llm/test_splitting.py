from hypothesis import given, settings, strategies as st

from minuteworks.llm import splitting as P

PIECE = st.sampled_from(["Ein Satz. ", "Noch ein langer Satz mit vielen Wörtern! ", "\n\n", "\n", "wort ", "x" * 70, "# Titel\n", "TOP 3 Thema\n", "Ende?\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECE, max_size=120).map("".join))
def test_pieces_cover_the_text(text):
    pieces = P.split_text(text, 240, 20)
    assert "".join(text[n:b] for _, n, b, _ in pieces) == text
    assert all(b - a <= 240 for a, _, b, _ in pieces)
    for (_, _, end, _), (start, new, _, _) in zip(pieces, pieces[1:], strict=False):
        assert new == end and new - 20 <= start <= new


def test_natural_boundaries_come_first():
    text = ("Das ist ein Satz. " * 8 + "\n\n") * 30
    kinds = {k for *_, k in P.split_text(text)[:-1]}
    assert kinds == {"paragraph"}
    assert {k for *_, k in P.split_text("Das ist ein Satz. " * 400)[:-1]} == {"sentence"}


def test_forced_and_rows(spark):
    rows = [(1, "a" * 6000, 1), (2, "Satz. " * 1000, 1), (3, "kurz", 1), (4, None, 1), (5, "", 1), (6, "wort " * 800, 2), (1, "a" * 6000, 1)]
    pieces = P.split_oversized(spark.createDataFrame(rows, "id long, text_full string, piece int"))
    assert {tuple(r) for r in P.split_kinds(pieces).collect()} == {(1, "forced"), (2, "natural"), (6, "forced")}
    assert pieces.where("length(text) > 2400").count() == 0
    assert pieces.where("id = 5").count() == 1 and pieces.where("id = 4").count() == 0
    assert P.split_oversized(spark.createDataFrame([], "id long, text_full string")).count() == 0


def test_stretches_within_the_limit_are_never_cut():
    """A stretch of up to the limit is one piece, its repeat gives way; one more character is cut at a word."""
    for n in (2199, 2201, 2299, 2399, 2400):
        stretch = ("wort " * 500)[: n - 1] + "x"
        for end in (". ", "\n", "\n\n", "! \n"):
            text = "Kurz davor. " + stretch + end + "Danach. " * 20
            assert all(k in P.NATURAL_ENDS for *_, k in P.split_text(text)), (n, end)
    assert "word" in {k for *_, k in P.split_text("wort " * 481)}


def test_only_siblings_are_merged():
    """Pieces never join the tail of a divided section with the next section."""
    long = "# A\n" + "Ein Satz im Abschnitt. " * 150
    text = long + "\n# B\n" + "Kurz. " * 20
    pieces = P.split_text(text)
    assert text[pieces[-1][1] :].startswith("# B")
    nested = "# A\n## A1\n" + "Satz eins. " * 150 + "\n## A2\n" + "Satz zwei. " * 150 + "\n# B\nEnde.\n"
    starts = [nested[n:][:4] for _, n, _, _ in P.split_text(nested)]
    assert starts == ["# A\n", "## A", "# B\n"] or starts == ["# A\n", "## A", "## A", "# B\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Satz. ", "wort ", "\n", "\n\n", "x" * 90, "Was? ", ".", "\r"]), max_size=60).map("".join))
def test_forced_means_a_long_stretch(text):
    """A cut at no natural boundary is made if and only if a stretch exceeds the limit."""
    import re

    longest = max(map(len, re.split(r"\n|\r|[.!?]\s", text)))
    pieces = P.split_text(text, 100, 10)
    if len(text) > 100:
        assert any(k not in P.NATURAL_ENDS for *_, k in pieces) == (longest > 100)
