"""Problem 6: cut oversized texts at natural boundaries by packing a structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 2400, 200
#: Beginnings of headings, by rank: sections of a rank lie inside those of a smaller one.
HEADINGS = (
    re.compile(r"(?m)^(?=# |TOP\s*\d)"), re.compile(r"(?m)^(?=## |[IVX]{1,5}\.\s)"), re.compile(r"(?m)^(?=### |\d{1,2}\.\d{1,2}\.?\s+\S)"),
    re.compile(r"(?m)^(?=#{4} |(?:\d{1,2}\.){2}\d{1,2}\.?\s+\S)"), re.compile(r"(?m)^(?=#{5,6} )"),
)
#: A paragraph ends at a blank line, an item of a list begins with its mark, a line ends at its break.
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
ITEM = re.compile(r"(?m)^(?=[^\S\n]*(?:[-*•–]|\d{1,3}[.)]|[a-z]\))\s)")
LINE = re.compile(r"\r\n?|\n")
LEVELS = (*HEADINGS, PARAGRAPH, ITEM, LINE)
WORD = re.compile(r"\s+")
#: A natural boundary of the statement: a line break, or the end of a sentence.
NATURAL = re.compile(r"\n|\r|[.!?]\s")
#: Ends of pieces that lie at natural boundaries.
NATURAL_ENDS = ("paragraph", "line", "sentence", "end")


def children(text: str, start: int, end: int, level: int) -> list[tuple[int, int]]:
    """The child nodes of ``text[start:end]`` at a level of ``LEVELS``; a boundary belongs to the text before it."""
    cuts = [m.end() for m in LEVELS[level].finditer(text, start, end)]
    edges = [start, *(c for c in cuts if start < c < end), end]
    return list(zip(edges, edges[1:], strict=False))


def stretches(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """The sentences of ``text[start:end]``; of one that only its boundary makes too long, the boundary is parted."""
    out, at = [], start
    for m in NATURAL.finditer(text, start, end):
        if m.start() < at:
            continue
        stop = m.end()
        while stop < end and text[stop].isspace():
            stop += 1
        while stop - at > limit and m.start() - at <= limit:
            cut = min(at + limit, stop)
            out.append((at, cut))
            at = cut
        if at < stop:
            out.append((at, stop))
        at = stop
    return [*out, (at, end)] if at < end else out


def words(text: str, start: int, end: int, room: int) -> list[tuple[int, int]]:
    """Parts of a stretch without natural boundary: cut between words, or inside those beyond ``room``."""
    cuts = [m.end() for m in WORD.finditer(text, start, end)]
    edges = [start, *(c for c in cuts if start < c < end), end]
    return [(i, min(i + room, b)) for a, b in zip(edges, edges[1:], strict=False) for i in range(a, b, room)]


def merge(nodes: list[tuple[int, int]], room: int, below) -> list[tuple[int, int]]:
    """Siblings in order, neighbours joined while they keep to ``room``; a larger one gives way to its own parts.

    Parts of a divided node stay its own: they are not joined with its siblings.
    """
    out: list[tuple[int, int]] = []
    open_ = False
    for a, b in nodes:
        if b - a > room:
            out += below(a, b)
            open_ = False
        elif open_ and b - out[-1][0] <= room:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            open_ = True
    return out


def pack(text: str, start: int, end: int, limit: int, room: int, level: int = 0) -> list[tuple[int, int]]:
    """The structure tree of ``text[start:end]`` packed bottom-up into parts of at most ``room``.

    Only oversized nodes are descended into. A stretch without natural boundary
    may exceed ``room`` up to ``limit``: it is cut at words only beyond that.
    """
    if end - start <= room:
        return [(start, end)]
    if level < len(LEVELS):
        nodes = children(text, start, end, level)
        if len(nodes) == 1:
            return pack(text, start, end, limit, room, level + 1)
        return merge(nodes, room, lambda a, b: pack(text, a, b, limit, room, level + 1))
    return merge(
        stretches(text, start, end, limit), room,
        lambda a, b: [(a, b)] if b - a <= limit else merge(words(text, a, b, room), room, lambda x, y: [(x, y)]),
    )


def overlap_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the repeat of about ``overlap`` characters before ``end`` begins: at a sentence, line or word."""
    low, high = max(start, end - overlap), max(start, end - overlap // 2)
    if low >= end:
        return end
    for pattern in (re.compile(r"\n\s*|[.!?]\s+"), re.compile(r"\s+")):
        if m := pattern.search(text, low, high):
            return m.end()
    return low


def boundary(text: str, start: int, end: int) -> str:
    """What a part ends at: paragraph, line, sentence, word or, inside a word, forced."""
    part = text[max(0, start - 2) : end]  # the boundary may have been parted
    if re.search(r"\n[^\S\n]*\n\s*$", part):
        return "paragraph"
    if re.search(r"[\n\r]\s*$", part) or text[end : end + 1] in ("\n", "\r"):
        return "line"
    if re.search(r"[.!?]\s+$", part) or NATURAL.match(text, end) or NATURAL.match(text, end - 1):
        return "sentence"
    return "word" if part[-1:].isspace() else "forced"


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces (start, new_from, end, boundary): ``text[start:end]`` of at most ``limit``, new from ``new_from``."""
    if len(text) <= limit:
        return [(0, 0, len(text), "end")]
    out: list[tuple[int, int, int, str]] = []
    for a, b in pack(text, 0, len(text), limit, limit - overlap):
        # A stretch that leaves less room than the overlap repeats less.
        begin = overlap_start(text, out[-1][0], a, min(overlap, limit - (b - a))) if out else 0
        out.append((begin, a, b, "end" if b == len(text) else boundary(text, a, b)))
    return out


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "text_full", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``limit`` characters of every text, in order.

    Returns ``id, piece, n_pieces, start_char, new_from, end_char, boundary, kind,
    text``. ``text`` is ``text_full[start_char:end_char]``; a piece repeats the
    characters from ``start_char`` to ``new_from`` of the one before, about
    ``overlap``, less where a stretch without natural boundary needs the room;
    ``boundary`` is what it ends at (paragraph, line, sentence, word, forced, end).
    The pieces without their repeats are the text, character by character. ``kind``
    is ``forced`` where some piece of the text ends at no natural boundary,
    ``natural`` where none does, null for texts within the limit. Such a text is one
    piece, an empty text one empty piece, a null text gives no row. Rows with one id
    are split each by itself.

    Every text is split where it lies: no shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for key, text in zip(p["id"], p["text"], strict=True):
                pieces = split_text(text, limit, overlap)
                kind = None if len(pieces) == 1 else "natural" if all(end in NATURAL_ENDS for *_, end in pieces) else "forced"
                rows += [(key, i, len(pieces), a, n, b, end, kind, text[a:b]) for i, (a, n, b, end) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["id", "piece", "n_pieces", "start_char", "new_from", "end_char", "boundary", "kind", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInPandas(split, f"id {df.schema[id_col].dataType.simpleString()}, piece int, n_pieces int, start_char int, new_from int, end_char int, boundary string, kind string, text string")


def split_kinds(pieces: DataFrame) -> DataFrame:
    """One row per split text: ``id, kind``, as its pieces came out."""
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("id", "kind")
