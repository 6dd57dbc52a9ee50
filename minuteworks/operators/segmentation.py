"""Agenda-driven segmentation: candidates for every agenda item, best monotone path, spans.

A document's pages and agenda are one group, so a task holds one document at a time.
Pages are joined into one text; places are offsets in it and become (page, char) at
the end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from minuteworks.functions.similarity import best_window

#: Candidate scores by method (fixed values).
HEADING, KEY_TITLE, KEY_ONLY, TITLE_HEADING, TITLE_ONLY, LAST_RESORT, WEAK = 95.0, 40.0, 22.0, 20.0, 20.0, 35.0, 10.0
MOST_CANDIDATES = 60
SAME_PAGE, PER_PAGE = 0.6, 0.25
GAP = 2  # characters between two pages of the joined text


@dataclass(frozen=True)
class Candidate:
    """A place where an agenda item may begin."""

    page: int
    char: int
    score: float
    method: str


def key_pattern(key: str) -> str:
    """FN10: an agenda key as print varies it: blanks and commas around points, blanks before letters."""
    parts = [p for p in re.split(r"[.\s]+", key.strip()) if p]
    parts = [re.sub(r"(?<=\d)(?=[A-Za-z])", r"\\s*", re.escape(p)) for p in parts]
    return r"\s*[.,]\s*".join(parts)


def heading_pattern(key: str) -> re.Pattern:
    """FN11: the key at a line's start, ``- 10 -`` or TOP before it, no further number behind it."""
    return re.compile(rf"(?mi)^[ \t]*(?:-\s*\d+\s*-\s*)?(?:TOP\s*)?(?:{key_pattern(key)})(?!\d)(?!\.\d)(?!\s+\.\s*\d)\.?(?=[\s:.)-])")


def anywhere_pattern(key: str) -> re.Pattern:
    """FN12: the key anywhere, no number around it."""
    return re.compile(rf"(?<!\d)(?:{key_pattern(key)})(?!\d)(?!\.\d)")


def words_of_title(title: str) -> list[str]:
    """FN21 for one title."""
    return [w for w in re.sub(r"[^a-z0-9äöüß]+", " ", title.lower()).split() if len(w) >= 5][:3]


def title_lines(page: str, title: str) -> list[int]:
    """FN22: offsets of lines that begin with a title, at most six characters in."""
    out, at, wanted = [], 0, title.strip().lower()[:40]
    for line in page.split("\n"):
        found = line.lower().find(wanted) if wanted else -1
        if 0 <= found <= 6:
            out.append(at + found)
        at += len(line) + 1
    return out


def snap_back(page: str, at: int, key: str, most: int = 140) -> int:
    """FN24: the start of the key's line shortly before a place, else the place."""
    before = [m.start() for m in re.finditer(rf"(?mi)^[ \t]*(?:TOP\s*)?{key_pattern(key)}\b", page[max(0, at - most) : at])]
    return max(0, at - most) + before[-1] if before else at


def layout_bonus(lines: list[tuple[str, float, float]], title: str, median: float) -> float:
    """FN25: bonus of the line most like a title: bold letters, larger print. Lines: text, bold share, size."""
    best = max(((best_window(title.lower(), t.lower()), b, s) for t, b, s in lines), default=(0.0, 0.0, 0.0))
    if best[0] < 88:
        return 0.0
    bonus = 8.0 if best[1] >= 0.5 else 4.0 if best[1] >= 0.3 else 0.0
    return bonus + (4.0 if best[2] >= 1.15 * median else 2.0 if best[2] >= 1.08 * median else 0.0) if median else bonus


def candidates_of(pages: list[str], key: str, title: str, first: int = 0, bonus: dict[int, float] | None = None) -> list[Candidate]:
    """CP11: places for one agenda item on pages from ``first`` on, best first, at most MOST_CANDIDATES."""
    bonus, out = bonus or {}, []
    heading, anywhere, words = heading_pattern(key), anywhere_pattern(key), words_of_title(title or "")
    for n in range(first, len(pages)):
        page, extra = pages[n], bonus.get(n, 0.0)
        seen = set()
        for m in heading.finditer(page):
            start = m.start() + (len(m.group()) - len(m.group().lstrip()))
            seen.add(start)
            ratio = best_window(title.lower()[:160], page[m.end() : m.end() + 520].lower()) if title else 0.0
            report = 20.0 if re.search(r"Berichterstatter|Bericht erstattet", page[m.end() : m.end() + 400]) else 0.0
            # Titles tell headings from numbered lists.
            out.append(Candidate(n, start, HEADING + extra + report + (ratio - 70) * 0.2 if title else HEADING + extra + report, "heading_line"))
        for m in anywhere.finditer(page):
            if any(abs(m.start() - s) < 12 for s in seen):
                continue
            low = 6.0 if m.start() < 80 else 0.0
            near = page[m.end() : m.end() + 520].lower()
            ratio = best_window(title.lower()[:160], near) if title and any(w in near for w in words) else 0.0
            if ratio < 55 and re.search(r"\d{3,4}/\d{4}", page[m.end() : m.end() + 260]):
                out.append(Candidate(n, m.start(), WEAK + extra - low, "key_only_weak"))
            elif ratio >= 70 or not title:
                out.append(Candidate(n, m.start(), KEY_TITLE + ratio + extra - low, "key_title"))
            elif ratio:
                out.append(Candidate(n, m.start(), KEY_ONLY + 0.35 * ratio + 0.5 * extra - low, "key_only"))
    if not out and title:
        for n in range(first, len(pages)):
            for at in title_lines(pages[n], title):
                start = snap_back(pages[n], at, key)
                out.append(Candidate(n, start, TITLE_HEADING + 100 + bonus.get(n, 0.0) + (6.0 if start != at else 0.0), "title_heading"))
    if not out and title:
        for n in range(first, len(pages)):
            ratio = best_window(title.lower()[:160], pages[n][:3500].lower()) if any(w in pages[n][:3500].lower() for w in words) else 0.0
            if ratio >= 90:
                out.append(Candidate(n, 0, TITLE_ONLY + ratio + bonus.get(n, 0.0), "title_only"))
    if not out and first < len(pages) and (m := anywhere.search(pages[first])):
        out.append(Candidate(first, m.start(), LAST_RESORT + bonus.get(first, 0.0), "key_only"))
    return sorted(out, key=lambda c: (-c.score, c.page, c.char))[:MOST_CANDIDATES]


def best_path(levels: list[list[Candidate]]) -> list[Candidate | None]:
    """WN15: one candidate a level, places strictly rising, of the greatest score less jumps.

    A jump costs SAME_PAGE on one page, PER_PAGE a page else. A level without
    candidates, or without one behind any chosen so far, is left out.
    """
    chains: list[tuple[float, tuple[int, int], tuple | None]] = [(0.0, (-1, -1), None)]  # score, place, (level, candidate, chain before)
    for i, level in enumerate(levels):
        new = []
        for c in level:
            place = (c.page, c.char)
            best = None
            for score, before, link in chains:
                if before < place:
                    cost = 0.0 if link is None else SAME_PAGE if before[0] == c.page else PER_PAGE * (c.page - before[0])
                    if best is None or score + c.score - cost > best[0]:
                        best = (score + c.score - cost, place, (i, c, link))
            if best:
                new.append(best)
        # Chains that leave this level out stay open; of two at one place the better stands.
        kept: dict[tuple[int, int], tuple] = {}
        for chain in (*chains, *new):
            if chain[1] not in kept or chain[0] > kept[chain[1]][0]:
                kept[chain[1]] = chain
        chains = list(kept.values())
    out: list[Candidate | None] = [None] * len(levels)
    link = max(chains, key=lambda c: c[0])[2]
    while link:
        out[link[0]], link = link[1], link[2]
    return out


def flow_start(pages: list[str]) -> tuple[int, int]:
    """FN26 to FN28: where the contents begin: behind the agenda, at the public part or the first running paragraph."""
    agenda = -1
    for n, page in enumerate(pages):
        lines = [x.strip() for x in page.split("\n") if x.strip()]
        short = sum(len(x) < 90 for x in lines)
        if re.search(r"(?mi)^\s*Tagesordnung\b", page) and len(lines) >= 8 and short >= 0.55 * len(lines):
            agenda = n
    if agenda < 0:
        return 0, 0
    for n in range(agenda, len(pages)):
        if m := re.search(r"(?m)^\s*Öffentlicher Teil\b.*$", pages[n]):
            if n > agenda or _flows(pages[n][m.end() :]):
                return n, m.start()
        at = 0
        for paragraph in pages[n].split("\n\n"):
            if _flows(paragraph):
                return n, at
            at += len(paragraph) + 2
    return min(agenda + 1, len(pages) - 1), 0


def _flows(paragraph: str) -> bool:
    lines = [x for x in paragraph.split("\n") if x.strip()]
    return bool(lines) and len(paragraph) >= 250 and len(re.findall(r"[.!?](?:\s|$)", paragraph)) >= 2 and sum(bool(re.match(r"\s*\d", x)) for x in lines) < 0.2 * len(lines) + 1


def appendix_start(pages: list[str]) -> int | None:
    """FN30: the first page after the first whose head says that it is an appendix."""
    for n in range(1, len(pages)):
        head = [x.strip() for x in pages[n].split("\n") if x.strip()][:3]
        if any(re.match(r"(?:Anlage|Anhang|Appendix)\b", x) for x in head):
            return n
    return None


def segment(pages: list[str], agenda: list[tuple[str, str]]) -> list[dict]:
    """CP12, CP13: spans of preface, agenda items, closing and appendix of one document.

    Items that the path leaves out are looked for once more between their neighbours'
    places, with half the bar; the new path is taken if it has more items.
    """
    if not pages:
        return []
    first, at = flow_start(pages)
    last = appendix_start(pages)
    body = pages[:last] if last is not None else pages
    levels = [[c for c in candidates_of(body, key, title, first) if (c.page, c.char) >= (first, at)] for key, title in agenda]
    path = best_path(levels)
    if any(c is None for c in path):
        wider = [lv if lv else candidates_of(body, key, title, 0) for lv, (key, title) in zip(levels, agenda, strict=True)]
        again = best_path(wider)
        path = again if sum(c is not None for c in again) > sum(c is not None for c in path) else path
    starts = [0]
    for p in body:
        starts.append(starts[-1] + len(p) + GAP)
    text = ("\n" * GAP).join(body)
    where = lambda c: starts[c.page] + c.char
    found = [(where(c), i) for i, c in enumerate(path) if c is not None]

    def span(kind: str, key: str | None, title: str | None, a: int, b: int, method: str, score: float | None, confidence: float) -> dict:
        b = max(a, b)
        p, q = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
        return {"seg_type": kind, "top_key": key, "title": title, "start_page": min(p, len(body) - 1) + 1, "start_char": a - starts[min(p, len(body) - 1)], "end_page": min(q, len(body) - 1) + 1, "end_char": b - starts[min(q, len(body) - 1)], "match_method": method, "match_score": score, "confidence": confidence, "text_full": text[a:b].strip()}

    out = []
    if found and text[: found[0][0]].strip():
        out.append(span("vorwort", None, None, 0, found[0][0], "before_first", None, 0.98))
    closing = None
    if found and (m := re.compile(r"(?m)^\s*(?:Die Sitzung (?:wird|wurde) (?:um .{0,20})?geschlossen|Ende der Sitzung|Schluss der Sitzung)").search(text, found[-1][0])):
        closing = m.start()
    for (a, i), nxt in zip(found, [*found[1:], None][: len(found)], strict=True):
        b = nxt[0] if nxt else (closing if closing is not None else len(text))
        c = path[i]
        sure = 0.99 if c.method in ("key_title", "title_heading") and c.score >= 120 else 0.95
        out.append(span("top", agenda[i][0], agenda[i][1], a, b, c.method, round(c.score, 4), sure))
    for i, (key, title) in enumerate(agenda):
        if path[i] is None:
            out.append({"seg_type": "top", "top_key": key, "title": title, "start_page": None, "start_char": None, "end_page": None, "end_char": None, "match_method": "missing", "match_score": None, "confidence": 0.0, "text_full": None})
    if closing is not None:
        out.append(span("nachwort", None, None, closing, len(text), "closing_line", None, 0.98))
    if last is not None:
        out.append({"seg_type": "anhang", "top_key": None, "title": None, "start_page": last + 1, "start_char": 0, "end_page": len(pages), "end_char": len(pages[-1]), "match_method": "header", "match_score": None, "confidence": 0.95, "text_full": "\n\n".join(pages[last:]).strip()})
    return out


SCHEMA = "document_id long, seg_type string, top_key string, title string, start_page int, start_char int, end_page int, end_char int, match_method string, match_score double, confidence double, text_full string"


def segment_documents(pages: DataFrame, agenda: DataFrame) -> DataFrame:
    """Segments of all documents.

    ``pages``: document_id, page_no, page_text (normalised); ``agenda``: document_id,
    row_index, top_key, title. A document without agenda or pages gives no row; null
    pages count as empty, agenda rows without key are left out.
    """
    p = pages.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("pages"))
    a = agenda.where("top_key is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "top_key", F.coalesce("title", F.lit("")).alias("title")))).alias("agenda"))

    def run(parts):
        for part in parts:
            rows = []
            for doc, texts, tops in zip(part["document_id"], part["pages"], part["agenda"], strict=True):
                rows += [{"document_id": doc} | s for s in segment(list(texts), [(t["top_key"], t["title"]) for t in tops])]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for c in ("start_page", "start_char", "end_page", "end_char"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return p.join(a, "document_id").mapInPandas(run, SCHEMA)


def anchor_spans(hints: DataFrame, pages: DataFrame, window: int = 1) -> DataFrame:
    """CP14, FN33: places of hinted anchors: the first page within ``window`` pages that holds the anchor's start.

    ``hints``: document_id, ord, page_no, anchor. Returns them with ``page_found`` and
    ``char`` (0-based), null where no page holds it.
    """
    near = hints.join(pages.select("document_id", F.col("page_no").alias("p"), "page_text"), "document_id").where(F.abs(F.col("p") - F.col("page_no")) <= window)
    hit = near.withColumn("at", F.expr("instr(page_text, substring(trim(anchor), 1, 120))"))
    best = hit.where("at > 0").groupBy("document_id", "ord").agg(F.min_by(F.struct("p", "at"), F.struct(F.abs(F.col("p") - F.col("page_no")), "p")).alias("b"))
    return hints.join(best, ["document_id", "ord"], "left").select(*hints.columns, F.col("b.p").alias("page_found"), (F.col("b.at") - 1).alias("char"))


def hinted_spans(agenda: DataFrame, hints: DataFrame, pages: DataFrame) -> DataFrame:
    """CP14: segments from hints: each item from its anchor's place to the next one's; preface and closing around them.

    Rows as those of ``segment_documents``. Hints are aligned to the agenda first; an
    item whose anchor isn't found begins with its page, one without hint has no span.
    The closing is always given, empty where the last item takes all.
    """
    from pyspark.sql import Window

    from minuteworks.functions import text as T
    from minuteworks.sources.imports import align_hints

    first = hints.groupBy("document_id", "top_key").agg(F.min_by("anchor", "ord").alias("anchor"))
    aligned = align_hints(agenda, hints).join(first, ["document_id", "top_key"], "left").join(agenda.select("document_id", "row_index", "title"), ["document_id", "row_index"])
    placed = anchor_spans(aligned.withColumnRenamed("row_index", "ord"), pages)
    total = pages.groupBy("document_id").agg(F.max("page_no").alias("last_page"), F.max_by(F.length("page_text"), "page_no").alias("last_size"))
    at = placed.join(total, "document_id").withColumn("begin", F.when(F.coalesce("page_found", "page_no").isNotNull(), F.struct(F.coalesce("page_found", "page_no").cast("int").alias("p"), F.coalesce("char", F.lit(0)).cast("int").alias("c"))))
    order = Window.partitionBy("document_id").orderBy("ord")
    # Places never fall: an anchor found before its predecessor begins where that does.
    at = at.withColumn("begin", F.when(F.col("begin").isNotNull(), F.max("begin").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    at = at.withColumn("after", F.first("begin", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    end = F.coalesce("after", F.struct(F.col("last_page").cast("int").alias("p"), F.coalesce("last_size", F.lit(0)).cast("int").alias("c")))
    tops = at.withColumn("finish", F.when(F.col("begin").isNotNull(), end)).select("document_id", F.lit("top").alias("seg_type"), "top_key", "title", "begin", "finish", F.when(F.col("begin").isNull(), "missing").when(F.col("page_found").isNull(), "hint_page").otherwise("hint_anchor").alias("match_method"))
    ends = at.groupBy("document_id").agg(F.min("begin").alias("first"), F.max(end).alias("last"))
    zero = F.struct(F.lit(1).alias("p"), F.lit(0).alias("c"))
    no = F.lit(None).cast("string")
    around = [ends.where(F.col("first").isNotNull()).select("document_id", F.lit(kind).alias("seg_type"), no.alias("top_key"), no.alias("title"), a.alias("begin"), b.alias("finish"), F.lit("hint_edge").alias("match_method")) for kind, a, b in (("vorwort", zero, F.col("first")), ("nachwort", F.col("last"), F.col("last")))]
    spans = tops.unionByName(around[0]).unionByName(around[1]).withColumn("sid", F.monotonically_increasing_id())
    lists = pages.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("texts"))
    text = F.when(F.col("begin").isNotNull(), T.span_text(F.col("texts"), F.col("begin.p") - 1, F.col("begin.c"), F.col("finish.p") - 1, F.col("finish.c")))
    return spans.join(lists, "document_id").select(
        "document_id", "seg_type", "top_key", "title", F.col("begin.p").alias("start_page"), F.col("begin.c").alias("start_char"), F.col("finish.p").alias("end_page"), F.col("finish.c").alias("end_char"),
        "match_method", F.lit(None).cast("double").alias("match_score"), F.when(F.col("match_method") == "hint_anchor", 0.9).when(F.col("begin").isNull(), 0.0).otherwise(0.7).alias("confidence"), text.alias("text_full"),
    )
