"""Problem 3: noise in text from scanned pages, and its repair into running paragraphs.

Headers are lines at page edges that come back, fuzzily, across documents, and the
same headings inside run-on text; page numbers are lines of a style whose numbers go up
one by one; words cut at line ends and misread words are told by the corpus vocabulary.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from minuteworks.session import cut, stored

NOISES = ("hyphenation", "misread", "running_header", "page_number")
_NUMBER = r"(?:\d{1,3}|[\dlIO]{1,2}\d|\d[lIO\d]{1,2})"
_PAGE = rf"[-–—\[(]?\s*(?:(?:S\.|Seite:?|Blatt:?|Bl\.|Page:?|p\.)\s*)?{_NUMBER}\s*(?:(?:/|von|of|\|)\s*[\dlIO]{{1,4}}\s*)?[-–—\])]?"
#: A page number in one line with a heading, set apart by blanks.
PAGE_BESIDE = re.compile(rf"^\s*{_PAGE}\s{{2,}}(?=\S)|(?<=\S)\s{{2,}}{_PAGE}\s*$", re.I)
#: Characters that hyphenate at line ends; the last never ends a word by wording.
HYPHENS = "-¬­‐‑"
LAYOUT = "¬­‐"
#: Words after a hyphen that stands for a left-out part (fixed values).
JOINERS = frozenset("und oder sowie bzw beziehungsweise als noch u et bis wie and or ou en of ve".split())
#: Characters and groups that scans take for others of similar shape (fixed values).
SHAPES = (("€", "e"), ("@", "a"), ("+", "t"), ("!", "i"), ("|", "l"), ("$", "s"), ("§", "s"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"))
GROUPS = (("rn", "m"), ("vv", "w"), ("ii", "u"), ("lc", "k"), ("cl", "d"), ("li", "h"))
ODD = re.compile(r"[^\W\d_][€@+!|$§015986347][^\W\d_]|[€@+|$015983](?=[^\W\d_]{3})|[^\W\d_]{3}[€@+|$01598](?![\w.,])|[^\W\d_]¨|¨[^\W\d_]|[^\W\d_]!(?=[^\W\d_])")
WORD = re.compile(r"[^\W_](?:[\w€@+|$§¨]|!(?=[^\W\d_]))*(?:-[^\W\d_](?:[\w€@+|$§¨]|!(?=[^\W\d_]))*)*|[€@+|$](?:[\w€@+|$¨]|!(?=[^\W\d_])){2,}")
def shape(word: str) -> str:
    """A word by the shape of its letters: what scans mix up is one."""
    text = unicodedata.normalize("NFD", word.lower().replace("¨", "").replace("ß", "ss"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    for a, b in SHAPES:
        text = text.replace(a, b)
    # One reading of "cli" is "ch", another "di": all three are one.
    for a, b in (("cli", "q"), ("ch", "q"), ("di", "q"), *GROUPS):
        text = text.replace(a, b)
    return text.replace("i", "l")


def bare(word: str) -> str:
    """A word without case, umlauts and accents: spellings that are no misreadings are one."""
    text = word.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = text.replace(a, b)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    for a, b in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        text = text.replace(a, b)
    return text


def suspicious(word: str) -> bool:
    """Whether misread characters can be in a word."""
    return bool(ODD.search(word)) or any(g in word.lower() for g, _ in GROUPS)


_shape = lru_cache(1 << 16)(shape)


class Names:
    """Names of bodies, found by shape in the shape of a line."""

    def __init__(self, names: list[str]):
        flat = sorted({" ".join(shape(w) for w in WORD.findall(n)) for n in names if n} - {""}, key=len, reverse=True)
        self.words = frozenset(w for n in flat for w in n.split())
        self.pattern = re.compile("(?<!\\S)(?:" + "|".join(map(re.escape, flat)) + ")(?!\\S)") if flat else None

    def mask(self, text: str) -> str:
        """The text with ``#`` for every name."""
        return self.pattern.sub("#", text) if self.pattern else text


def header_key(line: str, names: Names) -> str | None:
    """Fuzzy key of a line that may be a heading: shapes of its words, names of bodies as one, no numbers.

    None for lines that are no heading by themselves: begun in lower case, ended like a
    sentence or clause or inside a word, holding a sentence's end, of fewer than two words.
    """
    text = line.strip()
    if "  " in text:
        text = PAGE_BESIDE.sub("", text).strip()
    if not text or text[0].islower() or text[-1] in ".!?;:," or re.search(rf"[^\W\d_]{{3,}}[.!?]\s|[^\W\d_][{HYPHENS}]$", text):
        return None
    words = [w for w in WORD.findall(text) if not re.fullmatch(r"[\d./]+", w)]
    return names.mask(" ".join(map(_shape, words))) if len(words) > 1 else None


def key_hash(key: str) -> int:
    """A key as a signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: A line of one number, or two, with a word at most before and between: any style that page numbers may have.
_DIGIT = r"(?=[dlIO\d]*\d)[\dlIO]{1,3}"
NUMBERED = re.compile(rf"\W*(?:([^\W\d_]{{1,12}})[.:]{{0,2}}\s*)?({_DIGIT})(?:\s*(?:[^\W\d_]{{1,4}}|[/|])\s*[\dlIO]{{1,4}})?\W*")
_READ = str.maketrans("lIO", "110")


def numbered(line: str) -> tuple[str, int] | None:
    """Style and number of a line that holds nothing else."""
    m = NUMBERED.fullmatch(line)
    if not m:
        return None
    style = re.sub(_DIGIT, "0", line[: m.start(2)].lower() + "0" + re.sub(r"[\dlIO]+", "0", line[m.end(2) :]).lower())
    return re.sub(r"[–—]", "-", re.sub(r"\s+", "", style)), int(m[2].translate(_READ))


class Layout:
    """Lines of a text with what their place tells."""

    def __init__(self, text: str):
        self.lines = [x.strip() for x in text.split("\n")]
        self.numbers = {i: found for i, x in enumerate(self.lines) if 0 < len(x) and (x[-1].isdigit() or x[0].isdigit() or any(c.isdigit() for c in x[:40])) and (found := numbered(x))}
        self.body = [i for i, x in enumerate(self.lines) if x and i not in self.numbers]
        self.place = {i: n for n, i in enumerate(self.body)}
        # Lines that a wrapped sentence goes on in, and others that don't end a block, show the width.
        inner = [(len(self.lines[i]), i) for i in self.body if i + 1 < len(self.lines) and self.lines[i + 1]]
        self.flowing = sorted((x for x in inner if self.lines[x[1]][0].islower()), reverse=True)[:1]
        self.widest = sorted(inner, reverse=True)[:2]

    def width(self, i: int) -> int:
        """Width of the lines around line ``i``."""
        return next((n for n, j in (*self.flowing, *self.widest) if j != i), 0)

    def stands_alone(self, i: int) -> bool:
        """Whether line ``i`` ended though the next word would have fit."""
        line, after = self.lines[i], self.lines[i + 1] if i + 1 < len(self.lines) else ""
        width = self.width(i)
        return not after or len(line) > width or len(line) + 1 + len(after.split()[0]) <= width

    def interrupts(self, i: int) -> bool:
        """Whether a sentence begun before line ``i`` goes on behind it."""
        at = self.place.get(i)
        if at is None:
            at = bisect.bisect_left(self.body, i)
            before, after = at - 1, at
        else:
            before, after = at - 1, at + 1
        return 0 <= before and after < len(self.body) and self.lines[self.body[before]][-1] not in ".!?:;"

    def beside(self, i: int) -> tuple[str, str]:
        """The words before and behind line ``i``, digits as one, over blanks and lines of numbers; blank where there is none."""
        at = self.place[i]
        before = self.lines[self.body[at - 1]].split()[-1] if at else ""
        after = self.lines[self.body[at + 1]].split()[0] if at + 1 < len(self.body) else ""
        return tuple(re.sub(r"\d+", "0", x) for x in (before, after))

    def at_number(self, i: int) -> bool:
        """Whether a line of a number stands beside line ``i``, or a number in it, set apart."""
        if "  " in self.lines[i] and PAGE_BESIDE.search(self.lines[i]):
            return True
        beside = [i - 1 if i and self.lines[i - 1] else i - 2, i + 1 if i + 1 < len(self.lines) and self.lines[i + 1] else i + 2]
        return any(j in self.numbers for j in beside)

    def sequences(self) -> dict[str, list[int]]:
        """Numbers by style, in order."""
        out: dict[str, list[int]] = {}
        for style, number in self.numbers.values():
            out.setdefault(style, []).append(number)
        return out

    def in_order(self) -> set[str]:
        """Styles whose numbers here don't contradict a sequence: a single one, or some that follow another."""
        return {style for style, found in self.sequences().items() if len(found) == 1 or any(0 < b - a <= 3 for a, b in itertools.pairwise(found))}


_DIGITS = re.compile(r"[\dlIO./]*\d[\dlIO./]*")
#: Styles of page numbers in common use, as ``numbered`` writes them.
USUAL_STYLE = r"^[-\[(]?(s\.|seite:?|blatt:?|bl\.|page:?|p\.)?0((/|von|of|\|)0)?[-\])]?$"
_WORDED = rf"(?:S\.|Seite:?|Blatt:?|Bl\.|Page:?|p\.)\s*{_NUMBER}(?:\s*(?:/|von|of|\|)\s*[\dlIO]{{1,4}})?|[-–—]\s*{_NUMBER}\s*[-–—]"
#: A page number with its word or dashes, before or after a heading in running text.
PAGE_BEFORE = re.compile(rf"(?:(?<!\w)(?:S\.|Seite:?|Blatt:?|Bl\.|Page:?|p\.)\s*{_NUMBER}(?:\s*(?:/|von|of|\|)\s*[\dlIO]{{1,4}})?|(?<!\S)[-–—]\s*{_NUMBER}\s*[-–—])\s*$", re.I)
PAGE_AFTER = re.compile(rf"\s*(?:(?:S\.|Seite:?|Blatt:?|Bl\.|Page:?|p\.)\s*{_NUMBER}(?:\s*(?:/|von|of|\|)\s*[\dlIO]{{1,4}})?(?!\w)|[-–—]\s*{_NUMBER}\s*[-–—](?!\S))", re.I)


def units_of(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, symbol) of words by shape, with 0 for a number and ``#`` for a name."""
    words = [(m.start(), m.end(), "0" if _DIGITS.fullmatch(m.group()) else _shape(m.group())) for m in WORD.finditer(text)]
    if not names.pattern:
        return words
    out, at, k = [], 0, 0
    spans = [m.span() for m in names.pattern.finditer(" ".join(w[2] for w in words))]
    for a, b, w in words:
        if k < len(spans) and at > spans[k][1]:
            k += 1
        if k < len(spans) and spans[k][0] <= at < spans[k][1]:
            if at == spans[k][0]:
                out.append((a, b, "#"))
            else:
                out[-1] = (out[-1][0], b, "#")
        else:
            out.append((a, b, w))
        at += len(w) + 1
    return out


def _between(text: str) -> str:
    """Signs between words, without blanks, every dash as one."""
    return re.sub(r"[–—]", "-", re.sub(r"\s+", "", text))


def form_of(line: str, names: Names) -> str | None:
    """What a heading looks like inside a text: symbols and the signs between them; None if it has no word of its own."""
    text = line.strip()
    if "  " in text:
        text = PAGE_BESIDE.sub("", text).strip()
    units = units_of(text, names)
    if len(units) < 2 or all(u in "#0" for *_, u in units):
        return None
    parts = [units[0][2]]
    for (_, end, _), (start, _, u) in zip(units, units[1:], strict=False):
        parts += [_between(text[end:start]), u]
    return "\t".join([*parts, _between(text[units[-1][1] :]), "A" if text.isupper() else "a"])


class Inline:
    """Headings known from lines of their own, found inside other lines."""

    def __init__(self, forms: list[tuple[str, str]]):
        self.forms: dict[str, list[tuple[list[str], list[str], str, bool, str]]] = {}
        for key, form in forms:
            *parts, tail, case = form.split("\t")
            symbols = parts[::2]
            longest = max((u for u in symbols if u not in "#0"), key=len)
            self.forms.setdefault(longest, []).append((symbols, parts[1::2], tail, case == "A", key))

    def find(self, line: str, names: Names) -> list[tuple[int, int, str, bool]]:
        """(start, end, key, whether a page number is beside) of headings."""
        seen = {_shape(w) for w in WORD.findall(line)} & self.forms.keys()
        if not seen:
            return []
        units = units_of(line, names)
        first: dict[str, list[tuple[list[str], list[str], str, bool, str]]] = {}
        for word in seen:
            for form in self.forms[word]:
                first.setdefault(form[0][0], []).append(form)
        out, at = [], 0
        while at < len(units):
            step = 1
            for symbols, signs, tail, upper, key in sorted(first.get(units[at][2], ()), key=lambda f: -len(f[0])):
                got = units[at : at + len(symbols)]
                if [u for *_, u in got] != symbols or any(_between(line[x[1] : y[0]]) != s for x, y, s in zip(got, got[1:], signs, strict=False)):
                    continue
                start, end = got[0][0], got[-1][1]
                if line[start:end].isupper() != upper:
                    continue
                m = re.match(r"\s*[-–—|,]+", line[end:]) if tail else None
                if m and _between(m.group()) == tail:
                    end += m.end()
                before, after = PAGE_BEFORE.search(line[max(0, start - 40) : start]), PAGE_AFTER.match(line, end)
                if before:
                    start = max(0, start - 40) + before.start()
                if after:
                    end = after.end()
                out.append((start, end, key, bool(before or after)))
                step = len(symbols)
                break
            at += step
        return out


def lines_of(text: str, names: Names, keys: frozenset[int] = frozenset(), styles: frozenset[str] = frozenset(), inline: Inline | None = None) -> list[tuple[int, int, str, str | None]]:
    """(start, end, kind, key) of every line: text, blank, page or header; lines of text are parted at headings inside.

    ``keys`` are the hashes of the keys of headers, ``styles`` those of page numbers.
    """
    out, at = [], 0
    layout = Layout(text)
    ordered = layout.in_order() & styles
    for i, line in enumerate(text.split("\n")):
        stripped = line.strip()
        key = None
        if not stripped:
            kind = "blank"
        elif i in layout.numbers and layout.numbers[i][0] in ordered:
            kind = "page"
        else:
            key = header_key(stripped, names) if keys and i not in layout.numbers else None
            key = key if key and key_hash(key) in keys else None
            kind = "header" if key else "text"
        if kind == "text" and inline:
            a = 0
            spans = inline.find(line, names)
            for start, end, found, _ in spans:
                if line[a:start].strip():
                    out.append((at + a, at + start, "text", None))
                out.append((at + start, at + end, "header", found))
                a = end
            if not spans or line[a:].strip():
                out.append((at + a, at + len(line), "text", None))
            at += len(line) + 1
            continue
        out.append((at, at + len(line), kind, key))
        at += len(line) + 1
    return out


def cut_words(text: str, lines: list[tuple[int, int, str, str | None]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, left, right, sure) of places where a word may be cut: at line ends over noise lines, and inside lines."""
    out = []
    body = [x for x in lines if x[2] == "text"]
    following = {a[0]: b for a, b in zip(body, body[1:], strict=False)}
    for a, b, _, _ in body:
        line = text[a:b].rstrip()
        if line[-1:] in HYPHENS and (m := re.search(rf"([^\W\d_]+)([{HYPHENS}])$", line[-80:])):
            nxt = following.get(a)
            n = re.match(r"\s*([^\W\d_]+)", text[nxt[0] : nxt[1]]) if nxt else None
            if n and n[1][:1].islower() and n[1].lower() not in JOINERS:
                out.append((a + len(line) - len(line[-80:]) + m.start(), nxt[0] + n.end(), m[1], n[1], True))
            elif n and m[2] in LAYOUT and n[1].lower() not in JOINERS:
                out.append((a + len(line) - len(line[-80:]) + m.start(), nxt[0] + n.end(), m[1], n[1], n[1][:1].islower()))
        if "- " not in line and not any(c in line for c in LAYOUT):
            continue
        for m in re.finditer(rf"([^\W\d_]+)(?:([{LAYOUT}])[ \t]*|- +)([^\W\d_]+)", line):
            if m[3].lower() not in JOINERS and m[3][:1].islower():
                out.append((a + m.start(), a + m.end(), m[1], m[3], bool(m[2])))
    return out


class Noise:
    """``found``: segment_id, noise; ``texts``: id, text (running paragraphs)."""

    def __init__(self, found: DataFrame, texts: DataFrame):
        self.found, self.texts = found, texts


def clean(
    segments: DataFrame, documents: DataFrame, id_col: str = "id", text_col: str = "text_full", frequent: int = 20_000, max_names: int = 10_000, max_forms: int = 10_000,
    min_docs: int = 2, edge_share: float = 0.5, chance: float = 0.05, dominance: int = 5,
) -> Noise:
    """Find and repair the noise of scanned pages.

    ``found`` has one row per id and kind of NOISES. ``texts`` has every text that isn't
    null as paragraphs of one line each, without page numbers and headers, cut words
    joined, misread words replaced by the corpus's spelling. Empty texts stay empty and
    have no noise; ids may repeat (their findings are merged); other columns are
    ignored. ``documents`` gives the names of bodies, at most ``max_names``.

    * Headers: a line at a page edge stands by itself inside a sentence, or beside a
      page number. A key (the line by the shapes of its words) is a header's if it comes
      from ``min_docs`` documents, or twice from one, at least ``edge_share`` of its
      lines (one more than there are) lie at page edges, more than ``chance`` allows for
      any of the keys tried, and what stands beside it
      tells nothing of it: no word is before, and none behind, more than half of its
      lines, as a piece of a sentence would have. Forms of such lines are also sought inside lines, where text ran together over them; words cut there are joined.
    * Page numbers: a style of lines that hold but a number is one of page numbers if
      where two follow in a text, most go up by one. The styles in common use count as
      one such case, others must also interrupt sentences in a fifth of the lines. In
      a text, numbers of such a style that don't go up are left.
    * Words are counted over all texts (batches send sums), and the ``frequent`` most
      frequent are given to all workers: a bounded list that spares most words the join.
      A word is misread if another of equal shape is ``dominance`` times as frequent.

    Keys, styles and forms are given to all workers; more than ``max_forms`` of one
    raise an error.
    """
    listed = documents.select("gremium_name").where("gremium_name is not null").distinct().limit(max_names + 1).collect()
    if len(listed) > max_names:
        raise ValueError(f"more than {max_names} names of bodies")
    names = Names([r["gremium_name"] for r in listed])
    source = segments.select(F.col(id_col).cast("long").alias("id"), "document_id", F.col(text_col).alias("text")).where("text is not null")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of a batch: words; keys by document; forms of lines at edges; styles of numbers."""
        for p in parts:
            words: Counter[str] = Counter()
            keys: list[tuple] = []
            forms: Counter[tuple[int, str, str]] = Counter()
            styles: dict[str, list[int]] = {}
            for doc, t in zip(p["document_id"], p["text"], strict=True):
                words.update(w for w in WORD.findall(t) if len(w) > 2)
                if "\n" not in t and len(t) > 200:
                    continue
                layout = Layout(t)
                for style, found in layout.sequences().items():
                    sums = styles.setdefault(style, [0, 0, 0, 0])
                    sums[0] += len(found)
                    sums[1] += len(found) - 1
                    sums[2] += sum(b == a + 1 for a, b in itertools.pairwise(found))
                for i, (style, _) in layout.numbers.items():
                    styles[style][3] += layout.interrupts(i)
                for i in layout.body:
                    line = layout.lines[i]
                    if line[0].islower() or line[-1] in ".!?;:," or not (key := header_key(line, names)):
                        continue
                    edge = layout.at_number(i) or layout.stands_alone(i) and layout.interrupts(i)
                    before, after = layout.beside(i)
                    keys.append(("key", before, after, key_hash(key), -1 if pd.isna(doc) else int(doc), 1, int(edge), 0, 0))
                    if edge and (form := form_of(line, names)):
                        forms[key_hash(key), key, form] += 1
            rows = [("word", w, shape(w), 0, 0, n, 0, 0, 0) for w, n in words.items()]
            rows += keys
            rows += [("form", key, form, k, 0, n, 0, 0, 0) for (k, key, form), n in forms.items()]
            rows += [("style", style, None, 0, 0, *sums) for style, sums in styles.items()]
            yield pd.DataFrame(rows, columns=["kind", "word", "shape", "key", "doc", "n", "a", "b", "c"])

    counted = stored(source.select("document_id", "text").mapInPandas(count, "kind string, word string, shape string, key long, doc long, n long, a long, b long, c long"))
    vocabulary = cut(counted.where("kind = 'word'").groupBy("word", "shape").agg(F.sum("n").alias("n")))

    def few(df: DataFrame, what: str) -> list:
        """All rows, which a parameter bounds."""
        rows = df.limit(max_forms + 1).collect()
        if len(rows) > max_forms:
            raise ValueError(f"more than {max_forms} {what}")
        return rows

    sums = counted.where("kind = 'style'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("a").alias("pairs"), F.sum("b").alias("ups"), F.sum("c").alias("inside"))
    usual = F.regexp_like(F.col("word"), F.lit(USUAL_STYLE)).cast("int")
    paging = (2 * (F.col("ups") + usual) > F.col("pairs") + 1) & ((usual == 1) | (F.col("inside") * 5 >= F.col("n")))
    styles = frozenset(r["word"] for r in few(sums.where(paging).select("word"), "styles of page numbers"))
    by_key = counted.where("kind = 'key'").groupBy("key", "doc").agg(F.sum("n").alias("n"), F.sum("a").alias("edge")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.sum("edge").alias("edge"))
    by_key = cut(by_key)
    whole = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("edge"), F.lit(0)).alias("edge"), F.greatest(F.count_if(F.col("n") > 1), F.lit(1)).alias("keys")).first()
    # So many lines at edges must be unlikely (Chernoff's bound) where other lines are there by chance, for all keys tried.
    share, usual_share = F.col("edge") / F.col("n"), (F.lit(whole["edge"] + 1) - F.col("edge")) / (F.lit(whole["n"] + 10) - F.col("n"))
    surprise = F.col("n") * (share * F.log(share / usual_share) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual_share))).otherwise(0.0))
    repeated = ((F.col("docs") >= min_docs) | (F.col("n") >= 2)) & (F.col("edge") >= (F.col("n") + 1) * edge_share)
    headers = by_key.where(repeated & (share > usual_share) & (surprise >= math.log(whole["keys"] / chance))).select("key")
    places = counted.where("kind = 'key'").join(headers, "key", "left_semi").select("key", "word", "shape").distinct().select("key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word")), F.struct(F.lit(1).alias("side"), F.col("shape").alias("word")))).alias("x")).select("key", "x.*")
    told = places.where("word <> ''").groupBy("key", "side", "word").count().groupBy("key", "side").agg((F.max("count") * 2 > F.sum("count")).alias("told")).groupBy("key").agg(F.max("told").alias("told"))
    headers = cut(headers.join(told.where("told"), "key", "left_anti"))
    keys = frozenset(r["key"] for r in few(headers, "keys of headers"))
    shown = few(counted.where("kind = 'form'").join(headers, "key", "left_semi").groupBy("word", "shape").agg(F.sum("n").alias("n")).where("n > 1"), "forms of headers")
    inline = Inline(sorted((r["word"], r["shape"]) for r in shown)) if shown else None
    top = vocabulary.where("n >= 3").orderBy(F.desc("n"), "word").limit(frequent).collect()
    best: dict[str, tuple[int, str]] = {}
    for r in top:
        best[r["shape"]] = max(best.get(r["shape"], (0, "")), (r["n"], r["word"]))
    # Known to be right: frequent, and no misreading of a more frequent word.
    known = {r["word"] for r in top if not ODD.search(r["word"]) and (r["n"] * dominance > best[r["shape"]][0] or bare(r["word"]) == bare(best[r["shape"]][1]))}
    lower = {w.lower() for w in known}

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for key, text in zip(p["id"], p["text"], strict=True):
                lines = lines_of(text, names, keys, styles, inline)
                header = any(x[2] == "header" for x in lines)
                page = any(x[2] == "page" or x[2] == "header" and numbered_header(text[x[0] : x[1]]) for x in lines)
                odd = {w for w in WORD.findall(text) if len(w) > 2 and w not in known and suspicious(w)}
                cuts = [((left + right).lower(), sure or (left + right).lower() in lower) for _, _, left, right, sure in cut_words(text, lines)]
                rows.append((key, text, header, page, sorted(odd), any(ok for _, ok in cuts), sorted({w for w, ok in cuts if not ok})))
            yield pd.DataFrame(rows, columns=["id", "text", "header", "page", "odd", "cut", "joined"])

    given = scanned = stored(source.mapInPandas(scan, "id long, text string, header boolean, page boolean, odd array<string>, cut boolean, joined array<string>").withColumn("row", F.monotonically_increasing_id()))

    @F.pandas_udf("string")
    def shape_of(words: pd.Series) -> pd.Series:
        return words.map(shape)

    @F.pandas_udf("boolean")
    def misreads(said: pd.Series, meant: pd.Series) -> pd.Series:
        return pd.Series([bare(a) != bare(b) and (bool(ODD.search(a)) or any(g in a.lower() for g, _ in GROUPS)) for a, b in zip(said, meant, strict=True)], dtype=bool)

    words = scanned.select("row", F.explode("odd").alias("word"))
    rare = words.select("word").distinct().withColumn("shape", shape_of("word"))
    shapes = vocabulary.groupBy("shape").agg(F.max(F.struct("n", "word")).alias("best"))
    own = vocabulary.select("word", F.col("n").alias("own"))
    judged = rare.join(shapes, "shape", "left").join(own, "word", "left").select("word", F.col("best.word").alias("meant"), F.col("best.n").alias("n"), "own")
    sure = judged.where((F.col("n") >= F.greatest(F.lit(3), F.col("own") * dominance)) & misreads("word", F.coalesce("meant", F.lit(""))))
    # Digits and signs between letters are misread even in a word seen once.
    strange = judged.where(F.col("word").rlike(r"\p{L}[€@+!$]\p{L}|\p{L}{2}[0159]\p{L}{2}|\p{L}{3}[€@+]$|\p{L}\x{a8}\p{L}")).select("word", F.lit(None).cast("string").alias("meant"))
    wrong = sure.select("word", "meant").unionByName(strange).groupBy("word").agg(F.max("meant").alias("meant"))
    at_word = words.join(wrong, "word").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", F.coalesce("meant", F.col("word"))))).alias("fixes"))
    spelled = vocabulary.where("n >= 2").select(F.lower("word").alias("whole")).distinct()
    at_cut = given.select("row", F.explode("joined").alias("whole")).join(spelled, "whole").select("row").distinct().withColumn("also", F.lit(True))
    told = given.join(at_word, "row", "left").join(at_cut, "row", "left")
    found = told.select("id", F.explode(F.array_compact(F.array(
        F.when(F.col("cut") | F.coalesce("also", F.lit(False)), "hyphenation"), F.when(F.col("fixes").isNotNull(), "misread"),
        F.when(F.col("header"), "running_header"), F.when(F.col("page"), "page_number"),
    ))).alias("noise")).select(F.col("id").alias("segment_id"), "noise").distinct()

    def repair(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = []
            for text, fixes, also, joined in zip(p["text"], p["fixes"], p["also"], p["joined"], strict=True):
                lines = lines_of(text, names, keys, styles, inline)
                texts.append(flow(text, lines, dict(fixes) if fixes is not None else {}, lower | (set(joined) if also is True and joined is not None else set())))
            yield pd.DataFrame({"id": p["id"], "text": texts})

    texts = told.select("id", "text", "fixes", "also", "joined").mapInPandas(repair, "id long, text string")
    return Noise(found, texts)


def numbered_header(line: str) -> bool:
    """Whether a heading holds a page number, set apart or with its word or dashes."""
    text = line.strip()
    return "  " in text and bool(PAGE_BESIDE.search(text)) or bool(re.match(rf"(?:{_WORDED})\s", text, re.I)) or bool(re.search(rf"\s(?:{_WORDED})$", text, re.I))


def flow(text: str, lines: list[tuple[int, int, str, str | None]], fixes: dict[str, str], spelled: set[str]) -> str:
    """Running paragraphs of a text without its noise."""
    joins = {}
    for a, b, left, right, sure in cut_words(text, lines):
        if sure or (left + right).lower() in spelled:
            joins[a] = (b, left + right)
    paragraphs: list[list[str]] = [[]]
    skip, gap, noisy = -1, False, False
    for a, b, kind, _ in lines:
        if kind in ("page", "header"):
            noisy = True
            continue
        if kind == "blank":
            gap = True
            continue
        last = paragraphs[-1][-1] if paragraphs[-1] else ""
        # A gap that noise made in a sentence is none.
        if gap and last and not (noisy and not re.search(r"[.!?:]$", last)) and skip <= a:
            paragraphs.append([])
        gap = noisy = False
        at, out = max(a, skip), ""
        for start in sorted(s for s in joins if at <= s < b):
            if start < at:
                continue
            end, whole = joins[start]
            out += text[at:start] + whole
            at = skip = end
        out += text[at:b] if at < b else ""
        if out.strip():
            paragraphs[-1].append(re.sub(r"\s+", " ", out).strip())
    whole = "\n".join(" ".join(x) for x in paragraphs if x)

    def fix(m: re.Match) -> str:
        word = fixes.get(m.group(), m.group())
        return word[:1].upper() + word[1:] if m.group()[:1].isupper() else word

    return WORD.sub(fix, whole) if fixes else whole
