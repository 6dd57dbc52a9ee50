"""Problem 7: personal information in free text, by patterns and corpus disclosure.

Patterns find direct identifiers. Names are told by the corpus: forms of address seed
a few, and co-occurrence over all texts estimates how many bits each word and each
surrounding discloses about a private person being named. What exceeds the threshold
is replaced; words that reveal a name by their company are generalised or removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from minuteworks.session import cut, stored

TYPES = ("email", "phone", "id_number", "address", "name")
_AT = r"(?:\s?@\s?|\s?[\(\[\{]\s?(?:at|ät)\s?[\)\]\}]\s?|\s(?:at|ät)\s)"
_DOT = r"(?:\.|\s?[\(\[\{]\s?(?:dot|punkt)\s?[\)\]\}]\s?|\s(?:dot|punkt)\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+%-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-z]{{2,}}\b", re.I)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ -]?[0-9A-Z]{4}){3,7}(?:[ -]?[0-9A-Z]{1,3})?(?!\w)")
#: Words before an identity number (fixed values): identity card, passport, tax, insurance, account.
_ID_CUE = (
    r"(?:personal)?ausweis(?:es|s)?(?:[- ]?(?:nummer|nr\.?))?|(?:reise)?pass(?:[- ]?(?:nummer|nr\.?))?|perso|steuer(?:[- ]?id(?:entifikations(?:nummer|nr\.?))?|[- ]?nummer|[- ]?nr\.?|[- ]?identifikations(?:nummer|nr\.?))?|idnr\.?"
    r"|(?:sozial|renten|kranken)?[- ]?vers(?:icherungs|\.)?[- ]?(?:nummer|nr\.?)|sv[- ]?(?:nummer|nr\.?)|konto(?:[- ]?(?:nummer|nr\.?))?|iban|id[- ]?(?:card|number)|passport(?: (?:no\.?|number))?"
)
ID_AFTER = re.compile(rf"(?<!\w)(?:{_ID_CUE})(?![^\W\d_])\s*(?:ist|lautet|is|:|=)?\s*:?\s*((?-i:(?=[0-9A-Z /-]*\d)[0-9A-Z]{{1,4}}(?:[ /-]?[0-9A-Z]+){{0,7}}))(?!\w)", re.I)
SV = re.compile(r"(?<!\w)\d{2}[ ]?(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}[ ]?[A-Z][ ]?\d{3}(?!\w)")
CARD = re.compile(r"(?<!\w)(?=[0-9CFGHJKLMNPRTVWXYZ]*\d[0-9CFGHJKLMNPRTVWXYZ]*\d)[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8,9}(?!\w)")
TAX = re.compile(r"(?<![\w.,/-])\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}(?![\w/-])")
_DIGIT = r"(?:null|eins|ein|zwei|zwo|drei|vier|fünf|fuenf|sechs|sieben|acht|neun)"
PHONE = re.compile(
    r"(?<![\w./-])(?:(?:\+|00)\d{1,3}[\s./-]?(?:\(0\)[\s./-]?)?\(?\d{2,4}\)?|\(0\d{2,4}\)|0[1-9]\d{1,3})(?:\s?[/.-]\s?|\s)?\d{2,}(?:[\s./-]?\d{2,}){0,6}(?![\w/])"
    rf"|(?<!\w){_DIGIT}(?:[\s,-]+{_DIGIT}){{2,}}(?:[\s,-]+(?:\d+|{_DIGIT})){{2,}}(?!\w)",
    re.I,
)
_STREET = r"(?:stra(?:ß|ss)e|str\.|gasse|leite|trift|zeile|stiege|steig|allee|chaussee|promenade|twiete|weg|platz|ring|pfad|damm|ufer|hof|markt|wall|graben|kamp|redder|stieg|berg)"
ADDRESS = re.compile(rf"(?<!\w)(?:(?:[^\W\d_]+-)*[^\W\d_]{{3,}}{_STREET}|(?:[A-ZÄÖÜ][^\W\d_]+(?:er|-)?[ -])Str(?:aße|asse|\.))\s+(?:Nr\.?\s*|Hausnr\.?\s*)?\d{{1,3}}(?!\d)(?:\s?[a-hA-H](?!\w))?(?:\s1/2)?(?:\s?-\s?\d{{1,3}}(?!\d))?(?:,\s*\d{{5}}\s+[A-ZÄÖÜ][^\W\d_]+)?", re.I)
#: What looks like a phone or identity number but names a paper, file, account or project.
OFFICIAL = re.compile(r"(?:drucksache|vorlage|aktenzeichen|az\.|haushaltsstelle|sachkonto|ma(?:ß|ss)nahmennummer|vorhaben|bebauungsplan(?:\s+nr\.)?|paper|document|stuk|projekt(?:nummer)?|kennziffer|produkt|beschluss(?:nummer)?|top|seite|euro|haushalt)\s*(?:nr\.?\s*)?:?\s*$", re.I)
OFFICIAL_WORDS = ("drucksache", "vorlage", "aktenzeichen", "haushaltsstelle", "sachkonto", "maßnahmennummer", "vorhaben", "bebauungsplan")
_ANY = r"[^\W\d_]{2,}(?:-[^\W\d_]+)*"
#: Forms of address, of introducing oneself and of greeting: the only cues; they seed what the corpus then tells of words and their surroundings.
ADDRESSED = re.compile(rf"(?<!\w)(?:herrn?|frau|familie|ehepaar|hr\.|fr\.|mr\.?|mrs\.?|ms\.?|mme|monsieur|madame|mevrouw|meneer)\s+(?:(?:dr|prof)\.\s+)*({_ANY})(?:\s+({_ANY}))?", re.I)
INTRODUCED = re.compile(rf"(?<!\w)(?:mein name ist|ich hei(?:ß|ss)e|ich bin (?:der|die)|my name is|je m'appelle|mijn naam is|ik heet|adım)\s+({_ANY})(?:\s+({_ANY}))?", re.I)
GREETED = re.compile(rf"(?<!\w)(?:gr(?:u(?:ß|ss)|ü(?:ß|ss)en?)|regards|cordialement)[,:]?\s+{_ANY}\s+({_ANY})()", re.I)
WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Words, and the signs that part them.
UNITS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d+|[^\w\s]|\n")

def within_one_or_two(a: str, b: str) -> bool:
    """Whether two names differ by at most one edit, two in names of 8 letters or more (swaps count as one)."""
    most = 2 if min(len(a), len(b)) >= 8 else 1
    if abs(len(a) - len(b)) > most:
        return False
    before, last = list(range(len(b) + 1)), None
    older = last
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y))
            if older is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            now.append(d)
        older, before = before, now
    return before[-1] <= most


class Known:
    """Public persons: their names, and names a typing error away, are no secret."""

    def __init__(self, names: set[str]):
        self.names = names
        self.first: dict[str, list[str]] = {}
        for n in names:
            self.first.setdefault(n[:1], []).append(n)
            self.first.setdefault(n[1:2], []).append(n)
        self.cache: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        w = word.lower()
        if w in self.names:
            return True
        if w not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            near = {n for c in w[:2] for n in self.first.get(c, ())}
            parts = w.split("-")
            self.cache[w] = any(within_one_or_two(w, n) for n in near) or (len(parts) > 1 and any(p in self.names for p in parts))
        return self.cache[w]


def official(text: str, at: int) -> bool:
    """Whether the number at ``at`` follows a word for papers, files or accounts, be it mistyped."""
    before = text[max(0, at - 40) : at]
    if OFFICIAL.search(before):
        return True
    m = re.search(r"([^\W\d_]{6,})\W*(?:nr\.?)?\W*$", before, re.I)
    return bool(m) and any(within_one_or_two(m.group(1).lower(), w) for w in OFFICIAL_WORDS)


#: What every number begins with, in digits or in words.
NUMERIC = re.compile(rf"\d|{_DIGIT}", re.I)


def direct(text: str) -> list[tuple[int, int, str]]:
    """Spans of e-mail addresses, identity numbers, phone numbers and street addresses, in this order of claim."""
    spans: list[tuple[int, int, str]] = []

    def claim(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in spans):
            spans.append((a, b, kind))

    for m in EMAIL.finditer(text):
        claim(*m.span(), "email")
    if NUMERIC.search(text):
        for pattern in (IBAN, SV, TAX, CARD):
            for m in pattern.finditer(text):
                if not official(text, m.start()):
                    claim(*m.span(), "id_number")
        for m in ID_AFTER.finditer(text):
            if sum(c.isdigit() for c in m.group(1)) >= 4 or re.fullmatch(r"[0-9A-Z]{8,12}", m.group(1)):
                claim(*m.span(1), "id_number")
        for m in ADDRESS.finditer(text):
            claim(*m.span(), "address")
        for m in PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            words = len(re.findall(_DIGIT, m.group(), re.I))
            if digits + words >= 7 and not official(text, m.start()) and not re.fullmatch(r"\s*\d{2}\.\d{2}\.\d{4}\s*", m.group()):
                claim(*m.span(), "phone")
    return spans


def occurrences(text: str, spans: list[tuple[int, int, str]], known: Known, given: frozenset[str]) -> list[tuple[int, int, str, str, str, bool]]:
    """Words that may be a name: (start, end, word, surroundings before, after, whether addressed).

    Public persons' names, given names, words inside other personal information and
    words of fewer than three letters are none. The surroundings are the two units on
    each side, lower-cased, with ``#`` for numbers, ``@`` for a given name; across an
    addressed public person or other span they end.
    """
    seeds: set[int] = set()
    for m in (m for pattern in (ADDRESSED, INTRODUCED, GREETED) for m in pattern.finditer(text)):
        first, second = m.group(1).lower(), m.group(2)
        if first in given:
            if second and second not in known and second.lower() not in given:
                seeds.add(m.start(2))
        elif m.group(1) not in known:
            seeds.add(m.start(1))
            if m.re is INTRODUCED and second and second[0].isupper() and second not in known:
                seeds.add(m.start(2))
    units: list[tuple[int, int, str]] = []
    held = sorted(spans)
    for m in UNITS.finditer(text):
        start = m.start()
        while held and held[0][1] <= start:
            held.pop(0)
        if held and held[0][0] <= start:
            mark = f"<{held[0][2]}>"
            if not units or units[-1][2] != mark:
                units.append((start, m.end(), mark))
            continue
        word = m.group().lower()
        units.append((start, m.end(), "#" if word[0].isdigit() else "@" if word in given else word))
    out = []
    for i, (a, b, word) in enumerate(units):
        if len(word) < 3 or not word[0].isalpha() or word in known:
            continue
        before = [units[j][2] if j >= 0 else "^" for j in (i - 1, i - 2)]
        after = [units[j][2] if j < len(units) else "$" for j in (i + 1, i + 2)]
        out.append((a, b, word, " ".join(before), " ".join(after), a in seeds))
    return out


def name_span(text: str, a: int, b: int, given: frozenset[str]) -> tuple[int, int]:
    """A found name with the given name before it, or behind it and a comma."""
    before = re.search(rf"({_ANY})\s+$", text[max(0, a - 60) : a])
    if before and before.group(1).lower() in given:
        a = max(0, a - 60) + before.start(1)
    elif greeted := next((m for m in GREETED.finditer(text[max(0, a - 60) : b]) if m.end(1) == b - max(0, a - 60)), None):
        a = max(0, a - 60) + WORDS.search(text[max(0, a - 60) : b], re.match(r"\w+", greeted.group()).end() + greeted.start()).start()
    else:
        after = re.match(rf",?\s+({_ANY})", text[b : b + 60])
        if after and after.group(1).lower() in given:
            b += after.end(1)
    return a, b


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order, overlapping ones of one type joined, others cut to the first."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(set(spans)):
        if out and a < out[-1][1]:
            if kind == out[-1][2]:
                out[-1] = (out[-1][0], max(b, out[-1][1]), kind)
            continue
        out.append((a, b, kind))
    return out


#: Weight of the base rate in a share, in occurrences; bounds of one piece of evidence, in bits.
SMOOTH, MOST_BITS, UNSEEN_BITS = 0.5, 12.0, 0.5
FEATURES = ("word", "before", "after")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]", "place": "[PLACE]", "term": "[…]"}
_PLACE = re.compile(rf"(?:{_STREET}|stadt|dorf|heim|hausen|viertel|siedlung)$", re.I)


def disclosure(name: str, base: Column) -> Column:
    """Bits that a feature of an occurrence adds to the odds that it names a private person.

    ``n_`` and ``p_`` of the feature are its occurrences and the protected ones, both
    without this one. Surroundings that were never protected tell little, as most
    names are not protected at first; a word never protected tells all it can.
    """
    share = (F.col(f"p_{name}") + SMOOTH * base) / (F.col(f"n_{name}") + SMOOTH)
    bits = F.log2(share / (1 - share)) - F.log2(base / (1 - base))
    least = F.when(F.col(f"p_{name}") > 0, -MOST_BITS).otherwise(-MOST_BITS if name == "word" else -UNSEEN_BITS)
    return F.greatest(F.least(bits, F.lit(MOST_BITS)), least)


def protected(seen: DataFrame, rounds: int = 4, grow_bits: float = -3.0, min_bits: float = 0.0, overrule_bits: float = -5.0) -> DataFrame:
    """``row, start, end, word`` of the occurrences that name a private person.

    ``seen``: row, start, end, seed, and hashes ``word, before, after``. An occurrence
    is protected by the log-odds, in bits, that it names a private person: those of
    all occurrences and what its word, the units before and those behind it disclose,
    each estimated over all others in the corpus. At first the addressed ones (``seed``)
    are protected; each round estimates anew from what the last one protected above
    ``grow_bits``: words found beside an address teach surroundings, and these words.
    At the end the odds must reach ``min_bits``; an addressed word goes free if the word
    itself speaks against it by ``overrule_bits``.

    Counts by feature are summed in partitions before they move; a round joins the
    few protected features to the occurrences.
    """
    for k in FEATURES:
        seen = seen.join(seen.groupBy(k).agg((F.count("*") - 1).cast("int").alias(f"n_{k}")), k)
    seen = stored(seen)
    total = seen.count()
    found = cut(seen.where("seed").select("row", "start", "end", *FEATURES))
    hits = found.count()
    for at in range(rounds + 1):
        if not hits:
            break
        base = F.lit(min(0.5, (hits + 0.5) / (total + 1)))
        scored = seen
        for k in FEATURES:
            scored = scored.join(found.groupBy(k).agg(F.count("*").alias(f"p_{k}")), k, "left")
        # Others stand with nothing that was protected.
        scored = scored.where(" or ".join(f"p_{k} is not null" for k in FEATURES)).join(found.select("row", "start", F.lit(1).alias("own")), ["row", "start"], "left")
        scored = scored.withColumns({f"p_{k}": F.coalesce(f"p_{k}", F.lit(0)) - F.coalesce("own", F.lit(0)) for k in FEATURES})
        bits = F.log2(base / (1 - base)) + sum((disclosure(k, base) for k in FEATURES), F.lit(0.0))
        # One surrounding alone names no one: both must speak for a word that was nowhere else protected.
        backed = (F.col("p_word") > 0) | (disclosure("before", base) >= 1) & (disclosure("after", base) >= 1)
        if at == rounds or at and hits == before:
            last = scored.where(backed & (bits >= min_bits) | F.col("seed") & (disclosure("word", base) > overrule_bits))
            return cut(last.select("row", "start", "end", "word"))
        before = hits
        found = cut(scored.where(backed & (bits >= grow_bits) | F.col("seed")).select("row", "start", "end", *FEATURES))
        hits = found.count()
    return found.select("row", "start", "end", "word")


def revealing(seen: DataFrame, names: DataFrame, texts: DataFrame, min_texts: int = 3, min_share: float = 0.8) -> DataFrame:
    """``row, start, end`` of other words that reveal a protected one though it is replaced.

    A word reveals a name if at least ``min_texts`` distinct texts hold both, and at
    least ``min_share`` of the texts with the word. Only rows with a name are paired.
    """
    entity = names.select("row", F.col("word").alias("entity")).distinct().join(texts, "row")
    inside = seen.select("row", "word", "start", "end").join(names.select("row", "start"), ["row", "start"], "left_anti")
    pairs = inside.join(entity, "row").groupBy("word", "entity").agg(F.count_distinct("text_key").alias("both")).where(F.col("both") >= min_texts)
    with_word = seen.select("row", "word").join(pairs.select("word").distinct(), "word").join(texts, "row").groupBy("word").agg(F.count_distinct("text_key").alias("texts"))
    telling = pairs.join(with_word, "word").where(F.col("both") >= F.col("texts") * min_share).select("word", "entity").distinct()
    return inside.join(entity.select("row", "entity"), "row").join(telling, ["word", "entity"]).select("row", "start", "end").distinct()


def sanitise(df: DataFrame, id_col: str, text_col: str, members: DataFrame, source: str = "", min_bits: float = 0.0, max_members: int = 1_000_000) -> DataFrame:
    """``sanitise_tables`` of one table."""
    return sanitise_tables([(df, id_col, text_col, source)], members, min_bits, max_members)


def sanitise_tables(tables: list[tuple[DataFrame, str, str, str]], members: DataFrame, min_bits: float = 0.0, max_members: int = 1_000_000) -> DataFrame:
    """Find personal information and replace it by typed placeholders.

    ``tables`` are (table, id column, text column, source). Returns ``source, id,
    spans, types, text``: ``spans`` is an array of (start, end, type) in the given
    text, ``types`` the distinct types, ``text`` the text with ``[EMAIL]``, ``[PHONE]``,
    ``[ID]``, ``[ADDRESS]`` and ``[NAME]`` in place of them.
    ``members`` (first_name, last_name) are public: their names stay, as do names a
    typing error away. Null texts give no row, empty texts an empty result; repeated
    rows and ids give a row each; other columns are ignored.

    Direct identifiers have fixed shapes. Which words name a private person is
    decided by what they and their surroundings disclose over all rows of all tables
    (``protected``, odds of at least ``min_bits``); a given name beside such a word belongs to it. Words that reveal
    a name by company (``revealing``) are generalised to ``[PLACE]`` where they are a
    place or street, else removed (``[…]``); they have no type.
    """
    people = members.select("first_name", "last_name").limit(max_members + 1).collect()
    if len(people) > max_members:
        raise ValueError(f"more than {max_members} public persons")
    given = frozenset(p["first_name"].lower() for p in people if p["first_name"])
    known = Known({p["last_name"].lower() for p in people if p["last_name"]})

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for source, key, text in zip(p["source"], p["id"], p["text"], strict=True):
                spans = direct(text)
                rows.append((source, key, text, spans, occurrences(text, spans, known, given)))
            yield pd.DataFrame(rows, columns=["source", "id", "text", "spans", "seen"])

    parts = [df.select(F.lit(source).alias("source"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()) for df, id_col, text_col, source in tables]
    rows = reduce(DataFrame.unionByName, parts)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"source string, id {kind}, text string, spans array<struct<start:int,end:int,type:string>>, seen array<struct<start:int,end:int,word:string,before:string,after:string,seed:boolean>>"
    found = stored(rows.mapInPandas(find, schema).withColumn("row", F.monotonically_increasing_id()))
    seen = found.select("row", F.explode("seen").alias("x")).select("row", "x.start", "x.end", "x.seed", *[F.xxhash64(F.col(f"x.{k}")).alias(k) for k in FEATURES])
    names = protected(seen, min_bits=min_bits)
    company = revealing(seen, names, found.select("row", F.xxhash64("text").alias("text_key")))
    marks = names.select("row", "start", "end", F.lit("name").alias("type")).unionByName(company.select("row", "start", "end", F.lit("term").alias("type")))
    hidden = marks.groupBy("row").agg(F.collect_list(F.struct("start", "end", "type")).alias("hidden"))

    def replace(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for source, key, text, spans, marks in zip(p["source"], p["id"], p["text"], p["spans"], p["hidden"], strict=True):
                at = [(s["start"], s["end"], s["type"]) for s in spans]
                told = [(m["start"], m["end"], m["type"]) for m in marks] if marks is not None else []
                at += [(*name_span(text, a, b, given), t) for a, b, t in told if t == "name"]
                at += [(a, b, "place" if _PLACE.search(text[a:b]) else "term") for a, b, t in told if t == "term" and all(b <= x or a >= y for x, y, _ in at)]
                at, out, last = merged(at), [], 0
                for a, b, t in at:
                    out += [text[last:a], PLACEHOLDERS[t]]
                    last = b
                rows.append((source, key, at, sorted({t for *_, t in at} & set(TYPES)), "".join(out) + text[last:]))
            yield pd.DataFrame(rows, columns=["source", "id", "spans", "types", "text"])

    joined = found.select("row", "source", "id", "text", "spans").join(hidden, "row", "left").select("source", "id", "text", "spans", "hidden")
    return joined.mapInPandas(replace, f"source string, id {kind}, spans array<struct<start:int,end:int,type:string>>, types array<string>, text string")
