"""Problem 5: defective pairs of prompt and response, by labelling functions and a label model.

Every defect has several noisy labelling functions, each of which votes for it (1),
against it (-1) or not at all (0). How often the votes fall together over all rows
tells, by expectation maximisation, how far each function can be trusted; a row's
posterior follows from its votes. A row keeps every defect above its cutoff, which is
validated on defects planted in sound pairs.
"""

from __future__ import annotations

import difflib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from minuteworks.llm.language import LANGUAGES, WORD, Tagger
from minuteworks.session import discard, stored

#: The defects, in the order in which the first that fits counts.
DEFECTS = ("empty", "copies_query", "refusal", "truncated", "wrong_language")
PLACEHOLDER = re.compile(r"(?:null|none|nil|nan|undefined|n/?a|k\.?\s?a\.?|tbd|leer|keine antwort|error|no answer)", re.I)
LEAD_IN = re.compile(r"(?:sie fragen|du fragst|deine frage(?: lautet| ist)?|ihre frage(?: lautet| ist)?|die frage(?: lautet| ist)?|frage|zur frage|you ask(?:ed)?|your question(?: is)?|question|votre question|la question|uw vraag|je vraag|vraag|soru(?:nuz)?)\W*", re.I)
#: Some of these is in every lead-in; the letters are those that count as others where case doesn't.
LEAD_PARTS = ("frag", "question", "you ask", "vraag", "soru", "ſ", "ı", "İ")
#: Words of the first person (fixed values): minutes report in the third.
FIRST = {
    "de": "ich mir mich mein meine meiner meinem meinen meines", "en": "i me my i'm i'll i've myself", "fr": "je j me moi mon ma mes",
    "nl": "ik mij me mijn mezelf", "tr": "ben bana beni benim",
}
_FIRST = {lang: frozenset(words.split()) for lang, words in FIRST.items()}
#: Wordings of declining, in lower case (fixed values): letters that are quick to find and what follows them.
DECLINE = tuple((start, re.compile(start + rest)) for start, rest in (
    ("nicht ", r"(?:beantworten|helfen|äußern|kommentieren|wiedergeben|gestattet|erlaubt|zuständig|in der lage|bearbeiten|sagen|weiterhelfen|zu\b)"),
    ("kein", r"(?:e|en)? (?:auskunft|angaben|antwort|aussage|zugriff|stellung|informationen)"),
    ("passen", r"\b"), ("cannot", r"\b"), ("can't", r"\b"), ("unable", r"\b"), ("won't", r"\b"), ("not able", r"\b"), ("not allowed", r"\b"), ("decline", r"\b"), ("ne p", r"(?:eux|uis) pas"), ("kan ", r"(?:ik )?(?:u |je )?(?:daar |hier )?(?:niet|geen)"),
))
DECLINE_WORDS = (
    "ablehnen", "verwehrt", "verzichte", "sehe ich ab", "unangemessen", "nichts sagen", "sage ich nichts", "lasse ich es", "übersteigt", "möglichkeiten hinaus", "aufgabenbereich", "stehen mir nicht zu",
    "sprachmodell", "ki-assistent", "richtlinien", "neutralität", "impossible", "refuse", "niet beantwoorden", "weiger", "cevap veremem", "yardımcı olamam", "yanıtlayam",
)
COURTESIES = (
    "kann ich sonst etwas", "gerne können sie eine andere", "vielen dank für ihr verständnis", "danke für die frage", "tut mir leid", "leider", "sorry", "entschuldig", "anything else",
    "désolé", "het spijt me", "üzgünüm", "maalesef",
)
#: What only reports from minutes have.
REPORT = re.compile(r"\d{1,2}\.\d{1,2}\.\d{4}|\(Quelle|Quelle:|\[\d+\]|TOP \d|\d[\d.]* (?:Euro|euros?|avro)|Ja-Stimmen|Gegenstimmen|Niederschrift|Protokoll|votes|voix|stemmen|oyla|(?:Die|Der|Das|Den) (?:Verwaltung|Fraktion|Ausschuss|Vorsitz|Gremium|Antrag|Rechtsamt|Seniorenbeirat|Jugendrat|Sachverständige)")
#: Some of these is in every such text; a date has two points.
REPORT_PARTS = (
    "Quelle", "[", "TOP ", "Euro", "euro", "avro", "Ja-Stimmen", "Gegenstimmen", "Niederschrift", "Protokoll", "votes", "voix", "stemmen", "oyla", " Verwaltung", " Fraktion", " Ausschuss", " Vorsitz", " Gremium", " Antrag", " Rechtsamt",
    " Seniorenbeirat", " Jugendrat", " Sachverständige",
)
#: Names of the languages in requests for one (fixed values).
ASKED = (
    ("en", r"engl[a-z]*|english|anglais|engels|ingilizce"), ("fr", r"franz[a-zö]*|french|français|frans(?![a-zö]*kf)[a-z]*|fransızca"), ("nl", r"niederländ[a-z]*|niederlaend[a-z]*|holländ[a-z]*|dutch|néerlandais|nederlands|hollandaca|felemenkçe"),
    ("tr", r"türk[a-zç]*|tuerk[a-z]*|turkish|turc|turks|türkçe"), ("de", r"deutsch[a-z]*|german|allemand|duits|almanca"),
)
_REQUEST = re.compile(r"(?:antwort\w*|answer\w*|reply|répon\w*|repon\w*|antwoord\w*|beantwoord\w*|cevap\w*|yanıt\w*|sprache|language|bitte auf|please|lütfen|graag|s'il)", re.I)
#: Some of these is in every request, in lower case; the letters are those that count as others where case doesn't.
REQUEST_PARTS = ("antwo", "answer", "reply", "répon", "repon", "cevap", "sprache", "language", "bitte auf", "please", "lütfen", "graag", "s'il", "ſ", "ı", "i̇")
_ASKED = tuple((lang, re.compile(rf"(?<!\w)(?:auf|in|en|in het|op|in der)\s+(?:{words})(?!\w)|(?<!\w)(?:{words})(?:er sprache| please| lütfen| cevap| olarak)", re.I)) for lang, words in ASKED)
#: Frequent words of each language that the others lack (fixed values).
COMMON = {
    "de": "der die das den dem des und nicht ist wird werden wurde für mit auf von zur zum eine einer sich auch sind oder bei dass noch was wer wie wann wo warum welche welcher welchen gab hat haben gibt steht stehen seit ich vom es bitte nenne zeig soll unter zwischen",
    "en": "the of and to for that have has been on by at from this are be will would what when why how who did does there any please about which",
    "fr": "le la les du et est pour dans sur une avec que qui pas été aux ont cette sont quel quelle pourquoi quand comment quels quelles",
    "nl": "het van een en voor met dat niet op wordt werd zijn naar aan ook er te wat waarom wanneer hoe welke is",
    "tr": "ve bir bu için ile olarak göre kadar tarafından olan daha ne mı mi sonra önce iki yılı günü neden nasıl hakkında hangi zaman var",
}
_COMMON = {w: lang for lang, ws in COMMON.items() for w in ws.split() if sum(w in x.split() for x in COMMON.values()) == 1}
#: Letters of each language beyond a to z (fixed values).
LETTERS = {"de": "äöüß", "fr": "éèêàçùâîôœ", "tr": "ışğçöü", "nl": "ĳëï", "en": ""}
#: Words that no sentence ends with (fixed values): articles, prepositions, conjunctions.
DANGLING = frozenset(
    "der die das den dem des ein eine einen einem einer eines und oder sowie dass ob weil wenn für mit von zur zum auf an in im am bei nach über unter vor gegen durch um aus ohne bis seit zwischen "
    "the a an and or of to for with from on in at by that is was will le la les du des un une et ou de à pour dans sur avec par que het een en of van voor met op te dat ve bir ile için bu".split()
)
MARKUP = re.compile(r"<[^<>]*>|&nbsp;|[*_`#>]|[​-‏﻿⁠]")
#: Some of these is in all markup.
MARKS = re.compile(r"[<&*_`#>​-‏﻿⁠]")
LETTER_OR_DIGIT = re.compile(r"[^\W_]")
LETTERS_AND_DIGITS = re.compile(r"[^\W_]+")
LONGER_WORD = re.compile(r"[^\W\d_]{3,}")
QUOTED = re.compile(r"„[^“]*“")
QUOTED_EITHER = re.compile(r"„[^“]*“|\"[^\"]*\"")
LAST_WORD = re.compile(r"([^\W\d_]+)[,;:]?$")
#: What a text ends with that breaks off at an abbreviation, or in a number or date.
ABBREVIATED = ("Nr.", "Dr.", "bzw.", "ca.", "z.", "St.", "Abs.")
BROKEN_OFF = re.compile(r"(?:vom|am|zum|den|bis|seit|ab|um|von|Nr|dated|on|until|du|le|op|tot)\.?\s+\d{1,2}\.(?:\d{1,2}\.?)?(?:\d{1,3})?$|\b(?:Nr|Dr|bzw|ca|z|St|Abs)\.$")
#: All up to the last sentence or line.
BEFORE_LAST = re.compile(r"(?s:.*)(?:(?<=[.!?])\s+|\n)")
END_MARKS = (".", "!", "?", "…", ":")
ENDING = re.compile(r"[.!?…:]['\"“”’»)\]*_]*$|[\])]$|[“”»]$")
#: Has the letters of all these languages and the marks of print, a byte each.
CODE_PAGE = "cp1254"
_PAGE = [bytes([i]).decode(CODE_PAGE, "replace") for i in range(256)]
#: Its letters and apostrophes, and its letters and digits; blanks for all others.
_WORD_BYTES, _PLAIN_BYTES = (bytes(i if re.fullmatch(kept, c) else 32 for i, c in enumerate(_PAGE)) for kept in (r"[^\W\d_]|['’]", r"[^\W_]"))

#: Its letters are 1, its blanks 2.
_KIND_BYTES = bytes(1 if c.isalnum() and not c.isdecimal() else 2 if c.isspace() else 0 for c in _PAGE)
_NOT_IN_LETTERS = bytes(i for i, c in enumerate(_PAGE) if c not in "".join(LETTERS.values()))


def runs(text: str, kept: bytes, pattern: re.Pattern[str]) -> list[str]:
    """Runs of the bytes ``kept``, or what the pattern finds in a text with characters beyond the code page."""
    try:
        return text.encode(CODE_PAGE).translate(kept).decode(CODE_PAGE).split()
    except UnicodeEncodeError:
        return pattern.findall(text)


def words_of(text: str) -> list[str]:
    """All that ``WORD`` finds, faster."""
    found = runs(text, _WORD_BYTES, WORD)
    return [w for x in found for w in (WORD.findall(x) if "'" in x or "’" in x else (x,))] if "'" in text or "’" in text else found


@lru_cache(8192)
def content(text: str | None) -> str:
    """What a text says: without markup, blanks and stand-ins for nothing."""
    if text is None:
        return ""
    plain = (MARKUP.sub(" ", text) if MARKS.search(text) else text).strip()
    return "" if not LETTER_OR_DIGIT.search(plain) or PLACEHOLDER.fullmatch(plain.strip(" .-–[](){}\"'")) else plain


@lru_cache(8192)
def plainly(text: str) -> str:
    """Letters and digits only, lower case, umlauts as two letters."""
    text = text.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = text.replace(a, b)
    return " ".join(runs(text, _PLAIN_BYTES, LETTERS_AND_DIGITS))


@lru_cache(8192)
def requested(query: str) -> str | None:
    """The language a query asks for."""
    low = query.lower()
    if not any(map(low.__contains__, REQUEST_PARTS)) or not _REQUEST.search(query):
        return None
    found = [(m.start(), lang) for lang, p in _ASKED for m in p.finditer(query)]
    return max(found)[1] if found else None


def common_language(words: list[str]) -> tuple[str | None, int, int]:
    """Language of most common words, their number, and the runner-up's."""
    counts = Counter(filter(None, map(_COMMON.get, words))).most_common(2)
    return (counts[0][0], counts[0][1], counts[1][1] if len(counts) > 1 else 0) if counts else (None, 0, 0)


def cut_short(text: str) -> bool:
    """Ends in the middle of a number or date, or inside brackets or quotes."""
    t = text.rstrip()
    broken = t.endswith(ABBREVIATED) or t[-1:].isdecimal() or t[-1:] == "." and t[-2:-1].isdecimal()
    if not broken and "(" not in t and "„" not in t and "[" not in t:
        return False
    before = BEFORE_LAST.match(t)
    last = t[before.end() :] if before else t
    if broken and BROKEN_OFF.search(last):
        return True
    return last.count("(") > last.count(")") or last.count("„") > last.count("“") + last.count("”") or last.count("[") > last.count("]")


def empty_votes(answer: str | None, clarify: str | None) -> list[int]:
    """No signs, nothing but stand-ins, hardly any characters, hardly any words."""
    raw = f"{answer or ''} {clarify or ''}".strip()
    n_words = sum(1 for _ in itertools.islice(LONGER_WORD.finditer(raw), 3))
    return [
        -1 if LETTER_OR_DIGIT.search(raw) else 1,
        -1 if content(answer) or content(clarify) else 1,
        1 if len(raw) <= 8 else 0 if len(raw) <= 20 else -1,
        1 if not n_words else 0 if n_words < 3 else -1,
    ]


def without_lead_in(text: str) -> str:
    return LEAD_IN.sub("", text, count=1) if any(map(text.__contains__, LEAD_PARTS)) else text


@lru_cache(8192)
def _characters(text: str) -> Counter[str]:
    return Counter(text)


@lru_cache(256)
def _word_set(text: str) -> frozenset[str]:
    return frozenset(text.split())


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = left = (1 << len(a)) - 1
    for c in b:
        hit = left & places.get(c, 0)
        left = ((left + hit) | (left - hit)) & every
    return len(a) - left.bit_count()


def copy_votes(query: str, response: str) -> list[int]:
    """The query and a lead-in leave nothing over, same words, same length, same characters."""
    return plain_copy_votes(plainly(query), plainly(response))


def plain_copy_votes(q: str, a: str) -> list[int]:
    """``copy_votes`` of texts of letters and digits."""
    if not q or not a:
        return [0] * 4 if not a else [-1] * 4
    rest = without_lead_in(a.replace(q, " ").strip()).strip() if q in a else a
    q_words, a_words = _word_set(q), _word_set(a)
    both = len(q_words & a_words)
    shared = both / (len(q_words) + len(a_words) - both)
    # Twice the characters in common over all characters bounds the likeness from above; of a longer answer it is below 0.75.
    alike = 0.0
    # Three fifths of the query's length can't reach it either.
    if 0.6 * len(q) <= len(a) < 2 * len(q) + 100:
        stripped = without_lead_in(a)
        if q == stripped:
            alike = 1.0
        elif 3 * max(len(q), len(stripped)) <= 5 * min(len(q), len(stripped)):
            theirs = _characters(stripped)
            alike = 2 * sum([n if n < theirs[c] else theirs[c] for c, n in _characters(q).items()]) / (len(q) + len(stripped))
            # The blocks that are matched are a common subsequence.
            if alike >= 0.75:
                alike = 2 * common_length(q, stripped) / (len(q) + len(stripped))
            if alike >= 0.75:
                alike = difflib.SequenceMatcher(None, q, stripped, autojunk=False).ratio()
    return [
        1 if len(rest) <= 3 else -1,
        1 if shared >= 0.75 else 0 if shared >= 0.5 else -1,
        1 if 0.7 <= len(a) / len(q) <= 1.5 else 0 if len(a) / len(q) <= 2.2 else -1,
        1 if alike >= 0.88 else 0 if alike >= 0.75 else -1,
    ]


def refusal_votes(said: str, words: list[str], lang: str | None) -> list[int]:
    """First person, wording of declining, courtesies, short without anything that reports have."""
    if not said:
        return [0] * 4
    own = QUOTED_EITHER.sub(" ", said) if "„" in said or '"' in said else said
    low = own.lower()
    first = not _FIRST.get(lang or "de", _FIRST["de"]).isdisjoint(words) or lang == "tr" and any(w.endswith(("amıyorum", "emiyorum", "mıyorum", "miyorum")) for w in words)
    return [
        1 if first else -1, 1 if any(map(low.__contains__, DECLINE_WORDS)) or any(x in low and p.search(low) for x, p in DECLINE) else -1, 1 if any(map(low.__contains__, COURTESIES)) else 0,
        1 if len(own) < 160 and not ((own.count(".") > 1 or any(map(own.__contains__, REPORT_PARTS))) and REPORT.search(own)) else 0 if len(own) < 260 else -1,
    ]


def truncation_votes(said: str) -> list[int]:
    """No mark at the end (a point may belong to a number), breaks off in a number or bracket, ends in a word that needs another."""
    if not said:
        return [0] * 3
    end = said.rstrip(" \n\t*_")
    token = end.rsplit(None, 1)[-1] if end else ""
    last = LAST_WORD.search(token)
    return [
        (0 if token[-1:] == "." and token[-2:-1].isdecimal() else -1) if token.endswith(END_MARKS) or ENDING.search(token) else 1, 1 if cut_short(end) else -1,
        1 if last and last.group(1).lower() in DANGLING else -1,
    ]


@lru_cache
def _foreign_letters(want: str) -> tuple[str, ...]:
    """Letters of each other language that the wanted one lacks."""
    return tuple("".join(c for c in cs if c not in LETTERS.get(want, "")) for lang, cs in LETTERS.items() if lang != want)


def letters_beyond(text: str) -> str:
    """The text's ``LETTERS``; all of a text with characters beyond the code page."""
    try:
        return text.encode(CODE_PAGE).translate(None, _NOT_IN_LETTERS).decode(CODE_PAGE)
    except UnicodeEncodeError:
        return text


def language_votes(got: str | None, sure: float, common: tuple[str | None, int, int], text: str, want: str) -> list[int]:
    """Another language by the tagger, by frequent words, by letters that the wanted one lacks."""
    lang, n, other = common
    text = letters_beyond(text)
    own = sum(map(text.count, LETTERS.get(want, "")))
    foreign = max((sum(map(text.count, cs)) for cs in _foreign_letters(want)), default=0) if text else 0
    return [
        0 if got is None or sure < 0.5 else 1 if got != want else -1,
        0 if n < 1 or n < 2 * other else 1 if lang != want else -1,
        1 if foreign >= 3 and foreign > 3 * own else -1 if own >= 3 and own > 3 * foreign else 0,
    ]


def votes(query: str, answer: str | None, clarify: str | None, query_lang: str, answer_lang: tuple[str | None, float], words: list[str]) -> list[list[int]]:
    """Votes of the labelling functions, by defect; ``words`` are the response's, without quotations.

    Every function looks at its own trait of the whole response and knows nothing of
    the others; where there is nothing to look at it abstains. Refusals and breaks are
    sought in answers, copies and languages in a question back as well.
    """
    said, asked = content(answer), content(clarify)
    response = said or asked
    got, sure = answer_lang
    want = requested(query) or query_lang
    return [
        empty_votes(answer, clarify), copy_votes(query, response), refusal_votes(said, words, got),
        truncation_votes(said), language_votes(got, sure, common_language(words), response.lower(), want) if response else [0] * 3,
    ]


@dataclass
class LabelModel:
    """Prior of a defect and, for each function, the chances of its votes (-1, 0, 1) with and without it."""

    prior: float
    yes: np.ndarray
    no: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of the defect for rows of votes."""
        onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
        up = np.log(self.prior) + (onehot * np.log(self.yes)).sum((1, 2))
        down = np.log1p(-self.prior) + (onehot * np.log(self.no)).sum((1, 2))
        # Where all abstain there is nothing to label.
        return np.where((patterns == 0).all(1), 0.0, 1 / (1 + np.exp(np.clip(down - up, -500, 500))))


#: What is assumed of a function before votes are seen, with the weight of two rows: chances of -1, 0 and 1
#: with and without the defect; the second for functions that find one form of a defect only.
USUAL = (np.array([0.1, 0.2, 0.7]), np.array([0.85, 0.12, 0.03]))
ONE_FORM = (np.array([0.7, 0.1, 0.2]), np.array([0.9, 0.09, 0.01]))
ASSUMED = {"truncated": (USUAL, ONE_FORM, ONE_FORM)}


def fit_model(patterns: dict[tuple[int, ...], int], rounds: int = 200, floor: float = 0.01, assumed: tuple | None = None) -> LabelModel | None:
    """The label model by expectation maximisation, from how often each pattern of votes occurs."""
    keys = sorted(k for k in patterns if any(k))
    if not keys:
        return None
    x, n = np.array(keys), np.array([patterns[k] for k in keys], dtype=float)
    onehot = np.stack([x == v for v in (-1, 0, 1)], axis=2).astype(float)
    with_, without = (np.stack(z) for z in zip(*(assumed or [USUAL] * x.shape[1]), strict=True))
    model = LabelModel(0.05, with_, without)
    before = np.zeros(len(keys))
    for _ in range(rounds):
        post = model.posterior(x)
        if np.abs(post - before).max() < 1e-9:
            break
        before = post
        # Counts of a few rows of what was assumed keep rare votes in bounds.
        yes = ((n * post)[:, None, None] * onehot).sum(0) + 2 * with_
        no = ((n * (1 - post))[:, None, None] * onehot).sum(0) + 2 * without
        model = LabelModel(float(np.clip((n * post).sum() / n.sum(), floor, 0.5)), yes / yes.sum(1, keepdims=True), no / no.sum(1, keepdims=True))
    return model


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 200, floor: float = 0.01) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each pattern of votes, from how often each pattern occurs."""
    model = fit_model(patterns, rounds, floor)
    return dict(zip(sorted(patterns), model.posterior(np.array(sorted(patterns))).tolist(), strict=True)) if model else {}


def told_language(words: list[str], home: str) -> str | None:
    """Language of a query by its common words; None where they don't tell."""
    if not len(words):
        return home
    counts = Counter(filter(None, map(_COMMON.get, words)))
    n, lang = max(((n, lang) for lang, n in counts.items() if lang != home), default=(0, None))
    if n and n >= counts[home]:
        return lang if n >= 2 else None
    return home if counts[home] else None


def query_language(words: list[str], marginals: np.ndarray, languages: tuple[str, ...], home: str) -> str:
    """Language of a query; a foreign question beside remarks in the home language is foreign.

    Short queries full of names are told by their common words; the tagger decides
    where there are none.
    """
    return told_language(words, home) or languages[int(marginals.mean(0).argmax())]


class Judge:
    """Takes the votes on pairs of texts, in batches."""

    def __init__(self, tagger: Tagger, home: str, languages: tuple[str, ...]):
        self.tagger, self.home, self.languages = tagger, home, languages

    def __call__(self, queries: list[str], answers: list[str | None], clarify: list[str | None]) -> tuple[list[list[list[int]]], list[tuple[str | None, float]], list[str]]:
        """Votes by pair and defect, the language of each response and the one that its query wants."""
        wants = [requested(q) for q in queries]
        q_words = [words_of(q.lower()) if want is None else [] for q, want in zip(queries, wants, strict=True)]
        wants = [want or told_language(ws, self.home) for want, ws in zip(wants, q_words, strict=True)]
        # Only queries that neither ask for a language nor tell their own by common words need the tagger.
        open_ = [i for i, want in enumerate(wants) if want is None]
        a_words = [spoken(content(a) or content(c)) for a, c in zip(answers, clarify, strict=True)]
        marginals = self.marginals([*(q_words[i] for i in open_), *a_words])
        for i, m in zip(open_, marginals):
            wants[i] = query_language(q_words[i], m, self.languages, self.home)
        langs = [self.language(m) for m in marginals[len(open_) :]]
        out = [votes(*x) for x in zip(queries, answers, clarify, wants, langs, a_words, strict=True)]
        return out, langs, wants

    def marginals(self, words: list[list[str]]) -> list[np.ndarray]:
        flat, ends = self.tagger.scores([w for ws in words for w in ws]), np.cumsum([len(ws) for ws in words])
        return self.tagger.marginals([flat[e - len(ws) : e] for e, ws in zip(ends, words, strict=True)])

    def language(self, marginals: np.ndarray) -> tuple[str | None, float]:
        """Language of a response of three words or more, and how sure it is."""
        if len(marginals) < 3:
            return None, 0.0
        mean = np.add.reduce(marginals, 0) / len(marginals)
        return self.languages[int(mean.argmax())], float(mean.max())


def spoken(text: str) -> list[str]:
    """Words of a response, lower case, without quotations."""
    return words_of((QUOTED.sub(" ", text) if "„" in text else text).lower())


#: Hand-written refusals of the validation; none of the labelling functions was made from them (fixed values).
REFUSALS = (
    "Das kann ich Ihnen leider nicht sagen.", "Hierzu möchte ich mich nicht äußern.", "Auf diese Frage darf ich nicht eingehen, ich bitte um Nachsicht.", "Leider bin ich nicht in der Lage, das zu beurteilen.",
    "Als Assistent nehme ich dazu keine Stellung. Kann ich sonst etwas für Sie tun?", "Ich habe keinen Zugriff auf solche Daten.", "I cannot help with that request.", "I'm sorry, but I am not able to answer this.",
    "Je ne peux pas répondre à cette question.", "Daar kan ik u helaas niet bij helpen.", "Bu soruya cevap veremem.", "Bei diesem Thema muss ich passen, es liegt außerhalb meiner Möglichkeiten.",
)
EMPTIES = ("", " ", "-", "<p></p>", "n/a", "...", "** **", "null", "&nbsp;", "k. A.")


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Which characters of the basic plane are letters and which are white space."""
    every = [chr(i) for i in range(1 << 16)]
    return np.array([c.isalnum() and not c.isdecimal() for c in every]), np.array([c.isspace() for c in every])


def inner_places(text: str) -> np.ndarray:
    """Where a word goes on, or ends before another one."""
    try:
        kind = np.frombuffer(text.encode(CODE_PAGE).translate(_KIND_BYTES), np.uint8)
        letter = kind == 1
        after = kind[1:] == 1
        after[:-1] |= (kind[1:-1] == 2) & letter[2:]
        return np.flatnonzero(letter[:-1] & after) + 1
    except UnicodeEncodeError:
        pass
    at = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    letter, space = (kind[at] for kind in _kinds())
    after = letter.copy()
    after[:-1] |= space[:-1] & letter[1:]
    return np.flatnonzero(letter[:-1] & after[1:]) + 1


def planted(query: str, answer: str, other: str | None, rng: np.random.Generator) -> dict[str, str]:
    """A sound pair's answer with each defect; ``other`` is an answer in another language."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    out = {"empty": pick(EMPTIES), "copies_query": pick((query, query.upper(), f" {query}\n", f"Sie fragen: {query}", f"{query} {query}", query.rstrip("?"))), "refusal": pick(REFUSALS)}
    inside = inner_places(answer)
    if len(inside) > 10:
        out["truncated"] = answer[: inside[int(rng.integers(len(inside) // 3, len(inside)))]].rstrip()
    return out | ({"wrong_language": other} if other else {})


#: Pairs in which one defect is planted may have these as well.
IMPLIED = {"copies_query": {"truncated"}, "empty": set(DEFECTS), "refusal": {"wrong_language"}, "truncated": set(), "wrong_language": set()}


def planted_counts(judge: Judge, pairs: list[tuple[str, str, str, float, str]], rng: np.random.Generator) -> Counter[tuple[str, int, str]]:
    """How often which votes fall on which defect, by the defect planted in sound pairs.

    ``pairs`` are query, answer, the answer's language and how sure it is, and the
    language wanted. Every pair gets every defect; a wrong language where an answer
    in another one is among the pairs.
    """
    langs = np.array([p[2] for p in pairs])
    others = {lang: np.flatnonzero(langs != lang) for lang in set(langs.tolist())}
    cases: list[tuple[int, str, str, int]] = []
    for i, (q, a, lang, _, _) in enumerate(pairs):
        j = int(others[lang][int(rng.integers(len(others[lang])))]) if len(others[lang]) else -1
        cases += [(i, d, text, j if d == "wrong_language" else -1) for d, text in planted(q, a, pairs[j][1] if j >= 0 else None, rng).items()]
    # Each text is looked at once, whatever the number of queries that it is put to; whole answers have their language already.
    known = {pairs[j][1]: pairs[j][2:4] for *_, j in cases if j >= 0}
    texts = list(dict.fromkeys(text for _, _, text, _ in cases))
    contents = {t: content(t) for t in texts}
    words = {t: spoken(said) for t, said in contents.items()}
    unknown = [t for t in texts if t not in known]
    known |= {t: judge.language(m) for t, m in zip(unknown, judge.marginals([words[t] for t in unknown]), strict=True)}
    told = {t: [pattern_of(v) for v in (empty_votes(t, None), refusal_votes(said, words[t], known[t][0]), truncation_votes(said))] for t, said in contents.items()}
    common, plain = {t: common_language(ws) for t, ws in words.items()}, {t: plainly(said) for t, said in contents.items()}
    in_language: dict[tuple[str, str], str] = {}
    together: Counter[tuple[str, ...]] = Counter()
    for i, d, text, _ in cases:
        q, want = pairs[i][0], pairs[i][4]
        if (text, want) not in in_language:
            said = contents[text]
            in_language[text, want] = pattern_of(language_votes(*known[text], common[text], said.lower(), want) if said else [0] * 3)
        empty, refusal, truncation = told[text]
        together[d, empty, pattern_of(plain_copy_votes(plainly(q), plain[text])), refusal, truncation, in_language[text, want]] += 1
    out: Counter[tuple[str, int, str]] = Counter()
    for (d, *patterns), n in together.items():
        for k, pattern in enumerate(patterns):
            out[d, k, pattern] += n
    return out


def pattern_of(vote: list[int]) -> str:
    return "".join(map("0+-".__getitem__, vote))


def votes_of(pattern: str) -> tuple[int, ...]:
    return tuple("-0+".index(c) - 1 for c in pattern)


def validated_cutoffs(models: list[LabelModel | None], sound: list[Counter[str]], bad: dict[tuple[str, int], Counter[str]], lowest: float = 0.1) -> list[tuple[str, float, float, float, int]]:
    """(defect, cutoff, precision, recall, planted cases) of the best F1 on defects planted in sound pairs.

    ``sound`` counts the votes of the sound pairs by defect, ``bad`` those by planted
    and voted defect: the planted ones took part in no fit. The sound pairs and those
    with other defects must stay below the cutoff. Cutoffs are sought between the
    posteriors met, from ``lowest`` to its counterpart, the nearest to one half among
    equals; a defect of which none could be planted keeps one half.
    """
    out = []
    for i, d in enumerate(DEFECTS):
        of = bad.get((d, i))
        if models[i] is None or not of:
            out.append((d, 0.5, 0.0, 0.0, 0))
            continue
        clear = sum((bad.get((k, i), Counter()) for k in DEFECTS if k != d and d not in IMPLIED[k]), sound[i].copy())
        (up, n_up), (down, n_down) = ((models[i].posterior(np.array([votes_of(x) for x in c], dtype=int).reshape(len(c), models[i].yes.shape[0])), np.array(list(c.values()))) for c in (of, clear))
        marks = np.unique(np.r_[0.0, up, down, 1.0])
        middle = (marks[1:] + marks[:-1]) / 2
        best, total = None, int(n_up.sum())
        for cutoff in np.unique(np.r_[0.5, middle[(middle >= lowest) & (middle <= 1 - lowest)]]):
            hits, wrong = int(n_up[up > cutoff].sum()), int(n_down[down > cutoff].sum())
            rank = (round(2 * hits / max(1, hits + wrong + total), 9), -abs(cutoff - 0.5))
            if best is None or rank > best[0]:
                best = (rank, (d, float(cutoff), hits / max(1, hits + wrong), hits / total, total))
        out.append(best[1])
    return out


class Flags:
    """``rows``: id, defects, posteriors, first_defect; ``cutoffs``: (defect, cutoff, precision, recall, cases)."""

    def __init__(self, rows: DataFrame, cutoffs: list[tuple[str, float, float, float, int]]):
        self.rows, self.cutoffs = rows, cutoffs


def flag(df: DataFrame, tagger: Tagger, id_col: str = "id", query_col: str = "query", answer_col: str = "answer", clarify_col: str = "clarify", home: str = "de", validation_rows: int | None = None, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The ``rows`` of ``flags``."""
    return flags(df, tagger, id_col, query_col, answer_col, clarify_col, home, validation_rows, languages).rows


def flags(df: DataFrame, tagger: Tagger, id_col: str = "id", query_col: str = "query", answer_col: str = "answer", clarify_col: str = "clarify", home: str = "de", validation_rows: int | None = None, languages: tuple[str, ...] = LANGUAGES) -> Flags:
    """Defects of pairs of prompt and response.

    ``rows`` has ``id, defects, posteriors, first_defect``: ``defects`` are all whose
    posterior exceeds the defect's cutoff, in the order of ``DEFECTS``; ``posteriors``
    has one value for each of ``DEFECTS``; ``first_defect`` is null for sound pairs.
    Null texts count as empty; a null query is an empty one. A question in ``clarify``
    without an answer is no defect. Repeated rows and ids give a row each, other
    columns are ignored, an empty table gives an empty result. ``home`` is the language
    of remarks beside a question in another language.

    One pass takes the votes; a second plants every defect in every distinct sound pair
    with an answer, in groups that the hash of the pair decides, to validate the cutoffs
    (``validated_cutoffs``). Only counts of vote patterns (at most three to the number of
    functions, for each defect and planted defect) go to the driver. With
    ``validation_rows`` only about so many pairs, picked by hash, are validated on; the
    queries use all.
    """
    judge = Judge(tagger, home, languages)

    def vote(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 2048):
                b = p.iloc[at : at + 2048]
                answers, clarify = (b[c].where(b[c].notna(), None).tolist() for c in ("answer", "clarify"))
                got, langs, wants = judge(b["query"].fillna("").tolist(), answers, clarify)
                out = b[["id", "draw", "query", "answer"]].assign(votes=[[pattern_of(x) for x in v] for v in got], lang=[x for x, _ in langs], sure=[x for _, x in langs], want=wants)
                yield out.assign(answered=b["query"].notna() & [bool(content(a) and lang and sure > 0.8) for a, (lang, sure) in zip(answers, langs, strict=True)])

    def plant(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("draw")
        pairs = list(p[["query", "answer", "lang", "sure", "want"]].itertuples(index=False, name=None))
        counts = planted_counts(judge, pairs, np.random.default_rng([11, int(key[0])]))
        return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["planted", "defect", "pattern", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(a) for c, a in ((query_col, "query"), (answer_col, "answer"), (clarify_col, "clarify"))])
    source = source.withColumn("draw", F.xxhash64("query", "answer"))
    voted = stored(source.mapInPandas(vote, f"id {kind}, draw long, query string, answer string, votes array<string>, lang string, sure double, want string, answered boolean"))
    counts: dict[int, dict[tuple[int, ...], int]] = {i: {} for i in range(len(DEFECTS))}
    for r in voted.select(F.posexplode("votes").alias("defect", "pattern")).groupBy("defect", "pattern").count().collect():
        counts[r["defect"]][votes_of(r["pattern"])] = r["count"]
    total = sum(counts[0].values())
    if not total:
        return Flags(df.sparkSession.createDataFrame([], f"id {kind}, defects array<string>, posteriors array<double>, first_defect string"), [])
    models = [fit_model(counts[i], assumed=ASSUMED.get(d)) for i, d in enumerate(DEFECTS)]
    posterior = {(i, pattern_of(k)): v for i in counts for k, v in zip(counts[i], models[i].posterior(np.array(list(counts[i]))).tolist() if models[i] else [0.0] * len(counts[i]), strict=True)}
    table = F.create_map(*[F.lit(x) for (i, k), v in sorted(posterior.items()) for x in (f"{i}{k}", v)])
    scored = voted.withColumn("posteriors", F.transform("votes", lambda x, i: table[F.concat(i.cast("string"), x)]))
    clean = scored.where(F.col("query").isNotNull() & ~F.exists("posteriors", lambda x: x > 0.5))
    if validation_rows is not None:
        clean = clean.where(F.pmod(F.col("draw"), F.lit(1 << 30)) < math.ceil(min(1.0, 2 * validation_rows / total) * (1 << 30)))
    # Copies of a pair count once.
    pair = F.min(F.struct("answered", "votes", "query", "answer", "lang", "sure", "want"))
    clean = stored(clean.groupBy("draw").agg(pair.alias("x")).select("draw", "x.*"))
    sound: list[Counter[str]] = [Counter() for _ in DEFECTS]
    for r in clean.select(F.posexplode("votes").alias("defect", "pattern")).groupBy("defect", "pattern").count().collect():
        sound[r["defect"]][r["pattern"]] = r["count"]
    groups = math.ceil(sum(sound[0].values()) / 4096)
    bad: dict[tuple[str, int], Counter[str]] = {}
    if groups:
        placed = clean.where("answered").select(F.pmod("draw", F.lit(groups)).alias("place"), "draw", "query", "answer", "lang", "sure", "want")
        cases = placed.groupBy("place").applyInPandas(plant, "planted string, defect int, pattern string, n long")
        for r in cases.groupBy("planted", "defect", "pattern").agg(F.sum("n").alias("n")).collect():
            bad.setdefault((r["planted"], r["defect"]), Counter())[r["pattern"]] = r["n"]
    discard(clean)
    cutoffs = validated_cutoffs(models, sound, bad)
    named = F.array(*[F.when(F.col("posteriors")[i] > cutoff, d) for i, (d, cutoff, *_) in enumerate(cutoffs)])
    rows = scored.withColumn("defects", F.array_compact(named)).select("id", "defects", "posteriors", F.get("defects", F.lit(0)).alias("first_defect"))
    return Flags(rows, cutoffs)
