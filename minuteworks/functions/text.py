"""Text functions as Column expressions: normalising, tokens, keys, signals, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

#: A word character in any script; ``\\w`` alone would miss umlauts.
W = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def offset_normalise(c: Column) -> Column:
    """FN1: soft hyphens, line ends and blanks made uniform, words joined over line ends."""
    c = F.regexp_replace(c, "­", "")
    c = F.regexp_replace(c, r"\r\n|\r|\f", "\n")
    c = F.regexp_replace(c, rf"({W})-\n({W})", "$1$2")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def match_normalise(c: Column) -> Column:
    """FN2: FN1 in lower case, one blank for white space, bullets, quotes and dashes folded."""
    c = F.regexp_replace(F.lower(offset_normalise(c)), r"\s+", " ")
    c = F.translate(c, "„“”‚‘’´`«»–—−‐‑", "\"\"\"'''''\"\"-----")
    return strip(F.regexp_replace(c, "[•·▪●◦]", " "))


def chunk_clean(c: Column, faithful: bool = False) -> Column:
    """FN3: file paths to the end of the line dropped, blank lines collapsed; ``faithful`` also eats URLs."""
    drive = r"[A-Za-z]:[\\/][^\n]*" if faithful else r"\b[A-Za-z]:[\\/][^\n]*"
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\u0000", ""), drive, ""), r"\n{3,}", "\n\n"))


def clean_lines(c: Column) -> Column:
    """FN4: trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")


def tokens(c: Column) -> Column:
    """FN5: words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def embed_truncate(c: Column, most: int = 6000) -> Column:
    """FN6: the first ``most`` words, as an embedding service takes them."""
    return F.array_join(F.slice(tokens(strip(F.regexp_replace(c, "\u0000", ""))), 1, most), " ")


def span_clamp(start_page: Column, start_char: Column, end_page: Column, end_char: Column, pages: Column, last_chars: Column) -> Column:
    """FN7: a span inside its document, its end not before its start."""
    sp, sc = F.least(F.greatest(start_page, F.lit(0)), pages - 1), F.greatest(start_char, F.lit(0))
    ep = F.least(F.greatest(end_page, sp), pages - 1)
    ec = F.least(F.greatest(end_char, F.when(ep == sp, sc).otherwise(F.lit(0))), last_chars)
    return F.struct(sp.alias("start_page"), sc.alias("start_char"), ep.alias("end_page"), ec.alias("end_char"))


def span_text(pages: Column, start_page: Column, start_char: Column, end_page: Column, end_char: Column) -> Column:
    """FN8: the text of a span over an array of pages (0-based, end exclusive), joined by blank lines."""
    first, last = F.get(pages, start_page), F.get(pages, end_page)
    one = F.substring(first, start_char + 1, F.greatest(end_char - start_char, F.lit(0)))
    middle = F.slice(pages, start_page + 2, F.greatest(end_page - start_page - 1, F.lit(0)))
    more = F.concat(F.array(F.substring(first, start_char + 1, F.length(first))), middle, F.array(F.substring(last, F.lit(1), end_char)))
    return offset_normalise(F.when(start_page == end_page, one).otherwise(F.array_join(more, "\n\n")))


def offset_to_page(lengths: Column, offset: Column, gap: int = 2) -> Column:
    """FN9: (page, char) of an offset in pages joined with ``gap`` characters between them."""
    walk = F.aggregate(
        lengths, F.struct(offset.cast("long").alias("left"), F.lit(0).alias("page"), F.lit(False).alias("done")),
        lambda s, n: F.when(s["done"] | (s["left"] <= n), F.struct(s["left"].alias("left"), s["page"].alias("page"), F.lit(True).alias("done")))
        .otherwise(F.struct((s["left"] - n - gap).alias("left"), (s["page"] + 1).alias("page"), F.lit(False).alias("done"))),
    )
    return F.struct(walk["page"].alias("page"), F.greatest(walk["left"], F.lit(0)).alias("char"))


def agenda_key(c: Column) -> Column:
    """FN14 and FN15 as one parser: number, sub number, suffix and normal form of an agenda key.

    ``9``, ``9.a``, ``9a``, ``24.1``, ``24.1.a`` and ``24 . 1`` are understood, case and
    blanks don't count. A suffix is upper case after a number, lower case after a sub
    number; ``norm`` joins the parts with points. Anything else has null parts.
    """
    t = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), r"^(?:top)\.?|,", "")
    num = F.regexp_extract(t, r"^(\d{1,3})(?:\.(\d{1,3}))?\.?([a-z])?\.?$", 1)
    sub = F.regexp_extract(t, r"^(\d{1,3})(?:\.(\d{1,3}))?\.?([a-z])?\.?$", 2)
    suffix = F.regexp_extract(t, r"^(\d{1,3})(?:\.(\d{1,3}))?\.?([a-z])?\.?$", 3)
    suffix = F.when(sub == "", F.upper(suffix)).otherwise(suffix)
    norm = F.concat_ws(".", F.nullif(num, F.lit("")), F.nullif(sub, F.lit("")), F.nullif(suffix, F.lit("")))
    return F.struct(num.try_cast("int").alias("num"), F.nullif(sub, F.lit("")).alias("sub"), F.nullif(suffix, F.lit("")).alias("suffix"), F.nullif(norm, F.lit("")).alias("norm"))


def review_key(c: Column) -> Column:
    """FN15: the review parser of agenda keys: number, suffix, sub number and normal form.

    ``13``, ``13A``, ``13.a``, ``10.1`` and ``10.1.2`` are understood; of anything else
    that begins with digits only the number counts, otherwise it is 0. ``norm`` is the
    number, the suffix in upper case, and the sub number behind a point. Null stays null.
    """
    t = F.trim(F.regexp_replace(c, r"\s*\.\s*", "."))
    num = F.coalesce(F.regexp_extract(t, r"^(\d+)", 1).try_cast("int"), F.lit(0))
    suffix = F.nullif(F.upper(F.regexp_extract(t, r"^\d+\s*\.?([A-Za-z])$", 1)), F.lit(""))
    one, two = (F.regexp_extract(t, r"^\d+\.(\d+)(?:\.(\d+))?$", i).try_cast("int").cast("string") for i in (1, 2))
    sub = F.nullif(F.concat_ws(".", one, two), F.lit(""))
    norm = F.concat(num.cast("string"), F.coalesce(suffix, F.lit("")), F.coalesce(F.concat(F.lit("."), sub), F.lit("")))
    return F.when(c.isNotNull(), F.struct(num.alias("num"), suffix.alias("suffix"), sub.alias("sub"), norm.alias("norm")))


#: Spellings by canonical role (fixed values).
ROLES = {
    "vorsitz": ("vorsitz",), "mitglied": ("mitglied", "mitglieder"), "rat": ("rat", "mitglied des rates", "mitglieder des rates"), "verwaltung": ("verwaltung",),
    "schriftfuehrung": ("schriftfuehrung", "schriftführer", "schriftfuehrer", "schriftführerin", "schriftfuehrerin"), "gast": ("gast", "gäste"), "sonstige": ("sonstige",),
    "fehlt_entschuldigt": ("fehlt_entschuldigt", "fehlt: entschuldigt", "fehlt entschuldigt", "entschuldigt"),
    "fehlt_unentschuldigt": ("fehlt_unentschuldigt", "fehlt: unentschuldigt", "fehlt unentschuldigt", "unentschuldigt"),
}


def role(c: Column) -> Column:
    """FN16: canonical role; unknown ones are ``sonstige``, null stays null."""
    table = F.create_map(*[F.lit(x) for name, words in ROLES.items() for w in words for x in (w, name)])
    return F.when(c.isNotNull(), F.coalesce(table[F.trim(F.lower(c))], F.lit("sonstige")))


def name_normalise(c: Column) -> Column:
    """FN17: lower case, letters, digits and single blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", ""), r" +", " "))


def first_json(c: Column, *keys: str) -> Column:
    """FN18: the first of several JSON fields that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(c, f"$.{k}")), F.lit("")) for k in keys])


def strict_date(c: Column) -> Column:
    """FN19: a date written Y-m-d, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def strict_time(c: Column) -> Column:
    """FN19: HH:MM as HH:MM:00, HH:MM:SS as it is, else null."""
    return F.when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.concat(c, F.lit(":00"))).when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), c)


def strict_int(c: Column) -> Column:
    """FN19: up to six digits as a number, else null."""
    return F.when(c.rlike(r"^\d{1,6}$"), c.cast("int"))


def title_words(c: Column, n: int = 3, least: int = 5) -> Column:
    """FN21: the first ``n`` words of a title of at least ``least`` letters."""
    return F.slice(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9äöüß]+", " "), " "), lambda w: F.length(w) >= least), 1, n)


def confidence(c: Column, default: float = 0.0) -> Column:
    """FN35: a number between 0 and 1."""
    x = c.try_cast("double")
    return F.least(F.greatest(F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x), F.lit(0.0)), F.lit(1.0))


#: Endings of names of places and buildings (fixed values).
PLACE_ENDINGS = (
    "straße", "strasse", "weg", "platz", "allee", "gasse", "ring", "hütte", "haus", "hof", "park", "bad", "berg", "feld", "tal",
    "schule", "kirche", "zentrum", "halle", "brücke",
)


def proper_nouns(c: Column) -> Column:
    """FN36: words of five letters that end like a place, or of eight with a capital inside; distinct, in order."""
    words = F.regexp_extract_all(c, F.lit("[A-ZÄÖÜa-zäöüß]{5,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.lower(w).rlike(f"({'|'.join(PLACE_ENDINGS)})$") | (F.length(w) >= 8) & w.rlike(r"^.\p{L}*\p{Lu}")))


#: Wordings by kind of question, as whole words (fixed values); ``.*`` stands for anything between.
QUERY_KINDS = {
    "attendance": ("anwesend", "teilgenommen", "teilnahme", "mitglied", "mitglieder", "fraktion", "rolle", "vorsitz", "wer ist", "wer war", "gehört .* zu", "welcher fraktion", "welche fraktion"),
    "statement": (
        "gesagt", "gefragt", "geäußert", "äußerte", "erklärt", "meinte", "sagte", "fragte", "wies darauf hin", "merkte an", "bat", "wortmeldung", "redete", "hat .* gesagt", "hat .* gefragt",
    ),
    "metadata": ("wer ist", "welcher fraktion", "welche fraktion", "mitglied", "anwesend", "teilgenommen", "rolle", "vorsitz", "gehört .* zu"),
}
#: Words of questions about the present; they count inside words too (fixed values).
RECENCY_WORDS = ("aktuell", "derzeit", "stand", "noch", "geplant", "laufend", "in auftrag", "zuletzt", "letzte", "neueste", "heute", "jetzt", "aktueller")
RECENCY = "(" + "|".join(RECENCY_WORDS) + ")"


def whole_words(kinds: Sequence[str]) -> str:
    """A pattern for any of some wordings as whole words, umlauts counted as letters."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(kinds) + r")($|[^\p{L}\p{N}_])"


def query_flags(c: Column) -> Column:
    """FN37 and FN40: what a question asks for."""
    low = F.lower(c)
    return F.struct(*[low.rlike(whole_words(words)).alias(k) for k, words in QUERY_KINDS.items()], low.rlike(RECENCY).alias("recency"))


#: Aliases of factions in questions (fixed values); an engine for another council gives its own.
FACTION_ALIASES = {
    "grüne": ("grünen", "bündnis", "grüne", "gruene"), "cdu": ("cdu",), "spd": ("spd",), "fdp": ("fdp",), "linke": ("linke", "linken", "pds", "dkp"), "afd": ("afd",),
    "fw": ("ebb", "freie wähler", "fw"), "volt": ("volt", "partei", "gruppe volt & die partei"),
}
#: Capitalised words that are no person's name (fixed values).
NO_NAMES = (
    "wer was wie wann wo welche welcher welches wurde werden worden haben hatte hat sein war ist sind waren wird für der die das und oder aber auch noch nicht nur alle schon sitzung protokoll "
    "bezirksvertretung fraktion mitglied jahr jahre zuletzt seit nach über unter beim tätig dabei grünen linke partei gruppe gesagt gefragt erklärt meinte sagte fragte"
).split()


def detect_faction(c: Column, aliases: Mapping[str, Sequence[str]] = FACTION_ALIASES) -> Column:
    """FN39: the first faction of which a question holds an alias, also inside words; else null."""
    low = F.lower(c)
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words]), F.lit(key)) for key, words in aliases.items()])


def detect_person(c: Column, aliases: Mapping[str, Sequence[str]] = FACTION_ALIASES) -> Column:
    """FN39: the surname that a question names, else null.

    After ``Herr`` or ``Frau`` the last of the capitalised words that is no title;
    otherwise the last capitalised word of four letters, not the question's first, that
    is neither in ``NO_NAMES`` nor an alias.
    """
    called = F.split(F.regexp_extract(c, r"(?:Herr|Frau)\s+((?:[A-ZÄÖÜ][a-zäöüß-]+\.?\s+)*[A-ZÄÖÜ][a-zäöüß-]+)", 1), r"\s+")
    titled = F.filter(called, lambda w: (w != "") & ~w.rlike(r"^(Dr|Prof|Dipl|Med)\.?$"))
    other = [*NO_NAMES, *(w.lower() for words in aliases.values() for w in words)]
    rest = F.slice(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), 2, 1 << 20)
    words = F.filter(F.transform(rest, lambda w: F.regexp_replace(w, "[^a-zA-ZäöüÄÖÜß-]", "")), lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*other))
    return F.coalesce(F.get(titled, F.size(titled) - 1), F.get(words, F.size(words) - 1))


def query_signals(c: Column) -> Column:
    """FN38: agenda key, ISO date, paper number in a question (null where absent), and whether it spans years."""
    date = r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
    d, m, y = (F.regexp_extract(c, date, i) for i in (1, 2, 3))
    return F.struct(
        F.nullif(F.regexp_extract(c, r"(?i)\btop\s*(\d{1,3}(?:\.\d{1,3})?\.?[a-z]?)\b", 1), F.lit("")).alias("top_key"),
        F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).alias("iso_date"),
        F.nullif(F.regexp_extract(c, r"\b(\d{4}/\d{4}(?:/\d{1,2})?)\b", 1), F.lit("")).alias("paper"),
        F.coalesce(F.lower(c).rlike(MULTI_DOC), F.lit(False)).alias("multi_doc"),
    )


#: Wordings of questions over several years (fixed values).
MULTI_DOC = r"entwickelt|verändert|über die jahre|im laufe|seit \d{4}"


def linear_recency(date: Column, as_of: str, days: int = 365) -> Column:
    """FN41: 1 for today and later, falling to 0 after ``days``; 0 without a date."""
    age = F.datediff(F.lit(as_of).cast("date"), date)
    # least and greatest pass over nulls, so the date is looked at first.
    return F.when(date.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / F.lit(float(days)))))


#: Endings of nouns (fixed values).
NOUN_ENDINGS = ("ung", "heit", "keit", "schaft", "ität", "tion", "sion", "nis", "tum", "chen", "lein")
#: Words that are no topic of a question (fixed values).
NO_TOPICS = (
    "der die das den dem des ein eine einer einem einen eines und oder aber auch noch nicht nur schon ist sind war waren wird werden worden hat haben hatte hatten "
    "für von zu zur zum in im an am auf über unter bei mit nach vor ohne um wer was wie wann wo warum welche welcher welches ich du er sie es wir ihr mich dich mir dir ihm uns euch ihnen "
    "als wenn weil dass ob alle alles einige manche viele wenige sehr mehr weniger etwa circa "
    "ratsprotokoll protokoll protokolle sitzung sitzungen ausschuss bezirksvertretung gremium gremien stadt essen beschluss beschlüsse jahr jahre zuletzt seit dabei dazu"
).split()


def content_terms(c: Column, most: int = 3) -> Column:
    """FN46: up to ``most`` telling words of a question, in lower case: of five letters, with a capital, a noun's ending or eight letters."""
    words = F.regexp_extract_all(c, F.lit("[A-Za-zÄÖÜäöüß-]{5,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*NO_TOPICS) & (w.rlike(r"^\p{Lu}") | F.lower(w).rlike(f"({'|'.join(NOUN_ENDINGS)})$") | (F.length(w) >= 8)))
    return F.slice(F.array_distinct(F.transform(kept, F.lower)), 1, most)


def clean_variants(term: Column, variants: Column, most: int = 5) -> Column:
    """FN49: lower case, trimmed, other than the term, distinct, the first ``most``."""
    v = F.transform(variants, lambda x: F.trim(F.lower(x)))
    return F.slice(F.array_distinct(F.filter(v, lambda x: (x != "") & (x != F.lower(term)))), 1, most)


#: Wordings of attempts to override instructions (fixed values).
INJECTIONS = (
    "vergiss", "verhalte dich", "du bist jetzt", "tu so als", "rollenspiel", "überschreibe", "ersetze deine rolle", "ignoriere",
    "forget", "you are now", "roleplay", "pretend", "act as", "ignore previous", "disregard", "override", "jailbreak", "bypass", "break character", "simulate",
    "zeig deinen prompt", "zeige deinen system", "reveal your prompt", "show your instructions", "print your system",
    "base64", "<?php", "<script", "javascript:", "eval(",
)


def injection(c: Column) -> Column:
    """FN50: tries to override instructions; ``DAN`` only as a word in capitals."""
    return reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in INJECTIONS]) | c.rlike(r"\bDAN\b")


def nonsense(c: Column) -> Column:
    """FN51: too short, hardly a letter, one character or word again and again, no word of three letters."""
    t = F.trim(F.lower(c))
    return (
        (F.length(t) < 3) | (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 2) | t.rlike(r"(.)\1{4,}") | t.rlike(r"(?<![\p{L}\p{N}])([\p{L}\p{N}]+)(?:\s+\1){2,}(?![\p{L}\p{N}])") | ~t.rlike(r"\p{L}{3,}")
    )


#: Beginnings and words of questions that point back (fixed values).
POINTS_BACK = (("und", "aber", "oder", "was ist mit", "wie sieht es"), ("das", "dies", "dazu", "davon", "darüber", "er", "sie", "dort"))


def follow_up(c: Column) -> Column:
    """FN52: a question of at most eight words, or one that points back."""
    t = F.trim(F.lower(c))
    return (F.size(tokens(t)) <= 8) | t.rlike("^(" + "|".join(POINTS_BACK[0]) + r")($|[^\p{L}\p{N}_])") | t.rlike(whole_words(POINTS_BACK[1]))


def safe_filename(c: Column) -> Column:
    """FN57: letters, digits, point, minus and underscore; runs of others are one underscore."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", "_"), r"[^\p{L}\p{N}._-]+", "_")


def preview(c: Column, n: int = 200) -> Column:
    """FN58: the first ``n`` characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def query_year(c: Column) -> Column:
    """FN59: the first year 199x or 20xx in a text."""
    return F.regexp_extract(c, r"\b(20\d{2}|199\d)\b", 1).try_cast("int")


def window_bucket(ts: Column, seconds: int = 3600) -> Column:
    """FN60: start of the fixed window, in seconds since the epoch."""
    return (F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long")


def sha256_text(c: Column) -> Column:
    """FN56: hash of a text, null for null and empty."""
    return F.sha2(F.nullif(c, F.lit("")), 256)


def like_escape(term: str) -> str:
    """A term for LIKE in which ``%`` and ``_`` are themselves."""
    return term.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
