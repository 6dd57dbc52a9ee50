"""Problem 4: variant spellings of names, by canonical rewritings and equi-joins.

Every name, on both sides, is rewritten into all its canonical forms: titles and
remarks dropped, nicknames and initials opened, legal forms and abbreviations
undone, words in every order, compounds taken apart, one letter left out. Two names
meet where a form is equal. Of several entries met, the one stands that explains
the given name, the other field and the spelling best; the rarer a form is among
the entries, the more it counts.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from minuteworks.session import cut

#: Short forms and variants of German given names in general use (fixed values); others are met by rules.
NICKNAMES = {
    "alexander": "alex sascha sandro", "alfred": "fredi freddy", "andreas": "andi andy andrea", "anna": "anni änne anja", "anton": "toni", "barbara": "babsi bärbel", "bernd": "bernhard berni", "birgit": "biggi gitte birgitta",
    "christian": "chris krischan", "christine": "christel tine christina kristin", "daniel": "dani", "dieter": "didi", "dorothea": "doris dora thea dörte", "eduard": "edi ede", "elisabeth": "lisbeth elli lisa else liesel sissi elsbeth",
    "franz": "franzl", "friedrich": "fritz friedel fred", "georg": "jörg schorsch jürg", "gerda": "gerti gertrud", "gerhard": "gerd gert", "gottfried": "götz", "gustav": "gustl", "hans": "hansi johann", "hartmut": "hardy",
    "heike": "heiki", "heinrich": "heinz heiner hinrich henrik heino", "helene": "leni lene", "helga": "helgi", "hermann": "harm", "hildegard": "hilde", "holger": "holgi", "ilse": "ilschen", "ingeborg": "inge inga",
    "jakob": "jacob jascha", "joachim": "achim jochen jo", "johannes": "hannes jannes jan", "josef": "sepp jupp joseph jo", "jürgen": "jogi jörn", "karl": "carl kalle charly", "katharina": "kathi kathrin katja käthe", "klaus": "claus",
    "konrad": "conrad kurt conny", "ludwig": "lutz wiggerl", "manfred": "manni mane fred", "margarete": "grete gretel marga margret gretchen", "maria": "marie mia mizzi", "markus": "marcus", "martin": "maddin", "matthias": "mathias hias",
    "maximilian": "max maxi", "michael": "micha michel mike", "monika": "moni", "nikolaus": "klaas nico niklas", "paul": "pauli", "peter": "pit peer", "petra": "peti", "philipp": "phil", "rainer": "reiner", "regina": "gina", "renate": "reni nate",
    "richard": "richie", "robert": "robby bert", "rolf": "rudolf rudi", "sabine": "bine biene", "sebastian": "basti bastian", "siegfried": "sigi siggi", "stefan": "stephan steffen steff", "susanne": "susi sanne suse", "theodor": "theo",
    "thomas": "tom tommi", "torsten": "thorsten toto", "ulrich": "uli ulli ulla", "ursula": "uschi ulla", "walter": "walther walli", "werner": "wernfried", "wilhelm": "willi willy helmut", "wolfgang": "wolf wolle",
}
#: Words that are no part of a person's name, and none of a group's (fixed values).
TITLES = "herr herrn frau hr fr dr prof med jur phil rer nat ing dipl mag ra rin rm bm obm bv bgm stv stellv vors vorsitz vorsitzender vorsitzende ratsherr ratsfrau bürgermeister bürgermeisterin sachkundiger sachkundige entschuldigt mdl"
LEGAL = "fraktion fraktionen gruppe ratsgruppe partei die der das des und u e v ev"
_DIGITS = str.maketrans("01593", "olsge")


def fold(text: str) -> str:
    """Lower case, umlauts as two letters, accents dropped, digits in words as the letters they look like."""
    text = unicodedata.normalize("NFC", text).lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = text.replace(a, b)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.sub(r"[^\W_]+", lambda m: m.group().translate(_DIGITS) if re.search(r"[a-z]", m.group()) else m.group(), text)


_TITLES, _LEGAL = frozenset(fold(TITLES).split()), frozenset(fold(LEGAL).split())
_FULL: dict[str, set[str]] = {}
for _name, _shorts in NICKNAMES.items():
    for _short in fold(_shorts).split():
        _FULL.setdefault(_short, set()).add(fold(_name))


def flat(text: str) -> str:
    """Lower case with umlauts as their base letter, and letters that scans mix up as one."""
    text = "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    text = re.sub(r"[^\W_]+", lambda m: m.group().translate(_DIGITS) if re.search(r"[a-z]", m.group()) else m.group(), text)
    for a, b in (("rn", "m"), ("lc", "k"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("li", "h")):
        text = text.replace(a, b)
    return text


def deletions(word: str) -> set[str]:
    """The word, and the word with any one letter left out."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def full_names(word: str) -> set[str]:
    """The given names that a word may stand for: itself, and those it is a short form or variant of."""
    return {word} | _FULL.get(word, set()) | {short for full in (_FULL.get(word, set()) | {word}) if full in _SHORT for short in _SHORT[full]}


_SHORT = {fold(full): fold(names).split() for full, names in NICKNAMES.items()}


# Persons ---------------------------------------------------------------------------------


def person_words(text: str, writing=fold) -> list[str]:
    """Words without titles and remarks; a point stays with a word that it cuts short."""
    text = writing(re.sub(r"\([^)]*\d[^)]*\)|\b(?:ab|bis|von)\s+\d.*$", " ", text))
    if re.fullmatch(r"\W*\w(?:[\s–-]+\w){3,}\W*", text):
        text = re.sub(r"[\s–-]+", "", text)
    return [w for w in re.findall(r"[^\W_]*[a-z][^\W_]*\.?", text) if w.rstrip(".") not in _TITLES]


def surname_forms(words: list[str]) -> dict[str, int]:
    """Spellings of a surname with their cost: 0 other writing or order, 1 one letter off."""
    bare = [w.rstrip(".") for w in words]
    forms: dict[str, int] = {}
    for order in itertools.permutations(bare) if 1 < len(bare) <= 3 else [bare]:
        forms["=" + "".join(order)] = 0
    for form in deletions("".join(bare)):
        if len(form) >= 4:
            forms["-" + form] = 1
    if len(bare) == 2:
        for form in deletions("".join(reversed(bare))):
            forms.setdefault("-" + form, 1)
    return forms


def flat_forms(words: list[str]) -> dict[str, int]:
    """Forms of a surname with base letters for umlauts and letters alike as one."""
    return {"~" + d: 1 for d in deletions("".join(w.rstrip(".") for w in words)) if len(d) >= 4}


def person_mention(text: str, given: frozenset[str]) -> list[tuple[str, str, int]]:
    """(form, given name or initial or '', cost) of a name as typed, for every reading of its words."""
    words, other = person_words(text), person_words(text, flat)
    other = other if len(other) == len(words) else words
    readings: list[tuple[list[str], str, list[str]]] = [(words, "", other)] if words else []
    near = {d: g for g in given for d in deletions(g)}
    for i, w in enumerate(words):
        rest, bare, spare = words[:i] + words[i + 1 :], w.rstrip("."), other[:i] + other[i + 1 :]
        if not rest:
            continue
        if len(bare) == 1:
            readings.append((rest, bare, spare))
        elif meant := full_names(bare) & given:
            readings += [(rest, g, spare) for g in sorted(meant)]
        elif hit := next((near[d] for d in sorted(deletions(bare)) if len(d) >= 3 and d in near), None):
            readings.append((rest, hit, spare))
        else:
            # Short forms not listed: the beginning of a given name, or its end.
            readings += [(rest, g, spare) for g in sorted(given) if len(bare) >= 4 and (g[:4] == bare[:4] or g.endswith(bare))]
    out: dict[tuple[str, str], int] = {}
    for rest, first, spare in readings:
        forms = surname_forms(rest) | flat_forms(spare)
        if rest[-1].endswith(".") and len("".join(rest)) > 3:
            forms["<" + "".join(w.rstrip(".") for w in rest)] = 2  # cut short
        if len(rest) == 1 and len(rest[0]) >= 5:
            forms["+" + rest[0].rstrip(".")] = 3  # one part of a double name
        for form, cost in forms.items():
            out[form, first] = min(cost, out.get((form, first), 9))
    if m := re.search(r"(?<!\w)([a-z])\.?\s?-\s?([a-z]{3,})|([a-z]{3,})\s?-\s?([a-z])\.", fold(text)):
        out["^" + (f"{m[1]}-{m[2]}" if m[1] else f"{m[3]}-{m[4]}"), ""] = 2
    return [(form, first, cost) for (form, first), cost in out.items()]


def person_entry(surname: str) -> list[str]:
    """Forms under which an entry is found."""
    words = person_words(surname.replace("-", " "))
    forms, whole = set(surname_forms(words)) | set(flat_forms(person_words(surname.replace("-", " "), flat))), "".join(words)
    for text in (whole, *words):
        forms |= {"<" + text[:n] for n in range(3, len(text))}
    if len(words) == 2:
        forms |= {"+" + w for w in words} | {f"^{words[0][0]}-{words[1]}", f"^{words[0]}-{words[1][0]}"}
    return sorted(forms)


# Groups ----------------------------------------------------------------------------------


def stem(word: str) -> str:
    """A word without inflection; a word cut short by a point keeps its point and first letter."""
    if word.endswith("."):
        return word[0] + "."
    return re.sub(r"(?<=\w{3})(?:liche[rsnm]?|lich|e[rsnm]?|s)$", "", word)


def group_readings(text: str) -> list[list[str]]:
    """Word lists of a group's name: as it stands, without brackets, and what stands in them."""
    text = fold(text)
    parts = [text, re.sub(r"\([^)]*\)", " ", text), *re.findall(r"\(([^)]*)\)", text)]
    out = []
    for part in parts:
        if re.fullmatch(r"\W*(?:[a-z]\w?\.){2,}[a-z]?\W*", part):
            part = re.sub(r"\W", "", part)
        words = [w for w in re.findall(r"[a-z]+\.?", part) if w.rstrip(".") not in _LEGAL]
        if words and words not in out:
            out.append(words)
    return out


def word_sets(words: list[str]) -> set[tuple[str, ...]]:
    """Stems as they stand, and with one compound taken apart at any place."""
    out = {tuple(sorted(stem(w) for w in words))}
    for i, w in enumerate(words):
        for n in range(4, len(w.rstrip(".")) - 3):
            out.add(tuple(sorted([*(stem(x) for x in words[:i] + words[i + 1 :]), stem(w[:n]), stem(w[n:])])))
    return out


def group_mention(text: str) -> list[tuple[str, str, int]]:
    """(form, '', cost) of a group's name as typed."""
    out: dict[str, int] = {}
    for words in group_readings(text):
        if len(words) == 1:
            out["a" + words[0].rstrip(".")] = 0
        for ws in word_sets(words):
            out.setdefault("t" + " ".join(ws), 1)
        joined = "".join(w.rstrip(".") for w in words)
        for form in deletions(joined):
            if len(form) >= 6:
                out.setdefault("-" + form, 2)
    for form in deletions(re.sub(r"[^a-z]", "", flat(re.sub(r"\([^)]*\)", "", text)))):
        if len(form) >= 6:
            out.setdefault("~" + form, 2)
    return [(form, "", cost) for form, cost in out.items()]


def group_entry(name: str, short: str | None) -> list[str]:
    """Forms of an entry: short name, words dropped, cut short, put together, letters left out.

    Of names of more than eight words, as many are dropped as leave one or two, or
    one or two are; they are cut short all at once: forms stay few for any entry.
    """
    forms: set[str] = set()
    if short:
        forms.add("a" + "".join(re.findall(r"[a-z]+", fold(short))))
    forms |= {"~" + d for d in deletions(re.sub(r"[^a-z]", "", flat(name)))}
    for words in group_readings(name):
        for ws in word_sets(words):
            for n in range(1, len(ws) + 1) if len(ws) <= 8 else (1, 2, *range(len(ws) - 2, len(ws) + 1)):
                for kept in itertools.combinations(ws, n):
                    if len(kept) < 2 and len(kept[0]) < 8 or sum(map(len, kept)) < 8:
                        continue
                    masks = range(1 << n) if n <= 8 else (0, (1 << n) - 1)
                    for mask in masks if n == len(ws) else (0,):
                        forms.add("t" + " ".join(sorted(w[0] + "." if mask >> i & 1 else w for i, w in enumerate(kept))))
        for order in (words, words[::-1]):
            forms |= {"-" + d for d in deletions("".join(order))}
        for a, b in itertools.pairwise(words):
            forms |= {"a" + stem(a) + b, "a" + stem(a) + "er" + b, "t" + stem(stem(a) + b), "t" + stem(stem(a) + "er" + b)}
    return sorted(forms)


# Joins -----------------------------------------------------------------------------------


def _explode(df: DataFrame, function, schema: str) -> DataFrame:
    """Rows of ``function(row)`` for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for p in parts:
            yield pd.DataFrame([x for row in p.itertuples(index=False) for x in function(row)], columns=names)

    return df.mapInPandas(run, schema)


def _spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has, which adaptive execution doesn't merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def link_groups(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """``name, entry, cost, rarity``: the one entry that a group's name stands for.

    ``mentions``: name, any number of rows; ``entries``: entry, name, short_name. Names
    that no form or several entries explain equally well are left out. Distinct names
    are rewritten once.
    """
    forms = _explode(entries.select("entry", "name", "short_name").where("name is not null"), lambda r: ((f, r.entry) for f in group_entry(r.name, r.short_name)), "form string, entry string")
    n = Window.partitionBy("form")
    forms = forms.distinct().withColumn("rarity", -F.log2(F.count("*").over(n)))
    said = _explode(_spread(mentions.select("name").where("name is not null").distinct()), lambda r: ((r.name, f, c) for f, _, c in group_mention(r.name)), "name string, form string, cost int")
    met = said.join(forms, "form").groupBy("name", "entry").agg(F.max(F.struct(-F.col("cost"), F.col("rarity"))).alias("best"))
    first = Window.partitionBy("name").orderBy(F.desc("best"))
    ranked = met.withColumn("rank", F.rank().over(first)).where("rank = 1")
    alone = ranked.withColumn("ties", F.count("*").over(Window.partitionBy("name"))).where("ties = 1")
    return alone.select("name", "entry", (-F.col("best.col1")).cast("int").alias("cost"), F.col("best.rarity").alias("rarity"))


def link_persons(mentions: DataFrame, entries: DataFrame, max_given: int = 100_000) -> DataFrame:
    """``block, name, hint, entry, cost``: the one entry that a person's name stands for.

    ``mentions``: block, name, hint; ``entries``: entry, first_name, last_name, hint,
    blocks. A name is compared with the entries of its block. A given name or initial
    must be the entry's; an equal hint (the person's group) decides between entries of
    one surname. Names explained equally well by several entries are left out. More
    than ``max_given`` given names of entries raise an error: all workers get them.
    """
    people = cut(entries.where("last_name is not null").select("entry", F.coalesce("first_name", F.lit("")).alias("first_name"), "last_name", F.col("hint").alias("own"), F.explode("blocks").alias("block")))
    # Given names are a closed vocabulary; the table of entries is a fixed one.
    listed = people.select("first_name").distinct().limit(max_given + 1).collect()
    if len(listed) > max_given:
        raise ValueError(f"more than {max_given} given names")
    given = frozenset(fold(r["first_name"]) for r in listed if r["first_name"])
    given |= frozenset(_SHORT)
    forms = _explode(people.select("entry", "first_name", "last_name").distinct(), lambda r: ((f, r.entry, fold(r.first_name)) for f in person_entry(r.last_name)), "form string, entry string, first string")
    placed = people.select("entry", "own", "block").join(forms, "entry").withColumn("rarity", -F.log2(F.count("*").over(Window.partitionBy("block", "form"))))
    distinct = mentions.select("block", "name", "hint").where("name is not null and block is not null").distinct()
    # A name gives some thirty forms: spread over all tasks, however few bytes the names are.
    said = _explode(_spread(distinct.select("name").distinct()), lambda r: ((r.name, f, g, c) for f, g, c in person_mention(r.name, given)), "name string, form string, given string, cost int")
    met = distinct.join(said, "name").join(placed, ["block", "form"])
    agrees = F.when(F.col("given") == "", 0).when(F.col("given") == F.col("first"), 2).when((F.length("given") == 1) & F.startswith("first", "given"), 1).otherwise(-1)
    met = met.withColumn("agrees", agrees).where("agrees >= 0")
    score = F.struct(F.col("agrees"), F.coalesce((F.col("hint") == F.col("own")).cast("int"), F.lit(0)).alias("same"), -F.col("cost"), F.col("rarity"))
    best = met.groupBy("block", "name", "hint", "entry").agg(F.max(score).alias("best"))
    # Rarity is equal for entries of one form, so ties are true ties.
    key = ["block", "name", "hint"]
    ranked = best.withColumn("rank", F.rank().over(Window.partitionBy(*key).orderBy(F.desc("best")))).where("rank = 1")
    alone = ranked.withColumn("ties", F.count("*").over(Window.partitionBy(*key))).where("ties = 1")
    return alone.select(*key, "entry", (-F.col("best.col3")).cast("int").alias("cost"))


def link_attendance(rows: DataFrame, documents: DataFrame, members: DataFrame, factions: DataFrame) -> DataFrame:
    """``row_id, field, name, entity_key, exact`` of the attendance rows that mean a member or faction.

    ``last_name_extracted`` is compared with the members of the document's body,
    ``faction_extracted`` with all factions; the linked faction is the person's hint.
    Null and blank names, rows without document, and documents without body have no
    link; ``exact`` marks names written as the entry has them. Repeated rows are
    linked each; other columns are ignored. Names repeat, so each distinct name (and
    body, and faction) is linked once and joined back.
    """
    data = rows.select(F.col("id").alias("row_id"), "document_id", F.col("last_name_extracted").alias("person"), F.col("faction_extracted").alias("faction"))
    bodies = documents.select(F.col("id").alias("document_id"), F.col("gremium_key").alias("block")).dropDuplicates(["document_id"])
    groups = link_groups(data.select(F.col("faction").alias("name")), factions.select(F.col("faction_key").alias("entry"), "name", "short_name"))
    linked = groups.select(F.col("name").alias("faction"), F.col("entry").alias("hint"))
    data = cut(data.join(bodies, "document_id", "left").join(linked, "faction", "left"))
    own = members.select(F.col("member_id").cast("string").alias("entry"), "first_name", "last_name", F.col("faction_key").alias("hint"), F.col("gremium_keys").alias("blocks"))
    persons = link_persons(data.select("block", F.col("person").alias("name"), "hint"), own)
    persons = persons.select(F.col("block").alias("b"), F.col("name").alias("n"), F.col("hint").alias("h"), "entry")
    p = data.join(persons, (F.col("block") == F.col("b")) & (F.col("person") == F.col("n")) & F.col("hint").eqNullSafe(F.col("h")))
    p = p.join(members.select(F.col("member_id").cast("string").alias("entry"), "last_name"), "entry").select("row_id", F.lit("last_name_extracted").alias("field"), F.col("person").alias("name"), F.col("entry").alias("entity_key"), (F.col("person") == F.col("last_name")).alias("exact"))
    f = data.where("hint is not null").join(factions.select(F.col("faction_key").alias("hint"), F.col("name").alias("full")), "hint")
    f = f.select("row_id", F.lit("faction_extracted").alias("field"), F.col("faction").alias("name"), F.col("hint").alias("entity_key"), (F.col("faction") == F.col("full")).alias("exact"))
    return p.unionByName(f)
