"""Hybrid retrieval as DataFrame plans: channels, rank fusion, boosts, caps, enrichment.

Every ranked list carries its ``rank``; every order ends in a unique key. A channel
ends in ``orderBy.limit`` (no global sort); windows run only over those few rows, or
partitioned by document.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from minuteworks.functions import similarity as S, text as T
from minuteworks.session import cut

#: Columns of a hit.
HIT = ("source", "source_ord", "id", "document_id", "top_key", "start_page", "meeting_date", "gremium_key", "score")
#: Constants of rank fusion by list (fixed values).
RRF = {"dense": 60, "paraphrase": 70, "sparse": 40, "trigram": 45, "backfill": 45}


@dataclass(frozen=True)
class Profile:
    """Weights of a search mode."""

    recency: float
    current: float
    cap: int
    candidates: float


PROFILES = {"relevant": Profile(0.05, 4.0, 3, 1.0), "recent": Profile(0.25, 2.0, 3, 1.0), "breadth": Profile(0.0, 1.0, 2, 1.5)}


@dataclass(frozen=True)
class Query:
    """A question with all that its plan depends on; ``as_of`` stands for today."""

    text: str
    vectors: Sequence[Sequence[float]] = ()
    as_of: str = "2026-01-01"
    gremium_key: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    mode: str = "relevant"
    top_k: int = 10
    terms: Sequence[str] = field(default_factory=tuple)

    @property
    def profile(self) -> Profile:
        """Weights of the mode; an unknown one is ``relevant``."""
        return PROFILES.get(self.mode, PROFILES["relevant"])


def candidate_count(c: Column, mode: str = "relevant") -> Column:
    """SO9: how many hits a channel gives a question: 300 for breadth, 140 for recency words or names of places, else 40."""
    if mode == "breadth":
        return F.lit(int(200 * PROFILES["breadth"].candidates))
    return F.when(F.lower(c).rlike(T.RECENCY) | (F.size(T.proper_nouns(c)) > 0), 140).otherwise(40)


def said_of(spark: SparkSession, text: str, aliases: Mapping[str, Sequence[str]]) -> Row:
    """What a question tells by itself: flags, signals, faction, person, topics, candidates; one row, no table is read."""
    c = F.col("question")
    one = spark.createDataFrame([(text,)], "question string")
    return one.select(
        T.query_flags(c).alias("flags"), T.query_signals(c).alias("signals"), T.detect_faction(c, aliases).alias("faction"), T.detect_person(c, aliases).alias("person"),
        T.content_terms(c).alias("terms"), T.proper_nouns(c).alias("places"), S.lexemes(c).alias("lexemes"), candidate_count(c).alias("candidates"),
    ).first()


def candidates(query: Query) -> int:
    """SO9 of a question."""
    one = SparkSession.active().createDataFrame([(query.text,)], "question string")
    return one.select(candidate_count(F.col("question"), query.mode)).first()[0]


def filtered_documents(documents: DataFrame, query: Query) -> DataFrame:
    """FLT1: documents of the asked body and years; without a date none fits a year."""
    docs = documents.select(F.col("id").alias("document_id"), "gremium_key", "gremium_name", "meeting_date", "source_filename")
    if query.gremium_key:
        docs = docs.where(F.col("gremium_key") == query.gremium_key)
    if query.year_from:
        docs = docs.where(F.year("meeting_date") >= query.year_from)
    if query.year_to:
        docs = docs.where(F.year("meeting_date") <= query.year_to)
    return docs


def segment_items(segments: DataFrame) -> DataFrame:
    """Segments as items of a search: texts of at least 20 characters (FLT3)."""
    return segments.where(F.length(F.trim(F.coalesce("text_full", F.lit("")))) >= 20).select(
        F.lit("segment").alias("source"), F.lit(2).alias("source_ord"), "id", "document_id", "top_key", "start_page", F.col("text_full").alias("text"), "embedding",
    )


def chunk_items(chunks: DataFrame) -> DataFrame:
    """Chunks as items of a search."""
    return chunks.select(
        F.lit("chunk").alias("source"), F.lit(1).alias("source_ord"), "id", "document_id", "top_key", "start_page", F.col("chunk_text").alias("text"), "embedding",
    )


def _hits(df: DataFrame) -> DataFrame:
    return df.select(*HIT)


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rank of a list that is already cut short: its window holds only those rows."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def dense(items: DataFrame, docs: DataFrame, vector: Sequence[float], n: int) -> DataFrame:
    """CP1, SO1: the ``n`` items of each source nearest by cosine, chunks before segments (WN2)."""
    target = F.array(*[F.lit(float(x)) for x in vector])
    scored = items.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(vector))).withColumn("score", S.cosine(F.col("embedding"), target)).where("score is not null")
    scored = _hits(scored.join(docs, "document_id"))
    best = [scored.where(F.col("source") == s).orderBy(F.desc("score"), "id").limit(n) for s in ("chunk", "segment")]
    return _ranked(reduce(DataFrame.unionByName, best), F.col("source_ord"), F.desc("score"), F.col("id"))


def dense_all(items: DataFrame, docs: DataFrame, vectors: Sequence[Sequence[float]], n: int) -> list[DataFrame]:
    """CP2: one dense list for each variant of a question."""
    return [dense(items, docs, v, n) for v in vectors]


def sparse(items: DataFrame, agenda: DataFrame, docs: DataFrame, lexemes: Sequence[str | Sequence[str]], n: int) -> DataFrame:
    """CP3, FN44: weighted full text over item and agenda title; branch-local, then common top ``n`` (SO2).

    All lexemes must occur in title or body; of several in one place (FN47, ``OR``) any
    one. A repeated agenda key counts once (the
    first row), so hits don't multiply.
    """
    titles = agenda.where("top_key_curated is not null").groupBy("document_id", F.col("top_key_curated").alias("top_key")).agg(F.min_by("title_curated", F.struct("row_index", "id")).alias("title"))
    groups = [(x,) if isinstance(x, str) else tuple(x) for x in lexemes]
    query = F.array(*[F.lit(x) for x in dict.fromkeys(x for group in groups for x in group)])
    found = items.join(docs, "document_id").join(titles, ["document_id", "top_key"], "left")
    # A lexeme is part of its word: most rows are ruled out before their words are taken apart.
    low = F.lower(F.concat_ws(" ", "title", "text"))
    for group in groups:
        found = found.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in group]))
    found = found.withColumn("title_lex", S.lexemes(F.coalesce("title", F.lit("")))).withColumn("body_lex", S.lexemes(F.coalesce("text", F.lit(""))))
    both = F.array_union("title_lex", "body_lex")
    everywhere = reduce(lambda a, b: a & b, [F.arrays_overlap(both, F.array(*[F.lit(x) for x in group])) for group in groups], F.lit(True))
    scored = _hits(found.where(everywhere).withColumn("score", S.lexeme_rank(F.col("title_lex"), F.col("body_lex"), query)))
    best = [scored.where(F.col("source") == s).orderBy(F.desc("score"), "id").limit(n) for s in ("chunk", "segment")]
    return _ranked(reduce(DataFrame.unionByName, best).orderBy(F.desc("score"), "source_ord", "id").limit(n), F.desc("score"), F.col("source_ord"), F.col("id"))


def trigram(items: DataFrame, docs: DataFrame, terms: Sequence[str], n: int, threshold: float = 0.3) -> DataFrame:
    """CP4, FN45: items alike or containing a term; the best score over at most five terms (AG14)."""
    if not terms:
        return _ranked(_hits(items.join(docs, "document_id").withColumn("score", F.lit(0.0))).limit(0), F.col("id"))

    def best(grams: Column) -> Column:
        scores = []
        for term in terms[:5]:
            share = S.shared_share(grams, term)
            scores.append(F.when((share >= threshold) | F.lower("text").contains(term.lower()), share))
        return F.greatest(*scores) if len(scores) > 1 else scores[0]

    # The trigrams of a text are a variable of the lambda, and the score is exploded: each is computed once.
    score = F.filter(F.transform(F.array(S.trigrams(F.col("text"))), best), lambda x: x.isNotNull())
    found = _hits(items.withColumn("score", F.explode(score)).join(docs, "document_id"))
    return _ranked(found.orderBy(F.desc("score"), "source_ord", "id").limit(n), F.desc("score"), F.col("source_ord"), F.col("id"))


def backfill(items: DataFrame, docs: DataFrame, terms: Sequence[str], newest: int = 8, rows: int = 30, score: float = 0.2) -> DataFrame:
    """CP5: items of the newest documents that contain a term, chunks first, newest first (SO4, WN3)."""
    latest = docs.orderBy(F.desc_nulls_first("meeting_date"), "document_id").limit(newest)
    wanted = [F.lower("text").contains(v) for t in terms[:4] for v in dict.fromkeys((t.lower(), t.lower().replace("ß", "ss")))]
    hit = reduce(lambda a, b: a | b, wanted) if wanted else F.lit(False)
    found = _hits(items.where(hit).join(F.broadcast(latest), "document_id").withColumn("score", F.lit(score)))
    order = (F.desc_nulls_first("meeting_date"), F.asc_nulls_last("start_page"), F.col("id"))
    best = [found.where(F.col("source") == s).orderBy(*order).limit(rows) for s in ("chunk", "segment")]
    return _ranked(reduce(DataFrame.unionByName, best), F.col("source_ord"), *order)


def structured(attendance: DataFrame, docs: DataFrame, factions: Sequence[str] = (), person: str | None = None, year: int | None = None, n: int = 20) -> DataFrame:
    """CP6: attendance rows of a faction (any alias), a person or a year, newest first (SO5)."""
    rows = attendance.withColumn("faction", F.coalesce("faction_curated", "faction_extracted")).withColumn("person", F.coalesce("last_name_curated", "last_name_extracted"))
    if factions:
        rows = rows.where(reduce(lambda a, b: a | b, [F.lower("faction").contains(f.lower()) for f in factions]))
    if person:
        rows = rows.where(F.lower("person").contains(person.lower()))
    joined = rows.join(docs, "document_id")
    if year:
        joined = joined.where(F.year("meeting_date") == year)
    name = F.concat_ws(" ", F.nullif("salutation", F.lit("")), "person")
    line = F.concat(name, F.lit(" ("), F.coalesce("faction", F.lit("keine Fraktion")), F.lit(") – Sitzung vom "), F.coalesce(F.col("meeting_date").cast("string"), F.lit("?")))
    found = joined.select("id", "document_id", "person", "faction", F.col("role_extracted").alias("role"), "meeting_date", "gremium_key", line.alias("text"))
    return found.orderBy(F.desc_nulls_first("meeting_date"), "id").limit(n)


def fuse(lists: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """AG15: reciprocal rank fusion; what a hit carries comes from the last list that has it."""
    parts = [df.select(*HIT, (F.lit(1.0) / (k + F.col("rank"))).alias("part"), F.lit(i).alias("list")) for i, (df, k) in enumerate(lists)]
    both = reduce(DataFrame.unionByName, parts)
    carried = [c for c in HIT if c not in ("source", "id")]
    merged = both.groupBy("source", "id").agg(F.sum("part").alias("rrf_score"), F.max_by(F.struct(*carried), "list").alias("m"))
    return merged.select("source", "id", "rrf_score", *[F.col(f"m.{c}").alias(c) for c in carried])


def add_list(fused: DataFrame, extra: DataFrame, k: int) -> DataFrame:
    """AG16: one more list on top of fused hits; hits it brings are marked."""
    carried = [c for c in HIT if c not in ("source", "id")]
    a = fused.select(*HIT, F.col("rrf_score").alias("part"), F.lit(0).alias("list"))
    b = extra.select(*HIT, (F.lit(1.0) / (k + F.col("rank"))).alias("part"), F.lit(1).alias("list"))
    merged = a.unionByName(b).groupBy("source", "id").agg(F.sum("part").alias("rrf_score"), F.max("list").alias("x"), F.max_by(F.struct(*carried), "list").alias("m"))
    return merged.select("source", "id", "rrf_score", (F.col("x") == 1).alias("is_backfill"), *[F.col(f"m.{c}").alias(c) for c in carried])


def boost(hits: DataFrame, query: Query, top_key: str | None = None, iso_date: str | None = None, current: bool = False, multi_doc: bool = False, structured_docs: DataFrame | None = None) -> DataFrame:
    """FN42, CP7: final score of a hit: fusion plus key, date, source, recency and attendance."""
    p = query.profile
    score = F.col("rrf_score") + F.when(F.col("source") == "segment", 0.08).otherwise(0.0)
    if top_key:
        score = score + F.when(F.col("top_key") == top_key, 0.05).otherwise(0.0)
    if iso_date:
        score = score + F.when(F.col("meeting_date").cast("string") == iso_date, 0.05).otherwise(0.0)
    if not multi_doc:
        score = score + T.linear_recency(F.col("meeting_date"), query.as_of) * (p.recency * (p.current if current else 1.0))
    if structured_docs is not None:
        marked = structured_docs.select("document_id").distinct().withColumn("named", F.lit(True))
        hits = hits.join(F.broadcast(marked), "document_id", "left")
        score = score + F.when(F.coalesce("named", F.lit(False)), 0.08).otherwise(0.0)
    return hits.withColumn("final_score", score)


def prefer_segments(hits: DataFrame, within: float = 0.10) -> DataFrame:
    """WN4: of the best chunk and best segment of a document and key one stays; the segment if it is close.

    Hits without a key stay as they are.
    """
    best = Window.partitionBy("document_id", "top_key", "source").orderBy(F.desc("final_score"), "id")
    pair = Window.partitionBy("document_id", "top_key")
    keyed = hits.where("top_key is not null").withColumn("n", F.row_number().over(best)).where("n = 1")
    keyed = keyed.withColumn("chunk", F.max(F.when(F.col("source") == "chunk", F.col("final_score"))).over(pair)).withColumn("segment", F.max(F.when(F.col("source") == "segment", F.col("final_score"))).over(pair))
    segment_wins = F.col("segment").isNotNull() & (F.col("chunk").isNull() | (F.col("chunk") <= 0) | ((F.col("chunk") - F.col("segment")) / F.col("chunk") < within))
    kept = keyed.where(F.when(F.col("source") == "segment", segment_wins).otherwise(~segment_wins)).drop("n", "chunk", "segment")
    return kept.unionByName(hits.where("top_key is null"))


def cap_documents(hits: DataFrame, cap: int) -> DataFrame:
    """WN5: at most ``cap`` keys a document, the best ones; hits without a key are free."""
    order = Window.partitionBy("document_id").orderBy(F.desc("final_score"), "source", "id")
    keyed = hits.where("top_key is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")
    return keyed.unionByName(hits.where("top_key is null"))


def focus(hits: DataFrame, attendance_first: bool, gremium_key: str | None, multi_doc: bool) -> DataFrame:
    """CP9: hits of one body, where the first hit is an attendance row of it."""
    return hits.where(F.col("gremium_key") == gremium_key) if attendance_first and gremium_key and not multi_doc else hits


def ambiguity(found: DataFrame, names: DataFrame) -> DataFrame:
    """CP8, AG17: the bodies that attendance hits come from, if there are several: options to ask back."""
    bodies = found.select("gremium_key").distinct().join(F.broadcast(names.select("gremium_key", "gremium_name").distinct()), "gremium_key")
    return bodies.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0)))).where("n > 1").select("gremium_key", "gremium_name")


def enrich(hits: DataFrame, agenda: DataFrame, attendance: DataFrame) -> DataFrame:
    """JN5, AG18: agenda and attendance of the hits' documents, as ordered lists."""
    hits = cut(hits)  # a handful of rows, read three times
    ids = F.broadcast(hits.select("document_id").distinct())
    tops = agenda.join(ids, "document_id", "left_semi").groupBy("document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_index", "id", "top_key_curated", "title_curated", "drucksache_curated"))), lambda x: F.struct(x["top_key_curated"].alias("key"), x["title_curated"].alias("title"), x["drucksache_curated"].alias("paper"))).alias("agenda_full"))
    people = attendance.join(ids, "document_id", "left_semi").groupBy("document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_index", "id", "last_name_extracted", "faction_extracted", "role_extracted"))), lambda x: F.struct(x["last_name_extracted"].alias("name"), x["faction_extracted"].alias("faction"), x["role_extracted"].alias("role"))).alias("attendance_full"))
    return hits.join(tops, "document_id", "left").join(people, "document_id", "left")


def channels(query: Query, docs: DataFrame, segments: DataFrame, agenda: DataFrame, chunks: DataFrame | None, lexemes: Sequence[str | Sequence[str]], current: bool, multi_doc: bool, topic: bool = False) -> DataFrame:
    """Fused hits of all channels that the question has terms for."""
    items = segment_items(segments)
    if chunks is not None:
        items = chunk_items(chunks).unionByName(items)
    n = candidates(query)
    lists = [(df, RRF["dense"] if i == 0 else RRF["paraphrase"]) for i, df in enumerate(dense_all(items, docs, query.vectors, n))]
    if lexemes:
        lists.append((sparse(items, agenda, docs, lexemes, n), RRF["sparse"]))
    if query.terms:
        lists.append((trigram(items, docs, query.terms, n), RRF["trigram"]))
    hits = fuse(lists).withColumn("is_backfill", F.lit(False))
    if (current or topic) and query.terms and not multi_doc:
        hits = add_list(hits, backfill(items, docs, query.terms), RRF["backfill"])
    return hits


def best_hits(hits: DataFrame, query: Query) -> DataFrame:
    """WN4, WN5: preference, caps and the best ``top_k``."""
    hits = cap_documents(prefer_segments(hits), query.profile.cap)
    best = hits.orderBy(F.desc("final_score"), "source", "id").limit(query.top_k)
    # Attendance rows come first, whatever their score.
    return best.orderBy(F.desc(F.col("source") == "attendance"), F.desc("final_score"), "source", "id").select("source", "id", "document_id", "top_key", "gremium_key", "meeting_date", F.round("rrf_score", 9).alias("rrf_score"), F.round("final_score", 9).alias("final_score"), "is_backfill")


def retrieve(query: Query, segments: DataFrame, documents: DataFrame, agenda: DataFrame, attendance: DataFrame | None = None, chunks: DataFrame | None = None, lexemes: Sequence[str] = (), current: bool = False, top_key: str | None = None, iso_date: str | None = None, multi_doc: bool = False) -> DataFrame:
    """CP10 without CP7 to CP9 (see ``search``): channels and fusion as one plan, then caps; at most ``top_k`` rows, best first.

    Channels that the question has no terms for are left out. Backfill is added for
    questions about the present.
    """
    docs = filtered_documents(documents, query)
    hits = channels(query, docs, segments, agenda, chunks, lexemes, current, multi_doc)
    found = structured(attendance, docs, person=query.terms[0]) if attendance is not None and query.terms else None
    # The fused hits (some hundreds) are read several times by preference and caps.
    hits = cut(boost(hits, query, top_key, iso_date, current, multi_doc, found))
    return best_hits(hits, query)


def merge_structured(hits: DataFrame, found: DataFrame, attendance_question: bool) -> DataFrame:
    """CP7: attendance rows beside fused hits: in front at 1.0 for attendance questions; else at 0.10, and 0.08 for hits of their documents."""
    rows = found.select(F.lit("attendance").alias("source"), "id", "document_id", "gremium_key", "meeting_date", F.lit(1.0 if attendance_question else 0.10).alias("rrf_score"), F.lit(False).alias("is_backfill"))
    if not attendance_question:
        marked = F.broadcast(found.select("document_id").distinct().withColumn("named", F.lit(True)))
        hits = hits.join(marked, "document_id", "left").withColumn("rrf_score", F.col("rrf_score") + F.when(F.col("named"), 0.08).otherwise(0.0)).drop("named")
    return hits.unionByName(rows, allowMissingColumns=True)


def search(query: Query, segments: DataFrame, documents: DataFrame, agenda: DataFrame, attendance: DataFrame, chunks: DataFrame | None = None, lexemes: Sequence[str] = (), current: bool = False, top_key: str | None = None, iso_date: str | None = None, multi_doc: bool = False, factions: Sequence[str] = (), person: str | None = None, attendance_question: bool = False, topic: bool = False, year: int | None = None) -> DataFrame:
    """CP7 to CP10: ``retrieve`` with attendance rows among the hits.

    For an attendance question, rows of several bodies give a single row instead of hits,
    whose ``clarify`` lists the bodies; else hits of the first attendance row's body stay.
    Attendance rows have no key and are free of caps. Without person and factions
    there are no attendance rows.
    """
    docs = filtered_documents(documents, query)
    hits = channels(query, docs, segments, agenda, chunks, lexemes, current, multi_doc, topic)
    if person or factions:
        # At most 20 rows.
        found = cut(structured(attendance, docs, factions, person, year))
        if attendance_question:
            bodies = docs.where("gremium_key is not null").groupBy("gremium_key").agg(F.coalesce(F.max("gremium_name"), F.lit("unbekannt")).alias("gremium_name"))
            options = sorted(r["gremium_name"] for r in ambiguity(found, bodies).collect())
            if options:
                shape = best_hits(boost(merge_structured(hits, found, True), query), query).withColumn("clarify", F.lit("")).schema
                return found.sparkSession.createDataFrame([("clarify", *[None] * (len(shape) - 2), "; ".join(options))], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape))
        hits = merge_structured(hits, found, attendance_question)
    hits = cut(boost(hits, query, top_key, iso_date, current, multi_doc))
    if attendance_question and (top := hits.orderBy(F.desc("final_score"), "source", "id").select("source", "gremium_key").first()):
        hits = focus(hits, top["source"] == "attendance", top["gremium_key"], multi_doc)
    return best_hits(hits, query).withColumn("clarify", F.lit(None).cast("string"))


def ask(
    query: Query, segments: DataFrame, documents: DataFrame, agenda: DataFrame, attendance: DataFrame, chunks: DataFrame | None = None,
    aliases: Mapping[str, Sequence[str]] = T.FACTION_ALIASES, synonyms: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """CP10 from the bare question: all that ``search`` needs is taken from its text.

    ``query`` gives text, vectors (of the question and its paraphrases), filters and
    mode. Signals, recency, topics, faction and person come from ``said_of``; terms of
    ``synonyms`` found in the question widen full text (any variant) and trigrams.
    Attendance is looked up where the question asks for a person's place or a faction;
    it leads where the question is about attendance and not about what was said.
    """
    said = said_of(segments.sparkSession, query.text, aliases)
    known = {t.lower(): tuple(v.lower() for v in vs) for t, vs in (synonyms or {}).items() if t.lower() in query.text.lower()}
    variants = [v for vs in known.values() for v in vs]
    stems = {r["x"]: list(r["lex"]) for r in segments.sparkSession.createDataFrame([(x,) for x in (*known, *variants)] or [("",)], "x string").select("x", S.lexemes(F.col("x")).alias("lex")).collect()}
    also = {lex: [y for v in vs for y in stems[v][:1]] for t, vs in known.items() for lex in stems[t][:1]}
    lexemes = [(x, *also[x]) if also.get(x) else x for x in dict.fromkeys(said["lexemes"])]
    terms = tuple(dict.fromkeys([*(p.lower() for p in said["places"]), *said["terms"], *variants]))
    flags, signals = said["flags"], said["signals"]
    wanted = flags["metadata"] or said["faction"] is not None
    year = re.search(r"\b(20\d{2}|199\d)\b", query.text)
    return search(
        replace(query, terms=terms), segments, documents, agenda, attendance, chunks, lexemes, current=flags["recency"], top_key=signals["top_key"], iso_date=signals["iso_date"], multi_doc=signals["multi_doc"],
        factions=tuple(aliases[said["faction"]]) if wanted and said["faction"] else (), person=said["person"] if wanted else None,
        attendance_question=bool(flags["attendance"] and not flags["statement"]), topic=bool(said["places"] or variants), year=int(year[0]) if year and wanted else None,
    )


def dedupe_sources(hits: DataFrame, faithful: bool = False) -> DataFrame:
    """WN6: the first of the hits that cite one place; ``faithful`` takes equal dates and keys of two bodies for one."""
    keys = ["meeting_date", "top_key"] if faithful else ["document_id", "meeting_date", "top_key"]
    return hits.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where("n = 1").drop("n")
