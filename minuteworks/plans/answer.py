"""The edge: gate, follow-ups, synonyms, context and answers around a retrieval plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from minuteworks.functions import text as T
from minuteworks.operators.relational import last_n, latest
from minuteworks.providers import Chat, Extractive

#: FN55: tokens of an answer by length (fixed values).
BUDGET = {"short": 800, "normal": 3000, "detailed": 4000}


def clamp(top_k: int = 10, mode: str = "relevant", length: str = "normal", year_from: int | None = None, year_to: int | None = None) -> dict:
    """FN54: parameters within their bounds: 3 to 20 hits, known modes and lengths, years 2000 to 2035."""
    year = lambda y: None if y is None else min(2035, max(2000, y))
    return {"top_k": min(20, max(3, top_k)), "mode": mode if mode in ("relevant", "recent", "breadth") else "relevant", "length": length if length in BUDGET else "normal", "year_from": year(year_from), "year_to": year(year_to)}


def gate(requests: DataFrame, text_col: str = "query", longest: int = 2000) -> DataFrame:
    """Requests with ``verdict``: blocked (injection), clarify (nonsense), too_long or pass."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    return requests.withColumn("verdict", F.when(F.length(c) > longest, "too_long").when(T.injection(c), "blocked").when(T.nonsense(c), "clarify").otherwise("pass"))


def history(turns: DataFrame, n: int = 12) -> DataFrame:
    """WN12: the last ``n`` messages of each session (session_id, turn, role, content)."""
    return last_n(turns, "session_id", "turn", n)


def expand(query: str, synonyms: Mapping[str, Sequence[str]]) -> str:
    """FN47: the first occurrence of each term as a group of alternatives."""
    for term, variants in synonyms.items():
        at = query.lower().find(term.lower())
        if at >= 0 and variants:
            query = f"{query[:at]}({query[at:at + len(term)]} OR {' OR '.join(variants)}){query[at + len(term):]}"
    return query


def paraphrases(query: str, synonyms: Mapping[str, Sequence[str]], most: int = 2) -> list[str]:
    """FN48: the i-th variant in place of every term, distinct, at most ``most``."""
    out: list[str] = []
    for i in range(max((len(v) for v in synonyms.values()), default=0)):
        text = query
        for term, variants in synonyms.items():
            if i < len(variants) and (at := text.lower().find(term.lower())) >= 0:
                text = text[:at] + variants[i] + text[at + len(term) :]
        if text != query and text not in out:
            out.append(text)
    return out[:most]


def update_synonyms(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """CP23: generated synonyms (term, variants, source, updated_at) on top of a cache; manual ones stay as they are."""
    manual = cache.where("source = 'manual'")
    rest = cache.where("source <> 'manual'").unionByName(fresh.join(manual.select("term"), "term", "left_anti").select(*cache.columns))
    return manual.unionByName(latest(rest, ["term"], "updated_at"))


def context(hits: DataFrame, most_items: int = 25) -> DataFrame:
    """FN53: one text a hit, with its document's header and agenda on the document's first hit only."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("document_id").orderBy("rank")) == 1
    tops = F.transform(F.slice("agenda_full", 1, most_items), lambda x: F.concat_ws(" ", F.lit("TOP"), x["key"], x["title"]))
    more = F.when(F.size("agenda_full") > most_items, F.concat(F.lit("\n(+"), (F.size("agenda_full") - most_items).cast("string"), F.lit(")"))).otherwise("")
    header = F.concat(F.lit("## "), F.coalesce("gremium_key", F.lit("")), F.lit(", "), F.coalesce(F.col("meeting_date").cast("string"), F.lit("ohne Datum")), F.lit("\n"), F.coalesce(F.array_join(tops, "\n"), F.lit("")), F.coalesce(more, F.lit("")), F.lit("\n"))
    return hits.withColumn("context", F.concat(F.when(first, header).otherwise(""), F.lit("[TOP "), F.coalesce("top_key", F.lit("-")), F.lit("] "), F.coalesce("text", F.lit(""))))


def answer(question: str, contexts: Sequence[str], length: str = "normal", chat: Chat | None = None) -> str:
    """CP29: the answer of a chat service to a question and its context."""
    return (chat or Extractive()).complete("Antworte nur aus dem Kontext.", "\n---\n".join(contexts) + f"\n\nFrage: {question}", BUDGET.get(length, BUDGET["normal"]))


def condense(question: str, turns: Sequence[tuple[str, str]], chat: Chat | None = None) -> str:
    """CP29: a follow-up as a question of its own, by the chat service; others, and those without history, as they are.

    ``turns`` are (role, content), the last twelve count (WN12). An empty reply of the
    service leaves the question.
    """
    if not turns:
        return question
    one = SparkSession.active().createDataFrame([(question,)], "q string")
    if not one.select(T.follow_up(F.col("q"))).first()[0]:
        return question
    told = "\n".join(f"{role}: {content}" for role, content in turns[-12:])
    return (chat or Extractive()).complete("Formuliere die letzte Frage so, dass sie ohne den Verlauf verständlich ist.", f"{question}\n\nVerlauf:\n{told}", 200).strip() or question


def converse(question: str, turns: Sequence[tuple[str, str]], retrieve: Callable[[str], DataFrame], length: str = "normal", chat: Chat | None = None) -> dict:
    """CP29: gate, condense, retrieve, context, answer: ``verdict, question, clarify, answer, sources``.

    ``retrieve`` gives the enriched hits of a question with ``rank`` and ``text`` (at most
    its ``top_k`` rows), or one row whose ``clarify`` asks back.
    """
    one = SparkSession.active().createDataFrame([(question,)], "query string")
    verdict = gate(one).first()["verdict"]
    reply = {"verdict": verdict, "question": question, "clarify": None, "answer": None, "sources": []}
    if verdict != "pass":
        return reply
    reply["question"] = condense(question, turns, chat)
    hits = retrieve(reply["question"])
    if "clarify" in hits.columns and (asked := hits.where("clarify is not null").select("clarify").first()):
        return reply | {"verdict": "clarify", "clarify": asked["clarify"]}
    rows = context(hits).orderBy("rank").select("source", "id", "context").collect()
    if not rows:
        return reply | {"verdict": "no_hits"}
    return reply | {"answer": answer(reply["question"], [r["context"] for r in rows], length, chat), "sources": [(r["source"], r["id"]) for r in rows]}


def answer_events(question: str, contexts: Sequence[str], length: str = "normal", chat: Chat | None = None) -> Iterator[dict]:
    """CP30, SS5: status, tokens and end of an answer, one event a line."""
    yield {"type": "status", "message": "searching"}
    if not contexts:
        yield {"type": "clarify", "message": "no hits"}
        return
    for token in answer(question, contexts, length, chat).split(" "):
        yield {"type": "token", "text": token + " "}
    yield {"type": "done"}
