"""Problem 10: languages of texts and passages by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LANGUAGES = ("de", "en", "fr", "nl", "tr")
BUCKETS = 1 << 16
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A sentence ends at a mark with white space behind it, at a blank line or a line break after a mark.
SENTENCE = re.compile(r"(?<=[.!?])[\"'“”»)\]]*\s+|\n\s*\n")
#: Names of languages as people type them (fixed values); ISO 639-1 codes stand for themselves.
NAMES = {
    "de": ("ger", "deu", "german", "deutsch", "allemand", "duits", "almanca"),
    "en": ("eng", "english", "englisch", "anglais", "engels", "ingilizce"),
    "fr": ("fre", "fra", "french", "französisch", "franzoesisch", "français", "francais", "frans", "fransızca"),
    "nl": ("dut", "nld", "dutch", "niederländisch", "niederlaendisch", "néerlandais", "neerlandais", "nederlands", "hollandaca", "flemish"),
    "tr": ("tur", "turkish", "türkisch", "tuerkisch", "turc", "turks", "türkçe", "turkce"),
    "es": ("spa", "spanish", "spanisch", "español"), "it": ("ita", "italian", "italienisch", "italiano"),
    "da": ("dan", "danish", "dänisch"), "pl": ("pol", "polish", "polnisch"), "pt": ("por", "portuguese"), "sv": ("swe", "swedish"),
    "ru": ("rus", "russian", "russisch"), "ar": ("ara", "arabic", "arabisch"), "cs": ("cze", "ces", "czech"), "ro": ("rum", "ron", "romanian"),
}
#: ISO 639-1 codes (fixed values).
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj "
    "fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb "
    "lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd "
    "se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()


def label_language(label: Column) -> Column:
    """The ISO 639-1 code that a label names, null where it names none.

    Case, blanks and regions don't count: ``de-DE``, ``de_DE``, ``DE`` and ``Deutsch`` are ``de``.
    """
    names = {n: code for code, all_names in NAMES.items() for n in all_names} | {c: c for c in CODES}
    base = F.regexp_extract(F.trim(F.lower(label)), r"^(\p{L}+)(?:[-_.].*)?$", 1)
    return F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])[base]


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: itself, affixes, letter n-grams."""
    marked = f"^{word}$"
    names = {f"w{word}", "bias"}
    names |= {f"p{word[:n]}" for n in (2, 3)} | {f"s{word[-n:]}" for n in (1, 2, 3, 4)}
    names |= {f"g{marked[i : i + n]}" for n in (2, 3, 4) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


@dataclass
class Tagger:
    """Weights of the field; ``scores`` caches the words seen by one Python worker."""

    weights: np.ndarray
    transitions: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "transitions": self.transitions, "cache": {}, "table": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores, one row a word."""
        if self.table is None or len(self.cache) > 400_000:  # the cache is bounded; a word dropped here is scored again
            self.cache, self.table = {}, np.empty((0, self.weights.shape[1]), np.float32)
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if new:
            self.cache.update((w, i) for i, w in enumerate(new, len(self.cache)))
            self.table = np.concatenate([self.table, np.array([self.weights[features(w)].sum(0) for w in new], np.float32)])
        return self.table[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]

    def marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Posterior of every word's language, by forward-backward over each sequence."""
        out: list[np.ndarray] = [np.empty((0, self.weights.shape[1]), np.float32)] * len(scores)
        order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            # Sequences of like length side by side, as many as fit into a bounded block.
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(scores[order[end]]) <= 200_000:
                end += 1
            part, at = order[at:end], end
            lengths = np.array([len(scores[i]) for i in part])
            padded = np.zeros((len(part), lengths.max(), self.weights.shape[1]), np.float32)
            for row, i in enumerate(part):
                padded[row, : lengths[row]] = scores[i]
            for row, m in enumerate(forward_backward(padded, lengths, self.transitions)[0]):
                out[part[row]] = m[: lengths[row]]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequence, place, label) of padded sequences, with ``pairs`` also the expected transitions."""
    n, steps, k = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    t = np.exp(transitions).astype(scores.dtype)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    ones = np.ones((k, 1), e.dtype)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, steps):
        a = alpha[:, i - 1] @ t
        a *= e[:, i]
        np.divide(a, a @ ones, out=alpha[:, i])
    for i in range(steps - 2, -1, -1):
        # Sequences stand in the order of their length or not: those that have ended keep their ones.
        b = (beta[:, i + 1] * e[:, i + 1]) @ t.T
        np.divide(b, b @ ones, out=beta[:, i], where=(i + 1 < lengths)[:, None])
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    expected = np.zeros((k, k))
    for i in range(1, steps if pairs else 0):
        pair = alpha[:, i - 1, :, None] * t * (e[:, i] * beta[:, i])[:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        expected += pair[i < lengths].sum(0)
    return m, expected


def train(texts: Iterable[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES, epochs: int = 4, seed: int = 3) -> Tagger:
    """Fit the field to labelled texts by stochastic gradient ascent on the likelihood.

    Training sequences are sentences of the sample put together at random, so that
    the language changes between some of them: that is where the transitions learn.
    Texts whose fitted language isn't their label are left out of a second fit, as
    labels are wrong in places.
    """
    data = [(languages.index(lang), [w.lower() for w in WORD.findall(s)]) for lang, text in texts if lang in languages for s in SENTENCE.split(text)]
    data = [(k, ws) for k, ws in data if len(ws) >= 2]
    tagger = Tagger(np.zeros((BUCKETS, len(languages)), np.float32), np.zeros((len(languages), len(languages))))
    for round_ in range(2):
        tagger = _fit(data, len(languages), epochs, seed + round_)
        means = [m.mean(0) for m in tagger.marginals([tagger.scores(ws) for _, ws in data])]
        data = [(k, ws) for (k, ws), m in zip(data, means, strict=True) if m.argmax() == k]
    return tagger


def sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows at each of ``n`` places, added up one by one."""
    return np.stack([np.bincount(at, column, n) for column in rows.T], axis=1)


def _fit(data: list[tuple[int, list[str]]], k: int, epochs: int, seed: int) -> Tagger:
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    rows = [(lang, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws])) for lang, ws in data]
    lists = [features(w) for w in vocabulary]
    flat, counts = np.fromiter((f for x in lists for f in x), np.int64), np.array([len(x) for x in lists], np.int64)
    begin = np.cumsum(counts) - counts
    share = np.bincount([lang for lang, _ in rows], minlength=k).astype(float)
    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    square_w, square_t = np.full((BUCKETS, k), 1e-3), np.full((k, k), 1e-3)
    if not rows or share.max() == 0:
        return Tagger(weights.astype(np.float32), transitions)
    keep = np.minimum(1.0, 3 * np.median(share[share > 0]) / np.maximum(share, 1))
    for _ in range(epochs):
        order = [i for i in rng.permutation(len(rows)) if rng.random() < keep[rows[i][0]]]
        groups = [order[i : i + 3] for i in range(0, len(order), 3)]
        # Most neighbours share a language, as in real texts.
        groups.sort(key=lambda g: sum(len(rows[i][1]) for i in g))
        starts = rng.permutation(range(0, len(groups), 128))
        for at in starts:
            part = groups[at : at + 128]
            for j, g in enumerate(part):
                if j % 3:
                    part[j] = [i for i in g if rows[i][0] == rows[g[0]][0]]
            seqs = [np.concatenate([rows[i][1] for i in g]) for g in part]
            gold = [np.concatenate([np.full(len(rows[i][1]), rows[i][0]) for i in g]) for g in part]
            lengths = np.array([len(s) for s in seqs])
            ids = np.unique(np.concatenate(seqs))
            local = np.repeat(np.arange(len(ids)), counts[ids])
            sel = np.arange(len(local)) + (begin[ids] - np.cumsum(counts[ids]) + counts[ids])[local]
            emission = sums(local, weights[flat[sel]], len(ids))
            scores, truth, mask = np.zeros((len(seqs), lengths.max(), k)), np.zeros((len(seqs), lengths.max()), np.int64), np.zeros((len(seqs), lengths.max()), bool)
            places = np.zeros((len(seqs), lengths.max()), np.int64)
            for r, (s, g) in enumerate(zip(seqs, gold, strict=True)):
                places[r, : len(s)], truth[r, : len(s)], mask[r, : len(s)] = np.searchsorted(ids, s), g, True
            scores[mask] = emission[places[mask]]
            m, expected = forward_backward(scores, lengths, transitions, pairs=True)
            grad = -m[mask]
            grad[np.arange(len(grad)), truth[mask]] += 1
            by_type = sums(places[mask], grad, len(ids))
            touched, bucket = np.unique(flat[sel], return_inverse=True)
            d = sums(bucket, by_type[local], len(touched)) - 1e-2 * weights[touched]
            square_w[touched] += d * d
            weights[touched] += 0.15 * d / np.sqrt(square_w[touched])
            observed = np.zeros((k, k))
            both = mask[:, 1:]
            np.add.at(observed, (truth[:, :-1][both], truth[:, 1:][both]), 1)
            dt = observed - expected - 1e-2 * transitions
            square_t += dt * dt
            transitions += 0.1 * dt / np.sqrt(square_t)
    return Tagger(weights.astype(np.float32), transitions)


def train_on(df: DataFrame, text_col: str = "text", label_col: str = "lang", rows_per_language: int = 400, languages: tuple[str, ...] = LANGUAGES) -> Tagger:
    """A tagger fit on at most ``rows_per_language`` labelled texts a language of 40 to 6,000 characters.

    Texts are picked by hash: a first pass estimates how many distinct ones each
    language has, a second keeps those with a hash below the share that is needed,
    where they lie. Only about twice the sample is shuffled; copies count once.
    """
    labelled = df.select(F.col(text_col).alias("text"), label_language(F.col(label_col)).alias("lang")).where(F.col("lang").isin(*languages) & F.length("text").between(40, 6000)).withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return train([], languages)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2.0 * rows_per_language / max(1, n)))])
    drawn = labelled.where(F.col("h") / F.lit(2.0**64) + 0.5 <= share[F.col("lang")]).dropDuplicates(["lang", "h"])
    few = drawn.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rn") <= rows_per_language)
    return train([(r["lang"], r["text"]) for r in few.orderBy("lang", "h").select("lang", "text").collect()], languages)


def analyse(tagger: Tagger, texts: list[str], languages: tuple[str, ...], min_words: int = 4, sure: float = 0.5) -> list[tuple]:
    """For each text: letters, language, confidence, sentences by language, passages."""
    spans, words, cuts = [], [], []
    for text in texts:
        edges, at = [], 0
        for m in SENTENCE.finditer(text):
            edges.append((at, m.end()))
            at = m.end()
        edges.append((at, len(text)))
        own, counts = [], []
        for a, b in edges:
            found = WORD.findall(text[a:b].lower())
            own += found
            counts.append(len(found))
        spans.append(edges)
        words.append(own)
        cuts.append(counts)
    flat = tagger.scores([w for own in words for w in own])
    ends = np.cumsum([len(w) for w in words])
    marginals = tagger.marginals([flat[e - len(w) : e] for e, w in zip(ends, words, strict=True)])
    out = []
    for edges, own, counts, m in zip(spans, words, cuts, marginals, strict=True):
        size = np.fromiter(map(len, own), np.float64, len(own))
        letters = int(size.sum())
        if not own:
            out.append((0, None, 0.0, {}, []))
            continue
        weighted = m * size[:, None]
        mean = weighted.sum(0) / letters
        full = [i for i, n in enumerate(counts) if n]
        starts = np.cumsum([0, *(counts[i] for i in full[:-1])])
        weight = np.add.reduceat(size, starts)
        share = np.add.reduceat(weighted, starts) / weight[:, None]
        at, sentences, passages = -1, {}, []
        bests, sures = share.argmax(1).tolist(), share.max(1).tolist()
        for (a, b), n in zip(edges, counts, strict=True):
            if not n:
                if passages:
                    passages[-1] = (passages[-1][0], b, *passages[-1][2:])
                continue
            at += 1
            lang, p, w = languages[bests[at]], sures[at], float(weight[at])
            if n >= min_words and p >= sure:
                sentences[lang] = sentences.get(lang, 0) + 1
            if passages and passages[-1][2] == lang:
                last = passages[-1]
                passages[-1] = (last[0], b, lang, (last[3] * last[4] + p * w) / (last[4] + w), last[4] + w)
            else:
                passages.append((a if passages else 0, b, lang, p, w))
        lang = int(mean.argmax())
        out.append((letters, languages[lang], float(mean[lang]), sentences, passages))
    return out


def detect(df: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = "lang", languages: tuple[str, ...] = LANGUAGES, min_letters: int = 40, min_sentences: int = 4) -> DataFrame:
    """Language of every text, and of every passage of a mixed one, with confidences.

    Returns ``id, label_lang, lang, confidence, letters, langs, kind, passages``.
    ``label_lang`` is the code that the given label names; ``langs`` the languages with
    at least ``min_sentences`` sentences, most first; ``kind`` is ``mixed`` (two or more
    in ``langs``), else ``missing`` (label names no language), ``wrong`` (another one),
    ``right``, or null for texts under ``min_letters`` letters, which aren't judged.
    ``passages`` is an array of (start_char, end_char, lang, confidence). Null texts, and
    texts without letters, have no language and confidence 0. Rows stay as they are:
    repeated ids and texts give one row each. One pass, no shuffle.
    """
    def tag(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 2048):
                b = p.iloc[at : at + 2048]
                rows = []
                for letters, lang, confidence, sentences, passages in analyse(tagger, b["text"].fillna("").tolist(), languages):
                    langs = sorted((s for s, n in sentences.items() if n >= min_sentences), key=lambda s: (-sentences[s], s))
                    rows.append((lang, confidence, letters, langs, [x[:4] for x in passages]))
                out = pd.DataFrame(rows, columns=["lang", "confidence", "letters", "langs", "passages"])
                yield pd.concat([b[["id", "label_lang"]].reset_index(drop=True), out], axis=1)

    label = label_language(F.col(label_col)) if label_col else F.lit(None).cast("string")
    kind = (
        F.when((F.col("letters") < min_letters) | F.col("lang").isNull(), F.lit(None).cast("string"))
        .when(F.size("langs") >= 2, "mixed").when(F.col("label_lang").isNull(), "missing").when(F.col("label_lang") != F.col("lang"), "wrong").otherwise("right")
    )
    schema = f"id {df.schema[id_col].dataType.simpleString()}, label_lang string, lang string, confidence double, letters int, langs array<string>, passages array<struct<start_char:int,end_char:int,lang:string,confidence:double>>"
    rows = df.select(F.col(id_col).alias("id"), label.alias("label_lang"), F.col(text_col).alias("text"))
    return rows.mapInPandas(tag, schema).withColumn("kind", kind)
