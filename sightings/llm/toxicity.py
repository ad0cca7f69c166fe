"""Operator 7: toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, the field needs them of tokens.  A word, or a word's beginning, is taken as toxic in toxic
documents where it is many times as frequent there as in clean ones and stands between different neighbours (so
that copies of one document prove nothing); words are added until the toxic documents are covered as far as such
words go.  The field has two tags; a token's features are its word, beginnings, ending and neighbours.  It is
trained by gradient ascent on its likelihood, and runs over every sentence of the whole text by forward-backward.
A document's score is its largest marginal; its spans are the runs of tokens whose marginal is a half or more.

Training takes a bounded sample of labelled rows (``TOXIC`` and ``CLEAN``); scoring is a column without a shuffle.

Defined cases: null and empty texts, and texts without words, score 0; so does everything if no row is labelled
toxic or none is labelled clean.  A document labelled both ways counts as toxic.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.chunk_tokens import Memo, slices
from sightings.llm.common import documents, frames, held_out, plain_texts, unused

# Labelled documents that the field is fitted on, at most, and the characters of each.
TOXIC, CLEAN, SAMPLE_CHARS = 1000, 4000, 20_000
# A toxic word: so many times as frequent in toxic documents, in so many of them and between so many neighbours.
RATIO, SUPPORT = 20, 5  # or one in a hundred, if that is more
PLACES = 1 << 21
STEPS, STEP, PENALTY = 50, 0.5, 1e-4
# Longer sentences are trained on in chains of so many tokens; they are scored whole.
SENTENCE = 200
_TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
_STOPS = frozenset(".!?\n")
_STOP = ""  # between sentences


def _place(kind: str, value: str) -> int:
    return crc32(f"{kind}:{value}".encode()) % PLACES


def features(word: str) -> list[int]:
    """Places of a word's own features."""
    word = word.lower()
    return [_place("word", word), *(_place("begin", word[:n]) for n in (4, 5, 6)), _place("end", word[-3:]), _place("any", "")]


def neighbours(word: str) -> tuple[int, int]:
    """Places of the word as the one before and as the one after."""
    word = word.lower()
    return _place("before", word), _place("after", word)


def tokens(text: str) -> list[str]:
    """Words in order, with a stop between sentences and at the end."""
    return [_STOP if x[0] in _STOPS else x for x in _TOKEN.findall(text)] + [_STOP]


def _runs(stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sentences between stops."""
    ends = np.flatnonzero(stop)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts
    return starts[sizes > 0], sizes[sizes > 0]


def _cut(starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same runs in parts of at most so many tokens."""
    parts = -(-sizes // most)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(starts, parts) + most * number
    return begin, np.minimum(np.repeat(starts + sizes, parts) - begin, most)


@dataclass
class Field:
    """Weights of the features for the toxic tag, and the scores of tags that follow each other."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(PLACES, np.float32))
    follow: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    trained: bool = False
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def chains(self, emission: np.ndarray, starts: np.ndarray, sizes: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the toxic tag at all tokens; with ``expect`` also the expected number of each pair of tags.

        Forward and backward scores are kept as the toxic tag's share against the other's.  Sentences of similar
        length go together, a step for each place.
        """
        (a00, a01), (a10, a11) = np.exp(self.follow)
        e = np.exp(np.clip(emission, -30, 30))
        marginal, pairs = np.zeros(len(emission)), np.zeros((2, 2))
        level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for bucket in np.unique(level):
            start, size = starts[level == bucket], sizes[level == bucket]
            span = int(size.max())
            places = start[None, :] + np.minimum(np.arange(span)[:, None], size[None, :] - 1)
            own = e[places]
            forward = np.empty_like(own)
            forward[0] = own[0]
            for t in range(1, span):
                r = forward[t - 1]
                forward[t] = own[t] * (a01 + a11 * r) / (a00 + a10 * r)
            backward = np.ones_like(own)
            for t in range(span - 2, -1, -1):
                nxt = own[t + 1] * backward[t + 1]
                backward[t] = np.where(t < size - 1, (a10 + a11 * nxt) / (a00 + a01 * nxt), 1.0)
            inside = np.arange(span)[:, None] < size[None, :]
            both = forward * backward
            marginal[places[inside]] = (both / (1 + both))[inside]
            if expect and span > 1:
                follows = inside[1:]
                r, n = forward[:-1], own[1:] * backward[1:]
                parts = np.stack([a00 + 0 * r, a01 * n, a10 * r, a11 * r * n])
                pairs += ((parts / parts.sum(0)) * follows).sum((1, 2)).reshape(2, 2)
        return marginal, pairs

    def word(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own emission, to the next token's and to the one before."""
        w = self.weights
        before, after = neighbours(word)
        return (float(w[features(word)].sum()) if word else 0.0), float(w[before]), float(w[after])


def _flat(lists: Sequence[list[str]]) -> tuple[list[str], np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return [x for one in lists for x in one], sizes


def _emission(ids: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    out = own[ids]
    out[1:] += before[ids[:-1]]
    out[:-1] += after[ids[1:]]
    return out


class Scorer:
    """A field and a memo of its words, kept by a Python worker."""

    def __init__(self, model: Field, generation: int = 150_000):
        self.model, self.memo = model, Memo(generation)

    def marginals(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """The marginal of every token of every text; stops have 0."""
        lists = [tokens(text) for text in texts]
        flat, sizes = _flat(lists)
        known, missing = self.memo.split(set(flat))
        fresh = {word: self.model.word(word) for word in missing}
        self.memo.add(fresh)
        known |= fresh
        index = {word: i for i, word in enumerate(known)}
        table = np.array(list(known.values())).reshape(-1, 3)
        ids = np.fromiter(map(index.__getitem__, flat), np.int32, len(flat))
        if not len(ids):
            return
        emission = _emission(ids, *table.T)
        marginal, _ = self.model.chains(emission, *_runs(ids == index[_STOP]))
        yield from np.split(marginal, np.cumsum(sizes)[:-1])

    def spans(self, text: str, marginal: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) in characters of the runs of tokens with a marginal of at least ``least``."""
        out: list[tuple[int, int, float]] = []
        open_run = False
        for match, p in zip(_TOKEN.finditer(text), marginal.tolist(), strict=False):
            if p < least:
                open_run = False
            elif open_run:
                start, _, best = out[-1]
                out[-1] = (start, match.end(), max(best, p))
            else:
                out.append((match.start(), match.end(), p))
                open_run = True
        return out

    def score(self, texts: Iterable[str]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        if not self.model.trained:
            yield from ((0.0, []) for _ in texts)
            return
        for some in slices(texts):
            for text, marginal in zip(some, self.marginals(some), strict=True):
                best = float(marginal.max())
                yield best, self.spans(text, marginal) if best >= 0.5 else []


def _keys(word: str) -> list[str]:
    """What may be toxic about a word: itself, or how it begins; the most special first."""
    word = word.lower()
    return [word, *(word[:n] + "*" for n in (6, 5, 4) if len(word) > n)]


def toxic_keys(toxic: Sequence[list[str]], clean: Iterable[list[str]]) -> set[str]:
    """Words and beginnings of words that mark the toxic documents, as the module says."""
    counts = Counter(key for words in toxic for key in {k for w in set(words) for k in _keys(w)})
    counts = {key: n for key, n in counts.items() if n > 1}
    clean_docs: Counter[str] = Counter()
    n_clean = 0
    for words in clean:
        clean_docs.update({k for w in set(words) for k in _keys(w)} & counts.keys())
        n_clean += 1
    rate = max(1e-9, len(toxic)) / max(1, n_clean)
    ratio = {key: n / rate / (clean_docs[key] + 0.5) for key, n in counts.items()}
    ratio = {key: r for key, r in ratio.items() if r >= RATIO / 4}
    docs: dict[str, set[int]] = defaultdict(set)
    places: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for i, words in enumerate(toxic):
        for j, word in enumerate(words):
            if word:
                for key in _keys(word):
                    if key in ratio:
                        docs[key].add(i)
                        places[key].add((words[j - 1] if j else "", words[j + 1]))
    support = max(SUPPORT, len(toxic) // 100)
    chosen = {key for key, found in docs.items() if ratio[key] >= RATIO and min(len(found), len(places[key])) >= support}
    open_docs = set(range(len(toxic))) - {i for key in chosen for i in docs[key]}
    likely = [key for key in docs if key not in chosen and len(places[key]) > 1]
    while open_docs and likely:
        best = max(likely, key=lambda key: (len(docs[key] & open_docs), -clean_docs[key], len(key), key))
        if len(docs[best] & open_docs) < max(2, len(toxic) // 200):
            break
        chosen.add(best)
        open_docs -= docs[best]
        likely = [key for key in likely if docs[key] & open_docs]
    return chosen


def train(toxic: Sequence[str], clean: Sequence[str]) -> Field:
    """A field from texts of toxic and of clean documents."""
    model = Field()
    bad = [tokens(x) for x in toxic]
    keys = toxic_keys(bad, map(tokens, clean))
    if not keys:
        return model
    marked = {w: any(k in keys for k in _keys(w)) for words in bad for w in words if w}
    # all sentences of the toxic documents, and those of as many clean ones
    lists = bad + [tokens(x) for x in clean[: max(1, len(bad))]]
    flat, sizes = _flat(lists)
    index = {word: i for i, word in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    from_bad = np.repeat(np.arange(len(lists)) < len(bad), sizes)
    is_marked = np.array([marked.get(word, False) for word in index])
    tag = (is_marked[ids] & from_bad).astype(float)
    stop = ids == index[_STOP]
    if not tag.any():
        return model
    starts, lengths = _cut(*_runs(stop), SENTENCE)
    goes_on = ~stop
    goes_on[starts + lengths - 1] = False
    own = np.array([features(word) if word else [0] * 6 for word in index])
    around = np.array([neighbours(word) for word in index])
    has_word = np.array([bool(word) for word in index])
    inner = np.flatnonzero(goes_on)  # tokens followed by a token of their chain
    seen = np.array([[((tag[inner] == i) & (tag[inner + 1] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    w, sums, follow_sums = np.zeros(PLACES), np.full(PLACES, 1e-8), np.full((2, 2), 1e-8)
    many = len(index)
    for _ in range(STEPS):
        emission = _emission(ids, np.where(has_word, w[own].sum(1), 0.0), w[around[:, 0]], w[around[:, 1]])
        marginal, pairs = model.chains(emission, starts, lengths, expect=True)
        miss = np.where(stop, 0.0, tag - marginal)
        by_word = np.bincount(ids, miss, many)
        gradient = np.bincount(own[has_word].ravel(), np.repeat(by_word[has_word], own.shape[1]), PLACES)
        gradient += np.bincount(around[:, 0], np.bincount(ids[:-1], miss[1:], many), PLACES)
        gradient += np.bincount(around[:, 1], np.bincount(ids[1:], miss[:-1], many), PLACES)
        gradient -= PENALTY * len(starts) * w
        sums += gradient**2
        w += STEP * gradient / np.sqrt(sums)
        change = seen - pairs
        follow_sums += change**2
        model.follow = model.follow + STEP * change / np.sqrt(follow_sums)
    model.weights, model.trained = w.astype(np.float32), True
    return model


def _passage(text: Column, seed: Column) -> Column:
    """The text, or of a long one a run of whole sentences of at most ``SAMPLE_CHARS``, anywhere in it."""
    start = F.pmod(seed, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1))) + 1
    run = F.substr(text, start.cast("int"), F.lit(SAMPLE_CHARS))
    whole = F.regexp_extract(run, r"(?s)[.!?\n](.*[.!?\n])", 1)
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.when(whole != "", whole).otherwise(run))


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(toxic, text) to learn from: at most so many documents of either kind, one text of each id.

    The draw is among labelled ids that are not held out and have a text; of a long text a passage is taken.
    """
    known = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = docs.where(F.trim("text") != "").select("doc_id").distinct()
    known = known.join(there, "doc_id", "left_semi")
    picks = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in ((1, toxic), (0, clean))]
    picked = F.broadcast(picks[0].unionByName(picks[1]))  # at most toxic + clean rows
    seed = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", "text").where(F.trim("text") != "").join(picked, "doc_id")
    rows = rows.select("doc_id", "toxic", seed.alias("seed"), _passage(F.col("text"), seed).alias("text"))
    one = F.min(F.struct("seed", "text")).alias("one")
    return rows.groupBy("doc_id", "toxic").agg(one).select("doc_id", "toxic", "one.text").orderBy(F.xxhash64("doc_id"), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Field:
    """Learns labels.toxic from a sample of the rows that are not held out."""
    rows = sample(docs, labels, toxic, clean).collect()
    texts = {kind: list(dict.fromkeys(r.text for r in rows if r.toxic == kind)) for kind in (0, 1)}
    return train(texts[1], texts[0])


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: Field) -> Scorer:
    """The model's scorer in this Python worker; that of an earlier model is let go."""
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model)
    return _SCORERS[model.name]


def judge(text: Column, model: Broadcast[Field]) -> Column:
    """struct(score, spans) of a text column; spans are struct(start, end, score) in characters."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judged = _scorer(model.value).score(plain_texts(batches))
        rows = ((score, [{"start": a, "end": b, "score": p} for a, b, p in spans]) for score, spans in judged)
        return frames(rows, ["score", "spans"])

    return F.pandas_udf(of, "score double, spans array<struct<start:int,end:int,score:double>>")(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a score under ``least``, in docs' own columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    (found,) = unused(docs.columns, "judged")
    marked = docs.withColumn(found, judge(F.col("text"), model))
    return marked.where(F.col(f"{found}.score") < least).select(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judge(F.col("text"), model).alias("judged"))
    score = F.col("judged.score")
    return judged.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
