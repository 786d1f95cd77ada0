"""Reading level of each document by regularised ordinal regression.

Features of the English prose: word and sentence length, lexical diversity, word rarity over the corpus,
connectives and a proxy of clause depth, as means and quantiles over sentences. The prose of each document is found
once and written; word rarity uses counts of all its words in a table of fixed size, by hashed word. The proportional odds model is fitted on the rated
documents; ratings that the first fit finds all but impossible are left out of the second.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import language, prose, sentences, words
from strandline.session import cut, free, spread

LEVELS = ("basic", "intermediate", "advanced")
#: Words a document needs outside code, logs and tables.
LEAST_WORDS = 40
#: Size of the hashed table of word counts: the bound of what is broadcast, whatever the corpus.
SLOTS = 1 << 20
#: Ratings used at most for the fit, the ones with the smallest hash of doc_id.
MOST_RATINGS = 20_000
#: Strength of the ridge penalty, in ratings.
RIDGE = 0.3
#: A rating this improbable under the first fit is taken for a slip.
SLIP = 0.04
#: Connectives and subordinators (fixed values).
CONNECTIVES = frozenset("although because since whereas while when whenever if unless until after before though thereby therefore consequently furthermore moreover nevertheless nonetheless notwithstanding insofar provided however hence thus accordingly albeit wherein whose whom which that whether given under".split())
_VOWELS = re.compile(r"[aeiouy]+")


_slots: dict[str, int] = {}


def slot(word: str) -> int:
    k = _slots.get(word)
    if k is None:
        if len(_slots) > 200_000:
            _slots.clear()
        k = _slots[word] = zlib.crc32(word.encode("utf-8", "replace")) % SLOTS
    return k


def english_prose(text: str | None) -> tuple[str, list[str]] | None:
    """(prose, words in lower case) of a document whose prose is English and long enough, else None.

    Where the text as a whole leaves a doubt, its sentences decide, each with the number of its words.
    """
    plain = prose(text)
    found = [w.lower() for w in words(plain)]
    if len(found) < LEAST_WORDS:
        return None
    whole, evidence = language(plain)
    if whole == "en" and evidence > 0.15 * len(found):
        return plain, found
    by: dict[str, int] = {}
    for s in sentences(plain):
        k, _ = language(s)
        by[k] = by.get(k, 0) + len(words(s))
    rest = {k: n for k, n in by.items() if k != "none"}
    return (plain, found) if rest and max(rest, key=lambda k: rest[k]) == "en" else None


def syllables(word: str) -> int:
    return max(1, len(_VOWELS.findall(word)))


class WordMeasures(dict):
    """(length, three syllables or more, rarity, connective) by word; emptied when full."""

    def __init__(self, rarity: np.ndarray) -> None:
        self.rarity = rarity

    def __missing__(self, w: str) -> tuple[int, int, float, int]:
        if len(self) > 200_000:
            self.clear()
        got = self[w] = (len(w), int(syllables(w) >= 3), float(self.rarity[slot(w)]), int(w in CONNECTIVES))
        return got


#: Marks that part clauses, and openings of brackets, which put one clause into another.
_PARTS, _INTO = re.compile(r"[,;:]|\s[-–—]\s"), re.compile(r"[(\[–—]")


def clause_depth(sentence: str, connectives: int) -> float:
    """A proxy of how deep clauses stand in a sentence: those that marks part and, once more, those that are put into another or begin with a subordinator."""
    return len(_PARTS.findall(sentence)) + len(_INTO.findall(sentence)) + connectives


def features(text: str | None, measures: WordMeasures) -> list[float] | None:
    """The features of a document, or None if it has no reading level."""
    got = english_prose(text)
    return prose_features(got[0], measures) if got else None


def prose_features(plain: str, measures: WordMeasures) -> list[float] | None:
    """The features of the prose of a document, or None if no sentence of it has three words."""
    low, per = [], []
    for s in sentences(plain):
        ws = [w.lower() for w in words(s)]
        low += ws
        ms = [measures[w] for w in ws]
        n = len(ms)
        if n < 3:
            continue
        rare = [m[2] for m in ms if m[0] >= 4] or [m[2] for m in ms]
        joins = sum(m[3] for m in ms)
        per.append((sum(m[0] for m in ms) / n, n, sum(m[1] for m in ms) / n, sum(rare) / len(rare), joins, clause_depth(s, joins)))
    if not per:
        return None
    a = np.array(per)
    weight = a[:, 1] / a[:, 1].sum()
    window = [len(set(low[i : i + 40])) / 40 for i in range(0, max(1, len(low) - 39), 20)]
    mid = np.median(a, axis=0)
    return [float(x) for x in (*a.mean(axis=0), *mid, (a[:, 0] * weight).sum(), np.mean(a[:, 1] > 9), np.mean(a[:, 2] > 0.3), np.mean((a[:, 1] > 9) & (a[:, 2] <= 0.3)), np.mean(window))]


N_FEATURES = 17


def english_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, plain, words): the prose of every document that has a reading level, with its words in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, plains, found = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = english_prose(t)
                if got is not None:
                    ids.append(i)
                    plains.append(got[0])
                    found.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(plains, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "plain", "words"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, plain string, words array<string>")


def corpus_rarity(english: DataFrame) -> np.ndarray:
    """Minus the log share of each word slot over all English documents. At most SLOTS rows of counts reach the driver."""
    slots = english.select(F.explode("words").alias("w")).groupBy((F.crc32(F.encode("w", "UTF-8")) % SLOTS).cast("int").alias("slot")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(SLOTS)
    counts[slots["slot"].to_numpy(dtype=np.int64)] = slots["n"].to_numpy(dtype=float)
    return (-np.log((counts + 0.5) / (counts.sum() + 0.5 * SLOTS))).astype(np.float32)


def document_features(english: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(doc_id, x): the features of each document of :func:`english_documents`."""
    table = english.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = WordMeasures(table.value)
        for b in batches:
            ids, xs = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = prose_features(t, measures)
                if x is not None:
                    ids.append(i)
                    xs.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return spread(english.select("doc_id", "plain")).mapInArrow(run, "doc_id bigint, x array<double>")


class OrdinalModel:
    """Proportional odds: P(level <= k) = sigmoid(cut_k - w.x) on standardised features."""

    def __init__(self) -> None:
        self.mean = self.scale = self.w = np.zeros(0)
        self.cuts = np.array([-1.0, 1.0])

    def _chances(self, z: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - (z @ self.w)[:, None], -30, 30)))
        edges = np.hstack([np.zeros((len(z), 1)), below, np.ones((len(z), 1))])
        return np.clip(np.diff(edges, axis=1), 1e-9, 1)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return self._chances((x - self.mean) / self.scale)

    def _descend(self, z: np.ndarray, y: np.ndarray, ridge: float) -> None:
        p = np.concatenate([np.zeros(z.shape[1]), [-1.0, math.log(2.0)]])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, 1501):
            self.w, self.cuts = p[:-2], np.array([p[-2], p[-2] + math.exp(p[-1])])
            s = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - (z @ self.w)[:, None], -30, 30)))
            edges = np.hstack([np.zeros((len(z), 1)), s, np.ones((len(z), 1))])
            slope = np.hstack([np.zeros((len(z), 1)), s * (1 - s), np.zeros((len(z), 1))])
            chance = np.clip(edges[np.arange(len(y)), y + 1] - edges[np.arange(len(y)), y], 1e-9, 1)
            up, down = slope[np.arange(len(y)), y + 1] / chance, slope[np.arange(len(y)), y] / chance
            d_cut = np.array([(-up * (y == k) + down * (y == k + 1)).sum() for k in range(2)])
            g = np.concatenate([z.T @ (up - down) + ridge * self.w, [d_cut.sum(), d_cut[1] * math.exp(p[-1])]]) / len(y)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.cuts = p[:-2], np.array([p[-2], p[-2] + math.exp(p[-1])])

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, slip: float = SLIP) -> OrdinalModel:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - self.mean) / self.scale
        self._descend(z, y, 10 * ridge)
        for _ in range(2):
            keep = self._chances(z)[np.arange(len(y)), y] >= slip
            self._descend(z[keep], y[keep], ridge)
        return self


def fit_levels(x: DataFrame, labels: DataFrame, most: int = MOST_RATINGS) -> OrdinalModel | None:
    """The model of the rated documents, or None without any rating. Null and unknown ratings are left out; a document rated twice counts twice."""
    rated = labels.where(F.col("reading_level").isin(*LEVELS)).select("doc_id", "reading_level").join(x, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "reading_level").limit(most).collect()
    if not rated:
        return None
    return OrdinalModel().fit(np.array([r.x for r in rated]), np.array([LEVELS.index(r.reading_level) for r in rated]))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level) for each document with English prose of at least LEAST_WORDS words. No ratings or no documents give no rows."""
    english = cut(english_documents(documents))
    x = cut(document_features(english, corpus_rarity(english)))
    free(english)
    model = fit_levels(x, labels)
    if model is None:
        return x.select("doc_id", F.lit(None).cast("string").alias("reading_level")).where("false")
    score = sum((F.col("x")[i] - float(model.mean[i])) * float(model.w[i] / model.scale[i]) for i in range(len(model.w)))
    low, high = (float(c) for c in model.cuts)
    # the likeliest level changes where two neighbours are equally likely
    grid = np.linspace(low - 20, high + 20, 20001)
    s = 1 / (1 + np.exp(-(np.array([low, high])[None, :] - grid[:, None])))
    best = np.argmax(np.stack([s[:, 0], s[:, 1] - s[:, 0], 1 - s[:, 1]]), axis=0)
    first, last = (float(grid[np.searchsorted(best, k)]) for k in (1, 2))
    return x.select("doc_id", F.when(score < first, LEVELS[0]).when(score < last, LEVELS[1]).otherwise(LEVELS[2]).alias("reading_level"))
