"""Language identification by segmentation-marginalised unigrams.

Each language has a distribution over the pieces of a fixed public vocabulary. A word's probability under a
language is the sum over all its segmentations into pieces of the product of their probabilities, which a forward
algorithm computes; expectation maximisation fits the piece probabilities. A text's score is the product over its words
(whole letter runs, lower-cased, with the blank mark in front).
Distinct words are scored once per worker, in blocks of one length; those of over LONG letters one by one, with sums scaled on the way, and not stored.

Null texts and texts without a letter give ("und", 0). Ties go to the first language by code point. With no training rows
every text gives ("und", 0).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import claim, map_texts, sampled_by_class
from gridloom.llm.pieces import BLANK, by_length, code_points, default_vocabulary, vocabulary

LONG = 40
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-7
_CACHE_WORDS = 300_000


def letter_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """piece_p has a row for each piece and a last one of zeros, and a column for each language."""

    languages: tuple[str, ...]
    piece_p: np.ndarray
    vocabulary: str
    key: str


def _forward(block: list[str], n: int, voc, p: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int, np.ndarray]]]:
    alpha = [np.ones((len(block), p.shape[1]))] + [np.zeros((len(block), p.shape[1])) for _ in range(n)]
    used = []
    for first, end, columns in voc.edges(block, n):
        for start in range(first, end):
            ids = columns[:, start - first]
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                alpha[end][hit] += alpha[start][hit] * p[ids[hit]]
                used.append((start, end, ids))
            if start == end - 1 and len(hit) < len(block):
                miss = np.flatnonzero(ids < 0)
                alpha[end][miss] += alpha[start][miss] * UNKNOWN
    return alpha, used


def _long_sums(word: str, voc, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a long word (with its mark): piece ids by end and start (longest first, -1: none), the forward sums, each scaled, and the logarithms of their scales, by language."""
    n, width = len(word), voc.longest
    sums, power = voc.prefixes(code_points([word], n))[0], voc.powers(width)
    ids = np.full((n, width), -1, np.int32)
    for size in range(1, min(width, n) + 1):
        ids[size - 1 :, width - size] = voc.lookup(sums[size:] - sums[: n - size + 1] * np.uint64(power[size]))
    alpha, scale = np.zeros((n + width, p.shape[1])), np.zeros((n + width, p.shape[1]))
    near = np.zeros((width, p.shape[1]))  # the last sums, all to the newest one's scale
    alpha[width - 1] = near[-1] = 1.0  # position 0 stands at width - 1: a step of one reads the row before
    for k in range(n):
        row = p[ids[k]]
        if ids[k, -1] < 0:
            row[-1] = UNKNOWN
        new = (near * row).sum(0)
        scale[k + width] = scale[k + width - 1]
        if new.min() < 1e-100:
            near /= new
            scale[k + width] += np.log(new)
            new = np.ones_like(new)
        near[:-1] = near[1:]
        near[-1] = alpha[k + width] = new
    return ids, alpha, scale


def word_log_likelihoods(words: list[str], voc, p: np.ndarray) -> np.ndarray:
    """(words, languages) logarithms of the probabilities summed over all segmentations."""
    out = np.empty((len(words), p.shape[1]))
    place = {}
    for i, w in enumerate(words):
        if len(w) <= LONG:
            place[w] = i
        else:
            _, alpha, scale = _long_sums(BLANK + w, voc, p)
            out[i] = np.log(alpha[-1]) + scale[-1]
    for n, block in by_length([BLANK + w for w in place]):
        alpha, _ = _forward(block, n, voc, p)
        out[[place[w[1:]] for w in block]] = np.log(alpha[n])
    return out


def _long_expected(word: str, voc, p: np.ndarray) -> np.ndarray:
    """As _expected, for one long word: the backward sum runs over the scaled forward sums, as shares of what each position holds."""
    ids, alpha, scale = _long_sums(BLANK + word, voc, p)
    n, width = ids.shape
    total, held = np.zeros(voc.size), np.zeros(n + width)
    held[-1] = 1.0  # the probability that a segmentation has a border here
    for k in range(n - 1, -1, -1):
        row = p[ids[k], 0]
        if ids[k, -1] < 0:
            row[-1] = UNKNOWN
        way = alpha[k : k + width, 0] * np.exp(scale[k : k + width, 0] - scale[k + width, 0]) * row
        way *= held[k + width] / way.sum()
        held[k : k + width] += way
        hit = ids[k] >= 0
        np.add.at(total, ids[k][hit], way[hit])
    return total


def _expected(counts: Counter, voc, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece under p, by the forward and backward sums."""
    total = np.zeros(voc.size)
    for w in counts:
        if len(w) > LONG:
            total += counts[w] * _long_expected(w, voc, p)
    for n, block in by_length([BLANK + w for w in counts if len(w) <= LONG]):
        times = np.array([counts[w[1:]] for w in block], float)
        alpha, used = _forward(block, n, voc, p)
        lost = {e: ids[:, -1] < 0 for _, e, ids in voc.edges(block, n)}
        beta = [np.zeros((len(block), 1)) for _ in range(n)] + [np.ones((len(block), 1))]
        steps: dict[int, list] = {}
        for start, end, ids in used:
            steps.setdefault(start, []).append((end, ids))
        for start in range(n - 1, -1, -1):
            for end, ids in steps.get(start, ()):
                hit = np.flatnonzero(ids >= 0)
                beta[start][hit] += p[ids[hit]] * beta[end][hit]
            miss = lost[start + 1]
            beta[start][miss] += UNKNOWN * beta[start + 1][miss]
        z = np.maximum(alpha[n][:, 0], 1e-300)
        for start, end, ids in used:
            hit = np.flatnonzero(ids >= 0)
            total += np.bincount(ids[hit], times[hit] * alpha[start][hit, 0] * p[ids[hit], 0] * beta[end][hit, 0] / z[hit], voc.size)
    return total


def fit(docs: DataFrame, trainable: Column, per_language: int = 250, longest: int = 400_000, rounds: int = 3, path: str | None = None) -> LanguageModel:
    """Fits on about per_language documents of each language, chosen by hash among rows where `trainable` holds.

    docs has doc_id, text and lang. Documents above `longest` characters don't serve as training rows.
    """
    path = path or default_vocabulary()
    voc = vocabulary(path)
    rows = docs.where(trainable & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").alias("y"))
    keys, _ = sampled_by_class(rows.select("doc_id", "y"), "doc_id", "y", per_language)
    sample = rows.join(F.broadcast(keys.distinct()), ["doc_id", "y"]).where(F.length("text") <= longest)
    count: dict[str, Counter] = {}
    for r in sample.distinct().toLocalIterator():
        count.setdefault(r["y"], Counter()).update(letter_words(r["text"]))
    count = {k: v for k, v in count.items() if v}
    languages = tuple(sorted(count))
    table = np.zeros((voc.size + 1, len(languages)))
    plain = np.array(voc.plain)
    # from Zipf's law over the vocabulary's order
    base = np.zeros(voc.size)
    base[plain] = 1.0 / (np.arange(len(plain)) + 100.0)
    base /= base.sum()
    for k, language in enumerate(languages):
        p = base.copy()
        for _ in range(rounds):
            used = _expected(count[language], voc, np.append(p, 0.0)[:, None])
            used[plain] += 0.02
            p = used / used.sum()
        table[:-1, k] = p
    return LanguageModel(languages, table, path, f"{hash((languages, table.tobytes()))}")


_words: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def _rows(model: LanguageModel, texts: list[list[str]]) -> tuple[dict[str, int], np.ndarray]:
    """The worker's store of word scores, with every word of the texts in it."""
    claim("language", _words.clear)
    known, scores = _words.get(model.key) or ({}, np.empty((0, len(model.languages))))
    new: set[str] = set()
    for words in texts:
        new.update(words)
    new.difference_update(known)
    if len(known) + len(new) > _CACHE_WORDS:
        known, scores, new = {}, scores[:0], set().union(*texts)
    if new:
        fresh = sorted(new)
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        scores = np.concatenate([scores, word_log_likelihoods(fresh, vocabulary(model.vocabulary), model.piece_p)])
    _words.clear()
    _words[model.key] = (known, scores)
    return known, scores


def _of_long(model: LanguageModel, words: Counter) -> np.ndarray:
    return sum(n * word_log_likelihoods([w], vocabulary(model.vocabulary), model.piece_p)[0] for w, n in words.items())


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability under equal priors, text by text."""
    words = [letter_words(t) if t else [] for t in texts]
    longer: dict[int, list[str]] = {}
    for i, ws in enumerate(words):
        if max(map(len, ws), default=0) > LONG:
            longer[i], words[i] = [w for w in ws if len(w) > LONG], [w for w in ws if len(w) <= LONG]
    langs, score = ["und"] * len(texts), np.zeros(len(texts))
    if model.languages:
        known, scores = _rows(model, words)
        for i, w in enumerate(words):
            if w or i in longer:
                total = scores[np.fromiter(map(known.__getitem__, w), np.int64, len(w))].sum(0)
                if i in longer:
                    total = total + _of_long(model, Counter(longer[i]))
                total = np.exp(total - total.max())
                best = int(total.argmax())
                langs[i], score[i] = model.languages[best], total[best] / total.sum()
    return langs, score


def detect(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """Appends lang_pred and score; one row in, one row out, no shuffle."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(column: pa.Array):
        langs, score = predict(model, column.to_pylist())
        return pa.array(langs, pa.string()), pa.array(score)

    return map_texts(docs, text, run, fields, keep)
