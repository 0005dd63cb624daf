"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel counts common subsequences of three letters, each occurrence weighted by DECAY to the power of the letters it
spans, so that gaps and inserted characters lower it without breaking it. It is taken over windows of WINDOW
letters and normalised. A window's features are its kernel values with the landmarks, whitened by the
landmarks' own kernel matrix. Since the kernel is an inner product of subsequence weights, the machine's weights on the
landmarks fold into one weight per subsequence, and a window is scored by a sum over its subsequences: the same value
without a kernel evaluation per landmark.

Labels belong to whole texts, so the offending forms are found first: letter sequences of four to seven that words of toxic texts hold beyond chance and
far more often than words of clean ones (copies of a text count once). Two machines share the landmarks. The one for sure forms
learns sequences of which clean texts are all but free; a single one makes a text suspect. The one for likely forms learns those that are merely far more frequent, such as stems that a clean text
may meet by chance; they count by their number against the text's words, as a log-likelihood ratio of the rates in toxic and clean texts.
Windows of words that hold such a sequence are positive, all other windows of clean texts negative. Each of the two figures becomes a probability by a logistic curve fitted
on labelled texts that the machines haven't seen; a text's score is that of either being so.

Before windows are cut a word's digits and signs that stand for letters are read as these, other non-letters go, and runs of
single letters (as in spaced-out words) are joined. Null and empty texts, and texts without a window, have the decision of a
window without any weight, and no likely form. With fewer than two classes of labels every text gets the share of label 1 (0 without labels).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import claim, labelled_texts, logistic_1d, map_texts, sigmoid

WINDOW = 7
DECAY = 0.6
#: Signs read as letters inside a word.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_READ = str.maketrans(LOOKALIKE)
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[ .,\-_*]+[^\W\d_]){2,}(?!\S)")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_LETTERS = 64
_TRIPLES = list(combinations(range(WINDOW), 3))
#: A window as one number, six bits a letter.
_PACK = 1 << 6 * np.arange(WINDOW - 1, -1, -1)
_CACHE_WORDS = 400_000


def tokens(text: str) -> list[str]:
    """Blank-separated words, lower-cased, and the joined runs of single letters."""
    low = text.lower()
    return low.split() + [_NOT_LETTER.sub("", m.group()) for m in _SPACED.finditer(low)]


def letters(token: str) -> str:
    """The letters of a token between ^ and $; signs at its ends are punctuation, those inside may stand for letters."""
    if not token.isalpha():
        core = token.strip("!?.,;:'\"()[]{}|#%&*$<>-_")
        if any(c.isdigit() for c in core):
            token = "" if sum(c.isdigit() for c in core) * 2 > len(core) else core.translate(_READ)
        else:
            token = core.translate(_READ)
        token = _NOT_LETTER.sub("", token)
    return f"^{token}$" if token else ""


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all words as letter codes (0: none), and the word each belongs to. Short words give one padded window."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join([w.ljust(WINDOW, "\0") if w else w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (points >= 97) & (points <= 122)
    letter = np.where(ascii_letter, points - 96, np.where(points == 0, 0, 27 + points % (_LETTERS - 27))).astype(np.int64)
    held = np.where(sizes > 0, np.maximum(sizes, WINDOW), 0)
    n = np.where(sizes > 0, held - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(words)), n)
    start = np.repeat(np.cumsum(held) - held, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return letter[start[:, None] + np.arange(WINDOW)], owner


def _subsequences(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, triples) ids of the subsequences, and their weights, 0 where a letter is missing."""
    ids = np.stack([(code[:, i] * _LETTERS + code[:, j]) * _LETTERS + code[:, k] for i, j, k in _TRIPLES], 1)
    span = np.array([DECAY ** (k - i - 2) for i, _, k in _TRIPLES])
    real = np.stack([code[:, k] > 0 for _, _, k in _TRIPLES], 1)
    return ids, real * span


def _norms(code: np.ndarray) -> np.ndarray:
    """Square roots of each window's kernel with itself, by the recursion over pairs of prefixes."""
    n, width = code.shape
    columns = [np.ascontiguousarray(code[:, i]) for i in range(width)]
    same = {(i, j): (columns[i] == columns[j]) & (columns[i] > 0) if i != j else columns[i] > 0 for i in range(width) for j in range(i + 1)}
    # scaled so that a contiguous subsequence weighs 1: inner[i][j] is the sum over pairs that end before i and j
    inner = [[np.ones(n) for _ in range(width + 1)] for _ in range(width + 1)]
    total = np.zeros(n)
    for level in range(3):
        ended = {(i, j): np.where(same[max(i, j), min(i, j)], inner[i][j], 0.0) for i in range(width) for j in range(width)}
        if level == 2:
            for value in ended.values():
                total += value
            break
        grown = [[np.zeros(n) for _ in range(width + 1)] for _ in range(width + 1)]
        for i in range(1, width + 1):
            row = np.zeros(n)
            for j in range(1, width + 1):
                row = DECAY * row + ended[i - 1, j - 1]
                grown[i][j] = DECAY * grown[i - 1][j] + row
        inner = grown
    return np.sqrt(np.maximum(total, 1e-12))


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised kernel matrix of windows, through a dense table of the subsequences of b; the rows of a go in blocks."""
    ib, wb = _subsequences(b)
    columns = np.unique(ib)
    dense_b = np.zeros((len(b), len(columns)), np.float32)
    np.add.at(dense_b, (np.arange(len(b))[:, None], np.searchsorted(columns, ib)), wb)
    out = np.empty((len(a), len(b)))
    for r in range(0, len(a), 512):
        ia, wa = _subsequences(a[r : r + 512])
        place = np.minimum(np.searchsorted(columns, ia), len(columns) - 1)
        dense_a = np.zeros((len(ia), len(columns)), np.float32)
        np.add.at(dense_a, (np.arange(len(ia))[:, None], place), np.where(columns[place] == ia, wa, 0.0))
        out[r : r + 512] = dense_a @ dense_b.T
    return out / np.outer(_norms(a), _norms(b))


SURE, LIKELY = 0, 1
#: A word counts as a likely form from the machine's margin on.
MARGIN = 1.0


@dataclass(frozen=True)
class ToxicityModel:
    """weight: of each subsequence in each machine; a window's decisions are its normalised sums plus bias. rates: of likely forms among the words of toxic and clean texts.
    curves: slope and intercept for the largest sure decision and for the likely forms' log-likelihood ratio; None for a machine without positive windows."""

    weight: np.ndarray
    bias: np.ndarray
    rates: tuple[float, float]
    curves: tuple[tuple[float, float] | None, tuple[float, float] | None]
    share: float
    key: str


def _decisions(model: ToxicityModel, words: list[str]) -> np.ndarray:
    """(words, machines) the largest decisions over each word's windows; the bias where there is none."""
    out = np.tile(model.bias, (len(words), 1))
    for start in range(0, len(words), 20_000):
        windows, owner = _codes(words[start : start + 20_000])
        if len(windows):
            # equal windows of several words are judged once
            packed, place = np.unique(windows @ _PACK, return_inverse=True)
            columns = [(packed >> 6 * (WINDOW - 1 - k) & 63) for k in range(WINDOW)]
            value = np.zeros((len(packed), 2), np.float32)
            for i, j, k in _TRIPLES:
                # windows are filled from the left, so a missing last letter is a missing triple
                at = (columns[i] << 12) + (columns[j] << 6) + columns[k]
                if k < 3:
                    value += model.weight[at] * np.float32(DECAY ** (k - i - 2))
                else:
                    value += np.where(columns[k][:, None] > 0, model.weight[at], np.float32(0)) * np.float32(DECAY ** (k - i - 2))
            value = (value / _norms(np.stack(columns, 1))[:, None] + model.bias)[place]
            # a word's windows stand together
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[first] + start] = np.maximum.reduceat(value, first, axis=0)
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 100.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine with balanced classes, by dual coordinate descent in a fixed order."""
    sign = np.where(y == 1, 1.0, -1.0)
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    limit = np.where(y == 1, cost * len(y) / (2.0 * max(1, (y == 1).sum())), cost * len(y) / (2.0 * max(1, (y == 0).sum())))
    limit = limit / limit.max() * cost
    alpha, w, diagonal = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(1)
    order = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        # only windows on the wrong side of their condition are visited; one product finds them
        slack = sign * (x @ w) - 1.0
        wrong = np.flatnonzero((slack < -1e-4) & (alpha < limit) | (slack > 1e-4) & (alpha > 0))
        for i in order.permutation(wrong):
            g = sign[i] * (x[i] @ w) - 1.0
            new = min(max(alpha[i] - g / diagonal[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w[:-1], float(w[-1])


def _unlike(sample: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Without texts whose word triples share two of four smallest hashes with an earlier one: copies say nothing new."""
    seen: set[tuple] = set()
    kept = []
    for words, y in sample:
        hashes = np.array([zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))], np.uint64)
        marks = {(r, int(((hashes ^ np.uint64(r * 0x9E3779B9)) * np.uint64(0x9E3779B1 + 2 * r) & np.uint64(0xFFFFFFFF)).min())) for r in range(4)}
        if len(marks & seen) < 2:
            kept.append((words, y))
        seen |= marks
    return kept


def _offending(words: dict[str, tuple[int, int]], ratio: float) -> set[str]:
    """Sequences of four to seven letters whose share of toxic texts' words exceeds `ratio` times the most that clean ones' share may well be, beyond chance over all sequences.

    words: for each word the numbers of toxic and clean texts that hold it.
    """
    toxic, clean = Counter(), Counter()
    for w, (a, b) in words.items():
        for g in {w[k : k + n] for n in range(4, WINDOW + 1) for k in range(len(w) - n + 1)}:
            if a:
                toxic[g] += a
            if b:
                clean[g] += b
    n1, n0 = sum(a for a, _ in words.values()), sum(b for _, b in words.values())
    least, taken = 2 * np.log(max(2, len(toxic))) + 2, set()
    for g, a in toxic.items():
        b = clean[g]
        # three more than were seen: the upper end of what may lie behind none
        if a < 3 or a * n0 < ratio * (b + 3) * n1:
            continue
        share, surprise = (a + b) / (n1 + n0), 0.0
        for seen, expected in ((a, n1 * share), (b, n0 * share), (n1 - a, n1 * (1 - share)), (n0 - b, n0 * (1 - share))):
            surprise += 2 * seen * np.log(seen / expected) if seen else 0.0
        if surprise > least:
            taken.add(g)
    return taken


def _windows(word: str) -> list[str]:
    return [word[k : k + WINDOW] for k in range(max(1, len(word) - WINDOW + 1))]


def _holds(window: str, grams: set[str]) -> bool:
    return any(window[k : k + n] in grams for n in range(4, len(window) + 1) for k in range(len(window) - n + 1))


def _far_apart(windows: list[str], n: int) -> list[str]:
    """Windows chosen one by one as the least similar to those chosen before."""
    if len(windows) <= n:
        return windows
    code = _codes(windows)[0]
    inner = _kernel(code, code)
    chosen, nearest = [0], inner[0].copy()
    while len(chosen) < n:
        chosen.append(int(nearest.argmin()))
        np.maximum(nearest, inner[chosen[-1]], out=nearest)
    return [windows[i] for i in sorted(chosen)]


def _folded(positive: list[str], negative: list[str], marks: list[str]) -> tuple[np.ndarray, float, np.ndarray]:
    """The machine over Nystroem features of the windows with the landmarks: as weights of subsequences, its bias, and as weights of the landmarks' kernel values."""
    to_code = lambda xs: _codes(xs)[0]
    code = to_code(marks)
    inner = _kernel(code, code)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
    x = _kernel(to_code(positive + negative), code) @ whiten
    w, bias = _machine(x, np.array([1] * len(positive) + [0] * len(negative)))
    ids, weight = _subsequences(code)
    folded = np.zeros(_LETTERS**3)
    np.add.at(folded, ids, weight * ((whiten @ w) / _norms(code))[:, None])
    return folded, bias, whiten @ w


def _spread(xs: list[str], n: int) -> list[str]:
    return xs[:: max(1, -(-len(xs) // n))]


def _trained(words: dict[str, tuple[int, int]], grams: set[str], landmarks: int, negatives: int) -> tuple[np.ndarray, float] | None:
    """One machine: windows that hold one of the sequences against the clean texts' other windows; None without the former."""
    found: Counter = Counter()
    clean: Counter = Counter()
    for w, (a, b) in words.items():
        for x in _windows(w):
            if _holds(x, grams):
                found[x] += a
            elif b:
                clean[x] += b
    positive = [x for x, n in sorted(found.items(), key=lambda x: (-x[1], x[0])) if n][:1000]
    if not positive or not clean:
        return None
    common = [x for x, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))]
    negative = sorted({*common[: negatives // 2], *_spread(common[negatives // 2 :], negatives // 2)})
    everything, hard = sorted(clean), []
    own = _far_apart(positive, landmarks // 2)
    for _ in range(4):  # the clean windows nearest to the border join the negatives
        folded, bias, _ = _folded(positive, negative, own + _spread(negative, landmarks // 4) + _far_apart(hard, landmarks // 4))
        raw = ToxicityModel(np.repeat(folded[:, None], 2, 1).astype(np.float32), np.full(2, bias), (0.0, 0.0), (None, None), 0.0, "raw")
        value = _decisions(raw, everything)[:, 0]
        near = [everything[i] for i in np.argsort(-value, kind="stable")[:800] if value[i] > -0.8]
        if not set(near) - set(negative):
            break
        negative, hard = sorted({*negative, *near}), sorted({*hard, *near})
    return folded, bias


def _times(words: list[str], hits: set[str]) -> float:
    """How many likely forms a text holds; one that it repeats counts by its number's logarithm."""
    return sum(1.0 + math.log2(words.count(w)) for w in hits)


def _ratio(hits: np.ndarray, n: np.ndarray, rates: tuple[float, float]) -> np.ndarray:
    """The log-likelihood ratio of so many likely forms among n words, within bounds that keep the curve's fit stable."""
    toxic, clean = rates
    return np.clip(hits * math.log(toxic / clean) - (toxic - clean) * n, -6.0, 12.0)


def fit(
    docs: DataFrame, labels: DataFrame, trainable: Column, label: str = "toxic", per_class: int = 1500, landmarks: int = 600, negatives: int = 4000, sure: float = 60.0, likely: float = 8.0
) -> ToxicityModel:
    """Fits on about per_class labelled documents of each class, chosen by hash; two thirds for the machines, a third for the curves.

    sure, likely: how many times as frequent in toxic texts a machine's forms are at least.
    """
    sample, counts = labelled_texts(docs, labels, label, trainable, per_class)
    seen = {int(k): v for k, v in counts.items()}
    share = seen.get(1, 0) / max(1, sum(seen.values()))
    flat = ToxicityModel(np.zeros((1, 2)), np.zeros(2), (0.0, 0.0), (None, None), share, "flat")
    read: dict[str, str] = {}  # equal words are held once
    texts = [([x for t in tokens(text) if (x := read[t] if t in read else read.setdefault(t, letters(t)))], y) for text, y in sample]
    del read
    if len({y for _, y in texts}) < 2:
        return flat
    parts = {y: [w for w, v in texts if v == y] for y in (0, 1)}
    few = {y: len(parts[y]) < 30 for y in (0, 1)}
    numbers: dict[str, list[int]] = {}
    for y in (0, 1):
        for ws, _ in _unlike([(ws, y) for i, ws in enumerate(parts[y]) if i % 3 or few[y]]):
            for w in set(ws):
                numbers.setdefault(w, [0, 0])[1 - y] += 1
    words = {w: (a, b) for w, (a, b) in numbers.items()}
    made = [_trained(words, _offending(words, ratio), landmarks, negatives) for ratio in (sure, likely)]
    if made[LIKELY] is None:
        return flat
    none = (np.zeros(_LETTERS**3), -1.0)
    weight = np.stack([(m or none)[0] for m in made], 1).astype(np.float32)
    bias = np.array([(m or none)[1] for m in made])
    raw = ToxicityModel(weight, bias, (0.0, 0.0), (None, None), share, "raw")
    curve = [(ws, y) for y in (0, 1) for i, ws in enumerate(parts[y]) if i % 3 == 0 or few[y]]
    truth = np.array([y for _, y in curve])
    distinct = sorted(set().union(*(ws for ws, _ in curve)))
    known = dict(zip(distinct, _decisions(raw, distinct).tolist(), strict=True))
    top = np.array([max((known[w][SURE] for w in ws), default=bias[SURE]) for ws, _ in curve])
    n = np.array([len(ws) for ws, _ in curve], float)
    hits = np.array([_times(ws, {w for w in ws if known[w][LIKELY] >= MARGIN}) for ws, _ in curve])
    rates = [(hits[truth == y].sum() + 1.0 - 0.5 * y) / (n[truth == y].sum() + 2.0) for y in (1, 0)]
    if rates[0] <= rates[1]:
        return flat
    balance = np.where(truth == 1, share / max(1, (truth == 1).sum()), (1 - share) / max(1, (truth == 0).sum())) * len(truth)
    curves: list[tuple[float, float] | None] = []
    for machine, x in ((SURE, top), (LIKELY, _ratio(hits, n, (rates[0], rates[1])))):
        slope, intercept = logistic_1d(x, truth, balance)
        curves.append((max(slope, 0.0), intercept) if made[machine] else None)
    return ToxicityModel(weight, bias, (rates[0], rates[1]), (curves[0], curves[1]), share, f"{hash((weight.tobytes(), bias.tobytes()))}")


_words: dict[str, tuple[dict[str, float], set[str]]] = {}


def scores(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    """The score of each text; words are judged once per worker."""
    claim("toxicity", _words.clear)
    if model.curves[LIKELY] is None:
        return np.full(len(texts), model.share)
    sure, likely = _words.setdefault(model.key, ({}, set()))
    top, hits, n = np.full(len(texts), model.bias[SURE]), np.zeros(len(texts)), np.zeros(len(texts))
    for start in range(0, len(texts), 200):
        lists = [tokens(t) if t else [] for t in texts[start : start + 200]]
        own = [set(ws) for ws in lists]
        new = sorted(set().union(*own).difference(sure))
        if len(sure) + len(new) > _CACHE_WORDS:
            sure.clear()
            likely.clear()
            new = sorted(set().union(*own))
        value = _decisions(model, [letters(w) for w in new])
        sure.update(zip(new, value[:, SURE].tolist(), strict=True))
        likely.update(new[k] for k in np.flatnonzero(value[:, LIKELY] >= MARGIN))
        for i, (ws, distinct) in enumerate(zip(lists, own, strict=True), start):
            if ws:
                top[i], n[i] = max(map(sure.__getitem__, distinct)), len(ws)
                if found := distinct & likely:
                    hits[i] = _times(ws, found)
    p = np.ones(len(texts))
    for curve, x in zip(model.curves, (top, _ratio(hits, n, model.rates)), strict=True):
        if curve:
            p *= 1.0 - sigmoid(curve[0] * x + curve[1])
    return 1.0 - p


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Appends score and predicted; one row in, one row out, no shuffle."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(column: pa.Array):
        s = scores(model, column.to_pylist())
        return pa.array(s), pa.array((s >= threshold).astype(np.int32))

    return map_texts(docs, text, run, fields, keep)
