"""Learned decision lists over text statistics, emitted as ordered Spark conditional expressions.

`statistics` measures every text. `learn` covers the bad labelled texts by rules one after the other: a rule grows by the threshold
condition with the most information gain, is pruned on held-back rows from its end, and joins the list while it is right
more often than not on these; texts it covers leave before the next one is sought. `dropped_by` turns the list into one CASE expression that drops what
the first matching rule drops and keeps the rest. The thresholds are readable and the expression runs inside code generation.

Null texts have zeros everywhere. Ratios over zero words are 0. Without labels of both classes the list is empty: all is kept.
Repeated rows are measured each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import words as W
from gridloom.llm.common import map_texts

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_distinct")
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
#: What conditions look at: name, numerator, denominator.
RATIOS = (
    ("word_length", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("exclaims_per_word", "n_exclaims", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("words", "n_words", None),
)


def _sums(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:], dtype=np.int64)
    return total[bounds[1:]] - total[bounds[:-1]]


def _measure(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    n = len(bounds) - 1
    start, end, at = W.find_words(data, bounds)
    sums = W.prefix_sums(data)
    word = W.spans(sums, start, end)
    n_words = np.diff(at)
    chars = _sums(((data & 0xC0) != 0x80) & ~W.BLANK[data], bounds)
    symbols = _sums(_SYMBOL[data], bounds)
    upper = _sums((data >= 65) & (data <= 90), bounds)
    exclaims = _sums(data == 33, bounds)
    # lines that hold a word: from each line break or text start to the next
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(breaks + 1, bounds[:-1])
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    owner = np.searchsorted(bounds, line_start, "right") - 1
    line_end = line_end - (data[np.maximum(line_end - 1, 0)] == 10) * (line_end > line_start)
    has = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    owner, hashed = owner[has], W.spans(sums, line_start[has], line_end[has])
    n_lines = np.bincount(owner, minlength=n)
    order = np.lexsort((hashed, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
    n_dup = np.bincount(owner[order][1:][same], minlength=n)
    repeat, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.flatnonzero(n_words):
        own = word[at[i] : at[i + 1]]
        distinct[i] = len(np.unique(own))
        threes = W.windows(own, 3)
        if len(threes) > 1:
            order = np.argsort(threes)
            s = threes[order]
            equal = s[1:] == s[:-1]
            if equal.any():
                twice = np.zeros(len(s), bool)
                twice[1:] |= equal
                twice[:-1] |= equal
                covered = np.zeros(len(own), bool)
                where = order[twice]
                covered[where] = covered[where + 1] = covered[where + 2] = True
                repeat[i] = covered.sum()
    return [n_words, chars, symbols, n_dup, repeat, n_lines, upper, exclaims, distinct]


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Appends STATISTICS of each whole text; one row in, one row out, no shuffle.

    n_repeat_words counts the words that lie in a window of three words found at least twice in the text; n_dup_lines the
    lines with a word that equal an earlier line; word_chars code points in words; n_upper ASCII capitals.
    """
    fields = [T.StructField(s, T.LongType()) for s in STATISTICS]

    def run(column: pa.Array):
        offsets, data = W.buffers(column)
        parts = []
        for i, j in W.pieces(offsets):
            bounds = offsets[i : j + 1]
            parts.append(_measure(data[bounds[0] : bounds[-1]], bounds - bounds[0]))
        return [pa.array(np.concatenate(p).astype(np.int64)) for p in zip(*parts, strict=True)]

    return map_texts(docs, text, run, fields, keep)


def ratio(name: str) -> Column:
    top, bottom = next((t, b) for n, t, b in RATIOS if n == name)
    if bottom is None:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


@dataclass(frozen=True)
class Rule:
    """Conditions (ratio, '>' or '<=', threshold) that must all hold for a text to be dropped."""

    conditions: tuple[tuple[str, str, float], ...]

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {t:.6g}" for n, o, t in self.conditions)


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    names = [r[0] for r in RATIOS]
    for name, op, t in conditions:
        column = x[:, names.index(name)]
        out &= column > t if op == ">" else column <= t
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    """Adds the condition with the largest gain (positives covered times the rise of their log share) until no clean text is covered."""
    conditions: list[tuple[str, str, float]] = []
    covered = np.ones(len(x), bool)
    while len(conditions) < most and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for c, (name, *_) in enumerate(RATIOS):
            v, b = x[covered, c], bad[covered]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p, a = np.cumsum(b)[cut], cut + 1
            for op, pos, n in (("<=", p, a), (">", p0 - p, p0 + n0 - a)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / n) - base), 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        covered &= _holds(x, [best[1]])
    return conditions


def learn(rows: list[tuple], most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9) -> list[Rule]:
    """A decision list from (key, label, *STATISTICS) rows; label 0 is what rules are to find. Rows are taken in key order."""
    rows = sorted(rows, key=lambda r: r[0])
    bad = np.array([r[1] == 0 for r in rows], bool)
    if not len(rows) or bad.all() or not bad.any():
        return []
    raw = {s: np.array([r[2 + i] for r in rows], float) for i, s in enumerate(STATISTICS)}
    x = np.stack([raw[t] if b is None else np.where(raw[b] > 0, raw[t] / np.maximum(raw[b], 1), 0.0) for _, t, b in RATIOS], 1)
    held = np.random.default_rng(9).permutation(len(rows)) % 3 == 0
    rules: list[Rule] = []
    left = np.ones(len(rows), bool)
    while len(rules) < most_rules and (left & ~held & bad).sum() >= 3:
        conditions = _grow(x[left & ~held], bad[left & ~held], most_conditions)
        xs, ys = x[left & held], bad[left & held]

        def worth(cs, xs=xs, ys=ys) -> float:
            hit = _holds(xs, cs)
            p, n = (hit & ys).sum(), (hit & ~ys).sum()
            return (p - n) / max(1, p + n)

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        hit = _holds(x, conditions) & left
        if not conditions or (hit & bad).sum() < least_precision * hit.sum():
            break
        rules.append(Rule(tuple(conditions)))
        left &= ~hit
    return rules


def dropped_by(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        fits = F.lit(True)
        for name, op, t in rules[k - 1].conditions:
            fits = fits & (ratio(name) > t if op == ">" else ratio(name) <= t)
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
