"""Quality by compression: two zstandard dictionaries, one of good and one of bad text.

A text is cut into blocks of BLOCK bytes, so that the dictionary and not the text's own beginning explains each block.
Every block is compressed under both dictionaries; the difference of the compressed sizes over the text's own size, taken over the
whole text, is the one feature (over the compressed sizes instead, text that repeats itself would count for as much as prose: both sizes are small then). It is
taken as its distance from the border between the classes, squashed, so that single outliers don't bend the curve. A logistic curve fitted on labelled texts that served neither dictionary turns it
into the probability of label 1, with the classes weighted as the labels have them. Short texts hold little evidence: a text of EVIDENCE bytes lies half way
between the share of label 1 and the curve.

Null and empty texts have difference 0 and get the share of label 1. With fewer than two classes of labels every text
gets the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import claim, labelled_texts, logistic_1d, map_texts, sigmoid

BLOCK = 512
LEVEL = 3
EVIDENCE = 64


@dataclass(frozen=True)
class CompressionModel:
    """border, spread: of the difference, from which the curve's distance is squashed; prior: the log-odds of label 1."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    border: float = 0.0
    spread: float = 1.0
    prior: float = 0.0

    def scores(self, differences: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of texts by their differences and sizes in bytes."""
        curve = self.slope * np.tanh((differences - self.border) / self.spread) + self.intercept
        told = sizes / (sizes + EVIDENCE)
        return sigmoid(told * curve + (1 - told) * self.prior)


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary; where zstandard finds too little in the samples, the raw text serves as content."""
    blocks = [b for t in texts for b in _blocks(t.encode("utf-8", "replace"))]
    whole = b"".join(blocks)
    try:
        return zstandard.train_dictionary(min(size, max(1024, len(whole) // 4)), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


_compressors: dict[tuple[int, int], tuple] = {}


def _pair(model: CompressionModel) -> tuple:
    key = (hash(model.good), hash(model.bad))
    if key not in _compressors:
        claim("compression", _compressors.clear)
        _compressors.clear()
        made = []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content)
            if content:
                d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d if content else None, write_content_size=False, write_dict_id=False))
        _compressors[key] = tuple(made)
    return _compressors[key]


def difference(model: CompressionModel, text: str | None) -> tuple[float, int]:
    """(size under bad - size under good) / size, and the size in bytes; positive where the text is more like the good ones."""
    if not text:
        return 0.0, 0
    good, bad = _pair(model)
    data = text.encode("utf-8", "replace")
    gain = 0
    for block in _blocks(data):
        gain += len(bad.compress(block)) - len(good.compress(block))
    return gain / len(data), len(data)


def _border(x: np.ndarray, y: np.ndarray) -> float:
    """The value that parts the classes with the fewest errors, each class weighing the same; in the middle of its gap."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    weight = np.where(y == 1, 1.0 / (y == 1).sum(), -1.0 / (y == 0).sum())
    errors = np.concatenate([[0.0], np.cumsum(weight)])  # of calling the first k bad, but for a constant
    k = int(errors.argmin())
    return float((x[max(k - 1, 0)] + x[min(k, len(x) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, label: str = "quality", per_class: int = 1000, dictionary_bytes: int = 110 << 10) -> CompressionModel:
    """Fits on about per_class labelled documents of each class, chosen by hash: every other one feeds a dictionary, the rest the curve."""
    sample, counts = labelled_texts(docs, labels, label, trainable, per_class)
    seen = {int(k): v for k, v in counts.items()}
    total = sum(seen.values())
    share = seen.get(1, 0) / total if total else 0.5
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    flat = CompressionModel(b"", b"", 0.0, prior, prior=prior)
    if len({y for _, y in sample}) < 2:
        return flat
    for_dictionary, for_curve = [], []
    for y in (0, 1):
        own = [t for t, v in sample if v == y]
        for_dictionary.append(own[::2])
        for_curve += [(t, y) for t in own[1::2] or own]
    raw = CompressionModel(_dictionary(for_dictionary[1], dictionary_bytes), _dictionary(for_dictionary[0], dictionary_bytes), 0.0, 0.0)
    x, y = np.array([difference(raw, t)[0] for t, _ in for_curve]), np.array([v for _, v in for_curve])
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    border = _border(x, y)
    spread = max((float(np.median(x[y == 1])) - border) / 2, 1e-6)
    slope, intercept = logistic_1d(np.tanh((x - border) / spread), y, weight)
    return CompressionModel(raw.good, raw.bad, max(slope, 0.0), intercept, border, spread, prior)


def score(docs: DataFrame, model: CompressionModel, keep: list[str], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Appends difference, score and predicted; one row in, one row out, no shuffle."""
    fields = [T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(column: pa.Array):
        made = np.array([difference(model, t) for t in column.to_pylist()], float).reshape(-1, 2)
        d, s = made[:, 0].copy(), model.scores(made[:, 0], made[:, 1])
        return pa.array(d), pa.array(s), pa.array((s >= threshold).astype(np.int32))

    return map_texts(docs, text, run, fields, keep)
