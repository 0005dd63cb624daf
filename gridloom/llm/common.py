"""Pieces shared by the training-data operators: shared folder, hash sampling of labelled rows, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.shared import checkpointed, scratch, shared_folder, written

__all__ = ["checkpointed", "claim", "crc_mod", "labelled_texts", "logistic_1d", "map_texts", "sampled_by_class", "scratch", "shared_folder", "sided", "sigmoid", "table", "tune", "unit_hash", "written"]

#: Words are runs of anything but the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts don't add up in a Python worker. Plans run when their rows are asked for, so the session keeps these two settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Reads a table with only the named columns, so that extra ones never reach an operator."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def crc_mod(key: str, m: int) -> Column:
    """crc32 of the key's text modulo m."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % m


#: Tables of a join's smaller side are broadcast up to so many rows (some 5 MB with a few numbers each).
SIDE_ROWS = 50_000


def sided(df: DataFrame, few: bool) -> DataFrame:
    """The smaller side of a join: broadcast where its rows are few, else never.

    Left alone, Spark guesses from the sizes of files or stages, which know neither compression nor what an explode makes of a row, and the driver builds tables many times as large.
    """
    return F.broadcast(df) if few else df.hint("merge")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def sampled_by_class(rows: DataFrame, key: str, label: str, per_class: int, seed: int = 7, most: int = 256) -> tuple[DataFrame, dict]:
    """Rows whose hash falls below per_class / (rows of the class), and the rows of each class.

    About per_class rows of every class remain whatever the table's size; null labels and null keys go. Only the `most` largest classes are
    learned, so that a dirty label column can't make the model or the driver's table grow with the rows.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    largest = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(most)
    counts = {r[label]: r["n"] for r in largest.collect()}
    rate = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(rate)
    return rows.where(unit_hash(F.col(key), seed) < rate), counts


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, longest: int = 400_000) -> tuple[list[tuple[str, int]], dict]:
    """(text, label) of a bounded hash sample of labelled documents, in a fixed order, and the counts of the classes.

    At most about per_class documents of each class, none above `longest` characters, so the driver holds a bounded
    amount. A doc_id that is repeated counts once, with its highest label and its first text.
    """
    chosen, counts = sampled_by_class(labels.where(keep).select("doc_id", F.col(label).alias("y")), "doc_id", "y", per_class)
    chosen = F.broadcast(chosen.groupBy("doc_id").agg(F.max("y").alias("y")))
    rows = (
        docs.select("doc_id", "text")
        .join(chosen, "doc_id")
        .where(F.col("text").isNotNull() & (F.length("text") <= longest))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("y").alias("y"))
        .collect()
    )
    return [(r["text"], int(r["y"])) for r in sorted(rows, key=lambda r: r["doc_id"])], counts


def map_texts(df: DataFrame, text: str, fn: Callable[..., Sequence[pa.Array]], fields: Sequence[T.StructField], keep: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Appends the arrays that fn makes of the columns `text` and `also`, batch by batch; of the other columns those in keep remain."""
    kept = [c for c in keep if c not in {f.name for f in fields}]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    read = [text, *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                column = lambda c, b=b: b.column(b.schema.get_field_index(c))
                made = fn(*map(column, read))
                yield pa.RecordBatch.from_arrays([*map(column, kept), *made], names=[*kept, *(f.name for f in fields)])

    return df.select(*dict.fromkeys([*kept, *read])).mapInArrow(run, schema)


_owner: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Gives this worker's memory to one operator: what another one has stored goes first, since workers outlive stages."""
    if name not in _owner:
        for drop in _owner.values():
            drop()
        _owner.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _owner[name] = clear


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def logistic_1d(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression on one feature, by Newton's method."""
    w = np.ones_like(x) if weight is None else weight
    features = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    # Platt's targets keep the slope finite where the classes separate
    n1, n0 = max(1.0, float((y == 1).sum())), max(1.0, float((y == 0).sum()))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(rounds):
        p = sigmoid(features @ beta)
        g = features.T @ (w * (p - t)) + ridge * beta
        h = (features * (w * p * (1 - p) + 1e-9)[:, None]).T @ features + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])

