"""Nearest neighbours by inner product: a block matrix join with int8 tiles, exact results.

Vectors are packed into blocks where they are read, and quantised there, once: int8 codes, a scale for each vector, and the norms that bound the error. Queries and candidates meet in a grid of cells (a group of query blocks, a group of candidate
blocks) through an equi-join on the cell, so no cell grows with the table: more rows make more cells. For each tile the int8
product (float32 arithmetic over at most EXACT dimensions at a time, in which sums of int8 products are whole numbers that it holds exactly) gives all inner products with a bound on the quantisation error; a candidate survives if its upper bound
reaches the k-th best lower bound of its query. Survivors are recomputed from the original floats in double precision, summed in component
order, and the best of each query are kept while the tiles of its block pass, then merged by heaps over cells.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, and vectors of different lengths aren't compared.
Blocks keep the original floats beside the codes, since ties (a vector that a third of the rows share) must be cut to k inside a tile, by exact values, before anything leaves it.
Rows with the query's own id are never its neighbours; rows that repeat an id count once: of different vectors under one id the first in array order stands for it. Ties go to the smaller id. Queries with fewer
candidates than k return all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Blocks on each side of a cell.
CELL_QUERIES, CELL_CANDIDATES = 32, 32
#: 127 * 127 * 1024 is below 2**24, up to which float32 holds whole numbers.
EXACT = 1024
#: Query blocks whose best are held in a task at once.
HELD = 16
#: codes: int8 by vector; figures: scale, norm of what the codes leave out, norm of the codes, norm of the vector.
_PACKED = "dim int, ids binary, vectors binary, codes binary, figures binary"


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _pack(most: int):
    """Gathers rows (id, vector) into blocks of up to `most` vectors of one length; an id counts once in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, np.ndarray]] = {}

        def block(dim: int) -> pa.RecordBatch:
            own = held.pop(dim)
            ids = np.array(sorted(own), np.int64)
            vectors = np.stack([own[i] for i in ids.tolist()])
            codes, figures = _quantised(vectors)
            binary = [pa.array([x.tobytes()]) for x in (ids, vectors, codes, figures)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *binary], names=["dim", "ids", "vectors", "codes", "figures"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for k, i in enumerate(ids.tolist()):
                v = flat[offsets[k] : offsets[k + 1]]
                own = held.setdefault(len(v), {})
                own.setdefault(i, v)
                if len(own) >= most:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def _quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes, and the figures of each vector."""
    scale = np.abs(v).max(1) / 127.0
    scale[scale == 0] = np.finfo(float).tiny  # a vector of nothing but the least numbers
    codes = np.clip(np.rint(v / scale[:, None]), -127, 127).astype(np.int8)
    near = codes * scale[:, None]
    norm = lambda x: np.linalg.norm(x, axis=1)
    return codes, np.stack([scale, norm(v - near), norm(near), norm(v)])


def _bounded(q: np.ndarray, q_figures: np.ndarray, c: np.ndarray, c_figures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All inner products by the codes, and how far they may be from those of the vectors."""
    whole = np.zeros((len(q), len(c)), np.float64 if q.shape[1] > EXACT else np.float32)
    for d in range(0, q.shape[1], EXACT):
        whole += q[:, d : d + EXACT].astype(np.float32) @ c[:, d : d + EXACT].astype(np.float32).T
    near = whole * q_figures[0][:, None] * c_figures[0][None, :]
    # what the codes leave out, and the rounding of the float sums themselves
    rounding = 1e-15 * q.shape[1] * (q_figures[3][:, None] * c_figures[3][None, :])
    return near, (q_figures[1][:, None] * c_figures[3][None, :] + q_figures[2][:, None] * c_figures[1][None, :]) * (1 + 1e-9) + rounding


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in component order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for ids, query, found, score in best.values():
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])
            best.clear()

        for b in batches:
            for r in range(b.num_rows):
                dim, raw = b.column("dim")[r].as_py(), lambda name, r=r: b.column(name)[r].as_py()  # noqa: B023
                key = raw("q_ids")
                q_ids, q = np.frombuffer(key, np.int64), np.frombuffer(raw("q_vectors")).reshape(-1, dim)
                c_ids, c = np.frombuffer(raw("ids"), np.int64), np.frombuffer(raw("vectors")).reshape(-1, dim)
                if key not in best and len(best) >= HELD:
                    yield from flushed()
                _, query, found, score = best.setdefault(key, [q_ids, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)])
                codes = lambda name, dim=dim, raw=raw: np.frombuffer(raw(name), np.int8).reshape(-1, dim)
                figures = lambda name, raw=raw: np.frombuffer(raw(name)).reshape(4, -1)
                near, bound = _bounded(codes("q_codes"), figures("q_figures"), codes("codes"), figures("figures"))
                own = q_ids[:, None] == c_ids[None, :]
                lower = np.where(own, -np.inf, near - bound)
                least = np.full(len(q), -np.inf)
                if len(c) > k:
                    least = np.partition(lower, len(c) - k, axis=1)[:, len(c) - k]
                full = np.bincount(query, minlength=len(q)) >= k  # those have a k-th best already
                if full.any():
                    worst = np.full(len(q), np.inf)
                    np.minimum.at(worst, query, score)
                    least = np.where(full, np.maximum(least, worst), least)
                i, j = np.nonzero((near + bound >= least[:, None]) & ~own)
                i, found, score = np.concatenate([query, i]), np.concatenate([found, c_ids[j]]), np.concatenate([score, _dots(q[i], c[j])])
                order = np.lexsort((found, -score, i))
                i, found, score = i[order], found[order], score[order]
                first = np.ones(len(i), bool)
                first[1:] = (i[1:] != i[:-1]) | (found[1:] != found[:-1])
                i, found, score = i[first], found[first], score[first]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                top = rank < k
                best[key][1:] = [i[top], found[top], score[top]]
        yield from flushed()

    return run


def _merge(k: int):
    """The k best of each query by heaps; rows come sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap, ids = None, [], set()

        def ranked() -> pa.RecordBatch:
            rows = sorted(((-s, -i) for s, i in heap))
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([query] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([i for _, i in rows], pa.int64()), pa.array([-s for s, _ in rows], pa.float64())],
                names=["query_id", "rank", "vec_id", "score"],
            )

        for b in batches:
            for q, v, s in zip(*(b.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != query:
                    if heap:
                        yield ranked()
                    query, heap, ids = q, [], set()
                if v not in ids:
                    entry = (s, -v)  # the heap's root is the worst of the best
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                        ids.add(v)
                    elif entry > heap[0]:
                        ids.discard(-heapq.heapreplace(heap, entry)[1])
                        ids.add(v)
        if heap:
            yield ranked()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each row where is_query holds.

    vectors has vec_id (an integer) and embedding (an array of numbers).
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # vectors move only where an id is repeated
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    candidates = written(rows.mapInArrow(_pack(CANDIDATE_BLOCK), _PACKED))
    queries = written(rows.where(is_query).mapInArrow(_pack(QUERY_BLOCK), _PACKED))
    n_queries, n_candidates = queries.count(), candidates.count()
    high = max(1, -(-n_queries // CELL_QUERIES))
    wide = max(1, -(-n_candidates // CELL_CANDIDATES), min(n_candidates, -(-vectors.sparkSession.sparkContext.defaultParallelism // high)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    left = queries.select("dim", F.col("ids").alias("q_ids"), *(F.col(c).alias(f"q_{c}") for c in ("vectors", "codes", "figures")), group(high).alias("h")).withColumn("w", each(wide))
    right = candidates.select("dim", "ids", "vectors", "codes", "figures", group(wide).alias("w")).withColumn("h", each(high))
    tiles = left.join(right.hint("merge"), ["h", "w", "dim"]).drop("h", "w")
    found = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
