"""Arrays as DataFrames: reads, updates, layouts.

Three layouts of one array:
- cells: index columns i0.. and the element v; what isn't there is the fill value
- chunks: chunk columns c0.. and data, the chunk's elements in C order
- blobs: a store key and the encoded chunk

A read of a box takes the chunks that the grid derives from the box: of a stored array their files are opened one by one by the executors, without a shuffle, and only the parts that
the box touches are decoded; of a table of chunks the scan is pruned by c0... Missing chunks are filled as whole chunks, so no single cell is joined or shuffled.
Cells become chunks by one shuffle on the chunk numbers and one Arrow stage that puts them in place. Nothing is collected but by `to_numpy`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import prod
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.boxes import Box, Indexer, OutOfBoundsError, div, unravel_columns
from gridloom.functions.dtypes import DataType, same_bits
from gridloom.functions.grids import GRIDS, Grid
from gridloom.plans.meta import ArrayMeta
from gridloom.plans.shared import bounded

#: Index lists are broadcast up to so many entries (driver-made lists: they come from memory).
BROADCAST_INDICES = 200_000
#: Elements that an Arrow stage has in hand at once, and that its batches hold; a larger chunk is taken alone.
ELEMENTS = 1 << 18


def index_names(dims: int, prefix: str = "i") -> list[str]:
    return [f"{prefix}{k}" for k in range(dims)]


def ravel_in_chunk(meta: ArrayMeta, index: Sequence[Column], chunk: Sequence[Column]) -> Column:
    """The C-order place of an element in its chunk."""
    grid, out = meta.grid, F.lit(0).cast("long")
    for i, o, e in zip(index, grid.origin_columns(chunk), grid.edge_columns(chunk), strict=True):
        out = out * e + (i - o)
    return out


def fill_column(meta: ArrayMeta, kind: T.DataType) -> Column:
    """The fill value as a literal of the element column's type."""
    fill = meta.fill
    if fill is None:
        return F.lit(None).cast(kind)
    if meta.dtype.small or meta.dtype.name == "bfloat16":
        fill = float(meta.dtype.unpack(np.array([fill]))[0])
    value = fill.item() if isinstance(fill, np.generic) and fill.dtype.kind not in "mMV" else int(fill.astype("i8")) if isinstance(fill, np.generic) and fill.dtype.kind in "mM" else fill
    return F.lit(bytes(value) if isinstance(value, np.void) else value).cast(kind)


def is_fill(v: Column, meta: ArrayMeta, kind: T.DataType) -> Column:
    """Whether an element has the fill value's bits: for floats, -0.0 isn't 0.0 and NaN is NaN."""
    fill = fill_column(meta, kind)
    same = v.eqNullSafe(fill)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return same & v.cast("string").eqNullSafe(fill.cast("string"))
    return same


@dataclass(frozen=True)
class ArrayFrame:
    """An array: metadata and its stored chunks as a DataFrame (c0.., data).

    stored: where the chunks lie in a store, if the frame is an unchanged view of it. numbers: the chunk numbers that `chunks` holds, where a table
    gives them without the data (a Parquet scan of c0..). made: makes a range of the chunks from their source, so that a read of a box filters the source's rows first.
    """

    meta: ArrayMeta
    chunks: DataFrame
    stored: Any = None
    numbers: DataFrame | None = None
    made: Callable[[Box], DataFrame] | None = None

    # building

    @staticmethod
    def from_cells(meta: ArrayMeta, cells: DataFrame, value: str = "v") -> ArrayFrame:
        """Groups cells (i0.., value) into dense chunks. One task owns a chunk; a cell given twice takes the larger value."""
        kind, named = cells.schema[value].dataType, cells.withColumnRenamed(value, "v")

        def made(chunks: Box | None) -> DataFrame:
            near = named if chunks is None else named.where(meta.grid.chunks_subset(chunks).predicate(index_names(meta.dims)))
            return bounded(placed_cells(meta, near)).mapInArrow(_scatter(meta, kind), _chunk_schema(meta, kind))

        return ArrayFrame(meta, made(None), made=made)

    @staticmethod
    def from_rows(meta: ArrayMeta, rows: DataFrame, index: str, vector: str) -> ArrayFrame:
        """A 2-d array from rows that each hold one line of it: lines are sliced by chunk, so no single cells are shuffled. A line given twice takes the larger one."""
        line, column = meta.grid.axes
        kind = rows.schema[vector].dataType.elementType

        def made(chunks: Box | None) -> DataFrame:
            first, last, near = 0, column.count - 1, rows
            if chunks is not None:
                box = meta.grid.chunks_subset(chunks)
                near = rows.where((F.col(index) >= box.start[0]) & (F.col(index) < box.end[0]))
                first, last = chunks.start[1], chunks.last[1]
            sliced = near.select(F.col(index).cast("long").alias("i0"), F.col(vector).alias("line")).select(
                line.chunk_column(F.col("i0")).alias("c0"), "i0", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("c1"), "line"
            )
            start, n = column.origin_column(F.col("c1")).cast("int"), column.edge_column(F.col("c1")).cast("int")
            cut = sliced.where(F.col("c0").isNotNull()).select("c0", "c1", "i0", F.slice("line", start + 1, n).alias("part"))
            once = cut.repartition("c0", "c1").groupBy("c0", "c1", "i0").agg(F.max("part").alias("part"))
            place = (F.col("i0") - line.origin_column(F.col("c0"))) * column.edge_column(F.col("c1"))
            grouped = once.groupBy("c0", "c1").agg(F.collect_list(F.struct(place.alias("k"), F.col("part").alias("v"))).alias("m"))
            return bounded(grouped).mapInArrow(_scatter(meta, kind), _chunk_schema(meta, kind))

        return ArrayFrame(meta, made(None), made=made)

    @staticmethod
    def of_table(meta: ArrayMeta, table: DataFrame) -> ArrayFrame:
        """An array whose chunks (c0.., data) are a table that gives single columns cheaply, as Parquet does."""
        return ArrayFrame(meta, table, numbers=table.select(*index_names(meta.dims, "c")))

    @staticmethod
    def empty(spark: SparkSession, meta: ArrayMeta) -> ArrayFrame:
        c = [f"{n} bigint" for n in index_names(meta.dims, "c")]
        return ArrayFrame(meta, spark.createDataFrame([], ", ".join([*c, f"data array<{meta.dtype.spark}>"])))

    @property
    def c(self) -> list[str]:
        return index_names(self.meta.dims, "c")

    @property
    def i(self) -> list[str]:
        return index_names(self.meta.dims)

    @property
    def element(self) -> T.DataType:
        return self.chunks.schema["data"].dataType.elementType

    def without_fill(self) -> ArrayFrame:
        """Drops chunks of nothing but fill values, unless the array stores these too."""
        if self.meta.options.store_empty_chunks:
            return self
        return self._changed(self.chunks.where(~F.forall("data", lambda v: is_fill(v, self.meta, self.element))))

    # layouts

    def cells(self, chunks: DataFrame | None = None) -> DataFrame:
        """Stored elements with their indices, beyond the array's shape too."""
        grid, c = self.meta.grid, [F.col(n) for n in self.c]
        rows = (self.chunks if chunks is None else chunks).select(*self.c, F.posexplode("data").alias("k", "v"))
        offsets, rest = [], F.col("k").cast("long")
        for e in reversed(grid.edge_columns(c)):
            offsets.append(rest % e)
            rest = div(rest, e)
        index = [o + d for o, d in zip(grid.origin_columns(c), reversed(offsets), strict=True)]
        return rows.select(*(x.alias(n) for x, n in zip(index, self.i, strict=True)), "v")

    def prune(self, box: Box) -> DataFrame:
        """The stored chunks that a box touches."""
        return self._chunks_of(self._touched(box))

    def _touched(self, box: Box) -> Box:
        chunks = self.meta.grid.chunks_in(box)
        if chunks is None:
            raise OutOfBoundsError(f"{box} lies outside the grid")
        return chunks

    def _chunks_of(self, chunks: Box) -> DataFrame:
        if self.stored:
            return self.stored.chunks(self.meta, chunks)
        if self.made and not chunks.is_empty:
            return self.made(chunks).where(chunks.predicate(self.c))
        return self.chunks.where(chunks.predicate(self.c))

    # reads

    def _filled(self, chunks: Box) -> DataFrame:
        """All chunks of a range (c0.., data), those that aren't stored full of fill values."""
        spark, kind = self.chunks.sparkSession, T.ArrayType(self.element)
        size = reduce(lambda a, b: a * b, self.meta.grid.edge_columns([F.col(n) for n in self.c]), F.lit(1).cast("long")).cast("int")
        empty = F.array_repeat(fill_column(self.meta, self.element), size).cast(kind)
        domain, held = chunks.domain(spark, self.c), self._chunks_of(chunks).select(*self.c, "data")
        if self.numbers is not None:  # only numbers meet; the data stays where it is
            missing = domain.join(self.numbers.where(chunks.predicate(self.c)), self.c, "left_anti")
            return held.unionByName(missing.select(*self.c, empty.alias("data")))
        return domain.hint("shuffle_hash").join(held, self.c, "left").select(*self.c, F.coalesce("data", empty).alias("data"))

    def subset(self, box: Box) -> DataFrame:
        """All elements of a box: i0.., v."""
        if box.is_empty:
            box._same(self.meta.shape)
            return box.domain(self.chunks.sparkSession, self.i).withColumn("v", fill_column(self.meta, self.element))
        touched = self._touched(box)
        if self.stored:
            return self.stored.cells(self.meta, box)
        return self.cells(self._filled(touched)).where(box.predicate(self.i))

    def chunk(self, *chunk: int) -> DataFrame:
        """One row: the chunk's data, all fill values when it isn't stored."""
        return self._filled(Box(tuple(chunk), (1,) * len(chunk))).select("data")

    def chunk_if_exists(self, *chunk: int) -> DataFrame:
        """The stored chunk, or no row."""
        return self._chunks_of(Box(tuple(chunk), (1,) * len(chunk)))

    def chunk_box(self, chunks: Box) -> DataFrame:
        """All elements of a range of chunks."""
        return self.subset(self.meta.grid.chunks_subset(chunks))

    def chunk_subset(self, chunk: Sequence[int], box: Box) -> DataFrame:
        """A box relative to one chunk, which must lie in it."""
        own = self.meta.grid.subset(chunk)
        if not box.fits(own.shape):
            raise OutOfBoundsError(f"{box} outside a chunk of {own.shape}")
        return self.subset(box.offset(own.start))

    def gather(self, indexer: Indexer) -> DataFrame:
        """Elements in the indexer's order, repeats kept: ord, i0.., v."""
        indexer.check(self.meta.shape)
        wanted = indexer.rows(self.chunks.sparkSession, self.i)
        placed = wanted.select("*", *(x.alias(n) for x, n in zip(self.meta.grid.chunk_columns([F.col(n) for n in self.i]), self.c, strict=True)))
        if self.stored:
            return self.stored.gather(self.meta, placed)
        listed = [p for p in indexer.parts if not isinstance(p, Box)]
        small = not any(isinstance(p, Box) for p in indexer.parts) and sum(map(len, listed)) <= BROADCAST_INDICES
        touched = placed.select(*self.c).distinct()
        # only chunks that hold a wanted element are exploded
        near = self.chunks.join(F.broadcast(touched) if small else touched, self.c, "left_semi")
        hit = self.cells(near).withColumn("_hit", F.lit(True))
        value = F.when(F.col("_hit"), F.col("v")).otherwise(fill_column(self.meta, self.element))
        return wanted.join(hit, self.i, "left").select("ord", *self.i, value.alias("v"))

    def local_subchunk_grid(self, chunk: Sequence[int], level: int = 0) -> Grid | None:
        """The grid of one stored chunk's inner chunks, with indices relative to the chunk; None where the chunk isn't stored or has none."""
        shapes = self.meta.subchunk_shapes()
        if level >= len(shapes) or self.chunk_if_exists(*chunk).select(*self.c).isEmpty():
            return None
        return GRIDS.get("regular")(self.meta.grid.chunk_shape(chunk), {"chunk_shape": list(shapes[level])})

    def subchunk(self, number: Sequence[int], level: int = 0) -> DataFrame:
        return self.subset(self.meta.subchunk_grid(level).subset(number))

    def subchunks(self, numbers: Box, level: int = 0) -> DataFrame:
        return self.subset(self.meta.subchunk_grid(level).chunks_subset(numbers))

    def value_view(self) -> DataFrame:
        """All elements of the array."""
        return self.subset(Box.whole(self.meta.shape))

    def time_view(self, df: DataFrame) -> DataFrame:
        """Ticks of a time type as timestamps or intervals (s, ms, us); not-a-time becomes null, finer and coarser units stay ticks."""
        unit, scale = self.meta.dtype.config["unit"], self.meta.dtype.config.get("scale_factor", 1)
        micros = {"s": 1_000_000, "ms": 1000, "us": 1}.get(unit)
        ticks = F.when(F.col("v") != -(1 << 63), F.col("v"))
        if micros is None:
            return df.withColumn("v", ticks)
        whole = ticks * (micros * scale)
        if "datetime" in self.meta.dtype.name:
            return df.withColumn("v", F.timestamp_micros(whole).cast("timestamp_ntz"))
        return df.withColumn("v", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (whole / 1_000_000).cast("decimal(18,6)")))

    # updates

    def _changed(self, chunks: DataFrame) -> ArrayFrame:
        return ArrayFrame(self.meta, chunks)

    def store_chunk(self, chunk: Sequence[int], data: Sequence) -> ArrayFrame:
        """Replaces one chunk by a whole one."""
        if len(data) != prod(self.meta.grid.chunk_shape(chunk)):
            raise ValueError(f"{len(data)} elements for a chunk of {self.meta.grid.chunk_shape(chunk)}")
        row = self.chunks.sparkSession.createDataFrame([(*map(int, chunk), list(data))], self.chunks.schema)
        return self._changed(self._erased(Box(tuple(chunk), (1,) * len(chunk))).unionByName(self._changed(row).without_fill().chunks))

    def store_chunks(self, chunks: Box, rows: DataFrame) -> ArrayFrame:
        """Replaces a range of chunks by whole ones (c0.., data); those of the range that rows lack become fill values."""
        new = rows.where(chunks.predicate(self.c)).select(*self.c, F.col("data").cast(self.chunks.schema["data"].dataType).alias("data"))
        return self._changed(self._erased(chunks).unionByName(self._changed(new).without_fill().chunks))

    def store_cells(self, cells: DataFrame, box: Box) -> ArrayFrame:
        """Overwrites the cells of a box (i0.., v). New cells meet the touched chunks chunk by chunk; the other chunks pass through untouched."""
        if box.dims != self.meta.dims:
            box._same(self.meta.shape)
        grid = self.meta.grid
        touched = grid.chunks_in(box)
        if touched is None or not touched.fits(grid.shape):
            raise OutOfBoundsError(f"{box} lies outside the grid")
        if box.is_empty:
            return self
        new = placed_cells(self.meta, cells.where(box.predicate(self.i)).select(*self.i, F.col("v").cast(self.element).alias("v")))
        merged = self._chunks_of(touched).select(*self.c, "data").join(new, self.c, "full_outer")
        rebuilt = bounded(merged).mapInArrow(_scatter(self.meta, self.element), _chunk_schema(self.meta, self.element))
        return self._changed(self._erased(touched).unionByName(rebuilt))

    def store_chunk_subset(self, chunk: Sequence[int], box: Box, cells: DataFrame) -> ArrayFrame:
        """As store_cells, with box and cells relative to one chunk."""
        own = self.meta.grid.subset(chunk)
        if not box.fits(own.shape):
            raise OutOfBoundsError(f"{box} outside a chunk of {own.shape}")
        moved = cells.select(*((F.col(n) + o).alias(n) for n, o in zip(self.i, own.start, strict=True)), "v")
        return self.store_cells(moved, box.offset(own.start))

    def _erased(self, chunks: Box) -> DataFrame:
        return self.chunks.where(~chunks.predicate(self.c))

    def erase_chunk(self, *chunk: int) -> ArrayFrame:
        return self.erase_chunks(Box(tuple(chunk), (1,) * len(chunk)))

    def erase_chunks(self, chunks: Box) -> ArrayFrame:
        """Drops stored chunks; those that aren't there are no error."""
        return self._changed(self._erased(chunks))

    def resize(self, shape: Sequence[int]) -> ArrayFrame:
        """Another shape; chunks stay, so growing shows fill values and shrinking hides elements."""
        return replace(self, meta=self.meta.resized(shape))

    # codecs

    def encode(self) -> DataFrame:
        """Blobs (c0.., key, value): every chunk through the codec chain, in one Arrow stage."""
        meta, c = self.meta, self.c
        keyed = self.chunks.select(*c, meta.keys.column([F.col(n) for n in c]).alias("key"), "data")
        schema = T.StructType([*(keyed.schema[n] for n in c), T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
        return bounded(keyed).mapInArrow(_per_chunk(meta, lambda chain, shape, data: chain.encode(to_numpy(data, meta.dtype, shape)), "data", pa.binary(), "value"), schema)

    @staticmethod
    def decode(meta: ArrayMeta, blobs: DataFrame, element: T.DataType) -> ArrayFrame:
        """Chunks of blobs (c0.., value)."""
        c = index_names(meta.dims, "c")
        schema = T.StructType([*(blobs.schema[n] for n in c), T.StructField("data", T.ArrayType(element))])
        arrow = pa.list_(_arrow_of(element))
        run = _per_chunk(meta, lambda chain, shape, value: chain.decode(value), "value", arrow, "data", drop=("key",), chunks_of=meta.dtype)
        return ArrayFrame(meta, bounded(blobs.select(*c, "value")).mapInArrow(run, schema))

    def mapped(self, meta: ArrayMeta, fn: Callable[[np.ndarray], np.ndarray], element: T.DataType) -> ArrayFrame:
        """Another array of the same grid, chunk by chunk through a numpy function."""
        schema = T.StructType([*(self.chunks.schema[n] for n in self.c), T.StructField("data", T.ArrayType(element))])
        own = self.meta
        run = _per_chunk(own, lambda chain, shape, data: fn(to_numpy(data, own.dtype, shape)), "data", pa.list_(_arrow_of(element)), "data", bound=False, chunks_of=meta.dtype)
        return ArrayFrame(meta, bounded(self.chunks).mapInArrow(run, schema))

    # ends

    def to_numpy(self, box: Box | None = None, most: int = 50_000_000) -> np.ndarray:
        """Collects a box; refuses more than `most` elements."""
        box = box or Box.whole(self.meta.shape)
        if box.size > most:
            raise MemoryError(f"{box.size} elements; at most {most} are collected")
        rows = self.subset(box).toArrow()
        lin = np.zeros(rows.num_rows, np.int64)
        for n, s, e in zip(self.i, box.start, box.shape, strict=True):
            lin = lin * e + rows.column(n).to_numpy() - s
        out = to_numpy(rows.column("v").to_pylist(), self.meta.dtype, (rows.num_rows,))
        made = out.copy()
        made[lin] = out
        return made.reshape(box.shape)

    def cached(self) -> ArrayFrame:
        """Keeps decoded chunks in Spark's storage, which drops the least recently used when memory is short; `release` frees them."""
        return ArrayFrame(self.meta, self.chunks.persist())

    def release(self) -> ArrayFrame:
        self.chunks.unpersist()
        return self


def _arrow_of(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _chunk_schema(meta: ArrayMeta, element: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(n, T.LongType()) for n in index_names(meta.dims, "c")), T.StructField("data", T.ArrayType(element))])


def placed_cells(meta: ArrayMeta, cells: DataFrame) -> DataFrame:
    """c0.., m: the cells (i0.., v) of each chunk as (place in the chunk, value), each place once, with the larger value. One shuffle, on the chunk numbers."""
    i, c = index_names(meta.dims), index_names(meta.dims, "c")
    chunk = meta.grid.chunk_columns([F.col(x) for x in i])
    placed = cells.select(*(x.alias(n) for x, n in zip(chunk, c, strict=True)), *i, "v").where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in c), F.lit(True)))
    lin = ravel_in_chunk(meta, [F.col(x) for x in i], [F.col(x) for x in c])
    placed = placed.select(*c, lin.alias("k"), "v")
    # both groupings find the rows where this one puts them
    once = (placed.repartition(*c) if c else placed.coalesce(1)).groupBy(*c, "k").agg(F.max("v").alias("v"))
    return once.groupBy(*c).agg(F.collect_list(F.struct("k", "v")).alias("m")).where(F.size("m") > 0)


def fill_element(meta: ArrayMeta):
    """The fill value as an element of a column."""
    if meta.fill is None:
        return None
    dtype = meta.dtype.inner or meta.dtype
    if dtype.numpy == object:
        return meta.fill if isinstance(meta.fill, str) else bytes(meta.fill)
    return from_numpy(np.array([meta.fill], dtype.numpy), dtype)[0]


def _equals_fill(values: pa.Array, fill: pa.Array) -> np.ndarray:
    """For each value whether it has the fill value's bits."""
    if fill.null_count:
        return values.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_floating(values.type):
        bits = f"u{values.type.bit_width // 8}"
        same = values.fill_null(0).to_numpy(zero_copy_only=False).view(bits) == fill.to_numpy(zero_copy_only=False).view(bits)[0]
        return same & values.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_nested(values.type):
        want = fill[0].as_py()
        return np.array([v == want for v in values.to_pylist()], bool)
    return pc.fill_null(pc.equal(values, fill[0]), False).to_numpy(zero_copy_only=False)


def _parts(b: pa.RecordBatch, meta: ArrayMeta) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, ...]]]]:
    """A batch in runs of chunks that hold up to ELEMENTS elements, or of a single larger chunk; with the chunks' numbers."""
    names = index_names(meta.dims, "c")
    numbers = list(zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)) if names else [()] * b.num_rows
    start = held = 0
    for k, number in enumerate(numbers):
        size = prod(meta.grid.chunk_shape(number))
        if k > start and held + size > ELEMENTS:
            yield b.slice(start, k - start), numbers[start:k]
            start, held = k, 0
        held += size
    if numbers:
        yield b.slice(start), numbers[start:]


def _scatter(meta: ArrayMeta, element: T.DataType):
    """An Arrow stage that puts cells (k, v in m; v may be a run of elements) into dense chunks: over the old data where there is some, else over fill values.

    Chunks of nothing but fill values are dropped, unless the array stores these too.
    """
    c, arrow, keep_empty = index_names(meta.dims, "c"), _arrow_of(element), meta.options.store_empty_chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, fill = meta.grid, pa.array([fill_element(meta)], arrow)
        for b, numbers in (p for whole in batches for p in _parts(whole, meta)):
            column = lambda n, b=b: b.column(b.schema.get_field_index(n))
            sizes = np.array([prod(grid.chunk_shape(n)) for n in numbers], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            source = np.zeros(at[-1], np.int64)  # where each element comes from; 0 is the fill value
            m = column("m")
            m_at = m.offsets.to_numpy().astype(np.int64)
            cells, m_at = m.values.slice(m_at[0], m_at[-1] - m_at[0]), m_at - m_at[0]
            place, v = cells.field(0).to_numpy(zero_copy_only=False).astype(np.int64), cells.field(1)
            pools = [fill]
            if "data" in b.schema.names:
                data = column("data")
                d_at = data.offsets.to_numpy().astype(np.int64)
                held, d_at = data.values.slice(d_at[0], d_at[-1] - d_at[0]), d_at - d_at[0]
                for r in np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False)):
                    source[at[r] : at[r + 1]] = 1 + np.arange(d_at[r], d_at[r + 1])
                pools.append(held)
            base = sum(map(len, pools))
            shift = np.repeat(at[:-1], np.diff(m_at))  # each cell's chunk
            if pa.types.is_list(v.type):
                v_at = v.offsets.to_numpy().astype(np.int64)
                run_of = np.diff(v_at)
                first = np.repeat(shift + place, run_of)
                step = np.arange(len(first)) - np.repeat(np.cumsum(run_of) - run_of, run_of)
                source[first + step] = base + np.repeat(v_at[:-1] - v_at[0], run_of) + step
                v = v.values.slice(v_at[0], v_at[-1] - v_at[0])
            else:
                source[shift + place] = base + np.arange(len(place))
            values = pa.concat_arrays([*pools, v.cast(arrow)]).take(pa.array(source))
            rows = np.arange(len(sizes))
            if not keep_empty and len(rows):
                other = np.concatenate([[0], np.cumsum(~_equals_fill(values, fill))])
                rows = np.flatnonzero(other[at[1:]] > other[at[:-1]])
                if len(rows) < len(sizes):
                    kept = np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)
                    values = values.filter(pa.array(kept))
            offsets = np.concatenate([[0], np.cumsum(sizes[rows])]).astype(np.int32)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(column(n).take(take) for n in c), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*c, "data"])

    return run


def _per_chunk(meta: ArrayMeta, fn, column: str, arrow: pa.DataType, name: str, bound: bool = True, drop: tuple = (), chunks_of: DataType | None = None):
    """An Arrow stage that maps one column chunk by chunk; the chain is bound once for each chunk shape. chunks_of: fn gives chunks of this type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, chains = meta.grid, {}
        for b, numbers in (p for whole in batches for p in _parts(whole, meta)):
            values, made = b.column(b.schema.get_field_index(column)), []
            for k, number in enumerate(numbers):
                shape = grid.chunk_shape(number)
                if bound and shape not in chains:
                    chains[shape] = meta.chain(shape)
                made.append(fn(chains.get(shape), shape, values[k].as_py() if column == "value" else values[k]))
            kept = [n for n in b.schema.names if n != column and n not in drop]
            column_made = pa.array(made, arrow) if chunks_of is None else chunk_lists(made, arrow, chunks_of)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in kept), column_made], names=[*kept, name])

    return run


def chunk_lists(chunks: list[np.ndarray], arrow: pa.DataType, dtype: DataType) -> pa.Array:
    """Chunks as one Arrow list array; plain numbers go over as buffers, without Python values."""
    if not dtype.is_plain:
        return pa.array([from_numpy(c, dtype) for c in chunks], arrow)
    offsets = np.concatenate([[0], np.cumsum([c.size for c in chunks])]).astype(np.int32)
    flat = np.concatenate([c.ravel() for c in chunks]) if chunks else np.empty(0, dtype.numpy)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(arrow.value_type.to_pandas_dtype()), arrow.value_type))


def to_numpy(values, dtype: DataType, shape: Sequence[int]) -> np.ndarray:
    """Column elements as a numpy array of the type; nulls of optional types are masked."""
    if isinstance(values, pa.ListScalar) and dtype.is_plain and values.values.null_count == 0:
        return values.values.to_numpy(zero_copy_only=False).astype(dtype.numpy).reshape(shape)
    values = values.as_py() if isinstance(values, pa.Scalar) else list(values)
    if dtype.inner is not None:
        mask = [v is None for v in values]
        zero = "" if dtype.inner.name == "string" else b"" if dtype.inner.numpy == object else 0
        data = to_numpy([zero if v is None else v for v in values], dtype.inner, (len(values),))
        return np.ma.masked_array(data, mask).reshape(shape)
    if dtype.numpy == object:
        out = np.empty(len(values), object)
        out[:] = values
        return out.reshape(shape)
    if dtype.small or dtype.name == "bfloat16":
        return dtype.pack(np.array(values, np.float64)).reshape(shape)
    if dtype.numpy.kind in "mM":
        return np.array(values, np.int64).view(dtype.numpy).reshape(shape)
    if dtype.numpy.kind == "V" and dtype.numpy.names is None:
        return np.frombuffer(b"".join(values), dtype.numpy).reshape(shape)
    if dtype.numpy.kind == "c":
        return np.array([complex(v["re"], v["im"]) for v in values], dtype.numpy).reshape(shape)
    if dtype.numpy.kind == "u" and dtype.numpy.itemsize == 8:
        return np.array([int(v) for v in values], dtype.numpy).reshape(shape)
    return np.array(values, dtype.numpy).reshape(shape)


def from_numpy(a: np.ndarray, dtype: DataType) -> list:
    """Elements for a column."""
    if dtype.inner is not None:
        mask = np.ma.getmaskarray(a).ravel()
        return [None if m else v for m, v in zip(mask.tolist(), from_numpy(np.ma.getdata(a), dtype.inner), strict=True)]
    flat = a.ravel()
    if dtype.small or dtype.name == "bfloat16":
        return dtype.unpack(flat).astype(np.float32).tolist()
    if dtype.numpy.kind in "mM":
        return flat.view(np.int64).tolist()
    if dtype.numpy.kind == "V" and dtype.numpy.names is None:
        return [v.tobytes() for v in flat]
    if dtype.numpy.kind == "c":
        return [{"re": float(v.real), "im": float(v.imag)} for v in flat]
    if dtype.numpy.kind == "u" and dtype.numpy.itemsize == 8:
        from decimal import Decimal

        return [Decimal(int(v)) for v in flat]
    return flat.tolist()


def all_fill(a: np.ndarray, meta: ArrayMeta) -> bool:
    if meta.dtype.inner is not None:
        mask = np.ma.getmaskarray(a)
        return bool(mask.all()) if meta.fill is None else not mask.any() and same_bits(np.ma.getdata(a), meta.fill)
    return same_bits(a, meta.fill)


def dump(frame: ArrayFrame) -> DataFrame:
    """lin, json: all elements in C order as JSON values; sort by lin to print them."""
    lin = F.lit(0).cast("long")
    for n, e in zip(frame.i, frame.meta.shape, strict=True):
        lin = lin * e + F.col(n)
    text = F.coalesce(F.regexp_extract(F.to_json(F.struct("v")), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
    return frame.value_view().select(lin.alias("lin"), F.when(F.col("v").isNull(), "null").otherwise(text).alias("json"))


def transposed(frame: ArrayFrame, order: Sequence[int]) -> DataFrame:
    """Cells with permuted indices: a renaming, without work."""
    names = frame.i
    return frame.value_view().select(*(F.col(names[o]).alias(names[k]) for k, o in enumerate(order)), "v")


def reshaped(frame: ArrayFrame, shape: Sequence[int]) -> DataFrame:
    """Cells under another shape of the same size, in the same C order."""
    if prod(shape) != prod(frame.meta.shape):
        raise ValueError(f"{frame.meta.shape} doesn't fit {tuple(shape)}")
    lin = F.lit(0).cast("long")
    for n, e in zip(frame.i, frame.meta.shape, strict=True):
        lin = lin * e + F.col(n)
    cells = frame.value_view().select(lin.alias("lin"), "v")
    return cells.select(*(x.alias(n) for x, n in zip(unravel_columns(F.col("lin"), shape), index_names(len(shape)), strict=True)), "v")


def squeezed(frame: ArrayFrame) -> DataFrame:
    """Cells without the dimensions of extent 1."""
    kept = [n for n, e in zip(frame.i, frame.meta.shape, strict=True) if e != 1]
    return frame.value_view().select(*(F.col(n).alias(m) for n, m in zip(kept, index_names(len(kept)), strict=True)), "v")
