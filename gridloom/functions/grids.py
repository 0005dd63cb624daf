"""Chunk grids: disjoint boxes that cover an array, on the driver and as column expressions over index columns."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.boxes import Box, DimensionalityError, div, unravel_columns
from gridloom.registry import GRIDS


class GridError(ValueError):
    pass


class Axis:
    """One dimension of a grid. `extent` is the array's, `edge` and `origin` are of a chunk number."""

    extent: int
    count: int
    bounded = False

    def edge(self, c: int) -> int: ...
    def origin(self, c: int) -> int: ...
    def chunk_of(self, i: int) -> int | None: ...
    def chunk_column(self, i: Column) -> Column: ...
    def origin_column(self, c: Column) -> Column: ...
    def edge_column(self, c: Column) -> Column: ...


@dataclass(frozen=True)
class Even(Axis):
    """Equal chunks. Unbounded: the last one overhangs and the pattern goes on past the array; bounded: the last one is clipped."""

    extent: int
    size: int
    bounded: bool = False

    def __post_init__(self) -> None:
        if self.size < 1:
            raise GridError("chunk edges are positive")

    @property
    def count(self) -> int:
        return -(-self.extent // self.size)

    def edge(self, c: int) -> int:
        return max(0, min(self.size, self.extent - c * self.size)) if self.bounded else self.size

    def origin(self, c: int) -> int:
        return c * self.size

    def chunk_of(self, i: int) -> int | None:
        return None if self.extent == 0 or self.bounded and i >= self.extent else i // self.size

    def chunk_column(self, i: Column) -> Column:
        c = div(i, self.size)
        return F.when(i < self.extent, c) if self.bounded else c if self.extent else F.lit(None).cast("long")

    def origin_column(self, c: Column) -> Column:
        return (c * F.lit(self.size)).cast("long")

    def edge_column(self, c: Column) -> Column:
        full = F.lit(self.size).cast("long")
        return F.least(full, F.lit(self.extent) - self.origin_column(c)) if self.bounded else full


@dataclass(frozen=True)
class Varying(Axis):
    """Chunks of given edges, which must cover the extent. Columns search the edges' running sums, a constant array."""

    extent: int
    edges: tuple[int, ...]

    def __post_init__(self) -> None:
        if min(self.edges, default=1) < 1 or sum(self.edges) < self.extent:
            raise GridError(f"edges {self.edges} don't cover {self.extent}")

    @property
    def count(self) -> int:
        return len(self.edges)

    @property
    def ends(self) -> list[int]:
        return list(accumulate(self.edges))

    def edge(self, c: int) -> int:
        return self.edges[c]

    def origin(self, c: int) -> int:
        return self.ends[c] - self.edges[c]

    def chunk_of(self, i: int) -> int | None:
        c = bisect_right(self.ends, i)
        return c if c < len(self.edges) else None

    def _array(self, values: Sequence[int]) -> Column:
        return F.array(*(F.lit(v).cast("long") for v in values))

    def chunk_column(self, i: Column) -> Column:
        c = F.aggregate(self._array(self.ends), F.lit(0).cast("long"), lambda a, e: a + F.when(e <= i, 1).otherwise(0))
        return F.when(c < len(self.edges), c)

    def origin_column(self, c: Column) -> Column:
        return F.get(self._array([e - n for e, n in zip(self.ends, self.edges, strict=True)]), c.cast("int"))

    def edge_column(self, c: Column) -> Column:
        return F.get(self._array(self.edges), c.cast("int"))


@dataclass(frozen=True)
class Tiled(Axis):
    """An inner axis repeated inside every chunk of an outer one, as subchunks of shards are."""

    outer: Axis
    inner: Axis

    @property
    def extent(self) -> int:
        return self.outer.extent

    @property
    def count(self) -> int:
        return self.outer.count * self.inner.count

    def edge(self, c: int) -> int:
        return self.inner.edge(c % self.inner.count)

    def origin(self, c: int) -> int:
        return self.outer.origin(c // self.inner.count) + self.inner.origin(c % self.inner.count)

    def chunk_of(self, i: int) -> int | None:
        o = self.outer.chunk_of(i)
        c = None if o is None else self.inner.chunk_of(i - self.outer.origin(o))
        return None if c is None else o * self.inner.count + c

    def chunk_column(self, i: Column) -> Column:
        o = self.outer.chunk_column(i)
        return o * self.inner.count + self.inner.chunk_column(i - self.outer.origin_column(o))

    def origin_column(self, c: Column) -> Column:
        return self.outer.origin_column(div(c, self.inner.count)) + self.inner.origin_column(c % self.inner.count)

    def edge_column(self, c: Column) -> Column:
        return self.inner.edge_column(c % self.inner.count)


@dataclass(frozen=True)
class Grid:
    axes: tuple[Axis, ...]
    name: str = "regular"

    @property
    def dims(self) -> int:
        return len(self.axes)

    @property
    def array_shape(self) -> tuple[int, ...]:
        return tuple(a.extent for a in self.axes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.count for a in self.axes)

    def _same(self, index: Sequence[int]) -> None:
        if len(index) != self.dims:
            raise DimensionalityError(f"{len(index)} dimensions, not {self.dims}")

    def edges(self, dim: int) -> list[int]:
        a = self.axes[dim]
        return [a.edge(c) for c in range(a.count)]

    def chunk_shape(self, chunk: Sequence[int]) -> tuple[int, ...]:
        self._same(chunk)
        return tuple(a.edge(c) for a, c in zip(self.axes, chunk, strict=True))

    def origin(self, chunk: Sequence[int]) -> tuple[int, ...]:
        self._same(chunk)
        return tuple(a.origin(c) for a, c in zip(self.axes, chunk, strict=True))

    def subset(self, chunk: Sequence[int]) -> Box:
        return Box(self.origin(chunk), self.chunk_shape(chunk))

    def subset_bounded(self, chunk: Sequence[int]) -> Box:
        return self.subset(chunk).bound(self.array_shape)

    def chunks_subset(self, chunks: Box) -> Box:
        if chunks.is_empty:
            return Box.empty(self.dims)
        return Box.between(self.origin(chunks.start), self.subset(chunks.last).end)

    def chunk_indices(self, index: Sequence[int]) -> tuple[int, ...] | None:
        self._same(index)
        found = tuple(a.chunk_of(i) for a, i in zip(self.axes, index, strict=True))
        return None if None in found else found

    def element_indices(self, index: Sequence[int]) -> tuple[int, ...] | None:
        chunk = self.chunk_indices(index)
        return chunk and tuple(i - o for i, o in zip(index, self.origin(chunk), strict=True))

    def in_array(self, index: Sequence[int]) -> bool:
        return Box.whole(self.array_shape).contains(index)

    def in_grid(self, chunk: Sequence[int]) -> bool:
        return Box.whole(self.shape).contains(chunk)

    def chunks_in(self, box: Box) -> Box | None:
        """The chunks that a box touches: what a read prunes by. None where the grid doesn't reach."""
        self._same(box.start)
        if box.is_empty:
            return Box.empty(self.dims)
        first, last = self.chunk_indices(box.start), self.chunk_indices(box.last)
        return None if first is None or last is None else Box.including(first, last)

    def chunks(self) -> Iterator[tuple[tuple[int, ...], Box]]:
        return ((c, self.subset(c)) for c in product(*map(range, self.shape)))

    def within(self, inner: Grid) -> Grid:
        return Grid(tuple(Tiled(a, b) for a, b in zip(self.axes, inner.axes, strict=True)), "repeat")

    # as columns
    def chunk_columns(self, index: Sequence[Column]) -> list[Column]:
        self._same(index)
        return [a.chunk_column(i) for a, i in zip(self.axes, index, strict=True)]

    def offset_columns(self, index: Sequence[Column]) -> list[Column]:
        return [i - a.origin_column(c) for a, i, c in zip(self.axes, index, self.chunk_columns(index), strict=True)]

    def origin_columns(self, chunk: Sequence[Column]) -> list[Column]:
        self._same(chunk)
        return [a.origin_column(c) for a, c in zip(self.axes, chunk, strict=True)]

    def edge_columns(self, chunk: Sequence[Column]) -> list[Column]:
        self._same(chunk)
        return [a.edge_column(c) for a, c in zip(self.axes, chunk, strict=True)]

    def rows(self, spark: SparkSession, columns: Sequence[str]) -> DataFrame:
        """All chunk indices, one row each."""
        box = Box.whole(self.shape)
        made = unravel_columns(F.col("id"), self.shape)
        return spark.range(box.size).select(*(m.alias(c) for m, c in zip(made, columns, strict=True)))


def _even(shape: Sequence[int], config: dict, bounded: bool) -> Grid:
    chunk = config["chunk_shape"]
    if len(chunk) != len(shape):
        raise DimensionalityError(f"{len(chunk)} chunk edges, {len(shape)} dimensions")
    return Grid(tuple(Even(n, c, bounded) for n, c in zip(shape, chunk, strict=True)), "regular_bounded" if bounded else "regular")


@GRIDS.add("regular")
def regular(shape: Sequence[int], config: dict) -> Grid:
    return _even(shape, config, False)


@GRIDS.add("regular_bounded")
def regular_bounded(shape: Sequence[int], config: dict) -> Grid:
    return _even(shape, config, True)


def expand_runs(edges: Sequence) -> tuple[int, ...]:
    """[[5, 3], 15] stands for 5, 5, 5, 15."""
    return tuple(x for e in edges for x in ([e[0]] * e[1] if isinstance(e, (list, tuple)) else [e]))


@GRIDS.add("rectilinear", "rectangular")
def rectilinear(shape: Sequence[int], config: dict) -> Grid:
    given = config.get("chunk_shapes", config.get("chunk_shape"))
    if len(given) != len(shape):
        raise DimensionalityError(f"{len(given)} axes of edges, {len(shape)} dimensions")
    return Grid(tuple(Even(n, g) if isinstance(g, int) else Varying(n, expand_runs(g)) for n, g in zip(shape, given, strict=True)), "rectilinear")
