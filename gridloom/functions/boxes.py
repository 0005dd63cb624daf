"""Boxes: half-open hyper-rectangles of indices, on the driver and as column expressions.

The driver's Box plans; columns do the work. An empty box is a value, not an error; mismatched dimensions are errors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class DimensionalityError(ValueError):
    pass


class OutOfBoundsError(ValueError):
    pass


@dataclass(frozen=True)
class Box:
    start: tuple[int, ...]
    shape: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.start) != len(self.shape):
            raise DimensionalityError(f"{len(self.start)} starts, {len(self.shape)} extents")
        if min((*self.start, *self.shape), default=0) < 0:
            raise ValueError("indices are not negative")
        if prod(self.shape) >= 1 << 63:
            raise ValueError("more elements than a BIGINT can count")

    @staticmethod
    def empty(dims: int) -> Box:
        return Box((0,) * dims, (0,) * dims)

    @staticmethod
    def of(*ranges: range | tuple[int, int] | slice) -> Box:
        ends = [(r.start or 0, r.stop) if isinstance(r, (range, slice)) else tuple(r) for r in ranges]
        return Box.between([a for a, _ in ends], [b for _, b in ends])

    @staticmethod
    def whole(shape: Sequence[int]) -> Box:
        return Box((0,) * len(shape), tuple(shape))

    @staticmethod
    def between(start: Sequence[int], end: Sequence[int]) -> Box:
        if len(start) != len(end):
            raise DimensionalityError(f"{len(start)} starts, {len(end)} ends")
        if any(e < s for s, e in zip(start, end, strict=True)):
            raise ValueError(f"end {tuple(end)} before start {tuple(start)}")
        return Box(tuple(start), tuple(e - s for s, e in zip(start, end, strict=True)))

    @staticmethod
    def including(start: Sequence[int], last: Sequence[int]) -> Box:
        return Box.between(start, [x + 1 for x in last])

    @property
    def end(self) -> tuple[int, ...]:
        return tuple(s + n for s, n in zip(self.start, self.shape, strict=True))

    @property
    def last(self) -> tuple[int, ...] | None:
        return None if self.is_empty else tuple(e - 1 for e in self.end)

    @property
    def dims(self) -> int:
        return len(self.start)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def is_empty(self) -> bool:
        return 0 in self.shape

    def ranges(self) -> list[range]:
        return [range(s, e) for s, e in zip(self.start, self.end, strict=True)]

    def _same(self, other: Sequence[int]) -> None:
        if len(other) != self.dims:
            raise DimensionalityError(f"{len(other)} dimensions, not {self.dims}")

    def bound(self, end: Sequence[int]) -> Box:
        self._same(end)
        start = tuple(min(s, e) for s, e in zip(self.start, end, strict=True))
        return Box.between(start, [min(a, b) for a, b in zip(self.end, end, strict=True)])

    def contains(self, index: Sequence[int]) -> bool:
        return len(index) == self.dims and all(s <= i < e for s, i, e in zip(self.start, index, self.end, strict=True))

    def fits(self, shape: Sequence[int]) -> bool:
        return len(shape) == self.dims and all(e <= n for e, n in zip(self.end, shape, strict=True))

    def within(self, other: Box) -> bool:
        return other.dims == self.dims and all(b <= a and x <= y for a, b, x, y in zip(self.start, other.start, self.end, other.end, strict=True))

    def overlap(self, other: Box) -> Box:
        self._same(other.start)
        start = [max(a, b) for a, b in zip(self.start, other.start, strict=True)]
        return Box.between(start, [max(s, min(a, b)) for s, a, b in zip(start, self.end, other.end, strict=True)])

    def relative_to(self, offset: Sequence[int]) -> Box:
        self._same(offset)
        if any(o > s for o, s in zip(offset, self.start, strict=True)):
            raise OutOfBoundsError(f"offset {tuple(offset)} beyond start {self.start}")
        return Box(tuple(s - o for s, o in zip(self.start, offset, strict=True)), self.shape)

    def offset(self, by: Sequence[int]) -> Box:
        self._same(by)
        return Box(tuple(s + o for s, o in zip(self.start, by, strict=True)), self.shape)

    def indices(self) -> Iterator[tuple[int, ...]]:
        return product(*self.ranges())

    def _inside(self, shape: Sequence[int]) -> None:
        self._same(shape)
        if not self.fits(shape):
            raise OutOfBoundsError(f"{self} outside {tuple(shape)}")

    def linear(self, shape: Sequence[int]) -> Iterator[int]:
        self._inside(shape)
        return (ravel(i, shape) for i in self.indices())

    def runs(self, shape: Sequence[int]) -> Iterator[tuple[tuple[int, ...], int]]:
        """(index, length) of the longest runs that are contiguous in an array of this shape."""
        self._inside(shape)
        if self.is_empty:
            return iter(())
        k = self.dims
        while k and (k == self.dims or self.shape[k] == shape[k]):
            k -= 1
        length = prod(self.shape[k:])
        return (((*lead, *self.start[k:]), length) for lead in product(*self.ranges()[:k]))

    def linear_runs(self, shape: Sequence[int]) -> Iterator[tuple[int, int]]:
        return ((ravel(i, shape), n) for i, n in self.runs(shape))

    def byte_ranges(self, shape: Sequence[int], element: int) -> Iterator[tuple[int, int]]:
        return ((i * element, n * element) for i, n in self.linear_runs(shape))

    # as columns
    def predicate(self, columns: Sequence[str]) -> Column:
        """Index columns inside the box; a conjunction of ranges that scans can prune by."""
        self._same(columns)
        out = F.lit(True)
        for c, s, e in zip(columns, self.start, self.end, strict=True):
            out = out & (F.col(c) >= s) & (F.col(c) < e)
        return out

    def domain(self, spark: SparkSession, columns: Sequence[str], tasks: int | None = None) -> DataFrame:
        """All indices of the box, one row each, made by the executors."""
        self._same(columns)
        rows = spark.range(0, self.size, 1, tasks)
        made = unravel_columns(F.col("id"), self.shape)
        return rows.select(*((made[k] + self.start[k]).alias(c) for k, c in enumerate(columns)))


def ravel(index: Sequence[int], shape: Sequence[int]) -> int:
    if len(index) != len(shape):
        raise DimensionalityError(f"{len(index)} indices, {len(shape)} extents")
    out = 0
    for i, n in zip(index, shape, strict=True):
        if not 0 <= i < n:
            raise OutOfBoundsError(f"{tuple(index)} outside {tuple(shape)}")
        out = out * n + i
    return out


def unravel(linear: int, shape: Sequence[int]) -> tuple[int, ...]:
    if not 0 <= linear < prod(shape):
        raise OutOfBoundsError(f"{linear} outside {tuple(shape)}")
    out = []
    for n in reversed(shape):
        linear, i = divmod(linear, n)
        out.append(i)
    return tuple(reversed(out))


def ravel_column(columns: Sequence[Column], shape: Sequence[int]) -> Column:
    """The C-order position; null where an index is out of bounds."""
    if len(columns) != len(shape):
        raise DimensionalityError(f"{len(columns)} indices, {len(shape)} extents")
    out, inside = F.lit(0).cast("long"), F.lit(True)
    for c, n in zip(columns, shape, strict=True):
        out, inside = out * n + c, inside & (c >= 0) & (c < n)
    return F.when(inside, out)


def unravel_columns(linear: Column, shape: Sequence[int]) -> list[Column]:
    """The index of a C-order position."""
    out, inner = [], prod(shape)
    for n in shape:
        inner = inner // n if n else 1
        out.append((div(linear, inner) % F.lit(n or 1)).cast("long"))
    return out


def div(a: Column, b: Column | int) -> Column:
    """Integer division of indices."""
    return F.call_function("div", a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


# Box columns: struct<start array<bigint>, shape array<bigint>>
def box_column(start: Column, shape: Column) -> Column:
    return F.struct(start.alias("start"), shape.alias("shape"))


def box_end(box: Column) -> Column:
    return F.zip_with(box["start"], box["shape"], lambda s, n: s + n)


def box_size(box: Column) -> Column:
    return F.aggregate(box["shape"], F.lit(1).cast("long"), lambda a, n: a * n)


def box_overlap(a: Column, b: Column) -> Column:
    start = F.zip_with(a["start"], b["start"], lambda x, y: F.greatest(x, y))
    end = F.zip_with(box_end(a), box_end(b), lambda x, y: F.least(x, y))
    return box_column(start, F.zip_with(start, end, lambda s, e: F.greatest(e - s, F.lit(0).cast("long"))))


def box_bound(box: Column, end: Column) -> Column:
    start = F.zip_with(box["start"], end, lambda s, e: F.least(s, e))
    clipped = F.zip_with(box_end(box), end, lambda x, y: F.least(x, y))
    return box_column(start, F.zip_with(start, clipped, lambda s, e: e - s))


def box_offset(box: Column, by: Column) -> Column:
    return box_column(F.zip_with(box["start"], by, lambda s, o: s + o), box["shape"])


def box_within(a: Column, b: Column) -> Column:
    starts = F.forall(F.arrays_zip(a["start"].alias("x"), b["start"].alias("y")), lambda z: z["x"] >= z["y"])
    ends = F.forall(F.arrays_zip(box_end(a).alias("x"), box_end(b).alias("y")), lambda z: z["x"] <= z["y"])
    return starts & ends


# Indexers
class Indexer:
    """What a read selects, in order: boxes, index lists, or a concatenation. Rows carry their place in `ord`."""

    def __init__(self, parts: Sequence[Box | Sequence[Sequence[int]]]):
        self.parts = list(parts)
        dims = {p.dims if isinstance(p, Box) else len(i) for p in self.parts for i in ([p] if isinstance(p, Box) else p)}
        if len(dims) > 1:
            raise DimensionalityError(f"indexers of {sorted(dims)} dimensions")
        self.dims = dims.pop() if dims else 0

    @property
    def shape(self) -> tuple[int, ...]:
        if len(self.parts) == 1 and isinstance(self.parts[0], Box):
            return self.parts[0].shape
        return (sum(p.size if isinstance(p, Box) else len(p) for p in self.parts),)

    def check(self, shape: Sequence[int]) -> None:
        if len(shape) != self.dims:
            raise DimensionalityError(f"{self.dims} dimensions against {len(shape)}")
        for p in self.parts:
            if isinstance(p, Box):
                p._inside(shape)
            else:
                for i in p:
                    ravel(i, shape)

    def linear(self, shape: Sequence[int]) -> list[int]:
        self.check(shape)
        return [x for p in self.parts for x in (p.linear(shape) if isinstance(p, Box) else (ravel(i, shape) for i in p))]

    def runs(self, shape: Sequence[int]) -> list[tuple[int, int]]:
        """Runs of boxes are joined, those of index lists are single elements."""
        self.check(shape)
        return [x for p in self.parts for x in (p.linear_runs(shape) if isinstance(p, Box) else ((ravel(i, shape), 1) for i in p))]

    def rows(self, spark: SparkSession, columns: Sequence[str]) -> DataFrame:
        out, at = None, 0
        for p in self.parts:
            if isinstance(p, Box):
                # the range's own number is the place in the box
                made = unravel_columns(F.col("id"), p.shape)
                df = spark.range(p.size).select((F.col("id") + at).alias("ord"), *((made[k] + p.start[k]).alias(c) for k, c in enumerate(columns)))
                at += p.size
            else:
                rows = [(at + n, *map(int, i)) for n, i in enumerate(p)]
                df = spark.createDataFrame(rows, ", ".join(["ord long", *(f"{c} long" for c in columns)]))
                at += len(p)
            out = df if out is None else out.unionByName(df)
        return out
