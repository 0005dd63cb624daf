"""The Python data source "gridloom": arrays in a folder as chunks, one input partition per group of chunks.

    spark.dataSource.register(GridloomSource)
    spark.read.format("gridloom").option("box", "0:10,5:8").load("/path/to/array")

Rows are chunks (c0.., data). The option `box` prunes chunks before anything is read. The folder must be one that executors reach under the same
path, as /dbfs-like mounts and shared disks are; other file systems go through `sources.arrays.open_array`, which reads by Spark's own sources.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.functions.boxes import Box, unravel
from gridloom.functions.keys import V2_ARRAY_KEY, V2_ATTRIBUTES_KEY, V3_KEY
from gridloom.operators.frame import from_numpy, index_names, to_numpy
from gridloom.plans.meta import ArrayMeta, MetadataError, array_to_v3

#: Chunks of one input partition, where the grid isn't too large.
CHUNKS_PER_TASK = 64
MOST_TASKS = 10_000


def local(path: str) -> str:
    """The path as this machine's file system knows it."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def read_meta(path: str) -> ArrayMeta:
    def text(name: str) -> str | None:
        at = os.path.join(path, name)
        return open(at).read() if os.path.exists(at) else None

    if (doc := text(V3_KEY)) is not None:
        return ArrayMeta.from_json(doc)
    if (doc := text(V2_ARRAY_KEY)) is not None:
        return array_to_v3(doc, text(V2_ATTRIBUTES_KEY))
    raise MetadataError(f"no array at {path}")


def parse_box(text: str) -> Box:
    return Box.of(*(tuple(map(int, part.split(":"))) for part in text.split(",")))


class Chunks(InputPartition):
    """Chunks by their C-order places in a range of chunks."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    """Deals the grid's chunks, or those of a box, to tasks without listing the folder; what isn't stored gives no row."""

    def __init__(self, path: str, meta: dict, box: str | None):
        self.path, self.meta, self.box = path, meta, box

    def _range(self, meta: ArrayMeta) -> Box:
        chunks = Box.whole(meta.grid.shape) if self.box is None else meta.grid.chunks_in(parse_box(self.box))
        return chunks or Box.empty(meta.dims)

    def partitions(self) -> list[Chunks]:
        n = self._range(ArrayMeta.from_json(self.meta)).size
        each = max(CHUNKS_PER_TASK, -(-n // MOST_TASKS))
        return [Chunks(i, min(i + each, n)) for i in range(0, n, each)] or [Chunks(0, 0)]

    def read(self, partition: Chunks) -> Iterator[tuple]:
        meta, chains = ArrayMeta.from_json(self.meta), {}
        chunks = self._range(meta)
        for place in range(partition.first, partition.last):
            number = tuple(s + i for s, i in zip(chunks.start, unravel(place, chunks.shape), strict=True))
            shape = meta.grid.chunk_shape(number)
            chain = chains.setdefault(shape, meta.chain(shape))
            try:
                with open(os.path.join(self.path, meta.keys.key(number)), "rb") as f:
                    data = f.read()
            except FileNotFoundError:
                continue
            yield (*number, from_numpy(chain.decode(data), meta.dtype))


class Written(WriterCommitMessage):
    def __init__(self, parts: list[tuple[str, str]]):
        self.parts = parts


class Writer(DataSourceWriter):
    """Encodes chunks to files under temporary names; the commit renames them, an abort removes them."""

    def __init__(self, path: str, meta: dict):
        self.path, self.meta = path, meta

    def write(self, rows: Iterator) -> Written:
        meta, chains, parts = ArrayMeta.from_json(self.meta), {}, []
        for row in rows:
            number, data = tuple(row)[: meta.dims], tuple(row)[meta.dims]
            shape = meta.grid.chunk_shape(number)
            chain = chains.setdefault(shape, meta.chain(shape))
            at = os.path.join(self.path, meta.keys.key(number))
            os.makedirs(os.path.dirname(at), exist_ok=True)
            part = f"{at}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(chain.encode(to_numpy(data, meta.dtype, shape)))
            parts.append((part, at))
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for part, at in m.parts if m else ():
                os.replace(part, at)
        with open(os.path.join(self.path, V3_KEY), "w") as f:
            json.dump(self.meta, f, indent=2)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for part, _ in m.parts if m else ():
                if os.path.exists(part):
                    os.remove(part)


class GridloomSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self) -> str:
        meta = read_meta(local(self.options["path"]))
        return ", ".join([*(f"{c} bigint" for c in index_names(meta.dims, "c")), f"data array<{meta.dtype.spark}>"])

    def reader(self, schema) -> Reader:
        path = local(self.options["path"])
        return Reader(path, read_meta(path).to_json(), self.options.get("box"))

    def writer(self, schema, overwrite: bool) -> Writer:
        path = local(self.options["path"])
        os.makedirs(path, exist_ok=True)
        return Writer(path, json.loads(self.options["metadata"]))

