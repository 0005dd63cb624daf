"""Chunks of stored arrays, read and written by the executors: files are opened by the keys that the grid gives, so nothing is listed and nothing is shuffled.

A reader knows its size and reads byte ranges; codecs ask it for as little as they need (`Chain.read_box`). File systems are Arrow's (local, hdfs, s3, gs);
arrays on others are read by Spark's binary files, see `sources.arrays.open_array`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.boxes import Box
from gridloom.functions.codecs import ByteReader
from gridloom.functions.keys import node_key
from gridloom.operators.frame import ELEMENTS, _arrow_of, _chunk_schema, _per_chunk, all_fill, chunk_lists, fill_element, index_names, placed_cells, to_numpy
from gridloom.plans.meta import ArrayMeta
from gridloom.plans.shared import bounded
from gridloom.sources.store import _opened, transformers

#: Chunks of one reading task, where there are enough for all cores.
CHUNKS_PER_TASK = 64


class FileReader:
    """One open file. `taken` counts what was read."""

    def __init__(self, file):
        self.file, self.size, self.taken = file, file.size(), 0

    def read(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        self.taken += len(data)
        if len(data) != length:
            raise EOFError(f"{len(data)} bytes of {length}")
        return data


class Folder:
    """An array's values under a root, by key; used inside a task. A storage transformer sees whole values only."""

    def __init__(self, uri: str, path: str, metas: tuple = ()):
        self.files, self.root = _opened(uri)
        self.path, self.through = path, transformers(metas)

    def at(self, key: str) -> str:
        key = node_key(self.path, key)
        for t in self.through:
            key = t.key(key)
        return f"{self.root}/{key}"

    def open(self, key: str):
        """A reader, or None where there is no value."""
        try:
            reader = FileReader(self.files.open_input_file(self.at(key)))
        except FileNotFoundError:
            return None
        if self.through:
            data = reader.read(0, reader.size)
            for t in reversed(self.through):
                data = t.decode(data)
            return ByteReader(data)
        return reader

    def write_part(self, key: str, value: bytes) -> tuple[str, str]:
        """Writes a value under a hidden name beside its key: the hidden name and the key's, both with their folders. `moved` makes it the key's value."""
        at = self.at(key)
        folder = at.rpartition("/")[0]
        self.files.create_dir(folder, recursive=True)
        for t in self.through:
            value = t.encode(value)
        part = f"{folder}/_{uuid.uuid4().hex}.part"
        with self.files.open_output_stream(part) as f:
            f.write(value)
        return part, at


class _Chains:
    """The chain of each chunk shape, bound once."""

    def __init__(self, meta: ArrayMeta):
        self.meta, self.held = meta, {}

    def of(self, shape: tuple[int, ...]):
        if shape not in self.held:
            self.held[shape] = self.meta.chain(shape)
        return self.held[shape]


def _numbers(b: pa.RecordBatch, dims: int) -> list[tuple[int, ...]]:
    return list(zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in index_names(dims, "c")), strict=True)) if dims else [()] * b.num_rows


@dataclass(frozen=True)
class StoredChunks:
    """Where an array's chunks lie. Its methods give DataFrames that read them."""

    spark: SparkSession
    uri: str
    path: str

    def _spread(self, meta: ArrayMeta, chunks: Box) -> DataFrame:
        """The numbers of a range of chunks, dealt to tasks."""
        tasks = meta.options.concurrent_target or max(self.spark.sparkContext.defaultParallelism, chunks.size // CHUNKS_PER_TASK)
        return chunks.domain(self.spark, index_names(meta.dims, "c"), max(1, min(chunks.size, tasks)))

    def cells(self, meta: ArrayMeta, box: Box) -> DataFrame:
        """i0.., v of a box, fill values where nothing is stored; only what the box touches is read and decoded."""
        i, element = index_names(meta.dims), T._parse_datatype_string(meta.dtype.spark)
        arrow, place = _arrow_of(element), (self.uri, self.path, meta.storage_transformers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folder, chains, grid, keys = Folder(*place), _Chains(meta), meta.grid, meta.keys
            fill = pa.array([fill_element(meta)], arrow)
            for b in batches:
                for number in _numbers(b, meta.dims):
                    own = grid.subset(number)
                    common = own.overlap(box)
                    if common.is_empty:
                        continue
                    reader = folder.open(keys.key(number))
                    if reader is None:
                        values = fill.take(pa.array(np.zeros(common.size, np.int64)))
                    else:
                        values = chunk_lists([chains.of(own.shape).read_box(reader, common.relative_to(own.start))], pa.list_(arrow), meta.dtype).values
                    index = [np.arange(s, e) for s, e in zip(common.start, common.end, strict=True)]
                    columns = [np.broadcast_to(x.reshape([-1 if k == d else 1 for k in range(meta.dims)]), common.shape).reshape(-1) for d, x in enumerate(index)]
                    for at in range(0, common.size, ELEMENTS):
                        yield pa.RecordBatch.from_arrays([*(pa.array(x[at : at + ELEMENTS]) for x in columns), values.slice(at, ELEMENTS)], names=[*i, "v"])

        schema = T.StructType([*(T.StructField(n, T.LongType()) for n in i), T.StructField("v", element)])
        return self._spread(meta, meta.grid.chunks_in(box)).mapInArrow(run, schema)

    def chunks(self, meta: ArrayMeta, chunks: Box) -> DataFrame:
        """c0.., data of the stored chunks of a range."""
        element = T._parse_datatype_string(meta.dtype.spark)
        return bounded(self.values(meta, self._spread(meta, chunks))).mapInArrow(
            _per_chunk(meta, lambda chain, shape, value: chain.decode(value), "value", pa.list_(_arrow_of(element)), "data", drop=("key",), chunks_of=meta.dtype), _chunk_schema(meta, element)
        )

    def values(self, meta: ArrayMeta, numbers: DataFrame) -> DataFrame:
        """c0.., key, value: the encoded chunks of these numbers (c0..) that are stored."""
        c, place = index_names(meta.dims, "c"), (self.uri, self.path, meta.storage_transformers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folder, keys = Folder(*place), meta.keys
            for b in batches:
                for number in _numbers(b, meta.dims):
                    key = keys.key(number)
                    reader = folder.open(key)
                    if reader is not None:
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in number), pa.array([key]), pa.array([reader.read(0, reader.size)], pa.binary())], names=[*c, "key", "value"])

        schema = T.StructType([*(T.StructField(n, T.LongType()) for n in c), T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
        return numbers.select(*c).mapInArrow(run, schema)

    def gather(self, meta: ArrayMeta, placed: DataFrame) -> DataFrame:
        """ord, i0.., v of wanted elements (ord, i0.., c0..). A chunk is opened once for all its elements that lie together; the box around them is read."""
        i, c = index_names(meta.dims), index_names(meta.dims, "c")
        element = T._parse_datatype_string(meta.dtype.spark)
        arrow, place = _arrow_of(element), (self.uri, self.path, meta.storage_transformers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folder, chains, grid, keys = Folder(*place), _Chains(meta), meta.grid, meta.keys
            fill = pa.array([fill_element(meta)], arrow)
            for b in batches:
                numbers = _numbers(b, meta.dims)
                index = np.stack([b.column(b.schema.get_field_index(n)).to_numpy() for n in i], 1) if i else np.zeros((b.num_rows, 0), np.int64)
                cuts = [0, *(k for k in range(1, len(numbers)) if numbers[k] != numbers[k - 1]), len(numbers)]
                parts = []
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if a == z:
                        continue
                    own, reader = grid.subset(numbers[a]), folder.open(keys.key(numbers[a]))
                    if reader is None:
                        parts.append(fill.take(pa.array(np.zeros(z - a, np.int64))))
                        continue
                    near = Box.including(index[a:z].min(0).tolist(), index[a:z].max(0).tolist())
                    block = chains.of(own.shape).read_box(reader, near.relative_to(own.start))
                    lin = np.zeros(z - a, np.int64)
                    for d in range(meta.dims):
                        lin = lin * near.shape[d] + index[a:z, d] - near.start[d]
                    parts.append(chunk_lists([block.reshape(-1)[lin]], pa.list_(arrow), meta.dtype).values)
                if parts:
                    yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in ("ord", *i)), pa.concat_arrays(parts)], names=["ord", *i, "v"])

        schema = T.StructType([T.StructField("ord", T.LongType()), *(T.StructField(n, T.LongType()) for n in i), T.StructField("v", element)])
        near = placed.repartitionByRange(*c, "ord").sortWithinPartitions(*c, "ord") if c else placed
        return near.mapInArrow(run, schema)

    def encoded(self, meta: ArrayMeta, blobs: DataFrame) -> DataFrame:
        """Writes encoded chunks (c0.., value; null: none) under hidden names; part, at of each, null part where there is no value."""
        place = (self.uri, self.path, meta.storage_transformers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folder, keys = Folder(*place), meta.keys
            for b in batches:
                made = []
                for number, value in zip(_numbers(b, meta.dims), b.column(b.schema.get_field_index("value")), strict=True):
                    key = keys.key(number)
                    made.append(folder.write_part(key, value.as_buffer()) if value.is_valid else (None, folder.at(key)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.string()) for k in (0, 1)], names=["part", "at"])

        return bounded(blobs).mapInArrow(run, "part string, at string")

    def updated(self, meta: ArrayMeta, cells: DataFrame) -> DataFrame:
        """c0.., value, changed inner chunks: the touched chunks with new cells (i0.., v) in place, encoded; null values where only fill values are left.

        Of a shard only the inner chunks that a cell touches are decoded and encoded; the others' bytes are taken over.
        """
        c, place = index_names(meta.dims, "c"), (self.uri, self.path, meta.storage_transformers)
        element = T._parse_datatype_string(meta.dtype.spark)
        i = index_names(meta.dims)
        grouped = placed_cells(meta, cells.select(*i, F.col("v").cast(element).alias("v")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folder, chains, grid, keys = Folder(*place), _Chains(meta), meta.grid, meta.keys
            for b in batches:
                m = b.column(b.schema.get_field_index("m"))
                for k, number in enumerate(_numbers(b, meta.dims)):
                    shape = grid.chunk_shape(number)
                    own = m[k].values
                    places = own.field(0).to_numpy(zero_copy_only=False)
                    values = to_numpy(own.field(1).to_pylist() if not meta.dtype.is_plain or own.field(1).null_count else own.field(1).to_numpy(zero_copy_only=False), meta.dtype, (len(own),))
                    value, n = chains.of(shape).updated(folder.open(keys.key(number)), places, values, lambda a: not meta.options.store_empty_chunks and all_fill(a, meta), meta.options.append_to_shards)
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in number), pa.array([value], pa.binary()), pa.array([n], pa.int64())], names=[*c, "value", "inner"])

        schema = T.StructType([*(T.StructField(n, T.LongType()) for n in c), T.StructField("value", T.BinaryType()), T.StructField("inner", T.LongType())])
        return bounded(grouped).mapInArrow(run, schema)

    def moved(self, parts: DataFrame) -> DataFrame:
        """Moves hidden values over their keys, and erases keys that have none; at of each. Repeated and speculative tasks do no harm."""
        uri = self.uri

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, _ = _opened(uri)
            for b in batches:
                for part, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if part is None:
                        if files.get_file_info(at).is_file:
                            files.delete_file(at)
                    elif files.get_file_info(part).is_file:  # else an earlier attempt has moved it
                        files.move(part, at)
                yield b.select(["at"])

        return parts.select("part", "at").mapInArrow(run, "at string")
