"""Array and group metadata: documents of both format versions, the builder, conversion from version 2 to 3."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace
from math import prod

import numpy as np

from gridloom.functions.codecs import Chain, Form, default_codecs
from gridloom.functions.dtypes import DataType, data_type
from gridloom.functions.grids import Grid
from gridloom.functions.keys import KeyEncoding
from gridloom.registry import GRIDS, KEY_ENCODINGS, TRANSFORMERS, UnsupportedExtension, register_all, registered


class MetadataError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    """How arrays are stored and read; copies by dataclasses.replace."""

    store_empty_chunks: bool = False
    validate_checksums: bool = True
    #: On writing an array that was read from a version 2 document.
    metadata_convert: str = "keep"  # or "v3"
    metadata_erase: str = "all"  # or "v2", "v3"
    use_consolidated: str = "auto"  # or "must", "never"
    #: Tasks of a read from a store; None: by the number of chunks.
    concurrent_target: int | None = None
    include_metadata_of_writer: bool = False
    #: Whether updates of shards append inner chunks and leave dead bytes, until the array is compacted.
    append_to_shards: bool = False


@dataclass(frozen=True)
class ArrayMeta:
    """What an array is. Immutable; changes give a new one."""

    shape: tuple[int, ...]
    data_type: str | dict
    chunk_grid: dict
    fill_value: object
    codecs: tuple
    chunk_key_encoding: dict = field(default_factory=lambda: {"name": "default", "configuration": {"separator": "/"}})
    attributes: dict = field(default_factory=dict)
    dimension_names: tuple[str | None, ...] | None = None
    storage_transformers: tuple = ()
    additional: dict = field(default_factory=dict)
    options: Options = Options()
    #: The version 2 document that this array was read from.
    version2: dict | None = None

    def __post_init__(self) -> None:
        if prod(self.shape) >= 1 << 63:
            raise MetadataError("more elements than a BIGINT can count")
        if self.dimension_names is not None and len(self.dimension_names) != len(self.shape):
            raise MetadataError("dimension names don't match the shape")
        for name, value in self.additional.items():
            if not (isinstance(value, dict) and value.get("must_understand") is False):
                raise UnsupportedExtension(f"unknown field {name}")

    def __reduce__(self):
        return _restored, (registered(), {f.name: getattr(self, f.name) for f in fields(self)})

    @property
    def dtype(self) -> DataType:
        return data_type(self.data_type)

    @property
    def fill(self):
        return self.dtype.fill(self.fill_value)

    @property
    def dims(self) -> int:
        return len(self.shape)

    @property
    def grid(self) -> Grid:
        return GRIDS.get(self.chunk_grid["name"])(self.shape, self.chunk_grid.get("configuration") or {})

    @property
    def keys(self) -> KeyEncoding:
        return KEY_ENCODINGS.get(self.chunk_key_encoding["name"])(self.chunk_key_encoding.get("configuration") or {})

    def chain(self, chunk_shape: Sequence[int]) -> Chain:
        return Chain(self.codecs, Form(self.dtype, tuple(chunk_shape), self.fill), self.options.validate_checksums)

    def bound(self) -> ArrayMeta:
        """Checks types, codecs and grid against each other, as opening an array does."""
        grid = self.grid
        self.chain(tuple(a.edge(0) if a.count else 1 for a in grid.axes))
        for t in self.storage_transformers:
            TRANSFORMERS.get(t["name"])
        return self

    # subchunks
    def subchunk_shapes(self) -> list[tuple[int, ...]]:
        """Inner chunk shapes of nested shards, outermost first."""
        out, codecs = [], list(self.codecs)
        while True:
            inner = next((c for c in codecs if isinstance(c, dict) and c["name"] == "sharding_indexed"), None)
            if inner is None:
                return out
            out.append(tuple(inner["configuration"]["chunk_shape"]))
            codecs = inner["configuration"]["codecs"]

    def subchunk_grid(self, level: int = 0) -> Grid:
        shapes = self.subchunk_shapes()
        if level >= len(shapes):
            return self.grid
        grid = self.grid
        inner = GRIDS.get("regular")(tuple(a.edge(0) for a in grid.axes), {"chunk_shape": shapes[level]})
        return grid.within(inner)

    # changes
    def resized(self, shape: Sequence[int]) -> ArrayMeta:
        if len(shape) != self.dims:
            raise MetadataError("the number of dimensions can't change")
        return replace(self, shape=tuple(shape)).bound()

    def with_dimension_names(self, names) -> ArrayMeta:
        return replace(self, dimension_names=None if names is None else tuple(names))

    def with_attributes(self, attributes: dict) -> ArrayMeta:
        return replace(self, attributes=dict(attributes))

    def with_options(self, **changes) -> ArrayMeta:
        return replace(self, options=replace(self.options, **changes))

    # documents
    def to_json(self) -> dict:
        out = {
            "zarr_format": 3,
            "node_type": "array",
            "shape": list(self.shape),
            "data_type": self.data_type,
            "chunk_grid": self.chunk_grid,
            "chunk_key_encoding": self.chunk_key_encoding,
            "fill_value": self.fill_value,
            "codecs": [{"name": c} if isinstance(c, str) else c for c in self.codecs],
        }
        if self.attributes:
            out["attributes"] = self.attributes
        if self.storage_transformers:
            out["storage_transformers"] = list(self.storage_transformers)
        if self.dimension_names is not None:
            out["dimension_names"] = list(self.dimension_names)
        return out | self.additional

    @staticmethod
    def from_json(doc: str | dict) -> ArrayMeta:
        d = dict(doc) if isinstance(doc, dict) else json.loads(doc)
        if d.pop("zarr_format", None) != 3 or d.pop("node_type", None) != "array":
            raise MetadataError("not a version 3 array")
        named = lambda m: {"name": m} if isinstance(m, str) else m
        known = {k: d.pop(k, None) for k in ("attributes", "dimension_names", "storage_transformers")}
        return ArrayMeta(
            tuple(d.pop("shape")),
            d.pop("data_type"),
            named(d.pop("chunk_grid")),
            d.pop("fill_value"),
            tuple(named(c) for c in d.pop("codecs")),
            named(d.pop("chunk_key_encoding")),
            known["attributes"] or {},
            tuple(known["dimension_names"]) if known["dimension_names"] is not None else None,
            tuple(known["storage_transformers"] or ()),
            d,
        ).bound()


def _restored(entries: list, own: dict) -> ArrayMeta:
    """Metadata as it reaches an executor: with what the driver has registered at run time."""
    register_all(entries)
    return ArrayMeta(**own)


@dataclass
class ArrayBuilder:
    """Builds metadata step by step; what isn't set gets the usual value."""

    shape: Sequence[int]
    chunk_shape: Sequence[int] | dict
    data_type: str | dict
    fill_value: object
    codecs: Sequence | None = None
    subchunk_shape: Sequence[int] | None = None
    key_encoding: dict | None = None
    attributes: dict = field(default_factory=dict)
    dimension_names: Sequence[str | None] | None = None
    storage_transformers: Sequence[dict] = ()

    def build(self) -> ArrayMeta:
        grid = self.chunk_shape if isinstance(self.chunk_shape, dict) else {"name": "regular", "configuration": {"chunk_shape": list(self.chunk_shape)}}
        codecs = list(self.codecs) if self.codecs is not None else default_codecs(data_type(self.data_type))
        if codecs and all(c in ("gzip", "zstd", "zlib", "bz2", "crc32c", "adler32", "fletcher32", "shuffle", "blosc") for c in (c if isinstance(c, str) else c["name"] for c in codecs)):
            codecs = default_codecs(data_type(self.data_type)) + codecs
        if self.subchunk_shape is not None:
            codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(self.subchunk_shape), "codecs": codecs, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}}]
        more = {"chunk_key_encoding": self.key_encoding} if self.key_encoding else {}
        names = None if self.dimension_names is None else tuple(self.dimension_names)
        return ArrayMeta(tuple(self.shape), self.data_type, grid, self.fill_value, tuple(codecs), attributes=dict(self.attributes), dimension_names=names, storage_transformers=tuple(self.storage_transformers), **more).bound()


@dataclass(frozen=True)
class GroupMeta:
    attributes: dict = field(default_factory=dict)
    consolidated: dict | None = None
    additional: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        out = {"zarr_format": 3, "node_type": "group"}
        if self.attributes:
            out["attributes"] = self.attributes
        if self.consolidated is not None:
            out["consolidated_metadata"] = {"kind": "inline", "must_understand": False, "metadata": self.consolidated}
        return out | self.additional

    @staticmethod
    def from_json(doc: str | dict) -> GroupMeta:
        d = dict(doc) if isinstance(doc, dict) else json.loads(doc)
        if d.pop("zarr_format", None) != 3 or d.pop("node_type", None) != "group":
            raise MetadataError("not a version 3 group")
        inline = d.pop("consolidated_metadata", None)
        return GroupMeta(d.pop("attributes", None) or {}, inline and inline["metadata"], d)


# version 2


def _v2_fill(value, dtype: str):
    if value is None:
        d = data_type(dtype)
        return "" if d.name == "string" else [] if d.name == "bytes" else False if d.name == "bool" else 0
    return list(base64.b64decode(value)) if isinstance(value, str) and dtype.startswith("|V") else value


def _v2_codec(c: dict, dtype: DataType) -> dict:
    config = {k: v for k, v in c.items() if k != "id"}
    name = c["id"].rpartition(".")[2]
    if name == "blosc":
        shuffle = config.get("shuffle", 1)
        size = dtype.numpy.itemsize if dtype.numpy != object else 1
        if shuffle == -1:
            shuffle = 2 if size == 1 else 1
        config = {"cname": config.get("cname", "lz4"), "clevel": config.get("clevel", 5), "shuffle": ["noshuffle", "shuffle", "bitshuffle"][shuffle], "typesize": size, "blocksize": config.get("blocksize", 0)}
    if name == "zstd":
        config.setdefault("checksum", False)
    return {"name": name, "configuration": config} if config else {"name": name}


def array_to_v3(zarray: str | bytes | dict, zattrs: str | bytes | dict | None = None) -> ArrayMeta:
    """A version 2 array as version 3: Fortran order becomes a transpose, object filters become the serialiser."""
    d = zarray if isinstance(zarray, dict) else json.loads(zarray)
    if d.get("zarr_format") != 2:
        raise MetadataError("not a version 2 array")
    if isinstance(d["dtype"], list):
        raise UnsupportedExtension("structured types aren't supported")
    dims, filters = len(d["shape"]), list(d.get("filters") or [])
    raw = d["dtype"]
    if raw == "|O":
        vlen = next((f for f in filters if f["id"] in ("vlen-utf8", "vlen-bytes", "vlen-array")), None)
        if vlen is None:
            raise UnsupportedExtension("objects without a vlen filter")
        filters.remove(vlen)
        name, serial = ("string" if vlen["id"] == "vlen-utf8" else "bytes"), {"name": vlen["id"]}
    else:
        t = data_type(raw)
        name = {"name": t.name, "configuration": t.config} if t.config else t.name
        serial = {"name": "bytes", "configuration": {"endian": "big" if raw[0] == ">" else "little"}}
    dtype = data_type(name)
    codecs: list[dict] = [{"name": "transpose", "configuration": {"order": list(range(dims))[::-1]}}] if d.get("order") == "F" and dims > 1 else []
    array_filters = [f for f in filters if f["id"].rpartition(".")[2] in ("fixedscaleoffset", "bitround")]
    codecs += [_v2_codec(f, dtype) for f in array_filters] + [serial] + [_v2_codec(f, dtype) for f in filters if f not in array_filters]
    if d.get("compressor"):
        codecs.append(_v2_codec(d["compressor"], dtype))
    attributes = (zattrs if isinstance(zattrs, dict | None) else json.loads(zattrs)) or {}
    return ArrayMeta(
        tuple(d["shape"]),
        name,
        {"name": "regular", "configuration": {"chunk_shape": list(d["chunks"])}},
        _v2_fill(d.get("fill_value"), raw if raw != "|O" else name),
        tuple(codecs),
        {"name": "v2", "configuration": {"separator": d.get("dimension_separator", ".")}},
        dict(attributes),
        version2=dict(d),
    ).bound()


def group_to_v3(zgroup: str | bytes | dict, zattrs: str | bytes | dict | None = None) -> GroupMeta:
    d = zgroup if isinstance(zgroup, dict) else json.loads(zgroup)
    if d.get("zarr_format") != 2:
        raise MetadataError("not a version 2 group")
    return GroupMeta((zattrs if isinstance(zattrs, dict | None) else json.loads(zattrs)) or {})


def element_json(value, dtype: DataType):
    """An element as JSON, as dumps print it."""
    if value is None or value is np.ma.masked:
        return None
    if dtype.numpy == object:
        return value if isinstance(value, str) else list(value)
    if dtype.is_float:
        x = float(dtype.unpack(np.array([value]))[0]) if dtype.small or dtype.name == "bfloat16" else float(value)
        return "NaN" if x != x else "Infinity" if x == float("inf") else "-Infinity" if x == float("-inf") else x
    if dtype.numpy.kind == "c":
        return [value.real.item(), value.imag.item()]
    return value.item() if hasattr(value, "item") else value
