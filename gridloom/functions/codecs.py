"""Codecs over numpy arrays and bytes, and their chain: array to array, array to bytes, bytes to bytes.

A codec is bound to the data type, shape and fill value that reach it, so that type errors appear when an array is opened. Chunks are
numpy arrays (object arrays for strings and bytes); optional ones are numpy masked arrays. The chain runs inside one Arrow stage.
"""

from __future__ import annotations

import bz2
import gzip
import json
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import product
from math import prod

import numpy as np

from gridloom.functions.boxes import Box
from gridloom.functions.dtypes import DataType, data_type, same_bits
from gridloom.registry import CODECS, UnsupportedExtension


class CodecError(ValueError):
    pass


class ChecksumError(CodecError):
    pass


@dataclass(frozen=True)
class Form:
    """What reaches a codec: type, chunk shape, fill value."""

    dtype: DataType
    shape: tuple[int, ...]
    fill: object


class ByteReader:
    """A value in memory, or a part of another reader's value, read by byte ranges. `taken` counts what was read."""

    def __init__(self, data):
        self.data, self.size, self.taken = data, len(data), 0

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise CodecError(f"bytes {offset} to {offset + length} of {self.size}")
        self.taken += length
        return self.data[offset : offset + length]


class PartReader:
    """A byte range of another reader's value."""

    def __init__(self, inner, offset: int, size: int):
        if offset < 0 or size < 0 or offset + size > inner.size:
            raise CodecError(f"bytes {offset} to {offset + size} of {inner.size}")
        self.inner, self.offset, self.size = inner, offset, size

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise CodecError(f"bytes {offset} to {offset + length} of {self.size}")
        return self.inner.read(self.offset + offset, length)


def slices(box: Box) -> tuple[slice, ...]:
    return tuple(slice(r.start, r.stop) for r in box.ranges())


class Codec:
    kind = "bytes"  # or "array", "serial"

    validate = True  # whether checksums are compared

    def __init__(self, config: dict):
        self.config = config

    def bind(self, form: Form) -> Form:
        """Checks the form and gives the next codec's."""
        self.form = form
        return form


# array to array


@CODECS.add("transpose")
class Transpose(Codec):
    kind = "array"

    def bind(self, form: Form) -> Form:
        order = self.config["order"]
        self.order = list(range(len(form.shape)))[::-1] if order == "F" else list(range(len(form.shape))) if order == "C" else list(order)
        if sorted(self.order) != list(range(len(form.shape))):
            raise CodecError(f"order {order} for {len(form.shape)} dimensions")
        if form.dtype.inner:
            raise CodecError("optional types can't be transposed")
        return replace(form, shape=tuple(form.shape[k] for k in self.order))

    def encode(self, a: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(a.transpose(self.order))

    def decode(self, a: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(a.transpose(np.argsort(self.order)))


@CODECS.add("reshape")
class Reshape(Codec):
    kind = "array"

    def bind(self, form: Form) -> Form:
        self.shape = form.shape
        made = [prod(form.shape[k] for k in d) if isinstance(d, list) else d for d in self.config["shape"]]
        if made.count(-1) > 1:
            raise CodecError("more than one automatic dimension")
        if -1 in made:
            rest = prod(d for d in made if d != -1)
            if not rest or prod(form.shape) % rest:
                raise CodecError(f"{form.shape} doesn't fit {made}")
            made[made.index(-1)] = prod(form.shape) // rest
        if prod(made) != prod(form.shape):
            raise CodecError(f"{form.shape} doesn't fit {made}")
        return replace(form, shape=tuple(made))

    def encode(self, a: np.ndarray) -> np.ndarray:
        made = self.config["shape"]
        return a.reshape([prod(a.shape[k] for k in d) if isinstance(d, list) else d for d in made])

    def decode(self, a: np.ndarray) -> np.ndarray:
        return a.reshape(self.shape)


@CODECS.add("squeeze")
class Squeeze(Codec):
    kind = "array"

    def bind(self, form: Form) -> Form:
        self.shape = form.shape
        return replace(form, shape=tuple(n for n in form.shape if n != 1))

    def encode(self, a: np.ndarray) -> np.ndarray:
        return a.reshape([n for n in a.shape if n != 1])

    def decode(self, a: np.ndarray) -> np.ndarray:
        return a.reshape(self.shape)


def round_bits(bits: np.ndarray, keep: int, width: int) -> np.ndarray:
    """Keeps the top `keep` of the lowest `width` bits, halves to even, without carrying past the integer's end."""
    drop = width - keep
    if drop <= 0:
        return bits
    t = bits.dtype.type
    half = (bits >> t(drop) & t(1)) + t((1 << (drop - 1)) - 1)
    most = np.iinfo(bits.dtype).max
    summed = np.where(bits > most - half, most, bits + half)
    return summed & ~t((1 << drop) - 1)


@CODECS.add("bitround")
class Bitround(Codec):
    kind = "array"

    def encode(self, a: np.ndarray) -> np.ndarray:
        keep, d = self.config["keepbits"], self.form.dtype
        mantissa = {"float16": 10, "float32": 23, "float64": 52, "bfloat16": 7, "complex64": 23, "complex128": 52}.get(d.name)
        if mantissa:
            size = a.dtype.itemsize // (2 if a.dtype.kind == "c" else 1)
            bits = np.ascontiguousarray(a).view(f"u{size}")
            return round_bits(bits, keep, mantissa).view(a.dtype)
        if not d.is_int:
            raise CodecError(f"bitround of {d.name}")
        # integers: from each one's highest set bit
        bits = np.ascontiguousarray(a).view(f"u{a.dtype.itemsize}")
        high = (bits.astype(np.uint64) >> np.uint64(32)).astype(np.float64)
        low = (bits.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.float64)
        width = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
        out = bits.copy()
        for w in np.unique(width):
            own = width == w
            out[own] = round_bits(bits[own], keep, int(w))
        return out.view(a.dtype)

    def decode(self, a: np.ndarray) -> np.ndarray:
        return a


def half_away(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) + x.dtype.type(0.5)), x)


def saturated(x: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Floats to a type; integers saturate and NaN becomes 0."""
    if dtype.kind == "f":
        return x.astype(dtype)
    info = np.iinfo(dtype)
    x = np.where(np.isnan(x), 0, x)
    inside = (x > float(info.min)) & (x < float(info.max))
    return np.where(inside, np.where(inside, x, 0).astype(dtype), np.where(x >= float(info.max), info.max, info.min)).astype(dtype)


@CODECS.add("fixedscaleoffset")
class FixedScaleOffset(Codec):
    kind = "array"

    def bind(self, form: Form) -> Form:
        self.form = form
        if not (form.dtype.numpy.kind in "iuf"):
            raise CodecError(f"fixedscaleoffset of {form.dtype.name}")
        wide = form.dtype.numpy.kind in "iu" and form.dtype.numpy.itemsize > 2 or form.dtype.numpy.itemsize == 8
        self.work = np.dtype("f8" if wide else "f4")
        astype = self.config.get("astype")
        self.to = data_type(astype) if astype else form.dtype
        return replace(form, dtype=self.to, fill=self.encode(np.array([form.fill], form.dtype.numpy))[0])

    def encode(self, a: np.ndarray) -> np.ndarray:
        scaled = half_away((a.astype(self.work) - self.work.type(self.config["offset"])) * self.work.type(self.config["scale"]))
        out = saturated(scaled, self.form.dtype.numpy)
        return out if self.to == self.form.dtype else saturated(out.astype("f4"), self.to.numpy)

    def decode(self, a: np.ndarray) -> np.ndarray:
        x = a if self.to == self.form.dtype else a.astype("f4")
        return saturated(x.astype(self.work) / self.work.type(self.config["scale"]) + self.work.type(self.config["offset"]), self.form.dtype.numpy)


def rounded(x: np.ndarray, mode: str) -> np.ndarray:
    return {"nearest-even": np.rint, "towards-zero": np.trunc, "towards-positive": np.ceil, "towards-negative": np.floor, "nearest-away": half_away}[mode](x)


def cast_values(a: np.ndarray, source: DataType, target: DataType, rounding: str, out_of_range: str | None, mapped: Sequence = ()) -> np.ndarray:
    """Elements cast one by one: exact pairs first, then rounding, then the range rule (clamp, wrap, or an error)."""
    flat = np.asarray(a).ravel()
    done, out = np.zeros(len(flat), bool), np.zeros(len(flat), target.numpy)
    number = lambda v, t: t.fill(v)
    for old, new in mapped:
        o = number(old, source)
        hit = ~done & ((flat == o) | (np.isnan(flat) & np.isnan(o) if source.numpy.kind == "f" else False))
        out[hit], done = number(new, target), done | hit
    rest = ~done
    x = flat[rest]
    if source.small or source.name == "bfloat16":
        x = source.unpack(x).astype(np.float64)
    if target.is_int:
        if x.dtype.kind == "f":
            if not np.isfinite(x).all():
                raise CodecError("a value that isn't finite can't become an integer")
            x = [int(v) for v in rounded(x.astype(np.float64), rounding)]
        else:
            x = [int(v) for v in x]
        if out_of_range is None and any(not target.low <= v <= target.high for v in x):
            raise CodecError(f"a value lies outside {target.name}")
        if out_of_range == "wrap":
            span = target.high - target.low + 1
            x = [(v - target.low) % span + target.low for v in x]
        out[rest] = np.array([min(max(v, target.low), target.high) for v in x], target.numpy)
    elif x.dtype.kind in "iu":
        out[rest] = np.array([_int_to_float(int(v), target, rounding) for v in x], target.numpy) if len(x) else out[rest]
    elif target.small or target.name == "bfloat16":
        out[rest] = target.pack(x)
    else:
        out[rest] = _narrow(x, target.numpy, rounding, out_of_range)
    return out.reshape(np.shape(a))


def _step(x, up: bool):
    return np.nextafter(x, x.dtype.type(np.inf if up else -np.inf))


def _int_to_float(v: int, target: DataType, mode: str):
    """Rounds once, straight to the target's precision."""
    if target.small or target.name == "bfloat16":
        return target.pack(np.array([float(v)]))[0]
    bits = {2: 11, 4: 24, 8: 53}[target.numpy.itemsize]
    size = abs(v).bit_length() - bits
    if size <= 0:
        return target.numpy.type(v)
    low, rest = abs(v) >> size, abs(v) & ((1 << size) - 1)
    half = 1 << (size - 1)
    up = {
        "nearest-even": rest > half or rest == half and low & 1,
        "nearest-away": rest >= half,
        "towards-zero": False,
        "towards-positive": rest > 0 and v > 0,
        "towards-negative": rest > 0 and v < 0,
    }[mode]
    return target.numpy.type(float(low + bool(up)) * 2.0**size * (1 if v > 0 else -1))


def _narrow(x: np.ndarray, dtype: np.dtype, mode: str, out_of_range: str | None) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x.astype(dtype)
    back = y.astype(np.float64)
    x = x.astype(np.float64)
    if mode == "towards-zero":
        y = np.where(np.abs(back) > np.abs(x), np.nextafter(y, dtype.type(0)), y)
    elif mode == "towards-positive":
        y = np.where(back < x, _step(y, True), y)
    elif mode == "towards-negative":
        y = np.where(back > x, _step(y, False), y)
    if out_of_range is None and (np.isinf(y) & np.isfinite(x)).any():
        raise CodecError("a value lies outside the type")
    return y


@CODECS.add("cast_value")
class CastValue(Codec):
    kind = "array"

    def bind(self, form: Form) -> Form:
        self.form, self.to = form, data_type(self.config["data_type"])
        if not all(d.is_int or d.is_float for d in (form.dtype, self.to)):
            raise CodecError(f"cast of {form.dtype.name} to {self.to.name}")
        return replace(form, dtype=self.to, fill=self.encode(np.array([form.fill], form.dtype.numpy))[0])

    def _cast(self, a: np.ndarray, source: DataType, target: DataType, way: str) -> np.ndarray:
        return cast_values(a, source, target, self.config.get("rounding", "nearest-even"), self.config.get("out_of_range"), (self.config.get("scalar_map") or {}).get(way) or ())

    def encode(self, a: np.ndarray) -> np.ndarray:
        return self._cast(a, self.form.dtype, self.to, "encode")

    def decode(self, a: np.ndarray) -> np.ndarray:
        return self._cast(a, self.to, self.form.dtype, "decode")


# array to bytes


@CODECS.add("bytes", "endian")
class Bytes(Codec):
    kind = "serial"

    def bind(self, form: Form) -> Form:
        if form.dtype.variable or form.dtype.inner:
            raise CodecError(f"bytes of {form.dtype.name}")
        self.disk = form.dtype.numpy.newbyteorder(">" if self.config.get("endian", "little") == "big" else "<")
        return super().bind(form)

    def encode(self, a: np.ndarray) -> bytes:
        return a.astype(self.disk, copy=False).tobytes()

    def decode(self, data: bytes) -> np.ndarray:
        if len(data) != prod(self.form.shape) * self.disk.itemsize:
            raise CodecError(f"{len(data)} bytes for {self.form.shape} of {self.form.dtype.name}")
        return np.frombuffer(data, self.disk).astype(self.form.dtype.numpy).reshape(self.form.shape)

    #: Runs that are read one by one; of more, the stretch from the first to the last.
    MOST_RUNS = 16

    def read_box(self, reader, box: Box) -> np.ndarray:
        """Reads only the bytes of the box: its contiguous runs where they are few, else the lines along the first dimension that hold it."""
        shape, size = self.form.shape, self.disk.itemsize
        if reader.size != prod(shape) * size:
            raise CodecError(f"{reader.size} bytes for {shape} of {self.form.dtype.name}")
        if box.is_empty or not shape:
            return self.decode(reader.read(0, reader.size))[slices(box)]
        runs = [r for _, r in zip(range(self.MOST_RUNS + 1), box.byte_ranges(shape, size), strict=False)]
        if len(runs) <= self.MOST_RUNS:
            flat, inner = b"".join(bytes(reader.read(o, n)) for o, n in runs), box.shape
            return np.frombuffer(flat, self.disk).astype(self.form.dtype.numpy).reshape(inner)
        line = prod(shape[1:]) * size
        flat = reader.read(box.start[0] * line, box.shape[0] * line)
        part = np.frombuffer(flat, self.disk).reshape(box.shape[0], *shape[1:])[(slice(None), *slices(box)[1:])]
        return part.astype(self.form.dtype.numpy)


def _raw(value) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


class _Variable(Codec):
    kind = "serial"

    def _made(self, parts: list[bytes]) -> np.ndarray:
        if len(parts) != prod(self.form.shape):
            raise CodecError(f"{len(parts)} elements for {self.form.shape}")
        out = np.empty(len(parts), object)
        out[:] = [p.decode() for p in parts] if self.form.dtype.spark == "string" else parts
        return out.reshape(self.form.shape)


@CODECS.add("vlen-utf8", "vlen-bytes", "vlen-array", "vlen_v2")
class VlenInterleaved(_Variable):
    """A 32-bit count, then each element's 32-bit length and bytes."""

    def encode(self, a: np.ndarray) -> bytes:
        parts = [_raw(v) for v in a.ravel()]
        return struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + p for p in parts)

    def decode(self, data: bytes) -> np.ndarray:
        (n,), at, parts = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", data, at)
            parts.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        return self._made(parts)


@CODECS.add("vlen")
class Vlen(_Variable):
    """The length of the encoded offsets (64 bits), the offsets, the data; or the offsets and their length at the end."""

    def bind(self, form: Form) -> Form:
        self.index_type = data_type(self.config.get("index_data_type", "uint64"))
        raw = [{"name": "bytes", "configuration": {"endian": "little"}}]
        self.index = Chain(self.config.get("index_codecs") or raw, Form(self.index_type, (prod(form.shape) + 1,), 0))
        self.data_codecs = self.config.get("data_codecs") or raw
        return super().bind(form)

    def _data(self, size: int) -> Chain:
        return Chain(self.data_codecs, Form(data_type("uint8"), (size,), 0))

    def encode(self, a: np.ndarray) -> bytes:
        parts = [_raw(v) for v in a.ravel()]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(self.index_type.numpy)
        joined = np.frombuffer(b"".join(parts), np.uint8)
        index, data = self.index.encode(offsets), self._data(len(joined)).encode(joined)
        size = struct.pack("<Q", len(index))
        return data + index + size if self.config.get("index_location") == "end" else size + index + data

    def decode(self, data: bytes) -> np.ndarray:
        if self.config.get("index_location") == "end":
            (n,) = struct.unpack("<Q", data[-8:])
            index, data = data[len(data) - 8 - n : -8], data[: len(data) - 8 - n]
        else:
            (n,) = struct.unpack_from("<Q", data)
            index, data = data[8 : 8 + n], data[8 + n :]
        offsets = self.index.decode(index).astype(np.int64)
        joined = self._data(int(offsets[-1])).decode(data).tobytes()
        return self._made([joined[a:b] for a, b in zip(offsets, offsets[1:], strict=False)])


@CODECS.add("packbits")
class Packbits(Codec):
    """Bits first_bit to last_bit of each component, lowest first; the count of padding bits may be kept in a byte at either end."""

    kind = "serial"

    def bind(self, form: Form) -> Form:
        d = form.dtype
        if d.variable or d.inner or d.numpy.kind not in "biufc" and d.numpy.names is None:
            raise CodecError(f"packbits of {d.name}")
        self.parts = 2 if d.numpy.kind == "c" or d.numpy.names else 1
        self.unit = np.dtype(f"u{d.numpy.itemsize // self.parts}")
        natural = 1 if d.name == "bool" else int(d.name.rpartition("int")[2]) if d.is_int else int("".join(c for c in d.name.partition("float")[2].partition("_")[0] if c.isdigit()) or self.unit.itemsize * 8) if d.small else self.unit.itemsize * 8
        self.first, last = self.config.get("first_bit") or 0, self.config.get("last_bit")
        self.last = natural - 1 if last is None else last
        self.signed = d.is_int and d.low < 0
        return super().bind(form)

    def encode(self, a: np.ndarray) -> bytes:
        raw = np.ascontiguousarray(a).view(self.unit).ravel().astype(np.uint64)
        bits = (raw[:, None] >> np.arange(self.first, self.last + 1, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
        packed, pad = np.packbits(bits, bitorder="little").tobytes(), bytes([-len(bits) % 8])
        how = self.config.get("padding_encoding", "none")
        return pad + packed if how in ("first_byte", "start_byte") else packed + pad if how in ("last_byte", "end_byte") else packed

    def decode(self, data: bytes) -> np.ndarray:
        how = self.config.get("padding_encoding", "none")
        data = data[1:] if how in ("first_byte", "start_byte") else data[:-1] if how in ("last_byte", "end_byte") else data
        n, width = prod(self.form.shape) * self.parts, self.last - self.first + 1
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width).astype(np.uint64)
        raw = (bits << np.arange(self.first, self.last + 1, dtype=np.uint64)).sum(1, dtype=np.uint64)
        if self.signed:  # the top bit goes on upwards
            raw = np.where(raw >> np.uint64(self.last) & np.uint64(1), raw | ~np.uint64((1 << (self.last + 1)) - 1), raw)
        return raw.astype(self.unit).view(self.form.dtype.numpy).reshape(self.form.shape)


@CODECS.add("optional")
class OptionalCodec(Codec):
    """Lengths of mask and data (64 bits each), the mask, and the data of the valid elements only. Arrays are masked arrays."""

    kind = "serial"

    def bind(self, form: Form) -> Form:
        if form.dtype.inner is None:
            raise CodecError(f"optional codec of {form.dtype.name}")
        self.mask = Chain(self.config.get("mask_codecs") or [{"name": "packbits"}], Form(data_type("bool"), form.shape, False))
        return super().bind(form)

    def _data(self, n: int) -> Chain:
        inner = self.form.dtype.inner
        return Chain(self.config.get("data_codecs") or default_codecs(inner), Form(inner, (n,), inner.fill(None) if inner.numpy != object else inner.fill("" if inner.name == "string" else [])))

    def encode(self, a: np.ma.MaskedArray) -> bytes:
        valid = ~np.ma.getmaskarray(a)
        held = np.ma.getdata(a)[valid]
        mask, data = self.mask.encode(valid), self._data(len(held)).encode(held)
        return struct.pack("<QQ", len(mask), len(data)) + mask + data

    def decode(self, data: bytes) -> np.ma.MaskedArray:
        m, n = struct.unpack_from("<QQ", data)
        valid = self.mask.decode(data[16 : 16 + m])
        out = np.ma.masked_all(self.form.shape, self.form.dtype.numpy)
        held = self._data(int(valid.sum())).decode(data[16 + m : 16 + m + n])
        out[valid] = held
        return out


_ABSENT = (1 << 64) - 1


@CODECS.add("sharding_indexed")
class Sharding(Codec):
    """Inner chunks encoded one by one, in C order, with an index of their offsets and sizes at the end or the start. Inner chunks of fill values are absent."""

    kind = "serial"

    def bind(self, form: Form) -> Form:
        self.inner_shape = tuple(self.config["chunk_shape"])
        if form.dtype.inner:
            raise CodecError("optional types can't be sharded")
        if len(self.inner_shape) != len(form.shape) or any(n % c for n, c in zip(form.shape, self.inner_shape, strict=True)):
            raise CodecError(f"inner chunks {self.inner_shape} don't divide {form.shape}")
        self.counts = tuple(n // c for n, c in zip(form.shape, self.inner_shape, strict=True))
        self.inner = Chain(self.config["codecs"], Form(form.dtype, self.inner_shape, form.fill), self.validate)
        index = self.config.get("index_codecs") or [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
        self.index = Chain(index, Form(data_type("uint64"), (*self.counts, 2), 0), self.validate)
        self.index_size = len(self.index.encode(np.zeros((*self.counts, 2), np.uint64)))
        self.at_start = self.config.get("index_location", "end") == "start"
        # encoding is sequential, so "unordered" gives C order, too
        if self.config.get("subchunk_write_order", "C") not in ("C", "unordered", "random"):
            raise CodecError(f"write order {self.config['subchunk_write_order']}")
        return super().bind(form)

    def box(self, number: Sequence[int]) -> tuple[slice, ...]:
        return tuple(slice(i * c, (i + 1) * c) for i, c in zip(number, self.inner_shape, strict=True))

    def join(self, parts: dict[tuple[int, ...], bytes]) -> bytes:
        index = np.full((*self.counts, 2), _ABSENT, np.uint64)
        at, body = self.index_size if self.at_start else 0, []
        for number in sorted(parts):
            index[number] = at, len(parts[number])
            at += len(parts[number])
            body.append(parts[number])
        encoded = self.index.encode(index)
        return b"".join([encoded, *body] if self.at_start else [*body, encoded])

    def encode(self, a: np.ndarray) -> bytes:
        parts = {}
        for number in product(*map(range, self.counts)):
            part = np.ascontiguousarray(a[self.box(number)])
            if not same_bits(part, self.form.fill):
                parts[number] = self.inner.encode(part)
        return self.join(parts)

    def index_range(self, size: int) -> tuple[int, int]:
        return (0, self.index_size) if self.at_start else (size - self.index_size, self.index_size)

    def entries(self, data: bytes) -> dict[tuple[int, ...], tuple[int, int]]:
        """Offset and size of each inner chunk that is there."""
        if len(data) < self.index_size:
            raise CodecError("a shard shorter than its index")
        a, n = self.index_range(len(data))
        return self.entries_of(data[a : a + n], len(data))

    def entries_of(self, index: bytes, size: int) -> dict[tuple[int, ...], tuple[int, int]]:
        found = {}
        table = self.index.decode(index)
        for number in product(*map(range, self.counts)):
            offset, n = map(int, table[number])
            if (offset, n) != (_ABSENT, _ABSENT):
                if offset + n > size:
                    raise CodecError(f"inner chunk {number} lies outside its shard")
                found[number] = offset, n
        return found

    def decode(self, data: bytes) -> np.ndarray:
        return self.read_box(ByteReader(data), Box.whole(self.form.shape))

    def decode_box(self, data: bytes, box: Box) -> np.ndarray:
        return self.read_box(ByteReader(data), box)

    def _index(self, reader) -> dict[tuple[int, ...], tuple[int, int]]:
        if reader.size < self.index_size:
            raise CodecError("a shard shorter than its index")
        return self.entries_of(reader.read(*self.index_range(reader.size)), reader.size)

    def read_box(self, reader, box: Box) -> np.ndarray:
        """Reads the index and decodes only the inner chunks that the box touches, and of these only what it touches, where their codecs can."""
        out = np.full(box.shape, self.form.fill, self.form.dtype.numpy)
        entries = self._index(reader)
        touched = [range(b.start // n, -(-b.stop // n)) for b, n in zip(box.ranges(), self.inner_shape, strict=True)] if not box.is_empty else [range(0)]
        # in the order of their bytes, so that a file is read forwards
        for offset, n, number in sorted((*entries[k], k) for k in product(*touched) if k in entries):
            own = Box(tuple(i * c for i, c in zip(number, self.inner_shape, strict=True)), self.inner_shape)
            common = own.overlap(box)
            out[slices(common.relative_to(box.start))] = self.inner.read_box(PartReader(reader, offset, n), common.relative_to(own.start))
        return out

    def updated(self, reader, places: np.ndarray, values: np.ndarray, append: bool = False) -> tuple[bytes | None, int]:
        """The shard with elements put at C-order places, None when it becomes empty, and the number of inner chunks that were decoded and encoded."""
        index = np.unravel_index(places, self.form.shape)
        numbers = np.ravel_multi_index([i // n for i, n in zip(index, self.inner_shape, strict=True)], self.counts)
        inside = np.ravel_multi_index([i % n for i, n in zip(index, self.inner_shape, strict=True)], self.inner_shape)
        entries = self._index(reader) if reader else {}
        changed = {}
        for flat in np.unique(numbers).tolist():
            number, own = tuple(map(int, np.unravel_index(flat, self.counts))), numbers == flat
            if number in entries:
                a = self.inner.decode(reader.read(*entries[number]))
            else:
                a = np.full(self.inner_shape, self.form.fill, self.form.dtype.numpy)
            a = np.array(a)
            a.reshape(-1)[inside[own]] = values[own]
            changed[number] = a
        return self.update(reader.read(0, reader.size) if reader else None, changed, append), len(changed)

    def update(self, data: bytes | None, changed: dict[tuple[int, ...], np.ndarray], append: bool = False) -> bytes | None:
        """Replaces inner chunks; None when the shard becomes empty. With `append` new ones go after the old bytes, of which some are then dead until `compact`."""
        entries = self.entries(data) if data else {}
        made = {k: None if same_bits(a, self.form.fill) else self.inner.encode(np.ascontiguousarray(a)) for k, a in changed.items()}
        left = {k: e for k, e in entries.items() if k not in made}
        if not left and not any(v is not None for v in made.values()):
            return None
        if not append or not left:
            return self.join({k: data[o : o + n] for k, (o, n) in left.items()} | {k: v for k, v in made.items() if v is not None})
        index = np.full((*self.counts, 2), _ABSENT, np.uint64)
        for k, e in left.items():
            index[k] = e
        body = [data[self.index_size :] if self.at_start else data[: len(data) - self.index_size]]
        at = len(data) if self.at_start else len(body[0])
        for k in sorted(made):
            if made[k] is not None:
                index[k] = at, len(made[k])
                at += len(made[k])
                body.append(made[k])
        encoded = self.index.encode(index)
        return b"".join([encoded, *body] if self.at_start else [*body, encoded])

    def compact(self, data: bytes) -> bytes | None:
        """The shard without dead bytes; None when it has none."""
        parts = {k: data[o : o + n] for k, (o, n) in self.entries(data).items()}
        return None if sum(map(len, parts.values())) + self.index_size == len(data) else self.join(parts)


# bytes to bytes


@CODECS.add("gzip")
class Gzip(Codec):
    def encode(self, data: bytes) -> bytes:
        return gzip.compress(data, self.config.get("level", 6), mtime=0)

    def decode(self, data: bytes) -> bytes:
        return gzip.decompress(data)


@CODECS.add("zlib")
class Zlib(Codec):
    def encode(self, data: bytes) -> bytes:
        return zlib.compress(data, self.config.get("level", 6))

    def decode(self, data: bytes) -> bytes:
        return zlib.decompress(data)


@CODECS.add("bz2")
class Bz2(Codec):
    def encode(self, data: bytes) -> bytes:
        return bz2.compress(data, self.config.get("level", 9))

    def decode(self, data: bytes) -> bytes:
        return bz2.decompress(data)


@CODECS.add("zstd")
class Zstd(Codec):
    def encode(self, data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=self.config.get("level", 3), write_checksum=bool(self.config.get("checksum"))).compress(data)

    def decode(self, data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)


_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0x82F63B78 if _c & 1 else 0)
    _CRC[_i] = _c
_CRC_LIST = _CRC.tolist()


_CRC_WORDS = np.empty((4, 256), np.uint32)
_CRC_WORDS[0] = _CRC
for _i in range(1, 4):
    _CRC_WORDS[_i] = _CRC[_CRC_WORDS[_i - 1] & 255] ^ (_CRC_WORDS[_i - 1] >> 8)


@lru_cache(maxsize=64)
def _over_zeros(n: int) -> list[list[int]]:
    """Tables that carry a register over n zero bytes, by its four bytes: the map is linear over bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step, out = _CRC[bits & 255] ^ (bits >> 8), bits.copy()
    through = lambda m, x: np.bitwise_xor.reduce(np.where((x[:, None] >> np.arange(32, dtype=np.uint32)) & 1, m[None, :], np.uint32(0)), axis=1)
    while n:
        if n & 1:
            out = through(step, out)
        step, n = through(step, step), n >> 1
    byte = np.arange(256, dtype=np.uint32)
    return [through(out, byte << np.uint32(8 * k)).tolist() for k in range(4)]


def crc32c(data: bytes) -> int:
    """Many stretches of the data side by side, four bytes at a step; then their registers are joined."""
    n = len(data)
    c = 0xFFFFFFFF
    lanes = min(4096, n // 512)
    if lanes >= 8:
        size = n // lanes // 4 * 4
        words = np.frombuffer(data, "<u4", lanes * size // 4).reshape(lanes, -1).T.copy()
        x = np.zeros(lanes, np.uint32)
        x[0] = c
        t0, t1, t2, t3 = _CRC_WORDS
        for w in words:
            x ^= w
            x = t3[x & 255] ^ t2[(x >> 8) & 255] ^ t1[(x >> 16) & 255] ^ t0[x >> 24]
        a, b, d, e = _over_zeros(size)
        c = 0
        for r in x.tolist():
            c = a[c & 255] ^ b[c >> 8 & 255] ^ d[c >> 16 & 255] ^ e[c >> 24] ^ r
        data = data[lanes * size :]
    for b in bytes(data):
        c = _CRC_LIST[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def fletcher32(data: bytes) -> int:
    """Big-endian 16-bit words; a last odd byte doesn't count."""
    words = np.frombuffer(data[: len(data) // 2 * 2], ">u2").astype(np.uint64)
    a = b = 0
    for i in range(0, len(words), 360):
        part = words[i : i + 360]
        n = len(part)
        b += n * a + int((part * np.arange(n, 0, -1, dtype=np.uint64)).sum())
        a += int(part.sum())
        a, b = _fold(_fold(a)), _fold(_fold(b))
    return _fold(b) << 16 | _fold(a)


def _fold(x: int) -> int:
    while x >> 16:
        x = (x & 0xFFFF) + (x >> 16)
    return x


class _Checksum(Codec):
    at = "end"
    sum = staticmethod(crc32c)

    def encode(self, data: bytes) -> bytes:
        mark = struct.pack("<I", self.sum(data))
        return mark + data if self.config.get("location", self.at) == "start" else data + mark

    def decode(self, data: bytes) -> bytes:
        if len(data) < 4:
            raise ChecksumError("too short for a checksum")
        body, mark = (data[4:], data[:4]) if self.config.get("location", self.at) == "start" else (data[:-4], data[-4:])
        if self.validate and self.config.get("validate", True) and struct.pack("<I", self.sum(body)) != mark:
            raise ChecksumError(f"{type(self).__name__} mismatch")
        return body


@CODECS.add("crc32c")
class Crc32c(_Checksum):
    pass


@CODECS.add("adler32")
class Adler32(_Checksum):
    at, sum = "start", staticmethod(zlib.adler32)


@CODECS.add("fletcher32")
class Fletcher32(_Checksum):
    sum = staticmethod(fletcher32)


@CODECS.add("shuffle")
class Shuffle(Codec):
    def _n(self, data: bytes) -> int:
        n = self.config["elementsize"]
        if len(data) % n:
            raise CodecError(f"{len(data)} bytes aren't elements of {n}")
        return n

    def encode(self, data: bytes) -> bytes:
        return np.frombuffer(data, np.uint8).reshape(-1, self._n(data)).T.tobytes()

    def decode(self, data: bytes) -> bytes:
        return np.frombuffer(data, np.uint8).reshape(self._n(data), -1).T.tobytes()


def _missing(name: str) -> None:
    @CODECS.add(name)
    class Missing(Codec):
        kind = "bytes" if name in ("blosc", "gdeflate") else "serial"

        def bind(self, form: Form) -> Form:
            raise UnsupportedExtension(f"the codec {name} needs a library that isn't here")


for _name in ("pcodec", "zfp", "zfpy", "gdeflate"):
    _missing(_name)


def _bitshuffled(raw: bytes, typesize: int, back: bool) -> bytes:
    """The bits of each place in the elements together, for whole groups of eight elements; the rest as it is."""
    n = len(raw) // typesize // 8 * 8
    held = np.frombuffer(raw[: n * typesize], np.uint8)
    if back:
        bits = np.unpackbits(held, bitorder="little").reshape(typesize * 8, n).T
        out = np.packbits(bits, axis=1, bitorder="little")
    else:
        bits = np.unpackbits(held.reshape(n, typesize), axis=1, bitorder="little").T
        out = np.packbits(np.ascontiguousarray(bits).ravel(), bitorder="little")
    return out.tobytes() + bytes(raw[n * typesize :])


def blosclz_inflate(raw: bytes, n: int) -> bytes:
    """Literal runs (1 to 32 bytes) and matches (3 bits of length, 13 of distance, more of either where these are full)."""
    out, at, end = bytearray(), 0, len(raw)
    control = raw[0] & 31
    at = 1
    while True:
        if control < 32:
            out += raw[at : at + control + 1]
            at += control + 1
        else:
            size, far = (control >> 5) - 1, (control & 31) << 8
            if size == 6:
                while True:
                    size += raw[at]
                    at += 1
                    if raw[at - 1] != 255:
                        break
            near = raw[at]
            at += 1
            back = far + near + 1
            if near == 255 and far == 31 << 8:
                back = (raw[at] << 8 | raw[at + 1]) + 8192
                at += 2
            size += 3
            start = len(out) - back
            if start < 0:
                raise CodecError("a match before the data's beginning")
            if back >= size:
                out += out[start : start + size]
            else:
                piece = bytes(out[start:])
                out += (piece * (size // back + 1))[:size]
        if at >= end:
            break
        control = raw[at]
        at += 1
    if len(out) != n:
        raise CodecError(f"{len(out)} bytes, not {n}")
    return bytes(out)


def blosclz_deflate(data: bytes) -> bytes | None:
    """Greedy matches by a table of three-byte beginnings; None where that saves nothing."""
    out, seen, literal, at, n = bytearray(), {}, 0, 0, len(data)

    def flush(stop: int) -> None:
        for k in range(literal, stop, 32):
            piece = data[k : min(k + 32, stop)]
            out.append(len(piece) - 1)
            out.extend(piece)

    while at < n:
        back, key = 0, data[at : at + 3]
        if at and len(key) == 3:  # the first byte is a literal, since the first control's upper bits don't count
            back = at - seen[key] if key in seen else 0
            seen[key] = at
        if not back or back > 8191:
            at += 1
            if len(out) + at - literal > n:
                return None
            continue
        size = 3
        while at + size < n and data[at + size] == data[at + size - back]:
            size += 1
        flush(at)
        rest, far = size - 3, back - 1
        out.append(min(rest + 1, 7) << 5 | far >> 8)
        if rest >= 6:
            rest -= 6
            out.extend(b"\xff" * (rest // 255) + bytes([rest % 255]))
        out.append(far & 255)
        at += size
        literal = at
    flush(n)
    return bytes(out) if len(out) < n else None


@CODECS.add("blosc")
class Blosc(Codec):
    """The blosc 1 container: 16 bytes of header, block offsets, and blocks, each split in streams where the header says so.

    Configuration: cname (lz4, lz4hc, zstd, zlib, snappy, blosclz), clevel (0 stores), shuffle (noshuffle, shuffle, bitshuffle), typesize, blocksize (0: 256 KiB).
    Blocks aren't split in streams on writing. lz4hc writes what lz4 does.
    """

    FORMATS = {"blosclz": 0, "lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}

    def bind(self, form: Form) -> Form:
        if self.config.get("cname", "lz4") not in self.FORMATS:
            raise UnsupportedExtension(f"blosc with {self.config['cname']}")
        if self.config.get("shuffle", "noshuffle") not in ("noshuffle", "shuffle", "bitshuffle"):
            raise CodecError(f"blosc with {self.config['shuffle']}")
        return super().bind(form)

    def encode(self, data: bytes) -> bytes:
        size, level, cname = self.config.get("typesize") or 1, self.config.get("clevel", 5), self.config.get("cname", "lz4")
        flags = {"noshuffle": 0, "shuffle": 1 if size > 1 else 0, "bitshuffle": 4}[self.config.get("shuffle", "noshuffle")]
        size = min(size, 255)
        block = min(len(data), (self.config.get("blocksize") or 1 << 18) // size * size or size)
        blocks, starts = [], []
        if level and len(data) >= 128:
            at = 16 + 4 * -(-len(data) // block)
            for k in range(0, len(data), block):
                part = self._shuffled(data[k : k + block], flags, size)
                made = self._deflate(cname, part, level)
                made = part if made is None or len(made) >= len(part) else made
                starts.append(at)
                blocks.append(struct.pack("<i", len(made)) + made)
                at += 4 + len(made)
            if at < len(data) + 16:
                head = struct.pack("<BBBBIII", 2, 1, flags | 0x10 | self.FORMATS[cname] << 5, size, len(data), block, at)
                return head + struct.pack(f"<{len(starts)}I", *starts) + b"".join(blocks)
        return struct.pack("<BBBBIII", 2, 1, 0x2 | 0x10 | self.FORMATS[cname] << 5, size, len(data), max(block, 1), len(data) + 16) + bytes(data)

    @staticmethod
    def _deflate(cname: str, part: bytes, level: int) -> bytes | None:
        if cname == "zlib":
            return zlib.compress(part, level)
        if cname == "zstd":
            import zstandard

            return zstandard.ZstdCompressor(level=2 * level - 1 if level < 9 else 22).compress(part)
        if cname == "blosclz":
            return blosclz_deflate(bytes(part))
        import pyarrow as pa

        return pa.Codec("snappy" if cname == "snappy" else "lz4_raw").compress(part, asbytes=True)

    @staticmethod
    def _shuffled(raw: bytes, flags: int, typesize: int) -> bytes:
        if flags & 0x1:
            whole = len(raw) // typesize * typesize
            return np.frombuffer(raw[:whole], np.uint8).reshape(-1, typesize).T.tobytes() + bytes(raw[whole:])
        return _bitshuffled(raw, typesize, False) if flags & 0x4 else bytes(raw)

    def decode(self, data: bytes) -> bytes:
        _, _, flags, typesize, size, block, _ = struct.unpack_from("<BBBBIII", data)
        if flags & 0x2:
            return data[16 : 16 + size]
        out = []
        for k in range(-(-size // block) if block else 0):
            n = min(block, size - k * block)
            (at,) = struct.unpack_from("<I", data, 16 + 4 * k)
            streams = typesize if not flags & 0x10 and n == block and typesize > 1 and n // typesize >= 128 else 1
            parts = []
            for _ in range(streams):
                (length,) = struct.unpack_from("<i", data, at)
                raw = data[at + 4 : at + 4 + length]
                parts.append(bytes(raw) if length == n // streams else self._inflate(flags >> 5, raw, n // streams))
                at += 4 + length
            out.append(self._ordered(b"".join(parts), flags, typesize))
        return b"".join(out)

    @staticmethod
    def _inflate(kind: int, raw: bytes, n: int) -> bytes:
        if kind == 3:
            return zlib.decompress(raw)
        if kind == 0:
            return blosclz_inflate(bytes(raw), n)
        import pyarrow as pa

        name = {1: "lz4_raw", 2: "snappy", 4: "zstd"}.get(kind)
        if name is None:
            raise UnsupportedExtension(f"blosc format {kind}")
        return pa.Codec(name).decompress(raw, n).to_pybytes()

    @staticmethod
    def _ordered(raw: bytes, flags: int, typesize: int) -> bytes:
        if flags & 0x1 and typesize > 1:
            whole = len(raw) // typesize * typesize
            return np.frombuffer(raw[:whole], np.uint8).reshape(typesize, -1).T.tobytes() + raw[whole:]
        return _bitshuffled(raw, typesize, True) if flags & 0x4 else raw


# the chain


def default_codecs(dtype: DataType) -> list[dict]:
    """What serialises a type when nothing is said."""
    if dtype.inner is not None:
        return [{"name": "optional", "configuration": {"mask_codecs": [{"name": "packbits"}], "data_codecs": default_codecs(dtype.inner)}}]
    if dtype.numpy == object:
        return [{"name": "vlen-utf8" if dtype.name == "string" else "vlen-bytes"}]
    return [{"name": "bytes", "configuration": {"endian": "little"}}]


class Chain:
    """Codecs bound to a form. Any number array to array, one array to bytes, any number bytes to bytes."""

    def __init__(self, metas: Sequence[str | dict], form: Form, validate: bool = True):
        self.metas, self.form, self.validate = list(metas), form, validate
        self.codecs: list[Codec] = []
        phase = 0
        for meta in metas:
            meta = {"name": meta} if isinstance(meta, str) else meta
            codec = CODECS.get(meta["name"])(dict(meta.get("configuration") or {}))
            codec.validate = validate
            want = {"array": 0, "serial": 1, "bytes": 2}[codec.kind]
            if want < phase or want == 1 == phase or want == 2 and phase == 0:
                raise CodecError(f"{meta['name']} is out of place")
            phase = max(phase, want)
            form = codec.bind(form)
            self.codecs.append(codec)
        if phase == 0:
            raise CodecError("no codec turns the array into bytes")

    @property
    def sharding(self) -> Sharding | None:
        """The sharding codec when nothing stands around it."""
        return self.codecs[0] if len(self.codecs) == 1 and isinstance(self.codecs[0], Sharding) else None

    def encode(self, a: np.ndarray) -> bytes:
        for codec in self.codecs:
            a = codec.encode(a)
        return a

    def decode(self, data: bytes) -> np.ndarray:
        for codec in reversed(self.codecs):
            data = codec.decode(data)
        return data

    def decode_box(self, data: bytes, box: Box) -> np.ndarray:
        return self.read_box(ByteReader(data), box)

    def read_box(self, reader, box: Box) -> np.ndarray:
        """The elements of a box from a reader of the encoded value. Shards and plain bytes read only what they need, checksums around them are skipped unread; else all is read."""
        serial, around = self.codecs[0], self.codecs[1:]
        if isinstance(serial, (Sharding, Bytes)) and all(isinstance(c, _Checksum) for c in around) and box != Box.whole(self.form.shape):
            for c in reversed(around):
                reader = PartReader(reader, 4 if c.config.get("location", c.at) == "start" else 0, reader.size - 4)
            return serial.read_box(reader, box)
        if isinstance(serial, Sharding) and not around:
            return serial.read_box(reader, box)
        return self.decode(reader.read(0, reader.size))[slices(box)]

    def updated(self, reader, places: np.ndarray, values: np.ndarray, is_empty, append: bool = False) -> tuple[bytes | None, int]:
        """The encoded chunk with elements put at C-order places, None when it holds nothing; and how many inner chunks (or the chunk itself) were encoded for it."""
        if self.sharding:
            return self.sharding.updated(reader, places, values, append)
        fill = self.form.fill
        if reader:
            a = self.decode(reader.read(0, reader.size)).copy()
        elif self.form.dtype.inner is not None:
            a = np.ma.masked_all(self.form.shape, self.form.dtype.numpy)
            if fill is not None:
                a[...] = fill
        else:
            a = np.full(self.form.shape, fill, self.form.dtype.numpy)
        flat = a.reshape(-1)
        flat[places] = values
        a = flat.reshape(self.form.shape)
        return (None, 1) if is_empty(a) else (self.encode(a), 1)

    def __reduce__(self):
        return Chain, (self.metas, self.form, self.validate)


def codecs_json(metas: Sequence) -> str:
    return json.dumps([{"name": m} if isinstance(m, str) else m for m in metas])
