"""Data types: names, numpy storage, Spark columns, fill values. Types that Spark lacks keep their bits in numpy and widen as columns."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np

from gridloom.registry import DATA_TYPES


class DataTypeError(ValueError):
    pass


@dataclass(frozen=True)
class DataType:
    """numpy: how elements lie in memory (object for strings and bytes). low, high: the range of integers. small: (exponent bits, mantissa bits, bias, kind) of bit-pattern floats."""

    name: str
    numpy: np.dtype
    spark: str
    low: int | None = None
    high: int | None = None
    small: tuple | None = None
    inner: DataType | None = None
    config: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def variable(self) -> bool:
        return self.inner.variable if self.inner else self.numpy == object

    @property
    def is_int(self) -> bool:
        return self.low is not None

    @property
    def is_float(self) -> bool:
        return self.small is not None or self.numpy.kind == "f"

    @property
    def is_plain(self) -> bool:
        """Numbers whose column values convert as whole buffers."""
        return self.inner is None and self.small is None and self.numpy.kind in "biuf" and self.name not in ("bfloat16", "uint64")

    def fill(self, value):
        """The element of a JSON fill value."""
        if self.inner is not None:
            return None if value is None else self.inner.fill(value[0] if isinstance(value, list) else value)
        if self.numpy == object:
            return value if self.name == "string" else bytes(value or [])
        if value is None:
            return np.zeros((), self.numpy)[()]
        if self.numpy.kind == "c" or self.name.startswith("complex"):
            re, im = (self._part(v) for v in (value if isinstance(value, list) else (value, 0)))
            return np.array(complex(re, im), self.numpy)[()] if self.numpy.kind == "c" else np.array((re, im), self.numpy)[()]
        if self.is_float:
            return self._part(value)
        if self.numpy.kind == "V":
            return np.void(bytes(value))
        if self.numpy.kind in "mM":
            return np.array("NaT" if value == "NaT" else int(value), self.numpy)[()]
        if self.numpy.kind == "U":
            return np.array(value, self.numpy)[()]
        if self.name == "bool":
            return np.bool_(value)
        if self.is_int and not self.low <= int(value) <= self.high:
            raise DataTypeError(f"{value} outside {self.name}")
        return np.array(int(value), self.numpy)[()]

    def _part(self, value):
        if isinstance(value, str) and value.startswith("0x"):
            bits = int(value, 16)
            width = {"bfloat16": "u2"}.get(self.name, f"u{max(1, self.numpy.itemsize // (2 if self.numpy.kind == 'c' else 1))}")
            raw = np.array(bits, width)
            return raw[()] if self.small or self.name == "bfloat16" else raw.view(width.replace("u", "f"))[()]
        number = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(value, value) if isinstance(value, str) else value
        if self.small or self.name == "bfloat16":
            return self.pack(np.array([number], np.float64))[0]
        return np.array(number, self.numpy if self.numpy.kind == "f" else f"f{self.numpy.itemsize // 2}")[()]

    # bit-pattern floats
    def unpack(self, bits: np.ndarray) -> np.ndarray:
        """Floats of bit patterns."""
        if self.name == "bfloat16":
            return (bits.astype(np.uint32) << 16).view(np.float32)
        return self.values()[bits.astype(np.int64)]

    def values(self) -> np.ndarray:
        """The value of every bit pattern, by the format's rule."""
        e, m, bias, kind = self.small
        sign_bit = 0 if kind == "unsigned" else 1
        code = np.arange(1 << (sign_bit + e + m))
        sign = np.where(code >> (e + m) & 1, -1.0, 1.0) if sign_bit else 1.0
        exponent, mantissa = code >> m & ((1 << e) - 1), code & ((1 << m) - 1)
        if kind == "unsigned":  # exponent only
            return np.where(code == 255, np.nan, np.exp2(code.astype(float) - bias))
        out = np.where(exponent == 0, mantissa * 2.0 ** (1 - bias - m), (1 + mantissa * 2.0**-m) * np.exp2(exponent.astype(float) - bias)) * sign
        if kind == "ieee":
            top = exponent == (1 << e) - 1
            out = np.where(top, np.where(mantissa == 0, np.inf * sign, np.nan), out)
        elif kind == "fn":
            out = np.where((code & ((1 << (e + m)) - 1)) == (1 << (e + m)) - 1, np.nan, out)
        elif kind == "fnuz":
            out = np.where(code == 1 << (e + m), np.nan, out)
        return out

    def pack(self, numbers: np.ndarray) -> np.ndarray:
        """The nearest bit patterns (ties to even patterns); beyond the largest value: infinity or NaN where the type has one, else the largest."""
        x = np.asarray(numbers, np.float64)
        if self.name == "bfloat16":
            bits = x.astype(np.float32).view(np.uint32)
            rounded = (bits + 0x7FFF + (bits >> 16 & 1)) >> 16
            return np.where(np.isnan(x), 0x7FC0, rounded).astype(np.uint16)
        values = self.values()
        finite = np.flatnonzero(np.isfinite(values))
        finite = finite[~((values[finite] == 0) & np.signbit(values[finite]))]
        order = finite[np.argsort(values[finite], kind="stable")]
        v = values[order]
        hi = np.clip(np.searchsorted(v, x), 1, len(v) - 1)
        a, b = v[hi - 1], v[hi]
        with np.errstate(invalid="ignore"):
            up = (x - a > b - x) | ((x - a == b - x) & (order[hi] % 2 == 0))
        out = np.where(up, order[hi], order[hi - 1])
        out = np.where(x >= v[-1], order[-1], np.where(x <= v[0], order[0], out))
        nans, infs = np.flatnonzero(np.isnan(values)), np.flatnonzero(np.isinf(values))
        with np.errstate(invalid="ignore"):
            over = np.abs(x) > max(abs(v[-1]), abs(v[0])) + abs(v[-1] - v[-2]) / 2
        if len(infs):
            out = np.where(over, np.where(x > 0, infs[values[infs] > 0][0], infs[values[infs] < 0][0] if (values[infs] < 0).any() else infs[0]), out)
        negative_zero = (x == 0) & np.signbit(x) & np.isin(1 << (len(values).bit_length() - 2), np.flatnonzero(values == 0))
        out = np.where(negative_zero, 1 << (len(values).bit_length() - 2), out)
        return np.where(np.isnan(x), nans[0] if len(nans) else order[-1], out).astype(np.uint8)


def _fixed(name: str, numpy: str, spark: str, *aliases: str, **more) -> None:
    made = DataType(name, np.dtype(numpy), spark, **more)
    DATA_TYPES.add(name, *aliases)(lambda config=None, made=made: made)


_fixed("bool", "?", "boolean", "|b1")
for _bits, _numpy in ((2, "i1"), (4, "i1"), (8, "i1"), (16, "i2"), (32, "i4"), (64, "i8")):
    _signed = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}.get(_bits, "tinyint")
    _fixed(f"int{_bits}", _numpy, _signed, *([f"<i{_bits // 8}", f">i{_bits // 8}", f"|i{_bits // 8}"] if _bits >= 8 else []), low=-(1 << (_bits - 1)), high=(1 << (_bits - 1)) - 1)
    _wider = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}.get(_bits, "tinyint")
    _fixed(f"uint{_bits}", _numpy.replace("i", "u"), _wider, *([f"<u{_bits // 8}", f">u{_bits // 8}", f"|u{_bits // 8}"] if _bits >= 8 else []), low=0, high=(1 << _bits) - 1)
_fixed("float16", "f2", "float", "<f2", ">f2")
_fixed("float32", "f4", "float", "<f4", ">f4")
_fixed("float64", "f8", "double", "<f8", ">f8")
_fixed("bfloat16", "u2", "float")
#: Exponent bits, mantissa bits, bias, and which patterns aren't finite.
SMALL_FLOATS = {
    "float4_e2m1fn": (2, 1, 1, "finite"),
    "float6_e2m3fn": (2, 3, 1, "finite"),
    "float6_e3m2fn": (3, 2, 3, "finite"),
    "float8_e3m4": (3, 4, 3, "ieee"),
    "float8_e4m3": (4, 3, 7, "ieee"),
    "float8_e4m3fn": (4, 3, 7, "fn"),
    "float8_e4m3b11fnuz": (4, 3, 11, "fnuz"),
    "float8_e4m3fnuz": (4, 3, 8, "fnuz"),
    "float8_e5m2": (5, 2, 15, "ieee"),
    "float8_e5m2fnuz": (5, 2, 16, "fnuz"),
    "float8_e8m0fnu": (8, 0, 127, "unsigned"),
}
for _name, _small in SMALL_FLOATS.items():
    _fixed(_name, "u1", "float", small=_small)
    _fixed(f"complex_{_name}", "u1,u1", "struct<re: float, im: float>")
_fixed("complex64", "c8", "struct<re: float, im: float>", "complex_float32", "<c8", ">c8")
_fixed("complex128", "c16", "struct<re: double, im: double>", "complex_float64", "<c16", ">c16")
_fixed("complex_float16", "f2,f2", "struct<re: float, im: float>")
_fixed("complex_bfloat16", "u2,u2", "struct<re: float, im: float>")
_fixed("string", "O", "string", "|O")
_fixed("bytes", "O", "binary", "binary", "variable_length_bytes")


@DATA_TYPES.add("raw_bits")
def _raw(config: dict) -> DataType:
    return DataType(f"r{8 * config['bytes']}", np.dtype(f"V{config['bytes']}"), "binary")


@DATA_TYPES.add("fixed_length_utf32")
def _utf32(config: dict) -> DataType:
    return DataType("fixed_length_utf32", np.dtype(f"<U{config['length_bytes'] // 4}"), "string", config=config)


#: Time units and numpy's codes for them.
UNITS = {"generic": "generic", "Y": "Y", "M": "M", "W": "W", "D": "D", "h": "h", "m": "m", "s": "s", "ms": "ms", "us": "us", "μs": "us", "ns": "ns", "ps": "ps", "fs": "fs", "as": "as"}


def _time(kind: str):
    def made(config: dict) -> DataType:
        unit, scale = UNITS[config["unit"]], config.get("scale_factor", 1)
        return DataType(f"numpy.{'datetime64' if kind == 'M' else 'timedelta64'}", np.dtype(f"{kind}8" if unit == "generic" else f"{kind}8[{scale}{unit}]"), "bigint", config={"unit": unit, "scale_factor": scale})

    return made


DATA_TYPES.add("numpy.datetime64", "datetime64")(_time("M"))
DATA_TYPES.add("numpy.timedelta64", "timedelta64")(_time("m"))


@DATA_TYPES.add("optional")
def _optional(config: dict) -> DataType:
    inner = data_type({"name": config["name"], "configuration": config.get("configuration") or {}})
    return DataType("optional", inner.numpy, inner.spark, inner=inner, config=config)


def data_type(meta: str | dict) -> DataType:
    """The type of a name, or of a name with a configuration."""
    name, config = (meta, {}) if isinstance(meta, str) else (meta["name"], meta.get("configuration") or {})
    if len(name) > 1 and name[0] == "r" and name[1:].isdigit():
        if int(name[1:]) % 8:
            raise DataTypeError(name)
        return DATA_TYPES.get("raw_bits")({"bytes": int(name[1:]) // 8})
    if name.startswith("|V"):
        return DATA_TYPES.get("raw_bits")({"bytes": int(name[2:])})
    if name[1:2] == "U" and name[0] in "<>":
        return DATA_TYPES.get("fixed_length_utf32")({"length_bytes": 4 * int(name[2:])})
    if name[1:3] in ("M8", "m8"):
        unit = name[name.index("[") + 1 : -1] if "[" in name else "generic"
        return DATA_TYPES.get("datetime64" if name[1] == "M" else "timedelta64")({"unit": unit, "scale_factor": 1})
    return DATA_TYPES.get(name)(config)


def same_bits(values: np.ndarray, fill) -> bool:
    """Whether all elements have the fill value's bits: -0.0 isn't 0.0, and NaNs are told apart by their payload. Strings are compared one by one."""
    if values.dtype == object:
        return all(v == fill for v in values.ravel())
    want = np.asarray(fill, values.dtype).tobytes()
    raw = np.ascontiguousarray(values).tobytes()
    return raw == want * values.size


def float_bits(x: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", x))[0]
