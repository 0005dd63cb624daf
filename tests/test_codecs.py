"""Codecs against known bytes and values, and round trips over types."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions.boxes import Box
from gridloom.functions.codecs import ByteReader, Chain, ChecksumError, CodecError, Form, blosclz_deflate, blosclz_inflate, cast_values, crc32c, slices
from gridloom.functions.dtypes import SMALL_FLOATS, data_type, same_bits
from gridloom.registry import CODECS, UnsupportedExtension


def bound(name, a, kind, fill=0, **config):
    codec = CODECS.get(name)(config)
    codec.bind(Form(data_type(kind), a.shape, data_type(kind).fill(fill)))
    return codec


@pytest.mark.parametrize(
    "dtype, given, wanted",
    [
        ("float32", [0, 1.2345679, -8.358719, 98765.43], [0, 1.25, -8, 98304]),
        ("uint32", [0, 1024, 1280, 1664, 1685, 123145182, 4294967295], [0, 1024, 1280, 1536, 1792, 117440512, 3758096384]),
        ("uint8", [0, 3, 7, 15, 17, 54, 89, 128, 255], [0, 3, 7, 16, 16, 56, 96, 128, 224]),
    ],
)
def test_bitround(dtype, given, wanted):
    a = np.array(given, data_type(dtype).numpy)
    assert bound("bitround", a, dtype, keepbits=3).encode(a).tolist() == wanted


@pytest.mark.parametrize("name, wanted", [("crc32c", [0, 1, 2, 3, 4, 5, 20, 133, 9, 65]), ("adler32", [16, 0, 41, 0, 0, 1, 2, 3, 4, 5]), ("fletcher32", [0, 1, 2, 3, 4, 5, 9, 6, 14, 8])])
def test_checksums(name, wanted):
    codec = CODECS.get(name)({})
    data = codec.encode(bytes(range(6)))
    assert list(data) == wanted and codec.decode(data) == bytes(range(6))
    with pytest.raises(ChecksumError):
        codec.decode(bytes([data[0] ^ 1]) + data[1:])
    assert CODECS.get(name)({"validate": False}).decode(bytes([data[0] ^ 1]) + data[1:])


def test_fixed_scale_offset():
    a = 1000 + np.arange(11) / 10
    codec = bound("fixedscaleoffset", a, "float64", 1000, offset=1000, scale=10, dtype="<f8", astype="|u1")
    assert codec.encode(a).dtype == np.uint8
    assert np.allclose(codec.decode(codec.encode(a)), a)


@pytest.mark.parametrize(
    "mode, wanted, wide",
    [
        ("nearest-even", [2, 2, -2, -2], (2.0**64, 2.0**53)),
        ("towards-zero", [1, 2, -1, -2], (2.0**64 - 2048, 2.0**53)),
        ("towards-positive", [2, 3, -1, -2], (2.0**64, 2.0**53 + 2)),
        ("towards-negative", [1, 2, -2, -3], (2.0**64 - 2048, 2.0**53)),
        ("nearest-away", [2, 3, -2, -3], (2.0**64, 2.0**53 + 2)),
    ],
)
def test_cast_rounding(mode, wanted, wide):
    d = data_type
    assert cast_values(np.array([1.5, 2.5, -1.5, -2.5]), d("float64"), d("int8"), mode, None).tolist() == wanted
    assert tuple(cast_values(np.array([2**64 - 1, 2**53 + 1], "u8"), d("uint64"), d("float64"), mode, None)) == wide


def test_cast_ranges():
    d = data_type
    assert cast_values(np.array([127, 128, 129, -129], "i2"), d("int16"), d("int8"), "nearest-even", "wrap").tolist() == [127, -128, -127, 127]
    assert cast_values(np.array([1.5, 300, np.nan], "f4"), d("float32"), d("uint8"), "nearest-even", "clamp", [(1.5, 42), ("NaN", 7)]).tolist() == [42, 255, 7]
    assert cast_values(np.array([1.0]), d("float64"), d("uint8"), "nearest-even", "clamp", [(1, 2), (1, 3)]).tolist() == [2]
    for bad in ([np.nan], [np.inf], [300.0]):
        with pytest.raises(CodecError):
            cast_values(np.array(bad), d("float64"), d("uint8"), "nearest-even", None)


@pytest.mark.parametrize("dtype", [*SMALL_FLOATS, "bfloat16"])
def test_small_floats_pack_what_they_unpack(dtype):
    d = data_type(dtype)
    bits = np.arange(256 if d.numpy.itemsize == 1 else 65536, dtype=d.numpy)
    bits = bits[: len(d.values())] if d.small else bits
    x = d.unpack(bits)
    finite = np.isfinite(x)
    assert (d.pack(x[finite]) == bits[finite]).all()


NUMBERS = ["bool", "int2", "int4", "int8", "int16", "int32", "int64", "uint2", "uint4", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "bfloat16", "complex64", "complex128", "float8_e4m3fn", "complex_float8_e5m2"]


@pytest.mark.parametrize("dtype", NUMBERS)
@pytest.mark.parametrize("codecs", [["bytes"], [{"name": "bytes", "configuration": {"endian": "big"}}, "gzip"], ["packbits", "crc32c"], [{"name": "transpose", "configuration": {"order": [1, 0]}}, "bytes", "zstd"]], ids=str)
def test_round_trips(dtype, codecs):
    d = data_type(dtype)
    span = d.high - d.low + 1 if d.is_int and d.high < 200 else 2 if dtype == "bool" else 50
    base = np.arange(24) % span + (d.low if d.is_int and d.high < 200 else 0)
    a = np.zeros(24, d.numpy)
    if d.numpy.names:
        a["f0"], a["f1"] = base, base[::-1]
    else:
        a[:] = base
    a = a.reshape(4, 6)
    chain = Chain(codecs, Form(d, (4, 6), d.fill(None)))
    assert chain.decode(chain.encode(a)).tobytes() == a.tobytes()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=6, max_size=6), st.sampled_from(["start", "end"]), st.sampled_from(["uint32", "uint64"]))
def test_strings(values, where, index):
    a = np.empty(6, object)
    a[:] = [v.encode("utf-8", "replace").decode() for v in values]
    for codecs in (["vlen-utf8"], [{"name": "vlen", "configuration": {"index_location": where, "index_data_type": index}}, "zstd"]):
        chain = Chain(codecs, Form(data_type("string"), (2, 3), ""))
        assert (chain.decode(chain.encode(a.reshape(2, 3))) == a.reshape(2, 3)).all()


def shards(location="end", inner=(4, 4)):
    return Chain([{"name": "sharding_indexed", "configuration": {"chunk_shape": list(inner), "codecs": ["bytes", "zstd"], "index_location": location}}], Form(data_type("float32"), (8, 8), np.float32(0)))


@pytest.mark.parametrize("location", ["start", "end"])
def test_sharding(location):
    chain, x = shards(location), np.arange(64, dtype="f4").reshape(8, 8)
    x[:4, :4] = 0
    data = chain.encode(x)
    codec = chain.sharding
    assert len(codec.entries(data)) == 3
    assert (chain.decode(data) == x).all()
    assert (chain.decode_box(data, Box.of((2, 6), (3, 7))) == x[2:6, 3:7]).all()
    assert codec.compact(data) is None
    x[4:, 4:] = 5
    assert (chain.decode(codec.update(data, {(1, 1): x[4:, 4:]})) == x).all()
    assert codec.update(None, {(0, 0): np.zeros((4, 4), "f4")}) is None
    if location == "end":  # dead bytes before the index
        entries, tail = codec.entries(data), data[len(data) - codec.index_size :]
        loose = data[: len(data) - codec.index_size] + b"dead" + tail
        assert len(codec.entries(loose)) == len(entries)
        assert codec.compact(loose) == data


def test_errors():
    with pytest.raises(CodecError):
        shards(inner=(3, 4))
    with pytest.raises(CodecError):
        Chain(["gzip"], Form(data_type("int8"), (2,), 0))
    with pytest.raises(UnsupportedExtension):
        Chain(["zfp"], Form(data_type("float32"), (2,), 0.0))
    with pytest.raises(UnsupportedExtension):
        Chain(["nothing_like_it"], Form(data_type("float32"), (2,), 0.0))


def test_fill_is_compared_by_bits():
    assert not same_bits(np.array([-0.0]), 0.0) and same_bits(np.array([np.nan]), np.nan) and not same_bits(np.array(["aa", ""], object), "a")


def test_runtime_codecs_go_first():
    class Twice(CODECS.get("gzip")):
        def encode(self, data):
            return data + data

        def decode(self, data):
            return data[: len(data) // 2]

    CODECS.register("gzip", Twice)
    try:
        chain = Chain(["bytes", "gzip"], Form(data_type("int8"), (2,), 0))
        assert chain.encode(np.array([1, 2], "i1")) == bytes([1, 2, 1, 2])
    finally:
        assert CODECS.unregister("gzip") and not CODECS.unregister("gzip")


def test_blosc_blocks():
    """Containers with split, shuffled, compressed blocks."""
    import struct

    import pyarrow as pa

    raw = np.arange(1024, dtype="<u4").tobytes()
    shuffled = np.frombuffer(raw, np.uint8).reshape(-1, 4).T
    streams = b"".join(struct.pack("<i", len(z)) + z for z in (pa.Codec("lz4_raw").compress(s.tobytes(), asbytes=True) for s in shuffled))
    data = struct.pack("<BBBBIII", 2, 1, 1 << 5 | 1, 4, len(raw), len(raw), 20 + len(streams)) + struct.pack("<I", 20) + streams
    assert CODECS.get("blosc")({}).decode(data) == raw


def test_crc32c_by_lanes():
    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert crc32c(b"123456789") == 0xE3069283
    draw = np.random.default_rng(0)
    for n in (0, 1, 4095, 4096, 4097, 5003, 20_001):
        data = draw.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert crc32c(data) == plain(data)


BLOSC_INPUTS = [b"", b"abc" * 3, np.arange(5000, dtype="u4").tobytes(), bytes(70_001), np.random.default_rng(1).integers(0, 4, 30_003, dtype=np.uint8).tobytes(), np.random.default_rng(2).bytes(4099)]


@pytest.mark.parametrize("cname", ["lz4", "lz4hc", "zstd", "zlib", "snappy", "blosclz"])
@pytest.mark.parametrize("shuffle", ["noshuffle", "shuffle", "bitshuffle"])
def test_blosc(cname, shuffle):
    for typesize in (1, 2, 4, 8):
        for blocksize in (0, 1000):
            codec = CODECS.get("blosc")({"cname": cname, "clevel": 5, "shuffle": shuffle, "typesize": typesize, "blocksize": blocksize})
            codec.bind(Form(data_type("uint8"), (1,), 0))
            for data in BLOSC_INPUTS:
                made = codec.encode(data)
                assert codec.decode(made) == data and len(made) <= len(data) + 16
                assert made[3] == typesize and int.from_bytes(made[4:8], "little") == len(data) and int.from_bytes(made[12:16], "little") == len(made)
            assert len(codec.encode(bytes(70_001))) < 6000
    if shuffle != "noshuffle" and cname != "snappy":
        codec = CODECS.get("blosc")({"cname": cname, "shuffle": shuffle, "typesize": 4})
        assert len(codec.encode(np.arange(50_000, dtype="u4").tobytes())) < 10_000


def test_blosc_choices():
    data = np.arange(999, dtype="u4").tobytes()
    stored = CODECS.get("blosc")({"clevel": 0}).encode(data)
    assert stored[2] & 0x2 and stored[16:] == data
    for config in ({"cname": "none"}, {"shuffle": "odd"}):
        with pytest.raises((UnsupportedExtension, CodecError)):
            CODECS.get("blosc")(config).bind(Form(data_type("uint8"), (1,), 0))


def test_blosclz_streams():
    """Streams by hand: three literals and a match that overlaps itself, a long one, a far one."""
    assert blosclz_inflate(bytes([2]) + b"abc" + bytes([3 << 5, 2]), 8) == b"abcabcab"
    assert blosclz_inflate(bytes([0]) + b"x" + bytes([7 << 5, 255, 3, 0]), 1 + 9 + 258) == b"x" * 268
    lead = bytes(range(32)) * 300
    far = bytes([31]) + lead[:32] + b"".join(bytes([31]) + lead[k : k + 32] for k in range(32, 9600, 32)) + bytes([1 << 5 | 31, 255, (9600 - 8192) >> 8, (9600 - 8192) & 255])
    assert blosclz_inflate(far, 9603) == lead + lead[:3]
    for data in BLOSC_INPUTS:
        made = blosclz_deflate(data)
        assert made is None or blosclz_inflate(made, len(data)) == data


NESTED = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [4, 6, 4], "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 3, 2], "codecs": ["bytes", "crc32c"]}}]}}]


@pytest.mark.parametrize(
    "metas, most",
    [
        (["bytes"], 100),
        (["bytes", "crc32c"], 100),
        (["bytes", "adler32", "crc32c"], 100),
        (["bytes", "zstd"], 10_000),
        (NESTED, 350),
        ([{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 3, 2], "codecs": ["bytes", "gzip"], "index_location": "start"}}, "crc32c"], 450),
    ],
)
def test_boxes_read_what_they_need(metas, most):
    draw = np.random.default_rng(3)
    a = draw.random((8, 6, 4))
    a[:4] = 0
    chain = Chain(metas, Form(data_type("float64"), a.shape, 0.0))
    data = chain.encode(a)
    for _ in range(60):
        start = [int(draw.integers(0, n)) for n in a.shape]
        box = Box(tuple(start), tuple(int(draw.integers(0, n - s + 1)) for s, n in zip(start, a.shape, strict=True)))
        assert (chain.read_box(ByteReader(data), box) == a[slices(box)]).all()
    reader = ByteReader(data)
    chain.read_box(reader, Box.of((4, 6), (0, 3), (0, 2)))
    assert reader.taken <= most
    with pytest.raises(CodecError):
        chain.decode(data[: len(data) // 2])


@pytest.mark.parametrize("location", ["start", "end"])
def test_shard_updates(location):
    a = np.random.default_rng(4).random((8, 6, 4))
    a[:4] = 0
    chain = Chain([{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 3, 2], "codecs": ["bytes", "gzip"], "index_location": location}}], Form(data_type("float64"), a.shape, 0.0))
    data, places, values = chain.encode(a), np.array([0, 100, 101, 191]), np.array([1.0, 2.0, 3.0, 0.5])
    want = a.copy()
    want.reshape(-1)[places] = values
    plain, n = chain.updated(ByteReader(data), places, values, None)
    assert n == 3 and (chain.decode(plain) == want).all() and chain.sharding.compact(plain) is None
    longer, n = chain.updated(ByteReader(data), places, values, None, True)
    assert n == 3 and len(longer) > len(plain) and (chain.decode(longer) == want).all()
    assert chain.sharding.compact(longer) is not None and (chain.decode(chain.sharding.compact(longer)) == want).all()
    fresh, n = chain.updated(None, places, values, None, True)
    assert n == 3 and np.count_nonzero(chain.decode(fresh)) == 4
    assert chain.updated(ByteReader(fresh), places, np.zeros(4), None, True) == (None, 3)


def test_unchecked_checksums():
    form = Form(data_type("uint8"), (6,), 0)
    data = bytearray(Chain(["bytes", "crc32c"], form).encode(np.arange(6, dtype="u1")))
    data[0] ^= 1
    with pytest.raises(ChecksumError):
        Chain(["bytes", "crc32c"], form).decode(bytes(data))
    assert Chain(["bytes", "crc32c"], form, validate=False).decode(bytes(data)).tolist() == [1, 1, 2, 3, 4, 5]
    with pytest.raises(CodecError):
        Chain([{"name": "sharding_indexed", "configuration": {"chunk_shape": [2], "codecs": ["bytes"], "subchunk_write_order": "odd"}}], form)
