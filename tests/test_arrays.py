"""Boxes, grids, keys, metadata, frames, stores and hierarchies."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions.boxes import Box, DimensionalityError, Indexer, OutOfBoundsError, ravel, unravel
from gridloom.functions.grids import GRIDS, GridError
from gridloom.functions.keys import KEY_ENCODINGS, check_key, check_path, check_prefix
from gridloom.operators import hierarchy as H
from gridloom.operators.frame import ArrayFrame
from gridloom.plans.meta import ArrayBuilder, ArrayMeta, GroupMeta, MetadataError, array_to_v3
from gridloom.registry import UnsupportedExtension
from gridloom.sources.arrays import compacted, consolidate_group, encoded_chunks, open_array, open_hierarchy, read_node, save_array, subchunk_bytes, write_node
from gridloom.sources.store import LoggedStore, MemoryStore, MeteredStore, RangeError, ReadOnlyStore, SparkStore, byte_range


def test_runs():
    assert list(Box.of((1, 4), (2, 4)).linear_runs((4, 4))) == [(6, 2), (10, 2), (14, 2)]
    assert Indexer([Box.of((1, 4), (2, 4)), Box.of((0, 1), (0, 4))]).runs((4, 4)) == [(6, 2), (10, 2), (14, 2), (0, 4)]
    assert Indexer([[(0, 0), (0, 1), (0, 3), (1, 1)]]).runs((4, 4)) == [(0, 1), (1, 1), (3, 1), (5, 1)]
    for shape, error in (((3, 3), OutOfBoundsError), ((4, 4, 4), DimensionalityError)):
        with pytest.raises(error):
            Indexer([Box.of((1, 4), (2, 4))]).linear(shape)


boxes = st.integers(1, 3).flatmap(lambda n: st.tuples(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=n, max_size=n), st.lists(st.integers(5, 9), min_size=n, max_size=n)))


@settings(max_examples=150, deadline=None)
@given(boxes)
def test_box_against_numpy(given):
    ends, shape = given
    box = Box(tuple(a for a, _ in ends), tuple(min(b, n - a) for (a, b), n in zip(ends, shape, strict=True)))
    want = np.arange(np.prod(shape)).reshape(shape)[tuple(slice(r.start, r.stop) for r in box.ranges())].ravel().tolist()
    assert list(box.linear(shape)) == want
    assert [i for s, n in box.linear_runs(shape) for i in range(s, s + n)] == want
    assert all(unravel(ravel(i, shape), shape) == i for i in box.indices())


def test_grids():
    g = GRIDS.get("rectilinear")((100, 100), {"chunk_shapes": [[5, 5, 5, 15, 15, 20, 35], [[10, 10]]]})
    assert (g.chunk_indices((17, 17)), g.element_indices((17, 17)), g.shape) == ((3, 1), (2, 7), (7, 10))
    assert g.chunks_subset(Box.of((1, 5), (2, 6))) == Box.of((5, 45), (20, 60))
    with pytest.raises(GridError):
        GRIDS.get("rectilinear")((123,), {"chunk_shapes": [[5, 5]]})
    over = GRIDS.get("rectilinear")((6, 6), {"chunk_shapes": [[4, 4, 4], [3, 3, 3]]})
    assert over.shape == (3, 3) and over.chunk_indices((5, 5)) == (1, 1)
    even = GRIDS.get("regular")((10, 20), {"chunk_shape": [3, 7]})
    assert even.edges(0) == [3] * 4 and even.edges(1) == [7] * 3 and even.chunk_indices((50, 50)) == (16, 7)
    clipped = GRIDS.get("regular_bounded")((10, 20), {"chunk_shape": [3, 7]})
    assert clipped.chunk_shape((3, 2)) == (1, 6) and clipped.chunk_indices((10, 0)) is None
    assert GRIDS.get("regular")((0, 20), {"chunk_shape": [3, 7]}).chunk_indices((0, 0)) is None


def test_keys():
    default, v2 = KEY_ENCODINGS.get("default")({}), KEY_ENCODINGS.get("v2")({})
    assert (default.key((0, 1)), default.key(()), v2.key((0, 1)), v2.key(())) == ("c/0/1", "c", "0.1", "0")
    assert default.chunk("c/3/4") == (3, 4) and default.chunk("zarr.json") is None
    for bad in ("", "/a", "a//b"):
        with pytest.raises(ValueError):
            check_key(bad)
    with pytest.raises(ValueError):
        check_prefix("a")
    for bad in ("a", "/a/", "/__a", "/.."):
        with pytest.raises(ValueError):
            check_path(bad)


def board(spark, subchunk=None):
    meta = ArrayBuilder((4, 4), [2, 2], "uint8", 0, None, subchunk).build()
    f = ArrayFrame.empty(spark, meta).store_chunk((0, 0), [1, 2, 0, 0]).store_chunk((0, 1), [3, 4, 7, 8])
    new = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 9), (2, 1, 10)], "i0 long, i1 long, v smallint")
    return f.store_cells(new, Box.of((1, 3), (0, 2)))


def data(df):
    rows = df.collect()
    return list(rows[0]["data"]) if rows else None


@pytest.mark.parametrize("subchunk", [None, (1, 1)])
def test_board(spark, subchunk):
    f = board(spark, subchunk)
    f = ArrayFrame.decode(f.meta, f.encode(), f.element)
    assert [data(f.chunk(*c)) for c in ((0, 0), (0, 1), (1, 0), (1, 1))] == [[1, 2, 5, 6], [3, 4, 7, 8], [9, 10, 0, 0], [0, 0, 0, 0]]
    assert data(f.chunk_if_exists(1, 1)) is None
    read = lambda df: [r["v"] for r in df.orderBy("i0", "i1").collect()]
    assert read(f.chunk_subset((0, 0), Box.of((0, 2), (1, 2)))) == [2, 6]
    assert read(f.chunk_box(Box.of((0, 2), (1, 2)))) == [3, 4, 7, 8, 0, 0, 0, 0]
    assert read(f.chunk_box(Box.of((0, 1), (1, 3)))) == [3, 4, 0, 0, 7, 8, 0, 0]
    assert read(f.subset(Box.of((1, 3), (1, 3)))) == [6, 7, 10, 0]
    assert read(f.subset(Box.of((5, 7), (5, 6)))) == [0, 0]
    assert read(f.subset(Box.of((0, 0), (0, 0)))) == []
    assert f.to_numpy().tolist() == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 0, 0], [0, 0, 0, 0]]
    with pytest.raises(OutOfBoundsError):
        f.chunk_subset((0, 0), Box.of((0, 3), (0, 3)))
    with pytest.raises(DimensionalityError):
        f.subset(Box.of((0, 4)))
    got = f.gather(Indexer([[(2, 1), (0, 0), (2, 1)]])).orderBy("ord").collect()
    assert [r["v"] for r in got] == [10, 1, 10]


def test_strings_and_optionals(spark):
    meta = ArrayBuilder((4, 4), [2, 2], "string", "").build()
    f = ArrayFrame.empty(spark, meta).store_chunk((0, 0), ["a", "bb", "ccc", "dddd"])
    new = spark.createDataFrame([(i, j, f"S{i}{j}") for i in (1, 2) for j in (1, 2)], "i0 long, i1 long, v string")
    f = f.store_cells(new, Box.of((1, 3), (1, 3)))
    f = ArrayFrame.decode(f.meta, f.encode(), f.element)
    assert data(f.chunk(0, 0)) == ["a", "bb", "ccc", "S11"] and data(f.chunk(1, 1)) == ["S22", "", "", ""]
    kind = {"name": "optional", "configuration": {"name": "uint8"}}
    f = ArrayFrame.empty(spark, ArrayBuilder((2, 4), [2, 2], kind, None).build()).store_chunk((0, 0), [1, None, 3, 4]).store_chunk((0, 1), [None] * 4)
    f = ArrayFrame.decode(f.meta, f.encode(), f.element)
    assert f.chunks.count() == 1
    assert [r["v"] for r in f.subset(Box.of((0, 2), (1, 3))).orderBy("i0", "i1").collect()] == [None, None, 4, None]


def test_negative_zero_is_not_the_fill_value(spark):
    meta = ArrayBuilder((4,), [2], "float64", 0.0).build()
    cells = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, -0.0), (3, 0.0)], "i0 long, v double")
    assert [r["c0"] for r in ArrayFrame.from_cells(meta, cells).chunks.collect()] == [1]


def test_store_and_open(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path / "root"))
    write_node(store, "/", GroupMeta({"title": "x"}))
    f = board(spark, (1, 1))
    assert save_array(store, "/a/board", f) == 3
    again = open_array(store, "/a/board")
    assert again.to_numpy().tolist() == f.to_numpy().tolist()
    assert save_array(store, "/a/board", again.erase_chunk(0, 0)) == 2
    assert data(open_array(store, "/a/board").chunk_if_exists(0, 0)) is None
    assert store.list_dir("a/board/")[0] == ["a/board/zarr.json"]
    assert store.size_prefix("a/") == sum(store.size_key(k) for k in store.list_prefix("a/"))
    nodes = H.nodes_of(store.blobs())
    assert H.tree(nodes).splitlines() == ["/", "    board [4, 4] uint8"]
    assert [r["path"] for r in H.child_arrays(nodes, "/a").collect()] == ["/a/board"]
    root = GroupMeta(consolidated=H.consolidate(nodes))
    write_node(store, "/", root)
    assert [r["path"] for r in H.children(H.consolidated_nodes(spark, read_node(store, "/")), "/", True).collect()] == ["/a/board"]
    listed = [r["path"] for r in open_hierarchy(store, "/", "never").collect()]
    assert listed == ["/", "/a/board"] and {r["path"] for r in open_hierarchy(store).collect()} == set(listed)
    with pytest.raises(MetadataError):
        open_hierarchy(store, "/a/board", "must")
    assert list(consolidate_group(store).consolidated) == ["a/board"]
    found = encoded_chunks(store, "/a/board", f.meta.grid.rows(spark, ["c0", "c1"])).collect()
    assert sorted((r["c0"], r["c1"]) for r in found if r["value"] is not None) == [(0, 1), (1, 0)]
    parts = subchunk_bytes(f.meta, f.encode()).collect()
    assert len(parts) == 10 and all(len(p["value"]) == 1 for p in parts)
    assert not compacted(f.meta, f.encode()).where("changed").count()
    store.erase_prefix("a/")
    assert store.list() == ["zarr.json"]


def test_memory_stores():
    metered = MeteredStore(LoggedStore(MemoryStore()))
    metered.set("a/b", b"12345")
    metered.set_partial("a/b", 7, b"x")
    assert metered.get("a/b") == b"12345\0\0x"
    assert metered.get_partial("a/b", [{"offset": 1, "length": 2}, {"suffix": 1}, {"offset": 6}]) == [b"23", b"x", b"\0x"]
    assert (metered.metrics.bytes_written, metered.metrics.writes) == (13, 2)
    with pytest.raises(RangeError):
        byte_range(b"abc", 1, 3)
    with pytest.raises(PermissionError):
        ReadOnlyStore(metered).set("a", b"")
    metered.rename("a/b", "c")
    assert metered.list() == ["c"] and metered.get("none") is None
    assert ("get", "a/b") in metered.inner.log


def test_metadata():
    meta = ArrayBuilder((10000, 1000), [1000, 100], "float64", "NaN", ["bytes", {"name": "gzip", "configuration": {"level": 1}}], attributes={"foo": 42}, dimension_names=["rows", "columns"]).build()
    again = ArrayMeta.from_json(json.dumps(meta.to_json()))
    assert again.to_json() == meta.to_json() and again.resized((5, 5)).shape == (5, 5)
    with pytest.raises(MetadataError):
        meta.resized((5,))
    with pytest.raises(UnsupportedExtension):
        ArrayMeta.from_json(meta.to_json() | {"odd": {"must_understand": True}})
    assert ArrayMeta.from_json(meta.to_json() | {"odd": {"must_understand": False}}).additional
    v2 = {"zarr_format": 2, "shape": [4, 6], "chunks": [2, 3], "dtype": ">f4", "fill_value": None, "order": "F", "filters": None, "compressor": {"id": "zlib", "level": 3}}
    made = array_to_v3(v2, {"a": 1})
    assert [c["name"] for c in made.codecs] == ["transpose", "bytes", "zlib"] and made.codecs[1]["configuration"]["endian"] == "big"
    assert made.keys.key((1, 2)) == "1.2" and made.attributes == {"a": 1} and made.fill == 0
    text = array_to_v3(v2 | {"dtype": "|O", "order": "C", "filters": [{"id": "vlen-utf8"}]})
    assert text.dtype.name == "string" and text.fill == ""
    with pytest.raises(UnsupportedExtension):
        array_to_v3(v2 | {"dtype": [["a", "<f4"]]})


def test_geometry():
    meta = ArrayBuilder((5, 5), [3, 3], "uint8", 0, subchunk_shape=(1, 1)).build()
    g = meta.grid
    assert g.shape == (2, 2) and meta.subchunk_grid().shape == (6, 6) and g.origin((1, 1)) == (3, 3)
    assert g.subset((1, 1)) == Box.of((3, 6), (3, 6)) and g.subset_bounded((1, 1)) == Box.of((3, 5), (3, 5))
    assert g.chunks_in(Box.of((2, 5), (2, 5))) == Box.of((0, 2), (0, 2))


def test_arrow_stages_hold_few_chunks_at_once(spark):
    """Spark's batches hold 10,000 rows, whole chunks each: they are bounded in bytes before a stage, and worked through and given on in runs of chunks."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from gridloom.operators.frame import _per_chunk, _scatter
    from gridloom.queries import QUERIES
    from tests.conftest import DATA

    meta, n = ArrayBuilder((900_000,), [1000], "float64", -1.0).build(), 900
    cells = pa.array([[{"k": 3, "v": float(c)}, {"k": 999, "v": None}] for c in range(n)], pa.list_(pa.struct([("k", pa.int64()), ("v", pa.float64())])))
    dense = list(_scatter(meta, T.DoubleType())(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), cells], names=["c0", "m"])])))
    whole = pa.Table.from_batches(dense).combine_chunks().to_batches()
    double = _per_chunk(meta, lambda chain, shape, data: data.values.to_numpy(zero_copy_only=False) * 2, "data", pa.list_(pa.float64()), "data", bound=False, chunks_of=meta.dtype)
    doubled = list(double(iter(whole)))
    for got, times in ((dense, 1), (doubled, 2)):
        assert len(got) == 4 and max(b.num_rows for b in got) * 1000 <= 1 << 18
        rows = [r for b in got for r in b.to_pylist()]
        assert [(r["c0"], r["data"][3], r["data"][4], len(r["data"])) for r in rows] == [(c, times * c, -times, 1000) for c in range(n)]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        QUERIES["fixed_scale_offset"](spark, DATA)
        assert int(spark.conf.get(key)) == 8 << 20
        wide = spark.range(0, 4000, 1, 1).select(F.sequence(F.lit(0), F.lit(999)).cast("array<double>").alias("data"))
        seen = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert max(r["n"] for r in seen) < (8 << 20) + 10_000 and sum(r["n"] for r in seen) > 32_000_000
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
