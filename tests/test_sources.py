"""The data source and streams of cells."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.boxes import Box, Indexer
from gridloom.operators.frame import ArrayFrame
from gridloom.plans.meta import ArrayBuilder, Options, array_to_v3
from gridloom.queries import embeddings
from gridloom.functions.codecs import Codec
from gridloom.registry import CODECS, TRANSFORMERS, UnsupportedExtension
from gridloom.sources.arrays import cached_array, compact_array, encoded_chunks, erase_node, erase_stored, open_array, open_hierarchy, read_node, save_array, update_cells, write_node
from gridloom.sources.datasource import GridloomSource
from gridloom.sources.store import RangeError, SparkStore, Transformer, transformed
from gridloom.streaming.updates import merge_cells, stream_cells
from tests.conftest import DATA


def test_data_source(spark, tmp_path):
    spark.dataSource.register(GridloomSource)
    frame = embeddings(spark, DATA, codecs=["bytes", "zstd"])
    path = str(tmp_path / "array")
    frame.chunks.write.format("gridloom").mode("append").option("metadata", json.dumps(frame.meta.to_json())).save(path)
    again = spark.read.format("gridloom").load(path)
    assert again.count() == frame.chunks.count()
    both = ArrayFrame(frame.meta, again).value_view().exceptAll(frame.value_view())
    assert both.count() == 0
    assert list((tmp_path / "array").rglob("*.part")) == []
    pruned = spark.read.format("gridloom").option("box", "95:105,10:40").load(path)
    assert {(r["c0"], r["c1"]) for r in pruned.collect()} == {(a, b) for a in (1, 2) for b in (0, 1, 2)}
    opened = open_array(SparkStore(spark, path))
    assert opened.value_view().exceptAll(frame.value_view()).count() == 0


def test_stream(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path / "store"))
    meta = ArrayBuilder((20,), [5], "int32", 0).build()
    save_array(store, "/a", ArrayFrame.empty(spark, meta).store_chunk((3,), [1, 2, 3, 4, 5]))
    source = str(tmp_path / "in")
    spark.range(3, 9).select(F.col("id").alias("i0"), (F.col("id") * 10).cast("int").alias("v")).write.parquet(source)
    cells = spark.readStream.schema("i0 long, v int").parquet(source)
    stream_cells(cells, store, "/a", str(tmp_path / "ck")).awaitTermination()
    assert open_array(store, "/a").to_numpy().tolist() == [0, 0, 0, 30, 40, 50, 60, 70, 80, *[0] * 6, 1, 2, 3, 4, 5]


def numbers(spark, shape, chunk, kind="int32", **more) -> ArrayFrame:
    """Every element is its own C-order number plus one."""
    meta = ArrayBuilder(shape, chunk, kind, 0, **more).build()
    box = Box.whole(shape)
    lin = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        lin = lin * n + F.col(f"i{k}")
    return ArrayFrame.from_cells(meta, box.domain(spark, [f"i{k}" for k in range(len(shape))]).withColumn("v", (lin + 1).cast(meta.dtype.spark)))


def files(root) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file() and not p.name.startswith(".")}


@pytest.mark.parametrize("more", [{"codecs": ["bytes", "zstd"]}, {"codecs": ["bytes"], "subchunk_shape": (4, 5)}])
def test_a_read_opens_only_what_its_box_touches(spark, tmp_path, more):
    """Every chunk beyond the box is spoilt, and every inner chunk beyond it, too."""
    whole = np.arange(1, 40 * 30 + 1).reshape(40, 30)
    store = SparkStore(spark, str(tmp_path))
    assert save_array(store, "/a", numbers(spark, (40, 30), [8, 10], **more)) == 15
    frame = open_array(store, "/a")
    assert (frame.to_numpy() == whole).all()
    box = Box.of((17, 20), (11, 14))
    for name in files(tmp_path):
        if name.startswith("a/c/") and name != "a/c/2/1":
            (tmp_path / name).write_bytes(b"spoilt")
    if "subchunk_shape" in more:
        shard = bytearray((tmp_path / "a/c/2/1").read_bytes())
        shard[4 * 20 :][: 4 * 20 * 2] = b""
        good = (tmp_path / "a/c/2/1").read_bytes()
        (tmp_path / "a/c/2/1").write_bytes(good[: 4 * 20] + bytes(3 * 4 * 20) + good[4 * 4 * 20 :])
    assert (frame.to_numpy(box) == whole[17:20, 11:14]).all()
    assert [r["v"] for r in frame.gather(Indexer([[(17, 11), (19, 13), (17, 11)]])).orderBy("ord").collect()] == [whole[17, 11], whole[19, 13], whole[17, 11]]
    plan = frame.subset(box)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "binaryFile" not in plan
    with pytest.raises(Exception, match="bytes|spoilt|frame|shard"):
        frame.to_numpy(Box.of((0, 3), (0, 3)))


def test_listed_and_tried_chunks_agree(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path))
    frame = numbers(spark, (20,), [4]).erase_chunk(2)
    save_array(store, "/", frame)
    for listed in (False, True):
        again = open_array(store, "/", listed=listed)
        assert again.chunks.count() == 4 and again.to_numpy().tolist() == frame.to_numpy().tolist()
    values = {r["c0"]: r["value"] for r in encoded_chunks(store, "/", frame.meta.grid.rows(spark, ["c0"])).collect()}
    assert values[2] is None and bytes(values[1]) == np.arange(5, 9, dtype="i4").tobytes()


@pytest.mark.parametrize("append", [False, True])
def test_updates_touch_only_their_chunks(spark, tmp_path, append):
    store = SparkStore(spark, str(tmp_path))
    save_array(store, "/a", numbers(spark, (40, 30), [8, 10], codecs=["bytes"], subchunk_shape=(4, 5)))
    before = files(tmp_path)
    cells = spark.createDataFrame([(9, 12, -1), (10, 13, -2), (9, 12, -5), (39, 29, 0), (39, 30, 7)], "i0 long, i1 long, v int")
    assert update_cells(store, "/a", cells, Options(append_to_shards=append)) == 2
    after = files(tmp_path)
    assert {k for k in after if after[k] != before.get(k)} == {"a/c/1/1", "a/c/4/2"} and set(after) == set(before)
    want = np.arange(1, 1201).reshape(40, 30)
    want[9, 12], want[10, 13], want[39, 29] = -1, -2, 0
    assert (open_array(store, "/a").to_numpy() == want).all()
    assert compact_array(store, "/a") == (2 if append else 0) and compact_array(store, "/a") == 0
    assert (open_array(store, "/a").to_numpy() == want).all()
    assert merge_cells(store, "/a", spark.createDataFrame([(0, 0, 5, 1), (0, 0, 3, 2)], "i0 long, i1 long, v int, t int"), "t") == 1
    assert open_array(store, "/a").to_numpy(Box.of((0, 1), (0, 1))).tolist() == [[3]]


def test_updates_of_plain_and_optional_chunks(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path))
    kind = {"name": "optional", "configuration": {"name": "uint8"}}
    save_array(store, "/o", ArrayFrame.empty(spark, ArrayBuilder((6,), [3], kind, None).build()).store_chunk((0,), [1, None, 3]))
    update_cells(store, "/o", spark.createDataFrame([(1, 9), (5, 7), (0, None)], "i0 long, v smallint"))
    assert [r["v"] for r in open_array(store, "/o").value_view().orderBy("i0").collect()] == [None, 9, 3, None, None, 7]
    save_array(store, "/s", ArrayFrame.empty(spark, ArrayBuilder((6,), [3], "string", "").build()).store_chunk((1,), ["x", "yy", ""]))
    update_cells(store, "/s", spark.createDataFrame([(4, ""), (3, ""), (0, "a")], "i0 long, v string"))
    assert [r["v"] for r in open_array(store, "/s").value_view().orderBy("i0").collect()] == ["a", "", "", "", "", ""]
    assert "s/c/1" not in files(tmp_path)
    assert erase_stored(store, "/s", Box.of((0, 2))) == 2 and "s/c/0" not in files(tmp_path)


def test_a_failed_write_leaves_the_old_array(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path))
    frame = numbers(spark, (20,), [4])
    save_array(store, "/a", frame)
    before = files(tmp_path)
    broken = frame.mapped(frame.meta, lambda a: a // 0 if a[0] > 9 else a * 2, frame.element)
    with np.errstate(divide="raise"), pytest.raises(Exception):  # noqa: B017
        save_array(store, "/a", ArrayFrame(frame.meta, broken.chunks.where(F.assert_true(F.lit(False)).isNull())))
    assert {k: v for k, v in files(tmp_path).items() if not k.endswith(".part")} == before


def test_store_values(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path))
    store.set("a/b", b"12345")
    store.set("a/b", b"123456")
    assert store.get("a/b") == b"123456" and [p for p in files(tmp_path)] == ["a/b"]
    assert store.get_partial("a/b", [{"offset": 1, "length": 2}, {"suffix": 1}, {"offset": 4}]) == [b"23", b"6", b"56"]
    assert store.get_partial("none", [{"offset": 0}]) is None
    with pytest.raises(RangeError):
        store.get_partial("a/b", [{"offset": 5, "length": 2}])


def test_hierarchies_of_older_documents_read_no_chunk(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path))
    for path in ("", "g/"):
        store.set(path + ".zgroup", b'{"zarr_format": 2}')
    store.set("g/a/.zarray", json.dumps({"zarr_format": 2, "shape": [6], "chunks": [3], "dtype": "<i4", "fill_value": 0, "order": "C", "filters": None, "compressor": None}).encode())
    store.set("g/a/0", b"x" * 12)
    (tmp_path / "g/a/0").chmod(0)
    assert [(r["path"], r["node_type"]) for r in open_hierarchy(store, "/").collect()] == [("/", "group"), ("/g", "group"), ("/g/a", "array")]
    assert store.list_prefix("g/") == ["g/.zgroup", "g/a/.zarray", "g/a/0"] and store.size_prefix("g/a/") > 12
    assert {r["key"]: r["length"] for r in store.listing().collect()}["g/a/0"] == 12


def test_storage_transformers(spark, tmp_path):
    class Turned(Transformer):
        def key(self, key):
            return key + ".rev" * self.config.get("mark", 0)

        def encode(self, value):
            return bytes(value)[::-1]

        decode = encode

    TRANSFORMERS.register("turned", Turned)
    try:
        store = SparkStore(spark, str(tmp_path))
        frame = numbers(spark, (10,), [4], storage_transformers=[{"name": "turned", "configuration": {"mark": 1}}])
        save_array(store, "/a", frame)
        assert (tmp_path / "a/c/0.rev").read_bytes() == np.arange(1, 5, dtype="i4").tobytes()[::-1]
        assert open_array(store, "/a").to_numpy().tolist() == list(range(1, 11))
        update_cells(store, "/a", spark.createDataFrame([(2, 0)], "i0 long, v int"))
        assert open_array(store, "/a").to_numpy(Box.of((1, 4))).tolist() == [2, 0, 4]
        assert transformed(store, frame.meta.storage_transformers).get("a/c/1") == np.arange(5, 9, dtype="i4").tobytes()
    finally:
        TRANSFORMERS.unregister("turned")
    with pytest.raises(UnsupportedExtension):
        open_array(store, "/a")


def test_registered_codecs_reach_the_executors(spark):
    class Flip(Codec):
        def encode(self, data):
            return bytes(255 - b for b in data)

        decode = encode

    CODECS.register("own.flip", Flip)
    try:
        frame = numbers(spark, (10,), [4], codecs=["bytes", "own.flip"])
        blobs = frame.encode()
        assert bytes(blobs.where("c0 = 0").first()["value"])[:4] == bytes([254, 255, 255, 255])
        assert ArrayFrame.decode(frame.meta, blobs, frame.element).to_numpy().tolist() == list(range(1, 11))
    finally:
        CODECS.unregister("own.flip")


def test_options(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path))
    frame = numbers(spark, (10,), [4], codecs=["bytes", "crc32c"])
    frame = ArrayFrame(frame.meta.with_options(include_metadata_of_writer=True, store_empty_chunks=True), frame.chunks)
    save_array(store, "/a", frame)
    assert "_gridloom" in read_node(store, "/a").attributes
    spoilt = bytearray((tmp_path / "a/c/0").read_bytes())
    spoilt[0] ^= 255
    (tmp_path / "a/c/0").write_bytes(bytes(spoilt))
    with pytest.raises(Exception, match="mismatch"):
        open_array(store, "/a").to_numpy()
    assert open_array(store, "/a", Options(validate_checksums=False)).to_numpy(Box.of((1, 10))).tolist() == list(range(2, 11))
    assert open_array(store, "/a", Options(concurrent_target=2)).subset(Box.of((4, 10))).rdd.getNumPartitions() == 2
    old = array_to_v3({"zarr_format": 2, "shape": [10], "chunks": [4], "dtype": "<i4", "fill_value": 0, "order": "C", "filters": None, "compressor": None}, {"x": 1})
    save_array(store, "/v2", ArrayFrame(old, frame.chunks))
    assert {"v2/.zarray", "v2/.zattrs", "v2/0", "v2/1", "v2/2"} == {k for k in files_with_hidden(tmp_path) if k.startswith("v2/")}
    assert open_array(store, "/v2").to_numpy().tolist() == list(range(1, 11))
    write_node(store, "/v2", open_array(store, "/v2", Options(metadata_convert="v3")).meta)
    assert json.loads(store.get("v2/zarr.json"))["attributes"] == {"x": 1}
    erase_node(store, "/v2", "v2")
    assert store.get("v2/.zarray") is None and open_array(store, "/v2").to_numpy().tolist() == list(range(1, 11))


def files_with_hidden(root) -> set[str]:
    return {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_local_subchunk_grids_and_levels(spark, tmp_path):
    inner = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 5], "codecs": ["bytes"]}}]
    store = SparkStore(spark, str(tmp_path))
    save_array(store, "/a", numbers(spark, (16, 20), [8, 10], codecs=inner, subchunk_shape=(4, 5)).erase_chunk(1, 1))
    frame = open_array(store, "/a")
    assert [frame.local_subchunk_grid((0, 1), k).shape for k in (0, 1)] == [(2, 2), (4, 2)]
    assert frame.local_subchunk_grid((1, 1)) is None and frame.local_subchunk_grid((0, 0), 2) is None
    whole = np.arange(1, 321).reshape(16, 20)
    read = lambda df: [r["v"] for r in df.orderBy("i0", "i1").collect()]
    assert read(frame.subchunk((1, 1), 0)) == whole[4:8, 5:10].ravel().tolist()
    assert read(frame.subchunk((3, 1), 1)) == whole[6:8, 5:10].ravel().tolist()
    assert read(frame.subchunks(Box.of((1, 3), (0, 2)), 1)) == whole[2:6, 0:10].ravel().tolist()


def test_cached_arrays_follow_writes(spark, tmp_path):
    store = SparkStore(spark, str(tmp_path))
    save_array(store, "/a", numbers(spark, (10,), [4]))
    first = cached_array(store, "/a")
    assert first is cached_array(store, "/a") and first.to_numpy().tolist() == list(range(1, 11))
    update_cells(store, "/a", spark.createDataFrame([(0, 99)], "i0 long, v int"))
    assert cached_array(store, "/a").to_numpy()[0] == 99
    erase_stored(store, "/a", Box.of((0, 1)))
    assert cached_array(store, "/a").to_numpy()[0] == 0


def test_large_chunks_are_built_in_linear_time(spark):
    import time

    frame = numbers(spark, (65_536,), [32_768])
    frame.chunks.count()
    began = time.time()
    assert [r["n"] for r in frame.chunks.select(F.size("data").alias("n")).collect()] == [32_768] * 2
    assert time.time() - began < 8


def test_box_filters_reach_the_source_rows(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("i0"), F.col("id").cast("int").alias("v")).write.parquet(str(tmp_path / "cells"))
    meta = ArrayBuilder((1000,), [10], "int32", 0).build()
    plan = ArrayFrame.from_cells(meta, spark.read.parquet(str(tmp_path / "cells"))).subset(Box.of((25, 35)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i0,20)" in plan and "LessThan(i0,40)" in plan
    plan = embeddings(spark, DATA).subset(Box.of((95, 105), (10, 40)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,50)" in plan and "LessThan(vec_id,150)" in plan
