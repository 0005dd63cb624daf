"""Registered queries of the engine's parts: boxes, grids, keys, metadata, stores, extension points. Each gives rows that SQL derives by itself."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from gridloom import registry as R
from gridloom.functions.boxes import Box, Indexer
from gridloom.functions.codecs import Bytes, Codec
from gridloom.functions.dtypes import data_type
from gridloom.functions.grids import GRIDS, regular
from gridloom.functions.keys import KEY_ENCODINGS, V2_ARRAY_KEY, V3_KEY, KeyEncoding, node_key, parent
from gridloom.operators.frame import ArrayFrame, to_numpy
from gridloom.plans.meta import ArrayBuilder, ArrayMeta, GroupMeta, Options, array_to_v3, group_to_v3
from gridloom.plans.shared import scratch
from gridloom.queries import _E, _P, _doubles, _extent, _little, _saved, _table, embeddings, query, sizes, values
from gridloom.sources.arrays import cached_array, consolidate_group, encoded_chunks, erase_node, invalidate, open_array, open_hierarchy, read_node, save_array, update_cells, write_node
from gridloom.sources.store import LoggedStore, MemoryStore, MeteredStore, ReadOnlyStore, SparkStore, Transformer, ValueReader, transformed

# boxes and indexers


@query("""
    SELECT * FROM (VALUES
        ('empty', [0, 0], [0, 0], 0, true), ('ranges', [1, 2], [3, 2], 6, false), ('shape', [0, 0], [4, 5], 20, false), ('start_shape', [1, 2], [3, 4], 12, false),
        ('start_end', [1, 2], [3, 2], 6, false), ('start_last', [1, 2], [4, 3], 12, false), ('bound', [1, 2], [1, 2], 2, false), ('relative', [0, 1], [3, 2], 6, false),
        ('overlap', [2, 2], [2, 1], 2, false), ('apart', [9, 9], [0, 0], 0, true), ('moved', [11, 22], [3, 2], 6, false)
    ) t(name, start, shape, elements, is_empty)
""")
def box_constructors(spark, sf_dir):
    box = Box.of((1, 4), (2, 4))
    made = {
        "empty": Box.empty(2),
        "ranges": box,
        "shape": Box.whole((4, 5)),
        "start_shape": Box((1, 2), (3, 4)),
        "start_end": Box.between((1, 2), (4, 4)),
        "start_last": Box.including((1, 2), (4, 4)),
        "bound": box.bound((2, 9)),
        "relative": box.relative_to((1, 1)),
        "overlap": box.overlap(Box.of((2, 9), (0, 3))),
        "apart": box.overlap(Box.of((9, 9), (9, 9))),
        "moved": box.offset((10, 20)),
    }
    return spark.createDataFrame([(n, list(b.start), list(b.shape), b.size, b.is_empty) for n, b in made.items()], "name string, start array<int>, shape array<int>, elements int, is_empty boolean")


@query("""
    WITH c AS (SELECT p_partkey AS k, p_partkey % 7 AS a, p_size % 9 AS b FROM part)
    SELECT k, a >= 1 AND a < 4 AND b >= 2 AND b < 6 AS inside, (a + 1 <= 7 AND b + 3 <= 9) AS fits FROM c
""")
def box_contains(spark, sf_dir):
    """Membership of each row's point and box, by the driver's box and as a predicate over columns; both must agree."""
    box, rows = Box.of((1, 4), (2, 6)), _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_partkey % 7 AS a", "p_size % 9 AS b")
    held = rows.withColumn("inside", box.predicate(["a", "b"]))
    sample = [(a, b) for a in range(7) for b in range(9)]
    if any(box.contains(x) != (1 <= x[0] < 4 and 2 <= x[1] < 6) for x in sample):
        raise AssertionError("the driver's box disagrees with its ranges")
    inside = [(a, b, Box((a, b), (1, 3)).fits((7, 9))) for a, b in sample]
    return held.join(F.broadcast(spark.createDataFrame(inside, "a long, b int, fits boolean")), ["a", "b"]).select("k", "inside", "fits")


@query("""
    SELECT 'index' AS what, (row_number() OVER (ORDER BY i, j) - 1)::BIGINT AS ord, (i * 9 + j)::BIGINT AS a, 0::BIGINT AS b FROM generate_series(2, 4) x(i), generate_series(3, 6) y(j)
    UNION ALL SELECT 'run', i - 2, i * 9 + 3, 4 FROM generate_series(2, 4) x(i)
    UNION ALL SELECT 'bytes', i - 2, 8 * (i * 9 + 3), 32 FROM generate_series(2, 4) x(i)
    UNION ALL SELECT 'whole', 0, 18, 27
""")
def box_linear(spark, sf_dir):
    """C-order places of a box, its contiguous runs, and their byte ranges; whole lines are one run."""
    shape, box = (7, 9), Box.of((2, 5), (3, 7))
    rows = [("index", k, i, 0) for k, i in enumerate(box.linear(shape))] + [("run", k, i, n) for k, (i, n) in enumerate(box.linear_runs(shape))]
    rows += [("bytes", k, i, n) for k, (i, n) in enumerate(box.byte_ranges(shape, 8))] + [("whole", k, i, n) for k, (i, n) in enumerate(Box.of((2, 5), (0, 9)).linear_runs(shape))]
    return spark.createDataFrame(rows, "what string, ord long, a long, b long")


@query("""
    SELECT ord::BIGINT AS ord, (i * 4 + j)::BIGINT AS lin FROM (VALUES (0, 1, 2), (1, 1, 3), (2, 2, 2), (3, 2, 3), (4, 0, 3), (5, 3, 0), (6, 0, 3), (7, 3, 1)) t(ord, i, j)
""")
def indexer_linear(spark, sf_dir):
    """A box, a list with repeats and a box, one after the other."""
    found = Indexer([Box.of((1, 3), (2, 4)), [(0, 3), (3, 0), (0, 3)], Box.of((3, 4), (1, 2))]).linear((4, 4))
    return spark.createDataFrame(list(enumerate(found)), "ord long, lin long")


# grids


@query("""
    WITH e(grid, d, c, a, n) AS (
        SELECT 'regular', 0, c, 3 * c, 3 FROM generate_series(0, 3) t(c) UNION ALL SELECT 'regular', 1, c, 7 * c, 7 FROM generate_series(0, 2) t(c)
        UNION ALL SELECT 'regular_bounded', 0, c, 3 * c, least(3, 10 - 3 * c) FROM generate_series(0, 3) t(c) UNION ALL SELECT 'regular_bounded', 1, c, 7 * c, least(7, 20 - 7 * c) FROM generate_series(0, 2) t(c)
        UNION ALL SELECT g, 0, c, a, n FROM (VALUES ('rectilinear'), ('rectangular')) x(g), (VALUES (0, 0, 2), (1, 2, 2), (2, 4, 6)) t(c, a, n) UNION ALL SELECT g, 1, c, 10 * c, 10 FROM (VALUES ('rectilinear'), ('rectangular')) x(g), generate_series(0, 1) t(c)
    )
    SELECT grid, d::INT AS dim, c::INT AS chunk, a::BIGINT AS origin, n::BIGINT AS edge FROM e
""")
def grid_geometry(spark, sf_dir):
    """Edges and origins of every chunk along every axis, by the driver's grids."""
    config = {"regular": [3, 7], "regular_bounded": [3, 7]}
    rows = []
    for name in ("regular", "regular_bounded", "rectilinear", "rectangular"):
        grid = GRIDS.get(name)((10, 20), {"chunk_shape": config[name]} if name in config else {"chunk_shapes": [[[2, 2], 6], [[10, 2]]]})
        for d in range(grid.dims):
            for c, edge in enumerate(grid.edges(d)):
                at = [0, 0]
                at[d] = c
                rows.append((name, d, c, grid.origin(at)[d], edge))
    return spark.createDataFrame(rows, "grid string, dim int, chunk int, origin long, edge long")


@query("""
    SELECT p_partkey AS k, (p_partkey % 25) // 3 AS chunk, (p_partkey % 25) % 3 AS place, p_partkey % 25 < 10 AS in_array, (p_partkey % 25) // 3 < 4 AS in_grid FROM part
""")
def grid_membership(spark, sf_dir):
    """Chunks and places of points inside and beyond an array; a regular grid goes on."""
    grid = GRIDS.get("regular")((10,), {"chunk_shape": [3]})
    table = [(i, *grid.chunk_indices((i,)), *grid.element_indices((i,)), grid.in_array((i,)), grid.in_grid(grid.chunk_indices((i,)))) for i in range(25)]
    own = spark.createDataFrame(table, "i long, chunk long, place long, in_array boolean, in_grid boolean")
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_partkey % 25 AS i").join(F.broadcast(own), "i").drop("i")


@query("SELECT (a.c * 2 + b.s)::BIGINT AS number, (a.c * 10 + b.s * 5)::BIGINT AS origin, 5::BIGINT AS edge FROM generate_series(0, 2) a(c), generate_series(0, 1) b(s)")
def subchunk_grids(spark, sf_dir):
    """The grid of inner chunks, and that of one chunk's own."""
    meta = ArrayBuilder((30,), [10], "uint8", 0, subchunk_shape=(5,)).build()
    local = ArrayFrame.empty(spark, meta).store_chunk((1,), [1] * 10).local_subchunk_grid((1,))
    inner = meta.subchunk_grid()
    rows = [(n, inner.origin((n,))[0], local.edges(0)[n % local.shape[0]]) for n in range(inner.shape[0])]
    return spark.createDataFrame(rows, "number long, origin long, edge long")


# keys and metadata


@query("""
    SELECT * FROM (VALUES ('root document', 'zarr.json'), ('node document', 'a/b/zarr.json'), ('older document', 'a/b/.zarray'), ('data', 'a/b/c/1/2'), ('parent', 'a/'), ('own', 'a/b/k1~k2')) t(what, key)
""")
def node_keys(spark, sf_dir):
    class Own(KeyEncoding):
        def key(self, chunk):
            return "~".join(f"k{c}" for c in chunk)

    KEY_ENCODINGS.register("own", lambda config: Own("", ".", "0"))
    try:
        own = KEY_ENCODINGS.get("own")({}).key((1, 2))
    finally:
        KEY_ENCODINGS.unregister("own")
    data = KEY_ENCODINGS.get("default")({}).key((1, 2))
    rows = [("root document", node_key("/", V3_KEY)), ("node document", node_key("/a/b", V3_KEY)), ("older document", node_key("/a/b", V2_ARRAY_KEY)), ("data", node_key("/a/b", data)), ("parent", parent("a/b/")), ("own", node_key("/a/b", own))]
    return spark.createDataFrame(rows, "what string, key string")


@query("""
    SELECT * FROM (VALUES ('shape', '[500, 64]'), ('data type', 'float32'), ('fill', '0.5'), ('grid', '[10, 4]'), ('codecs', 'transpose,bytes,zstd'), ('key', 'c/9/3'), ('names', 'row,column'), ('attributes', '{"unit": "m"}'),
        ('resized', '[600, 64]'), ('renamed', 'a,'), ('other attributes', '{}'), ('options', 'true false'), ('unknown', 'kept')) t(what, value)
""")
def array_accessors(spark, sf_dir):
    """What metadata tells, after it went through its document, and after changes."""
    builder = ArrayBuilder((500, 64), [50, 16], "float32", 0.5, [{"name": "transpose", "configuration": {"order": [1, 0]}}, "bytes", "zstd"], attributes={"unit": "m"}, dimension_names=["row", "column"])
    meta = ArrayMeta.from_json(json.dumps(builder.build().to_json() | {"extra": {"must_understand": False}}))
    changed = meta.resized((600, 64)).with_dimension_names(["a", None]).with_attributes({}).with_options(store_empty_chunks=True, validate_checksums=False)
    text = lambda names: ",".join(n or "" for n in names)
    rows = [
        ("shape", str(list(meta.shape))),
        ("data type", meta.dtype.name),
        ("fill", str(float(meta.fill))),
        ("grid", str(list(meta.grid.shape))),
        ("codecs", ",".join(c["name"] for c in meta.to_json()["codecs"])),
        ("key", meta.keys.key((9, 3))),
        ("names", text(meta.dimension_names)),
        ("attributes", json.dumps(meta.attributes)),
        ("resized", str(list(changed.shape))),
        ("renamed", text(changed.dimension_names)),
        ("other attributes", json.dumps(changed.attributes)),
        ("options", f"{changed.options.store_empty_chunks} {changed.options.validate_checksums}".lower()),
        ("unknown", "kept" if "extra" in changed.to_json() else "lost"),
    ]
    return spark.createDataFrame(rows, "what string, value string")


@query("""
    SELECT * FROM (VALUES ('codecs', 'fixedscaleoffset,bytes,shuffle,zlib'), ('endian', 'big'), ('keys', '1.2'), ('fill', '0'), ('order', '[1, 0]'), ('strings', 'vlen-utf8,bz2'), ('string fill', ''), ('attributes', '{"a": 1}'), ('group', '{"g": 2}')) t(what, value)
""")
def version2_conversion(spark, sf_dir):
    """Documents of the older version as newer metadata."""
    names = lambda m: ",".join(c["name"] for c in m.codecs)
    base = {"zarr_format": 2, "shape": [4, 6], "chunks": [2, 3], "dtype": ">f4", "fill_value": None, "order": "C", "compressor": {"id": "zlib", "level": 3}}
    plain = array_to_v3(base | {"filters": [{"id": "fixedscaleoffset", "offset": 1, "scale": 10, "dtype": "<f4"}, {"id": "shuffle", "elementsize": 4}]}, b'{"a": 1}')
    fortran = array_to_v3(base | {"order": "F", "filters": None})
    text = array_to_v3(base | {"dtype": "|O", "filters": [{"id": "vlen-utf8"}], "compressor": {"id": "bz2", "level": 1}})
    rows = [
        ("codecs", names(plain)),
        ("endian", plain.codecs[1]["configuration"]["endian"]),
        ("keys", plain.keys.key((1, 2))),
        ("fill", str(int(plain.fill))),
        ("order", str(fortran.codecs[0]["configuration"]["order"])),
        ("strings", names(text)),
        ("string fill", text.fill),
        ("attributes", json.dumps(plain.attributes)),
        ("group", json.dumps(group_to_v3('{"zarr_format": 2}', '{"g": 2}').attributes)),
    ]
    return spark.createDataFrame(rows, "what string, value string")


# stores


def _store_steps(store, prefix: str) -> list[tuple[str, str]]:
    """One sequence of calls, and what each gives."""
    show = lambda x: "none" if x is None else x.decode() if isinstance(x, bytes) else ",".join(map(show, x)) if isinstance(x, list | tuple) else str(x)
    out = []

    def step(what: str, value) -> None:
        out.append((prefix + what, show(value)))

    step("get of nothing", store.get("a/b"))
    store.set("a/b", b"12345")
    store.set("a/c/d", b"xyz")
    store.set("a/__e/f", b"hidden")
    store.set("g", b"")
    step("get", store.get("a/b"))
    step("partial", store.get_partial("a/b", [{"offset": 1, "length": 2}, {"suffix": 1}, {"offset": 3}]))
    store.set_partial("a/b", 3, b"ABC")
    step("patched", store.get("a/b"))
    store.set("a/b", b"new")
    step("replaced", store.get("a/b"))
    step("size", store.size_key("a/b"))
    step("size of nothing", store.size_key("h"))
    step("size below", store.size_prefix("a/"))
    step("size of all", store.size())
    step("list", store.list())
    step("list below", sorted(store.list_prefix("a/c/")))
    step("keys here", store.list_dir("a/")[0])
    step("prefixes here", store.list_dir("a/")[1])
    step("children", store.children("a/"))
    reader = ValueReader(store, "a/b")
    reader.seek(1)
    step("read on", reader.read())
    store.rename("a/c/d", "a/i")
    step("renamed", store.list_prefix("a/"))
    store.erase("a/b")
    store.erase("a/b")
    store.erase_many(["g", "none"])
    step("erased", store.list())
    store.erase_prefix("a/")
    step("erased below", store.list())
    return out


_STEPS = """(VALUES ('get of nothing', 'none'), ('get', '12345'), ('partial', '23,5,45'), ('patched', '123ABC'), ('replaced', 'new'), ('size', '3'), ('size of nothing', 'none'), ('size below', '12'), ('size of all', '12'),
    ('list', 'a/__e/f,a/b,a/c/d,g'), ('list below', 'a/c/d'), ('keys here', 'a/b'), ('prefixes here', 'a/__e/,a/c/'), ('children', 'a/c/'), ('read on', 'ew'), ('renamed', 'a/__e/f,a/b,a/i'), ('erased', 'a/__e/f,a/i'), ('erased below', ''))"""


@query(f"SELECT s || ' ' || what AS what, value FROM (VALUES ('memory'), ('files'), ('metered'), ('turned')) x(s), {_STEPS} t(what, value)")
def store_contract(spark, sf_dir):
    """One sequence of calls on every kind of store gives the same."""

    class Turned(Transformer):
        def encode(self, value):
            return bytes(value)[::-1]

        decode = encode

    R.TRANSFORMERS.register("turned", Turned)
    try:
        turned = transformed(MemoryStore(), [{"name": "turned"}])
    finally:
        R.TRANSFORMERS.unregister("turned")
    stores = {"memory": MemoryStore(), "files": SparkStore(spark, scratch(spark, "store")), "metered": MeteredStore(LoggedStore(MemoryStore())), "turned": turned}
    return spark.createDataFrame([r for n, s in stores.items() for r in _store_steps(s, f"{n} ")], "what string, value string")


@query("""
    SELECT * FROM (VALUES ('bytes written', 8), ('writes', 2), ('reads', 2), ('bytes read', 5), ('erased', 1), ('after reset', 0), ('calls', 6), ('refused', 2)) t(what, value)
""")
def store_adapters(spark, sf_dir):
    """What adapters count, log and refuse."""
    logged = LoggedStore(MemoryStore())
    store = MeteredStore(logged)
    store.set("a", b"12345")
    store.set("b", b"123")
    store.get("a")
    store.get("c")
    store.erase("b")
    store.list()
    m = store.metrics
    rows = [("bytes written", m.bytes_written), ("writes", m.writes), ("reads", m.reads), ("bytes read", m.bytes_read), ("erased", m.keys_erased), ("calls", len(logged.log))]
    store.reset()
    refused, closed = 0, ReadOnlyStore(store)
    for change in (lambda: closed.set("a", b""), lambda: closed.erase("a")):
        try:
            change()
        except PermissionError:
            refused += 1
    return spark.createDataFrame([*rows, ("after reset", store.metrics.writes), ("refused", refused)], "what string, value int")


# stored arrays and groups


@query("""
    SELECT * FROM (VALUES ('/', 'group', 'root'), ('/a', 'group', 'listed,consolidated'), ('/a/x', 'array', 'listed,consolidated'), ('/b', 'group', 'listed')) t(path, node_type, seen)
""")
def consolidated_modes(spark, sf_dir):
    """A consolidated document spares the listing and may be older than the store; "never" lists."""
    store = SparkStore(spark, scratch(spark, "store"))
    write_node(store, "/", GroupMeta({"title": "t"}))
    write_node(store, "/a", GroupMeta())
    write_node(store, "/a/x", ArrayBuilder((4,), [2], "uint8", 0).build())
    consolidate_group(store)
    write_node(store, "/b", GroupMeta())
    seen = lambda mode: {r["path"]: r["node_type"] for r in open_hierarchy(store, "/", mode).collect()}
    listed, held = seen("never"), seen("auto")
    rows = [(p, kind, "root" if p == "/" else ",".join([n for n, s in (("listed", listed), ("consolidated", held)) if p in s])) for p, kind in listed.items()]
    return spark.createDataFrame(rows, "path string, node_type string, seen string")


@query(f"SELECT i0, i1, CASE WHEN i0 < 50 AND i1 < 16 THEN 1 WHEN i0 < 100 AND i1 < 16 THEN 0 ELSE v END AS v FROM ({_E}) WHERE i0 BETWEEN 40 AND 109 AND i1 BETWEEN 10 AND 20")
def store_chunks(spark, sf_dir):
    """A range of two chunks is replaced; rows give one of them, the other becomes fill values."""
    f = embeddings(spark, sf_dir)
    rows = spark.createDataFrame([(0, 0, [1.0] * 800)], "c0 long, c1 long, data array<float>")
    return _doubles(f.store_chunks(Box.of((0, 2), (0, 1)), rows).subset(Box.of((40, 110), (10, 21))))


@query(f"SELECT i0, v FROM ({_P}) WHERE i0 < 100")
def encoded_write(spark, sf_dir):
    """Encoded chunks of one array, written as they are under another."""
    frame = sizes(spark, sf_dir, ["bytes", "zstd"])
    store = _saved(spark, frame, "/a")
    write_node(store, "/b", frame.meta)
    blobs = encoded_chunks(store, "/a", frame.meta.grid.rows(spark, ["c0"])).where("value IS NOT NULL")
    store.write_blobs(blobs.select(F.concat(F.lit("b/c/"), F.col("c0")).alias("key"), "value")).count()
    return open_array(store, "/b").subset(Box.of((0, 100))).join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i0")), "i0")


@query(f"SELECT count(*)::BIGINT AS n, sum(v)::BIGINT AS total, max(i0)::BIGINT AS last FROM ({_P})")
def numpy_output(spark, sf_dir):
    """A whole array on the driver, and an element list as numpy."""
    f = sizes(spark, sf_dir, ["bytes"])
    a = f.to_numpy()
    b = to_numpy([int(x) for x in a], data_type("uint8"), a.shape)
    held = np.flatnonzero(a)
    return spark.createDataFrame([(len(held), int(b.astype(np.int64).sum()), int(held.max()))], "n long, total long, last long")


@query(f"""
    WITH m AS (SELECT p_partkey // 100 AS c, count(*) AS n FROM part GROUP BY 1)
    SELECT (max(c) + 1)::BIGINT AS all_chunks, (SELECT count(*) FROM m)::BIGINT AS held, (SELECT sum(v)::BIGINT FROM ({_P})) AS total, 'x' AS writer FROM m
""")
def option_effects(spark, sf_dir):
    """Empty chunks are stored where the options ask for it; the writer's mark and unchecked sums, too."""
    df = _table(spark, sf_dir, "part")
    meta = ArrayBuilder((_extent(df, "p_partkey"),), [100], "uint8", 0, ["bytes", "crc32c"]).build()
    cells = df.select(F.col("p_partkey").alias("i0"), F.col("p_size").cast("smallint").alias("v"))
    zeros = meta.grid.rows(spark, ["c0"]).select((F.col("c0") * 100).alias("i0"), F.lit(0).cast("smallint").alias("v"))
    both = cells.unionByName(zeros.join(cells.select("i0"), "i0", "left_anti"))
    every = ArrayFrame.from_cells(meta.with_options(store_empty_chunks=True, include_metadata_of_writer=True), both)
    store = _saved(spark, every)
    mark = "x" if "_gridloom" in read_node(store, "/a").attributes else ""
    total = open_array(store, "/a", Options(validate_checksums=False, concurrent_target=2)).value_view().agg(F.sum("v")).first()[0]
    return spark.createDataFrame([(open_array(store, "/a").chunks.count(), ArrayFrame.from_cells(meta, both).chunks.count(), total, mark)], "all_chunks long, held long, total long, writer string")


@query("SELECT event_id AS i0, CASE WHEN event_id = 3 THEN 77 ELSE value END AS v FROM events WHERE event_id < 50")
def cached_reads(spark, sf_dir):
    """A cached array follows what is written to it."""
    store = _saved(spark, values(spark, sf_dir))
    if cached_array(store, "/a") is not cached_array(store, "/a"):
        raise AssertionError("two caches of one array")
    before = cached_array(store, "/a").subset(Box.of((0, 50))).count()
    update_cells(store, "/a", spark.createDataFrame([(3, 77.0)], "i0 long, v double"))
    after = cached_array(store, "/a").subset(Box.of((0, 50))).where(F.lit(before) == 50)
    rows = after.collect()
    invalidate(store, "/a")
    return spark.createDataFrame([(r["i0"], r["v"]) for r in rows], "i0 long, v double")


@query("SELECT * FROM (VALUES ('before', 'v2'), ('kept', 'v2'), ('converted', 'v2,v3'), ('erased', 'v3'), ('gone', '')) t(what, documents)")
def metadata_versions(spark, sf_dir):
    """An older document stays one, becomes a newer one on request, and each can be erased by itself."""
    store, rows = SparkStore(spark, scratch(spark, "store")), []

    def step(what: str) -> None:
        rows.append((what, ",".join(v for v, k in (("v2", "a/.zarray"), ("v3", "a/zarr.json")) if store.get(k) is not None)))

    store.set("a/.zarray", json.dumps({"zarr_format": 2, "shape": [6], "chunks": [3], "dtype": "<i4", "fill_value": 0, "order": "C", "filters": None, "compressor": None}).encode())
    step("before")
    write_node(store, "/a", read_node(store, "/a").resized((9,)))
    step("kept")
    write_node(store, "/a", read_node(store, "/a").with_options(metadata_convert="v3"))
    step("converted")
    erase_node(store, "/a", "v2")
    step("erased")
    erase_node(store, "/a")
    step("gone")
    return spark.createDataFrame(rows, "what string, documents string")


# extension points


@query(f"SELECT i0, v FROM ({_P}) WHERE i0 BETWEEN 0 AND 250")
def extension_points(spark, sf_dir):
    """A codec, a data type, a grid, a key encoding and a transformer of one's own, found by name, prefix, alias and pattern; executors know them, too."""

    class Flip(Codec):
        def encode(self, data):
            return bytes(np.frombuffer(data, np.uint8) ^ 0xFF)

        decode = encode

    class Marked(Transformer):
        def key(self, key):
            return key + ".own"

    own = [
        (R.CODECS, "flip", Flip),
        (R.CODECS, "serial", Bytes),
        (R.DATA_TYPES, "byte", lambda config: data_type("uint8")),
        (R.GRIDS, "tiles", lambda shape, config: regular(shape, {"chunk_shape": config["edges"]})),
        (R.KEY_ENCODINGS, "dotted", lambda config: KeyEncoding("d", ".", "d")),
        (R.TRANSFORMERS, "marked", Marked),
    ]
    for registry, name, made in own:
        registry.register(name, made)
    R.CODECS.match(r"flip-v\d+", "flip")
    try:
        df = _table(spark, sf_dir, "part")
        meta = ArrayMeta(
            (_extent(df, "p_partkey"),), "byte", {"name": "tiles", "configuration": {"edges": [64]}}, 0, ({"name": "own.serial"}, {"name": "flip-v2"}, {"name": "flip"}, {"name": "vendor.flip"}), {"name": "dotted"}, storage_transformers=({"name": "marked"},)
        ).bound()
        frame = ArrayFrame.from_cells(meta, df.select(F.col("p_partkey").alias("i0"), F.col("p_size").cast("smallint").alias("v")))
        store = _saved(spark, frame)
        if not store.list_prefix("a/")[0].endswith(".own"):
            raise AssertionError("keys haven't gone through the transformer")
        held = open_array(store, "/a").subset(Box.of((0, 251))).join(df.select(F.col("p_partkey").alias("i0")), "i0")
        return spark.createDataFrame([(r["i0"], r["v"]) for r in held.collect()], "i0 long, v smallint")
    finally:
        for registry, name, _ in own:
            registry.unregister(name)
        R.CODECS.patterns.pop()


@query(f"SELECT i0, v FROM ({_P})")
def squeeze_roundtrip(spark, sf_dir):
    """The squeeze codec inside a chain, over chunks with extents of one."""
    df = _table(spark, sf_dir, "part")
    codecs = [{"name": "squeeze"}, _little, "zstd"]
    meta = ArrayBuilder((1, _extent(df, "p_partkey"), 1), [1, 100, 1], "uint8", 0, codecs).build()
    cells = df.select(F.lit(0).cast("long").alias("i0"), F.col("p_partkey").alias("i1"), F.lit(0).cast("long").alias("i2"), F.col("p_size").cast("smallint").alias("v"))
    f = ArrayFrame.from_cells(meta, cells)
    out = ArrayFrame.decode(f.meta, f.encode(), f.element).value_view()
    return out.select(F.col("i1").alias("i0"), "v").join(df.select(F.col("p_partkey").alias("i0")), "i0")


@query("SELECT event_id AS i0, round(value, 3) AS v FROM events WHERE event_id < 200")
def merged_stream(spark, sf_dir):
    """Cells arriving as a stream, in several files, merged into a stored array batch by batch."""
    from gridloom.streaming.updates import stream_cells

    df = _table(spark, sf_dir, "events").where("event_id < 200").select(F.col("event_id").alias("i0"), F.round("value", 3).alias("v"))
    store, source = SparkStore(spark, scratch(spark, "store")), scratch(spark, "stream")
    save_array(store, "/a", ArrayFrame.empty(spark, ArrayBuilder((200,), [64], "float64", -1.0).build()))
    df.repartition(4).write.parquet(source)
    cells = spark.readStream.schema("i0 long, v double").option("maxFilesPerTrigger", 2).parquet(source)
    stream_cells(cells, store, "/a", scratch(spark, "progress")).awaitTermination()
    return open_array(store, "/a").value_view()
