"""The engine's registered queries: arrays made of the test tables, read, written, encoded and decoded; each with SQL that gives the same rows.

Arrays: E embeddings [n, 64] float32 (lines from rows), V event values [n] float64 (fill -1), C conversations [100 or so, 8] string (fill ""),
L labels [n] optional int32 (fill null), P part sizes [n] uint8, O order prices [n] float64. Extents come from the table's largest key.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import boxes as B
from gridloom.functions.boxes import Box, Indexer
from gridloom.functions.codecs import default_codecs
from gridloom.functions.dtypes import data_type
from gridloom.functions.grids import GRIDS
from gridloom.functions.keys import KEY_ENCODINGS
from gridloom.operators import frame as FR
from gridloom.operators import hierarchy as H
from gridloom.operators.frame import ArrayFrame
from gridloom.plans.meta import ArrayBuilder, ArrayMeta, GroupMeta, Options, array_to_v3
from gridloom.plans.shared import scratch
from gridloom.sources.arrays import compact_array, compacted, consolidate_group, erase_stored, open_array, open_hierarchy, save_array, subchunk_bytes, update_cells, write_node
from gridloom.sources.datasource import GridloomSource
from gridloom.sources.store import SparkStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extent(df: DataFrame, key: str) -> int:
    """One more than the largest key: read from the files' statistics."""
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def embeddings(spark: SparkSession, sf_dir: str, chunk=(50, 16), codecs=None, subchunk=None, extent: int | None = None) -> ArrayFrame:
    df = _table(spark, sf_dir, "embeddings")
    n = extent or _extent(df, "vec_id")
    meta = ArrayBuilder((n, 64), list(chunk), "float32", 0.0, codecs, subchunk).build()
    return ArrayFrame.from_rows(meta, df, "vec_id", "embedding")


def values(spark: SparkSession, sf_dir: str, chunk: int = 1000, codecs=None, fill: float = -1.0) -> ArrayFrame:
    df = _table(spark, sf_dir, "events")
    meta = ArrayBuilder((_extent(df, "event_id"),), [chunk], "float64", fill, codecs).build()
    return ArrayFrame.from_cells(meta, df.select(F.col("event_id").alias("i0"), F.col("value").alias("v")))


def conversations(spark: SparkSession, sf_dir: str, codecs=None) -> ArrayFrame:
    df = _table(spark, sf_dir, "conversations")
    meta = ArrayBuilder((_extent(df, "conv_id"), max(8, _extent(df, "turn"))), [10, 4], "string", "", codecs).build()
    return ArrayFrame.from_cells(meta, df.where("turn IS NOT NULL").select(F.col("conv_id").alias("i0"), F.col("turn").alias("i1"), F.col("text").alias("v")))


def labels(spark: SparkSession, sf_dir: str, codecs=None) -> ArrayFrame:
    df, docs = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents")
    kind = {"name": "optional", "configuration": {"name": "int32"}}
    meta = ArrayBuilder((_extent(docs, "doc_id"),), [64], kind, None, codecs).build()
    return ArrayFrame.from_cells(meta, df.select(F.col("doc_id").alias("i0"), F.col("quality").alias("v")))


def sizes(spark: SparkSession, sf_dir: str, codecs=None, grid=None) -> ArrayFrame:
    df = _table(spark, sf_dir, "part")
    meta = ArrayBuilder((_extent(df, "p_partkey"),), grid or [100], "uint8", 0, codecs).build()
    return ArrayFrame.from_cells(meta, df.select(F.col("p_partkey").alias("i0"), F.col("p_size").cast("smallint").alias("v")))


def _doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("v").cast("double"))


_E = "SELECT vec_id AS i0, generate_subscripts(embedding, 1) - 1 AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings"
_P = "SELECT p_partkey AS i0, p_size::SMALLINT AS v FROM part"
_V = "SELECT event_id AS i0, value AS v FROM events"
_C = "SELECT conv_id AS i0, turn AS i1, text AS v FROM conversations"


# reads


@query(f"SELECT * FROM ({_E}) WHERE i0 >= 95 AND i0 < 105 AND i1 >= 10 AND i1 < 40")
def subset_read(spark, sf_dir):
    return _doubles(embeddings(spark, sf_dir).subset(Box.of((95, 105), (10, 40))))


@query(f"""
    WITH e AS ({_E}), d AS (SELECT i0.i AS i0, i1.i AS i1 FROM generate_series(495, 504) i0(i), generate_series(60, 69) i1(i))
    SELECT d.i0, d.i1, coalesce(e.v, 0) AS v FROM d LEFT JOIN e ON d.i0 = e.i0 AND d.i1 = e.i1
""")
def subset_read_oob_fill(spark, sf_dir):
    return _doubles(embeddings(spark, sf_dir, extent=500).subset(Box.of((495, 505), (60, 70))))


@query(f"SELECT array_agg(v ORDER BY i0, i1) AS data FROM ({_E}) WHERE i0 BETWEEN 100 AND 149 AND i1 BETWEEN 16 AND 31")
def chunk_read(spark, sf_dir):
    return embeddings(spark, sf_dir).chunk(2, 1).select(F.col("data").cast("array<double>").alias("data"))


@query(f"""
    SELECT 1::BIGINT AS c0, array_agg(coalesce(v, '') ORDER BY i0, i1) AS data FROM (SELECT i0.i AS i0, i1.i AS i1 FROM generate_series(10, 19) i0(i), generate_series(0, 3) i1(i)) LEFT JOIN ({_C}) USING (i0, i1)
    HAVING bool_or(v <> '')
""")
def chunk_if_exists(spark, sf_dir):
    f = conversations(spark, sf_dir)
    return f.chunk_if_exists(1, 0).unionByName(f.chunk_if_exists(100_000, 1)).select("c0", "data")


@query(f"SELECT * FROM ({_E}) WHERE i0 BETWEEN 50 AND 149 AND i1 BETWEEN 16 AND 47")
def chunks_read(spark, sf_dir):
    return _doubles(embeddings(spark, sf_dir).chunk_box(Box.of((1, 3), (1, 3))))


@query(f"SELECT * FROM ({_E}) WHERE i0 BETWEEN 55 AND 64 AND i1 BETWEEN 33 AND 36")
def chunk_subset_read(spark, sf_dir):
    return _doubles(embeddings(spark, sf_dir).chunk_subset((1, 2), Box.of((5, 15), (1, 5))))


@query(f"""
    WITH e AS ({_E}), w(ord, i0, i1) AS (VALUES (0, 3, 5), (1, 99, 63), (2, 3, 5), (3, 0, 0), (4, 250, 31))
    SELECT w.ord::BIGINT AS ord, w.i0::BIGINT AS i0, w.i1::BIGINT AS i1, e.v FROM w JOIN e ON e.i0 = w.i0 AND e.i1 = w.i1
""")
def index_gather(spark, sf_dir):
    return _doubles(embeddings(spark, sf_dir).gather(Indexer([[(3, 5), (99, 63), (3, 5), (0, 0), (250, 31)]])))


@query(f"""
    WITH e AS ({_E}), a AS (SELECT (i0 - 10) * 3 + (i1 - 2) AS ord, * FROM e WHERE i0 BETWEEN 10 AND 13 AND i1 BETWEEN 2 AND 4),
    b AS (SELECT 12 + (i0 - 200) * 2 + (i1 - 60) AS ord, * FROM e WHERE i0 BETWEEN 200 AND 201 AND i1 BETWEEN 60 AND 61)
    SELECT * FROM a UNION ALL SELECT * FROM b
""")
def multi_box_gather(spark, sf_dir):
    return _doubles(embeddings(spark, sf_dir).gather(Indexer([Box.of((10, 14), (2, 5)), Box.of((200, 202), (60, 62))])))


@query(f"SELECT i0, i1, coalesce(v, '') AS v FROM (SELECT i0.i AS i0, i1.i AS i1 FROM generate_series(0, (SELECT max(conv_id) FROM conversations)) i0(i), generate_series(0, (SELECT greatest(7, max(turn)) FROM conversations)) i1(i)) LEFT JOIN ({_C}) USING (i0, i1)")
def ragged_read(spark, sf_dir):
    return conversations(spark, sf_dir).value_view()


@query("SELECT i AS i0, quality AS v FROM generate_series(0, (SELECT max(doc_id) FROM documents)) g(i) LEFT JOIN labels ON doc_id = i")
def optional_read(spark, sf_dir):
    return labels(spark, sf_dir).value_view()


@query(f"SELECT * FROM ({_E}) WHERE i0 BETWEEN 60 AND 64 AND i1 BETWEEN 24 AND 31")
def subchunk_read(spark, sf_dir):
    return _doubles(embeddings(spark, sf_dir, subchunk=(5, 8)).subchunk((12, 3)))


@query(f"SELECT * FROM ({_E}) WHERE i0 BETWEEN 60 AND 74 AND i1 BETWEEN 8 AND 31")
def subchunks_read(spark, sf_dir):
    return _doubles(embeddings(spark, sf_dir, subchunk=(5, 8)).subchunks(Box.of((12, 15), (1, 4))))


# boxes, grids, keys


@query("""
    SELECT p_partkey AS k, greatest(p_partkey % 17, 5) AS s0, greatest(p_size, 10)::BIGINT AS s1,
        greatest(least(p_partkey % 17 + 9, 12) - greatest(p_partkey % 17, 5), 0) AS n0, greatest(least(p_size + 7, 30) - greatest(p_size, 10), 0)::BIGINT AS n1
    FROM part
""")
def box_overlap(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    longs = lambda *x: F.array(*(F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in x))
    own = B.box_column(longs(F.col("p_partkey") % 17, F.col("p_size")), longs(9, 7))
    both = B.box_overlap(own, B.box_column(longs(5, 10), longs(7, 20)))
    return part.select(F.col("p_partkey").alias("k"), both.alias("b")).selectExpr("k", "b.start[0] AS s0", "b.start[1] AS s1", "b.shape[0] AS n0", "b.shape[1] AS n1")


@query("""
    SELECT p_partkey AS k, least(p_partkey % 60 + p_size, 50) - least(p_partkey % 60, 50) AS n0, (p_partkey % 60 >= 5 AND p_partkey % 60 + p_size <= 40) AS inside, p_partkey % 60 + 100 AS moved, p_size::BIGINT AS elements FROM part
""")
def box_algebra(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    one = lambda c: F.array(c.cast("long") if not isinstance(c, int) else F.lit(c).cast("long"))
    box = B.box_column(one(F.col("p_partkey") % 60), one(F.col("p_size")))
    bound, outer = B.box_bound(box, one(50)), B.box_column(one(5), one(35))
    moved = B.box_offset(box, one(100))
    return part.select(F.col("p_partkey").alias("k"), bound["shape"][0].alias("n0"), B.box_within(box, outer).alias("inside"), moved["start"][0].alias("moved"), B.box_size(box).alias("elements"))


@query("SELECT e.i0 * 64 + e.i1 AS lin, e.i0 AS i0, e.i1 AS i1, CASE WHEN e.i0 < 100 AND e.i1 < 32 THEN e.i0 * 32 + e.i1 END AS other FROM (SELECT vec_id AS i0, unnest(range(64)) AS i1 FROM embeddings) e")
def ravel_unravel(spark, sf_dir):
    n = _extent(_table(spark, sf_dir, "embeddings"), "vec_id")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).select(B.ravel_column([F.col("vec_id"), F.col("j")], (n, 64)).alias("lin"))
    i0, i1 = B.unravel_columns(F.col("lin"), (n, 64))
    return rows.select("lin", i0.alias("i0"), i1.alias("i1"), B.ravel_column([i0, i1], (100, 32)).alias("other"))


@query("""
    WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM k)
    SELECT min(k) AS start, count(*) AS length FROM g GROUP BY island
""")
def contiguous_runs(spark, sf_dir):
    """Runs of successive indices: islands by comparing each index with its predecessor inside ranges of indices."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return index_runs(rows, "k")


def index_runs(rows: DataFrame, key: str, widths=(1 << 16, 1 << 32, 1 << 48)) -> DataFrame:
    """(start, length) of maximal runs of distinct indices: found in ranges of the first width; runs that touch a range's border are joined in ranges of the next one, and so on."""
    runs, out = rows.select(F.col(key).cast("long").alias("start"), F.lit(1).cast("long").alias("length")), None
    for width in (*widths, None):
        ranged = runs.withColumn("r", B.div(F.col("start"), width) if width else F.lit(0))
        order = Window.partitionBy("r").orderBy("start")
        new = F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(-1)) != F.col("start")
        chained = ranged.withColumn("new", new.cast("int")).withColumn("id", F.sum("new").over(order))
        joined = chained.groupBy("r", "id").agg(F.min("start").alias("start"), F.sum("length").alias("length")).select("start", "length")
        at_border = (F.col("start") % width == 0) | ((F.col("start") + F.col("length")) % width == 0) if width else F.lit(False)
        done = joined.where(~at_border)
        out, runs = done if out is None else out.unionByName(done), joined.where(at_border)
    return out


@query("SELECT c AS c0, c * 1000 AS origin, 'c/' || c AS key_default, c || '' AS key_v2, 'c.' || c || '.tif' AS key_suffix FROM generate_series(0, (SELECT max(o_orderkey) // 1000 FROM orders)) g(c)")
def chunk_keys(spark, sf_dir):
    grid = GRIDS.get("regular")((_extent(_table(spark, sf_dir, "orders"), "o_orderkey"),), {"chunk_shape": [1000]})
    c = [F.col("c0")]
    made = {"key_default": ("default", {}), "key_v2": ("v2", {}), "key_suffix": ("default_suffix", {"separator": ".", "suffix": ".tif"})}
    return grid.rows(spark, ["c0"]).select("c0", grid.origin_columns(c)[0].alias("origin"), *(KEY_ENCODINGS.get(n)(cfg).column(c).alias(k) for k, (n, cfg) in made.items()))


@query("SELECT o_orderkey AS i, o_orderkey // 700 AS chunk, o_orderkey % 700 AS place, least(700, (SELECT max(o_orderkey) + 1 FROM orders) - o_orderkey // 700 * 700) AS edge FROM orders")
def regular_bounded_grid(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    grid = GRIDS.get("regular_bounded")((_extent(orders, "o_orderkey"),), {"chunk_shape": [700]})
    i = [F.col("o_orderkey")]
    chunk = grid.chunk_columns(i)
    return orders.select(F.col("o_orderkey").alias("i"), chunk[0].alias("chunk"), grid.offset_columns(i)[0].alias("place"), grid.edge_columns(chunk)[0].alias("edge"))


@query("""
    WITH edges(c, a, b) AS (VALUES (0, 0, 5), (1, 5, 10), (2, 10, 15), (3, 15, 30), (4, 30, 45), (5, 45, 65))
    SELECT p_partkey AS k, c::BIGINT AS chunk, p_size - a AS place, (b - a)::BIGINT AS edge FROM part JOIN edges ON p_size >= a AND p_size < b
""")
def rectilinear_grid(spark, sf_dir):
    grid = GRIDS.get("rectilinear")((60,), {"chunk_shapes": [[[5, 3], [15, 2], 20]]})
    i = [F.col("p_size").cast("long")]
    chunk = grid.chunk_columns(i)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), chunk[0].alias("chunk"), grid.offset_columns(i)[0].cast("int").alias("place"), grid.edge_columns(chunk)[0].alias("edge"))


@query(f"SELECT i0, v FROM ({_P}) WHERE i0 BETWEEN 20 AND 70")
def rectilinear_read(spark, sf_dir):
    n = _extent(_table(spark, sf_dir, "part"), "p_partkey")
    edges = [[7, 5], 40, n]
    return sizes(spark, sf_dir, grid={"name": "rectilinear", "configuration": {"chunk_shapes": [edges]}}).subset(Box.of((20, 71)))


@query("""
    SELECT a.c AS c0, b.c AS c1 FROM generate_series(1, 2) a(c), generate_series(0, 2) b(c)
""")
def chunks_in_subset(spark, sf_dir):
    grid = embeddings(spark, sf_dir).meta.grid
    return grid.chunks_in(Box.of((95, 105), (10, 40))).domain(spark, ["c0", "c1"])


@query("SELECT 50::BIGINT AS s0, 60::BIGINT AS s1, 50::BIGINT AS n0, 4::BIGINT AS n1")
def chunk_subset_bounded(spark, sf_dir):
    grid = GRIDS.get("regular")((500, 64), {"chunk_shape": [50, 20]})
    b = grid.subset_bounded((1, 3))
    return spark.range(1).select(*(F.lit(v).cast("long").alias(n) for n, v in zip(("s0", "s1", "n0", "n1"), (*b.start, *b.shape), strict=True)))


# layout and value transforms


@query(f"SELECT i1 AS i0, i0 AS i1, v FROM ({_E})")
def transpose(spark, sf_dir):
    return _doubles(FR.transposed(embeddings(spark, sf_dir), [1, 0]))


@query(f"SELECT lin // 16 AS i0, lin % 16 AS i1, v FROM (SELECT i0 * 64 + i1 AS lin, v FROM ({_E}))")
def reshape(spark, sf_dir):
    f = embeddings(spark, sf_dir)
    return _doubles(FR.reshaped(f, (f.meta.shape[0] * 4, 16)))


@query(f"SELECT i0, v FROM ({_P})")
def squeeze(spark, sf_dir):
    df = _table(spark, sf_dir, "part")
    meta = ArrayBuilder((1, _extent(df, "p_partkey"), 1), [1, 100, 1], "uint8", 0).build()
    cells = df.select(F.lit(0).cast("long").alias("i0"), F.col("p_partkey").alias("i1"), F.lit(0).cast("long").alias("i2"), F.col("p_size").cast("smallint").alias("v"))
    return FR.squeezed(ArrayFrame.from_cells(meta, cells))


def _through(frame: ArrayFrame, codecs: list, to: str | None = None) -> ArrayFrame:
    """The array encoded and decoded with these codecs before its own serialiser."""
    last = default_codecs(frame.meta.dtype if to is None else data_type(to))
    meta = replace(frame.meta, codecs=tuple([*codecs, *last])).bound()
    return ArrayFrame.decode(meta, ArrayFrame(meta, frame.chunks).encode(), frame.element)


@query("""
    WITH e AS (SELECT vec_id AS i0, generate_subscripts(embedding, 1) - 1 AS i1, unnest(embedding) AS v FROM embeddings),
    b AS (SELECT i0, i1, (v::FLOAT)::BIT::INTEGER::BIGINT AS x FROM e), u AS (SELECT i0, i1, CASE WHEN x < 0 THEN x + 4294967296 ELSE x END AS x FROM b),
    r AS (SELECT i0, i1, ((x + 524287 + ((x >> 20) & 1)) >> 20) << 20 AS x FROM u)
    SELECT i0, i1, (CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END)::INTEGER::BIT::FLOAT::DOUBLE AS v FROM r
""")
def bitround_f32(spark, sf_dir):
    return _doubles(_through(embeddings(spark, sf_dir), [{"name": "bitround", "configuration": {"keepbits": 3}}]).value_view())


@query("SELECT o_orderkey AS i0, CASE WHEN o_custkey = 0 THEN 0 ELSE (CASE WHEN b > 3 THEN ((o_custkey + (1 << (b - 4)) - 1 + ((o_custkey >> (b - 3)) & 1)) >> (b - 3)) << (b - 3) ELSE o_custkey END) END AS v FROM (SELECT *, floor(log2(greatest(o_custkey, 1)))::INT + 1 AS b FROM orders)")
def bitround_int(spark, sf_dir):
    df = _table(spark, sf_dir, "orders")
    meta = ArrayBuilder((_extent(df, "o_orderkey"),), [1000], "int64", 0).build()
    f = ArrayFrame.from_cells(meta, df.select(F.col("o_orderkey").alias("i0"), F.col("o_custkey").alias("v")))
    return _through(f, [{"name": "bitround", "configuration": {"keepbits": 3}}]).value_view()


@query("SELECT event_id AS i0, round((value - 10) * 10) / 10 + 10 AS v FROM events")
def fixed_scale_offset(spark, sf_dir):
    return _through(values(spark, sf_dir), [{"name": "fixedscaleoffset", "configuration": {"offset": 10, "scale": 10, "dtype": "<f8"}}]).value_view()


def _cast(spark, sf_dir, to: str, rounding: str, out_of_range: str | None = "clamp", mapped=None) -> DataFrame:
    config = {"data_type": to, "rounding": rounding} | ({"out_of_range": out_of_range} if out_of_range else {}) | ({"scalar_map": mapped} if mapped else {})
    return _through(values(spark, sf_dir), [{"name": "cast_value", "configuration": config}], to).value_view()


@query("SELECT event_id AS i0, least(greatest(round_even(value, 0), -128), 127) AS v FROM events")
def cast_clamp(spark, sf_dir):
    return _cast(spark, sf_dir, "int8", "nearest-even")


@query("SELECT event_id AS i0, ((round_even(value, 0)::BIGINT % 256 + 256) % 256)::DOUBLE AS v FROM events")
def cast_wrap(spark, sf_dir):
    return _cast(spark, sf_dir, "uint8", "nearest-even", "wrap")


@query("SELECT event_id AS i0, trunc(value) AS v FROM events")
def cast_rounding_towards_zero(spark, sf_dir):
    return _cast(spark, sf_dir, "int32", "towards-zero")


@query("SELECT event_id AS i0, ceil(value) AS v FROM events")
def cast_rounding_towards_positive(spark, sf_dir):
    return _cast(spark, sf_dir, "int32", "towards-positive")


@query("SELECT event_id AS i0, floor(value) AS v FROM events")
def cast_rounding_towards_negative(spark, sf_dir):
    return _cast(spark, sf_dir, "int32", "towards-negative")


@query("SELECT event_id AS i0, round(value) AS v FROM events")
def cast_rounding_nearest_away(spark, sf_dir):
    return _cast(spark, sf_dir, "int32", "nearest-away")


@query("SELECT event_id AS i0, round_even(value, 0) AS v FROM events")
def cast_rounding_nearest_even(spark, sf_dir):
    return _cast(spark, sf_dir, "int32", "nearest-even")


@query("WITH m AS (SELECT min(value) AS lo FROM events WHERE event_id < 100) SELECT event_id AS i0, CASE WHEN value = lo THEN lo ELSE least(greatest(round_even(value, 0), 0), 250) END AS v FROM events, m")
def cast_scalar_map(spark, sf_dir):
    """One value is mapped to 255 and back; the others are cast and clamped below it."""
    low = _table(spark, sf_dir, "events").where("event_id < 100").agg(F.min("value")).first()[0]
    f = values(spark, sf_dir)
    capped = f.mapped(f.meta, lambda a: np.where(a == low, low, np.minimum(a, 250.0)), T.DoubleType())
    config = {"data_type": "uint8", "rounding": "nearest-even", "out_of_range": "clamp", "scalar_map": {"encode": [[low, 255]], "decode": [[255, low]]}}
    return _through(capped, [{"name": "cast_value", "configuration": config}], "uint8").value_view()


# codecs: decoded again, the table comes back


def _round_trip(name: str, make: Callable[[SparkSession, str], ArrayFrame], sql: str, double: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = make(spark, sf_dir)
        out = ArrayFrame.decode(f.meta, f.encode(), f.element).value_view()
        return _doubles(out) if double else out

    run.__name__ = name
    query(sql)(run)


_little = {"name": "bytes", "configuration": {"endian": "little"}}
for _name in ("gzip", "zlib", "bz2", "zstd", "crc32c", "adler32", "fletcher32", "blosc"):
    _round_trip(f"{_name}_roundtrip", lambda s, d, n=_name: sizes(s, d, ["bytes", n]), _P)
_round_trip("shuffle_roundtrip", lambda s, d: values(s, d, codecs=[_little, {"name": "shuffle", "configuration": {"elementsize": 8}}, "zstd"]), _V)
_round_trip("bytes_be_roundtrip", lambda s, d: embeddings(s, d, codecs=[{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "big"}}]), _E, True)
_round_trip("reshape_roundtrip", lambda s, d: embeddings(s, d, codecs=[{"name": "reshape", "configuration": {"shape": [[0], 4, -1]}}, _little]), _E, True)
_round_trip("packbits_roundtrip", lambda s, d: sizes(s, d, [{"name": "packbits", "configuration": {"first_bit": 0, "last_bit": 5, "padding_encoding": "first_byte"}}]), _P)
_FULL_C = f"SELECT i0, i1, coalesce(v, '') AS v FROM (SELECT i0.i AS i0, i1.i AS i1 FROM generate_series(0, (SELECT max(conv_id) FROM conversations)) i0(i), generate_series(0, (SELECT greatest(7, max(turn)) FROM conversations)) i1(i)) LEFT JOIN ({_C}) USING (i0, i1)"
_round_trip("vlen_utf8_roundtrip", lambda s, d: conversations(s, d, ["vlen-utf8", "zstd"]), _FULL_C)
_round_trip("vlen_roundtrip", lambda s, d: conversations(s, d, [{"name": "vlen", "configuration": {"index_data_type": "uint32", "index_codecs": [_little, "gzip"], "data_codecs": ["bytes", "zstd"], "index_location": "end"}}]), _FULL_C)
_round_trip("optional_roundtrip", labels, ORACLES["optional_read"])
_round_trip("shard_roundtrip", lambda s, d: embeddings(s, d, codecs=[_little, "zstd"], subchunk=(10, 8)), _E, True)


@query(f"SELECT * FROM ({_E}) WHERE i0 BETWEEN 104 AND 111 AND i1 BETWEEN 30 AND 33")
def shard_partial(spark, sf_dir):
    """Only the shards that a box touches are made, and only the inner chunks that it touches are cut out of them and decoded."""
    f = embeddings(spark, sf_dir, codecs=[_little, "gzip"], subchunk=(10, 8))
    box = Box.of((104, 112), (30, 34))
    (inner_shape,) = f.meta.subchunk_shapes()
    counts = [n // c for n, c in zip(f.meta.grid.chunk_shape((0, 0)), inner_shape, strict=True)]
    wanted = f.meta.subchunk_grid(0).chunks_in(box)
    blobs = ArrayFrame(f.meta, f.prune(box)).encode()
    number = [(F.col(f"c{k}") * n + F.col(f"s{k}")).alias(f"c{k}") for k, n in enumerate(counts)]
    parts = subchunk_bytes(f.meta, blobs).select(*number, "value").where(wanted.predicate(["c0", "c1"]))
    meta = ArrayMeta(f.meta.shape, "float32", {"name": "regular", "configuration": {"chunk_shape": list(inner_shape)}}, 0.0, (_little, {"name": "gzip"})).bound()
    return _doubles(ArrayFrame.decode(meta, parts, T.FloatType()).subset(box))


@query("SELECT count(*) AS shards, 0::BIGINT AS changed FROM (SELECT DISTINCT vec_id // 50, b FROM embeddings, (VALUES (0), (1), (2), (3)) t(b))")
def shard_compact(spark, sf_dir):
    f = embeddings(spark, sf_dir, subchunk=(10, 8))
    return compacted(f.meta, f.encode()).agg(F.count("*").alias("shards"), F.sum(F.col("changed").cast("long")).alias("changed"))


# writes


@query("SELECT DISTINCT doc_id // 64 AS c0 FROM labels")
def store_chunk_elide_fill(spark, sf_dir):
    """Chunks of nothing but fill values aren't stored."""
    return labels(spark, sf_dir).chunks.select("c0")


@query(f"SELECT i0, i1, CASE WHEN i0 BETWEEN 45 AND 54 AND i1 BETWEEN 14 AND 17 THEN i0 * 100 + i1 ELSE v END AS v FROM ({_E}) WHERE i0 BETWEEN 40 AND 59 AND i1 BETWEEN 10 AND 20")
def store_subset_update(spark, sf_dir):
    box = Box.of((45, 55), (14, 18))
    new = box.domain(spark, ["i0", "i1"]).withColumn("v", (F.col("i0") * 100 + F.col("i1")).cast("float"))
    return _doubles(embeddings(spark, sf_dir).store_cells(new, box).subset(Box.of((40, 60), (10, 21))))


@query(f"SELECT i0, i1, CASE WHEN i0 BETWEEN 52 AND 53 AND i1 BETWEEN 33 AND 35 THEN 7 ELSE v END AS v FROM ({_E}) WHERE i0 BETWEEN 50 AND 54 AND i1 BETWEEN 32 AND 36")
def store_chunk_subset(spark, sf_dir):
    box = Box.of((2, 4), (1, 4))
    new = box.domain(spark, ["i0", "i1"]).withColumn("v", F.lit(7.0).cast("float"))
    return _doubles(embeddings(spark, sf_dir).store_chunk_subset((1, 2), box, new).subset(Box.of((50, 55), (32, 37))))


@query(f"SELECT i0, CASE WHEN i0 < 1000 THEN i0 % 7 ELSE v END AS v FROM ({_V}) WHERE i0 < 1010")
def store_chunk(spark, sf_dir):
    f = values(spark, sf_dir)
    return f.store_chunk((0,), [float(k % 7) for k in range(1000)]).subset(Box.of((0, min(1010, f.meta.shape[0]))))


@query(f"SELECT i0, CASE WHEN i0 >= 1000 AND i0 < 3000 THEN -1 ELSE v END AS v FROM ({_V})")
def erase_chunks(spark, sf_dir):
    return values(spark, sf_dir).erase_chunks(Box.of((1, 3))).value_view()


@query(f"SELECT g.i AS i0, coalesce(v, -1) AS v FROM generate_series(0, (SELECT max(event_id) + 500 FROM events)) g(i) LEFT JOIN ({_V}) ON i0 = g.i")
def resize_grow_fill(spark, sf_dir):
    f = values(spark, sf_dir)
    return f.resize((f.meta.shape[0] + 500,)).value_view()


@query(f"SELECT * FROM ({_V}) WHERE i0 < 321")
def resize_shrink(spark, sf_dir):
    return values(spark, sf_dir).resize((321,)).value_view()


@query("SELECT event_id AS i0, ts::TIMESTAMP AS v FROM events")
def datetime_view(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    kind = {"name": "numpy.datetime64", "configuration": {"unit": "us", "scale_factor": 1}}
    meta = ArrayBuilder((_extent(df, "event_id"),), [1000], kind, "NaT").build()
    f = ArrayFrame.from_cells(meta, df.select(F.col("event_id").alias("i0"), F.unix_micros(F.col("ts").cast("timestamp")).alias("v")))
    return f.time_view(ArrayFrame.decode(f.meta, f.encode(), f.element).value_view())


@query("SELECT d.i AS lin, coalesce(quality::VARCHAR, 'null') AS json FROM generate_series(0, (SELECT max(doc_id) FROM documents)) d(i) LEFT JOIN labels ON doc_id = i")
def dump(spark, sf_dir):
    return FR.dump(labels(spark, sf_dir))


@query("SELECT c AS c0, 'c/' || c AS key, EXISTS (SELECT 1 FROM labels WHERE doc_id // 64 = c) AS stored FROM generate_series(0, (SELECT max(doc_id) // 64 FROM documents)) g(c)")
def encoded_chunks(spark, sf_dir):
    """Which chunks of the whole grid are stored, by their encoded values."""
    f = labels(spark, sf_dir)
    numbers = f.meta.grid.rows(spark, ["c0"])
    held = numbers.join(f.encode().drop("key"), ["c0"], "left")
    return held.select("c0", f.meta.keys.column([F.col("c0")]).alias("key"), F.col("value").isNotNull().alias("stored"))


@query("SELECT p_partkey AS i0, (p_size * 2)::SMALLINT AS v FROM part")
def mapped_chunks(spark, sf_dir):
    """A numpy function over decoded chunks."""
    f = sizes(spark, sf_dir)
    return f.mapped(f.meta, lambda a: a * 2, T.ShortType()).value_view()


@query(f"SELECT i0 // 25 AS c0, i1 // 8 AS c1, count(*) AS n, round(sum(v), 6) AS total FROM ({_E}) GROUP BY ALL")
def rechunk(spark, sf_dir):
    """Another chunk grid for the same cells. Chunks at the border and missing lines have elements that no vector gave; the fill value, which no 32-bit float is, tells them from zeros, nulls and NaN."""
    df = _table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    absent = 1e300
    f = ArrayFrame.from_rows(ArrayBuilder((_extent(df, "vec_id"), 64), [50, 16], "float64", absent).build(), df, "vec_id", "embedding")
    given = lambda v: ~v.eqNullSafe(F.lit(absent))
    meta = replace(f.meta, chunk_grid={"name": "regular", "configuration": {"chunk_shape": [25, 8]}}).bound()
    chunks = ArrayFrame.from_cells(meta, f.value_view().where(given(F.col("v")))).chunks.withColumn("data", F.filter("data", given))
    total = F.aggregate(F.filter("data", lambda v: v.isNotNull()), F.lit(None).cast("double"), lambda a, x: F.coalesce(a, F.lit(0.0)) + x)
    return chunks.select("c0", "c1", F.size("data").cast("long").alias("n"), F.round(total, 6).alias("total"))


# stored arrays: written to a store in the shared folder, opened again


def _saved(spark: SparkSession, frame: ArrayFrame, path: str = "/a") -> SparkStore:
    store = SparkStore(spark, scratch(spark, "arrays"))
    save_array(store, path, frame)
    return store


@query(f"SELECT * FROM ({_E}) WHERE i0 >= 95 AND i0 < 105 AND i1 >= 10 AND i1 < 40")
def stored_subset_read(spark, sf_dir):
    store = _saved(spark, embeddings(spark, sf_dir, codecs=[_little, "gzip"], subchunk=(10, 8)))
    return _doubles(open_array(store, "/a").subset(Box.of((95, 105), (10, 40))))


@query(f"SELECT * FROM ({_E}) WHERE i0 BETWEEN 50 AND 149 AND i1 BETWEEN 16 AND 47")
def stored_chunks_read(spark, sf_dir):
    store = _saved(spark, embeddings(spark, sf_dir, codecs=[_little, {"name": "blosc", "configuration": {"cname": "zstd", "clevel": 5, "shuffle": "shuffle", "typesize": 4}}, "crc32c"]))
    return _doubles(open_array(store, "/a").chunk_box(Box.of((1, 3), (1, 3))))


@query(f"SELECT * FROM ({_E}) WHERE i0 BETWEEN 60 AND 74 AND i1 BETWEEN 8 AND 31")
def stored_subchunks_read(spark, sf_dir):
    """Inner chunks of inner chunks: both levels read only their own bytes."""
    inner = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [5, 8], "codecs": [_little, "crc32c"]}}]
    store = _saved(spark, embeddings(spark, sf_dir, codecs=inner, subchunk=(25, 16)))
    return _doubles(open_array(store, "/a").subchunks(Box.of((12, 15), (1, 4)), level=1))


@query(ORACLES["index_gather"])
def stored_gather(spark, sf_dir):
    store = _saved(spark, embeddings(spark, sf_dir, codecs=["bytes"]))
    return _doubles(open_array(store, "/a").gather(Indexer([[(3, 5), (99, 63), (3, 5), (0, 0), (250, 31)]])))


@query(ORACLES["optional_read"])
def stored_optional_read(spark, sf_dir):
    return open_array(_saved(spark, labels(spark, sf_dir)), "/a").value_view()


@query(f"SELECT i0, i1, coalesce(v, '') AS v FROM (SELECT i0.i AS i0, i1.i AS i1 FROM generate_series(5, 24) i0(i), generate_series(1, 6) i1(i)) LEFT JOIN ({_C}) USING (i0, i1)")
def stored_strings_read(spark, sf_dir):
    return open_array(_saved(spark, conversations(spark, sf_dir, ["vlen-utf8", "zstd"])), "/a").subset(Box.of((5, 25), (1, 7)))


@query(f"SELECT i0, i1, CASE WHEN i0 BETWEEN 45 AND 54 AND i1 BETWEEN 14 AND 17 THEN i0 * 100 + i1 ELSE v END AS v FROM ({_E}) WHERE i0 BETWEEN 40 AND 59 AND i1 BETWEEN 10 AND 20")
def stored_update(spark, sf_dir):
    """Cells written into a stored array: only the touched inner chunks are decoded and encoded."""
    store = _saved(spark, embeddings(spark, sf_dir, codecs=[_little, "gzip"], subchunk=(10, 8)))
    new = Box.of((45, 55), (14, 18)).domain(spark, ["i0", "i1"]).withColumn("v", (F.col("i0") * 100 + F.col("i1")).cast("float"))
    update_cells(store, "/a", new)
    return _doubles(open_array(store, "/a").subset(Box.of((40, 60), (10, 21))))


@query(f"SELECT i0, CASE WHEN i0 >= 1000 AND i0 < 3000 THEN -1 ELSE v END AS v FROM ({_V})")
def stored_erase(spark, sf_dir):
    store = _saved(spark, values(spark, sf_dir))
    erase_stored(store, "/a", Box.of((1, 3)))
    return open_array(store, "/a").value_view()


@query("""
    WITH s AS (SELECT vec_id // 50 AS c0, b AS c1, bool_or(vec_id = 7 OR vec_id = 122) AS touched FROM embeddings, (VALUES (0), (1), (2), (3)) t(b) GROUP BY ALL)
    SELECT count(*) AS shards, 4::HUGEINT::BIGINT AS encoded, count(*) FILTER (touched AND c1 IN (0, 3)) AS compacted, 0::BIGINT AS left_over FROM s
""")
def stored_append_compact(spark, sf_dir):
    """Appending inner chunks leaves dead bytes in the shards that had them; compaction rewrites these shards, and then none is left to rewrite."""
    frame = embeddings(spark, sf_dir, subchunk=(10, 8))
    store = _saved(spark, frame)
    shards = store.listing("a/").where("key LIKE '%/c/%'").count()
    cells = spark.createDataFrame([(7, 3, 1.5), (7, 60, 2.5), (122, 0, 3.5), (122, 63, 4.5)], "i0 long, i1 long, v float")
    encoded = update_cells(store, "/a", cells, Options(append_to_shards=True))
    done = [compact_array(store, "/a") for _ in range(2)]
    return spark.createDataFrame([(shards, encoded, *done)], "shards long, encoded long, compacted long, left_over long")


@query(f"SELECT * FROM ({_E}) WHERE i0 BETWEEN 10 AND 29 AND i1 BETWEEN 3 AND 9")
def version2_read(spark, sf_dir):
    """An array of the older format: its documents, keys and Fortran order."""
    f = embeddings(spark, sf_dir)
    meta = array_to_v3({"zarr_format": 2, "shape": list(f.meta.shape), "chunks": [50, 16], "dtype": ">f4", "fill_value": 0.0, "order": "F", "filters": None, "compressor": {"id": "zlib", "level": 1}, "dimension_separator": "."})
    store = _saved(spark, ArrayFrame(meta, f.chunks))
    again = open_array(store, "/a")
    if again.meta.version2 is None:
        raise ValueError("the document has not stayed one of version 2")
    return _doubles(again.subset(Box.of((10, 30), (3, 10))))


@query(f"SELECT i0, v FROM ({_P}) WHERE i0 BETWEEN 20 AND 70")
def datasource_read(spark, sf_dir):
    spark.dataSource.register(GridloomSource)
    f, path = sizes(spark, sf_dir, ["bytes", "zstd"]), scratch(spark, "arrays")
    f.chunks.write.format("gridloom").mode("append").option("metadata", json.dumps(f.meta.to_json())).save(path)
    return ArrayFrame(f.meta, spark.read.format("gridloom").option("box", "20:71").load(path)).subset(Box.of((20, 71)))


# codecs: the bytes themselves

_PART_BYTES = "p AS (SELECT c, k, coalesce(p_size, 0) AS b FROM generate_series(0, (SELECT max(p_partkey) // 100 FROM part)) t(c), generate_series(0, 99) u(k) LEFT JOIN part ON p_partkey = c * 100 + k)"
_PART_KEYS = "p AS (SELECT c, k, coalesce(p_partkey, 0) AS v FROM generate_series(0, (SELECT max(p_partkey) // 100 FROM part)) t(c), generate_series(0, 99) u(k) LEFT JOIN part ON p_partkey = c * 100 + k)"
_HEX = "string_agg(printf('%02X', b), '' ORDER BY k)"


def _hexed(frame: ArrayFrame) -> DataFrame:
    return frame.encode().select("c0", F.hex("value").alias("hex"))


def _keys(spark: SparkSession, sf_dir: str, codecs: list) -> ArrayFrame:
    """Part keys [n] int32, each at its own place."""
    df = _table(spark, sf_dir, "part")
    meta = ArrayBuilder((_extent(df, "p_partkey"),), [100], "int32", 0, codecs).build()
    return ArrayFrame.from_cells(meta, df.select(F.col("p_partkey").alias("i0"), F.col("p_partkey").cast("int").alias("v")))


@query(f"WITH {_PART_BYTES} SELECT c AS c0, {_HEX} AS hex FROM p GROUP BY c HAVING sum(b) > 0")
def bytes_hex(spark, sf_dir):
    return _hexed(sizes(spark, sf_dir, ["bytes"]))


@query(f"WITH {_PART_KEYS} SELECT c AS c0, string_agg(printf('%08X', v), '' ORDER BY k) AS hex FROM p GROUP BY c HAVING sum(v) > 0")
def bytes_be_hex(spark, sf_dir):
    return _hexed(_keys(spark, sf_dir, [{"name": "bytes", "configuration": {"endian": "big"}}]))


@query(f"WITH {_PART_KEYS} SELECT c AS c0, string_agg(printf('%02X', (v >> (8 * j)) & 255), '' ORDER BY j, k) AS hex FROM p, generate_series(0, 3) t(j) GROUP BY c HAVING sum(v) > 0")
def shuffle_hex(spark, sf_dir):
    return _hexed(_keys(spark, sf_dir, [_little, {"name": "shuffle", "configuration": {"elementsize": 4}}]))


@query(f"""
    WITH {_PART_BYTES}, s AS (SELECT c, (1 + sum(b)) % 65521 AS x, (100 + sum((100 - k) * b)) % 65521 AS y, {_HEX} AS h FROM p GROUP BY c HAVING sum(b) > 0)
    SELECT c AS c0, printf('%02X%02X%02X%02X', (x % 256)::INT, (x // 256)::INT, (y % 256)::INT, (y // 256)::INT) || h AS hex FROM s
""")
def adler32_hex(spark, sf_dir):
    return _hexed(sizes(spark, sf_dir, ["bytes", "adler32"]))


@query(f"""
    WITH {_PART_BYTES}, w AS (SELECT c, k // 2 AS j, sum(b * CASE WHEN k % 2 = 0 THEN 256 ELSE 1 END) AS w FROM p GROUP BY ALL),
    f AS (SELECT c, (sum(w) - 1) % 65535 + 1 AS x, (sum((50 - j) * w) - 1) % 65535 + 1 AS y FROM w GROUP BY c HAVING sum(w) > 0),
    h AS (SELECT c, {_HEX} AS h FROM p GROUP BY c)
    SELECT c AS c0, h || printf('%02X%02X%02X%02X', (x % 256)::INT, (x // 256)::INT, (y % 256)::INT, (y // 256)::INT) AS hex FROM f JOIN h USING (c)
""")
def fletcher32_hex(spark, sf_dir):
    return _hexed(sizes(spark, sf_dir, ["bytes", "fletcher32"]))


@query(f"""
    WITH RECURSIVE {_PART_BYTES}, r(c, k, x) AS (
        SELECT c, 0::BIGINT, 4294967295::BIGINT FROM p WHERE k = 0
        UNION ALL
        SELECT r.c, r.k + 1, xor(r.x >> 8, list_reduce([xor(r.x, p.b) & 255, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 2197175160 * (x & 1)))) FROM r JOIN p ON p.c = r.c AND p.k = r.k
    ), h AS (SELECT c, {_HEX} AS h FROM p GROUP BY c HAVING sum(b) > 0), z AS (SELECT c, xor(x, 4294967295) AS x FROM r WHERE k = 100)
    SELECT c AS c0, h || printf('%02X%02X%02X%02X', (x & 255)::INT, ((x >> 8) & 255)::INT, ((x >> 16) & 255)::INT, (x >> 24)::INT) AS hex FROM h JOIN z USING (c)
""")
def crc32c_hex(spark, sf_dir):
    return _hexed(sizes(spark, sf_dir, ["bytes", "crc32c"]))


@query(f"""
    WITH {_PART_BYTES}, l AS (SELECT c, list(b ORDER BY k) AS l FROM p GROUP BY c HAVING sum(b) > 0),
    m AS (SELECT c, m, sum(((l[(8 * m + r) // 6 + 1] >> ((8 * m + r) % 6)) & 1) << r)::INT AS b FROM l, generate_series(0, 74) t(m), generate_series(0, 7) u(r) GROUP BY ALL)
    SELECT c AS c0, '00' || string_agg(printf('%02X', b), '' ORDER BY m) AS hex FROM m GROUP BY c
""")
def packbits_hex(spark, sf_dir):
    return _hexed(sizes(spark, sf_dir, [{"name": "packbits", "configuration": {"first_bit": 0, "last_bit": 5, "padding_encoding": "first_byte"}}]))


@query(f"""
    WITH {_PART_BYTES}, i AS (SELECT c, k // 25 AS j, sum(b) > 0 AS held, {_HEX} AS h FROM p GROUP BY c, k // 25),
    o AS (SELECT *, CASE WHEN held THEN coalesce(sum(CASE WHEN held THEN 25 ELSE 0 END) OVER (PARTITION BY c ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT END AS place FROM i)
    SELECT c AS c0, coalesce(string_agg(h, '' ORDER BY j) FILTER (held), '') || string_agg(CASE WHEN held THEN printf('%02X', place) || '000000000000001900000000000000' ELSE repeat('F', 32) END, '' ORDER BY j) AS hex
    FROM o GROUP BY c HAVING bool_or(held)
""")
def shard_hex(spark, sf_dir):
    """Inner chunks one after the other, then offsets and sizes; those of nothing but fill values are absent."""
    inner = {"name": "sharding_indexed", "configuration": {"chunk_shape": [25], "codecs": ["bytes"], "index_codecs": [_little], "index_location": "end"}}
    return _hexed(sizes(spark, sf_dir, [inner]))


# runs


@query("SELECT (r * 64 + 10)::BIGINT AS start, 30::BIGINT AS length FROM generate_series(95, 104) t(r) UNION ALL SELECT 128, 192")
def box_runs(spark, sf_dir):
    """Runs of boxes that are contiguous in the array: lines of a part of its columns, one run of whole lines."""
    shape = embeddings(spark, sf_dir).meta.shape
    runs = Indexer([Box.of((95, 105), (10, 40)), Box.of((2, 5), (0, 64))]).runs(shape)
    return spark.createDataFrame(runs, "start long, length long")


# hierarchies


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each region, an array for each nation."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    arrays = nations.select(F.concat(F.lit("/"), F.translate("r_name", " ", "_"), F.lit("/"), F.translate("n_name", " ", "_")).alias("path"), F.lit("array").alias("node_type"), F.to_json(F.struct(F.array(F.col("n_nationkey")).alias("shape"), F.lit("uint8").alias("data_type"))).alias("meta"))
    groups = _table(spark, sf_dir, "region").select(F.concat(F.lit("/"), F.translate("r_name", " ", "_")).alias("path"), F.lit("group").alias("node_type"), F.lit("{}").alias("meta"))
    root = spark.range(1).select(F.lit("/").alias("path"), F.lit("group").alias("node_type"), F.lit("{}").alias("meta"))
    return H.with_places(arrays.unionByName(groups).unionByName(root))


_N = """(SELECT '/' || replace(r_name, ' ', '_') || '/' || replace(n_name, ' ', '_') AS path, '/' || replace(r_name, ' ', '_') AS parent, replace(n_name, ' ', '_') AS name, n_nationkey AS k
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"SELECT path, '    ' || name || ' [' || k || '] uint8' AS line FROM {_N} UNION ALL SELECT '/' || replace(r_name, ' ', '_'), '  ' || replace(r_name, ' ', '_') FROM region UNION ALL SELECT '/', '/'")
def hierarchy_tree(spark, sf_dir):
    return H.tree_lines(_nodes(spark, sf_dir))


@query(f"SELECT path, name FROM {_N} WHERE parent = (SELECT '/' || replace(min(r_name), ' ', '_') FROM region)")
def child_arrays(spark, sf_dir):
    first = _table(spark, sf_dir, "region").agg(F.min(F.translate("r_name", " ", "_"))).first()[0]
    return H.child_arrays(_nodes(spark, sf_dir), f"/{first}").select("path", "name")


@query("SELECT '/' || replace(r_name, ' ', '_') AS path FROM region")
def child_groups(spark, sf_dir):
    return H.child_groups(_nodes(spark, sf_dir), "/").select("path")


@query(f"SELECT path[2:] AS relative FROM {_N} UNION ALL SELECT replace(r_name, ' ', '_') FROM region")
def consolidate(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    root = GroupMeta(consolidated={p: {"zarr_format": 3, "node_type": "group"} for p in H.consolidate(nodes)})
    return H.children(H.consolidated_nodes(spark, root), "/", recursive=True).select(F.substring("path", 2, 1 << 30).alias("relative"))


@query(f"SELECT path[2:] AS relative, 'array' AS node_type, k::BIGINT AS extent FROM {_N} UNION ALL SELECT replace(r_name, ' ', '_'), 'group', NULL FROM region")
def stored_consolidate(spark, sf_dir):
    """Groups and arrays of a store, their documents gathered into the root's and read from there."""
    store = SparkStore(spark, scratch(spark, "arrays"))
    for r in _nodes(spark, sf_dir).toLocalIterator():
        shape = json.loads(r["meta"]).get("shape")
        write_node(store, r["path"], GroupMeta() if shape is None else ArrayBuilder(shape, [max(1, shape[0])], "uint8", 0).build())
    consolidate_group(store)
    nodes = open_hierarchy(store, "/", "must").where("path <> '/'")
    extent = F.get_json_object("meta", "$.shape[0]").cast("long")
    return nodes.select(F.substring("path", 2, 1 << 30).alias("relative"), "node_type", extent.alias("extent"))
