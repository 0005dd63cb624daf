"""Arrays and groups in stores: metadata on the driver, chunks as DataFrames."""

from __future__ import annotations

import json
import re
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.boxes import Box
from gridloom.functions.keys import V2_ARRAY_KEY, V2_ATTRIBUTES_KEY, V2_GROUP_KEY, V3_KEY, check_path, node_key, node_key_column
from gridloom.operators import hierarchy as H
from gridloom.operators.frame import ArrayFrame, _arrow_of, _per_chunk, index_names
from gridloom.plans.meta import ArrayMeta, GroupMeta, MetadataError, Options, array_to_v3, group_to_v3
from gridloom.plans.shared import bounded, written
from gridloom.registry import UnsupportedExtension
from gridloom.sources.chunks import StoredChunks
from gridloom.sources.store import SparkStore, Store, _opened


def read_node(store: Store, path: str) -> ArrayMeta | GroupMeta | None:
    """Metadata of a node: version 3 first, then version 2; None where there is no node."""
    check_path(path)
    doc = store.get(node_key(path, V3_KEY))
    if doc is not None:
        d = json.loads(doc)
        return ArrayMeta.from_json(d) if d.get("node_type") == "array" else GroupMeta.from_json(d)
    attributes = store.get(node_key(path, V2_ATTRIBUTES_KEY))
    if (doc := store.get(node_key(path, V2_ARRAY_KEY))) is not None:
        return array_to_v3(doc, attributes)
    if (doc := store.get(node_key(path, V2_GROUP_KEY))) is not None:
        return group_to_v3(doc, attributes)
    return None


#: Who writes, for arrays whose options ask for it.
WRITER = {"_gridloom": {"description": "written by gridloom"}}


def write_node(store: Store, path: str, meta: ArrayMeta | GroupMeta) -> None:
    """Writes a node's document: version 3, or version 2 where the node was read from one and its options keep it."""
    check_path(path)
    if isinstance(meta, ArrayMeta):
        if meta.options.include_metadata_of_writer:
            meta = meta.with_attributes(meta.attributes | WRITER)
        if meta.version2 is not None and meta.options.metadata_convert == "keep":
            store.set(node_key(path, V2_ARRAY_KEY), json.dumps(meta.version2 | {"shape": list(meta.shape)}, indent=2).encode())
            if meta.attributes:
                store.set(node_key(path, V2_ATTRIBUTES_KEY), json.dumps(meta.attributes, indent=2).encode())
            return
    store.set(node_key(path, V3_KEY), json.dumps(meta.to_json(), indent=2).encode())


def erase_node(store: Store, path: str, which: str = Options.metadata_erase) -> None:
    """Erases a node's documents: of both versions, or of one ("v3", "v2")."""
    keys = {"v3": [V3_KEY], "v2": [V2_ARRAY_KEY, V2_GROUP_KEY, V2_ATTRIBUTES_KEY]}
    store.erase_many(node_key(path, k) for k in (keys.get(which) or keys["v3"] + keys["v2"]))


def open_hierarchy(store: SparkStore, path: str = "/", use_consolidated: str = Options.use_consolidated) -> DataFrame:
    """Nodes at and below a path. Consolidated metadata spares the listing: "auto" where there is some, "must" or an error, "never".

    A consolidated document may be older than the store; it is taken as it stands.
    """
    root = read_node(store, path)
    inline = isinstance(root, GroupMeta) and root.consolidated is not None
    if use_consolidated == "must" and not inline:
        raise MetadataError(f"no consolidated metadata at {path}")
    if inline and use_consolidated != "never":
        return H.consolidated_nodes(store.spark, root, path)
    return H.traverse(H.nodes_of(store.blobs("", H.DOCUMENTS)), path)


def consolidate_group(store: SparkStore, path: str = "/") -> GroupMeta:
    """Gathers the metadata below a group into the group's own document."""
    root = read_node(store, path)
    if not isinstance(root, GroupMeta):
        raise MetadataError(f"no group at {path}")
    made = GroupMeta(root.attributes, H.consolidate(open_hierarchy(store, path, "never"), path), root.additional)
    write_node(store, path, made)
    return made


def blob_chunks(store: SparkStore, path: str, meta: ArrayMeta) -> DataFrame:
    """c0.., key, value of an array's stored chunks; chunk numbers come from the keys."""
    prefix = "" if path == "/" else path[1:]
    c = index_names(meta.dims, "c")
    key = F.col("key") if not prefix else F.expr(f"substring(key, {len(prefix) + 2})")
    pattern = chunk_pattern(meta)
    found = store.blobs(prefix, pattern.replace("^", f"^{re.escape(prefix)}/", 1) if prefix else pattern).withColumn("_key", key)
    return found.select(*(F.regexp_extract("_key", pattern, k + 1).cast("long").alias(n) for k, n in enumerate(c)), "key", "value")


def element_of(meta: ArrayMeta) -> T.DataType:
    return T._parse_datatype_string(meta.dtype.spark)


def stored_chunks(store: SparkStore, path: str) -> StoredChunks | None:
    """Where an array's chunks lie, if executors can open files there."""
    try:
        _opened(store.uri)
    except Exception:  # Arrow knows no such file system, or lacks its library
        return None
    return StoredChunks(store.spark, store.uri, path)


def open_array(store: SparkStore, path: str = "/", options: Options | None = None, listed: bool = False) -> ArrayFrame:
    """The array at a path; a read opens the chunks that it needs, by their keys, and of these reads what it needs.

    listed: whole-array operations find chunks by a listing instead of trying each of the grid's: for very sparse arrays. On file systems that
    only Spark can open, chunks are always listed and read whole by Spark's binary files.
    """
    meta = read_node(store, path)
    if not isinstance(meta, ArrayMeta):
        raise MetadataError(f"no array at {path}")
    if options is not None:
        meta = replace(meta, options=options)
    held = stored_chunks(store, path)
    if held is not None and not listed:
        return ArrayFrame(meta, held.chunks(meta, Box.whole(meta.grid.shape)), held)
    if meta.storage_transformers:
        raise UnsupportedExtension("storage transformers need a file system that executors can open")
    try:
        blobs = blob_chunks(store, path, meta)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "No such file" not in str(e):
            raise
        return ArrayFrame.empty(store.spark, meta)
    if held is not None:
        return ArrayFrame(meta, ArrayFrame.decode(meta, blobs.drop("key"), element_of(meta)).chunks, held)
    return ArrayFrame.decode(meta, blobs.drop("key"), element_of(meta))


_cached: dict[tuple[str, str], ArrayFrame] = {}


def cached_array(store: SparkStore, path: str = "/") -> ArrayFrame:
    """The array with its decoded chunks in Spark's storage; one for all callers, until something is written to it."""
    key = (store.uri, path)
    if key not in _cached:
        _cached[key] = open_array(store, path).cached()
    return _cached[key]


def invalidate(store: SparkStore, path: str) -> None:
    """Forgets cached chunks of an array."""
    if (held := _cached.pop((store.uri, path), None)) is not None:
        held.release()


def save_array(store: SparkStore, path: str, frame: ArrayFrame) -> int:
    """Writes chunks and metadata; stored chunks that the frame lacks are erased. The number of chunks written.

    Chunks are encoded to hidden files first and moved when all are there, so that a frame read from this store can be written back to it and a failure
    before that leaves the old array. Metadata follows, then what is stale goes. Chunks never pass the driver.
    """
    held = stored_chunks(store, path)
    if held is None:
        staged = written(frame.encode().select(node_key_column(path, F.col("key")).alias("key"), "value"))
        n = store.write_blobs_here(staged)
        names = staged.select("key")
    else:
        parts = written(held.encoded(frame.meta, frame.encode().drop("key")))
        n = held.moved(parts).count()
        names = parts.select(F.expr(f"substring(at, {len(_opened(store.uri)[1]) + 2})").alias("key"))
    invalidate(store, path)
    write_node(store, path, frame.meta)
    if frame.meta.storage_transformers:  # their keys can't be told from others'
        return n
    prefix = "" if path == "/" else path[1:] + "/"
    below = F.expr(f"substring(key, {len(prefix) + 1})")
    old = store.listing(prefix).select("key").where(below.rlike(chunk_pattern(frame.meta)))
    store.erase_keys(old.join(names, "key", "left_anti")).count()
    return n


def update_cells(store: SparkStore, path: str, cells: DataFrame, options: Options | None = None) -> int:
    """Writes cells (i0.., v; the larger value of a cell given twice) into a stored array. The number of inner chunks (or chunks without any) that were encoded.

    Only chunks that a cell touches are read and written, and of shards only the inner chunks. All are moved when all are written. One writer at a time.
    """
    meta, held = read_node(store, path), stored_chunks(store, path)
    if not isinstance(meta, ArrayMeta):
        raise MetadataError(f"no array at {path}")
    if options is not None:
        meta = replace(meta, options=options)
    if held is None:
        raise UnsupportedExtension("updates in place need a file system that executors can open")
    made = written(held.updated(meta, cells.where(Box.whole(meta.shape).predicate(index_names(meta.dims)))))
    held.moved(written(held.encoded(meta, made))).count()
    invalidate(store, path)
    return made.agg(F.coalesce(F.sum("inner"), F.lit(0))).first()[0]


def erase_stored(store: SparkStore, path: str, chunks: Box) -> int:
    """Erases a range of an array's chunks in the store, by their keys; those that aren't there are no error. The number of keys tried."""
    meta, held = read_node(store, path), stored_chunks(store, path)
    numbers = chunks.domain(store.spark, index_names(meta.dims, "c")).withColumn("value", F.lit(None).cast("binary"))
    n = held.moved(held.encoded(meta, numbers)).count()
    invalidate(store, path)
    return n


def compact_array(store: SparkStore, path: str) -> int:
    """Rewrites an array's shards that hold dead bytes. The number of these."""
    meta, held = read_node(store, path), stored_chunks(store, path)
    numbers = held._spread(meta, Box.whole(meta.grid.shape))
    smaller = compacted(meta, held.values(meta, numbers)).where("changed").drop("changed")
    n = held.moved(written(held.encoded(meta, smaller))).count()
    invalidate(store, path)
    return n


def chunk_pattern(meta: ArrayMeta) -> str:
    """A regular expression of an array's chunk keys, with a group for each chunk number."""
    encoding = meta.keys
    between = re.escape(encoding.separator)
    lead = re.escape(encoding.prefix) + between if encoding.prefix else ""
    numbers = between.join(["(\\d+)"] * meta.dims)
    return f"^{lead}{numbers}{re.escape(encoding.suffix)}$" if meta.dims else f"^{re.escape(encoding.alone + encoding.suffix)}$"


def encoded_chunks(store: SparkStore, path: str, numbers: DataFrame) -> DataFrame:
    """Encoded values of chunk numbers (c0..), null where a chunk isn't stored."""
    meta = read_node(store, path)
    c, held = index_names(meta.dims, "c"), stored_chunks(store, path)
    found = held.values(meta, numbers) if held else blob_chunks(store, path, meta)
    return numbers.join(found.drop("key"), c, "left")


def subchunk_bytes(meta: ArrayMeta, blobs: DataFrame) -> DataFrame:
    """c0.., s0.., offset, size, value: the encoded inner chunks of sharded chunks, cut by their index without decoding."""
    c, s = index_names(meta.dims, "c"), index_names(meta.dims, "s")
    entry = T.StructType([*(T.StructField(n, T.LongType()) for n in s), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())])
    def entries(chain, shape, value):
        return [dict(zip([*s, "offset", "size"], [*k, o, n], strict=True)) for k, (o, n) in chain.sharding.entries(value).items()]

    keep = blobs.select(*c, F.col("value").alias("raw"), "value")
    schema = T.StructType([*(keep.schema[n] for n in c), keep.schema["raw"], T.StructField("entries", T.ArrayType(entry))])
    rows = bounded(keep).mapInArrow(_per_chunk(meta, entries, "value", pa.list_(_arrow_of(entry)), "entries"), schema)
    flat = rows.select(*c, "raw", F.explode("entries").alias("e")).select(*c, *(F.col(f"e.{n}").alias(n) for n in s), "e.offset", "e.size", "raw")
    return flat.select(*c, *s, "offset", "size", F.expr("substring(raw, CAST(offset + 1 AS INT), CAST(size AS INT))").alias("value"))


def compacted(meta: ArrayMeta, blobs: DataFrame) -> DataFrame:
    """c0.., value, changed: sharded chunks without dead bytes."""
    c = index_names(meta.dims, "c")
    keep = blobs.select(*c, F.col("value").alias("raw"), "value")
    schema = T.StructType([*(keep.schema[n] for n in c), keep.schema["raw"], T.StructField("smaller", T.BinaryType())])
    rows = bounded(keep).mapInArrow(_per_chunk(meta, lambda chain, shape, value: chain.sharding.compact(value), "value", pa.binary(), "smaller"), schema)
    return rows.select(*c, F.coalesce("smaller", "raw").alias("value"), F.col("smaller").isNotNull().alias("changed"))

