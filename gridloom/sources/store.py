"""Stores: flat key to bytes maps. On the driver for metadata, and as DataFrames for chunks.

A store's root is any path that Spark reads. Executors list, read and write by Arrow's file systems (local, hdfs, s3, gs), where they can; values are written under a hidden name that is then moved.
On other file systems listings and blobs come through Spark's `binaryFile` source, which passes over names that begin with a dot or an underscore. The driver reads and writes metadata.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import check_key, check_prefix
from gridloom.plans.shared import bounded


class RangeError(ValueError):
    pass


def byte_range(data: bytes, offset: int | None = None, length: int | None = None, suffix: int | None = None) -> bytes:
    """Bytes from an offset, of a length or to the end, or the last `suffix` bytes. Beyond the value's end: an error."""
    if suffix is not None:
        offset, length = len(data) - suffix, suffix
    end = len(data) if length is None else offset + length
    if offset < 0 or end > len(data):
        raise RangeError(f"bytes {offset} to {end} of {len(data)}")
    return data[offset:end]


class Store:
    """What every store does in terms of get, set, erase and list."""

    def get(self, key: str) -> bytes | None: ...
    def set(self, key: str, value: bytes) -> None: ...
    def erase(self, key: str) -> None: ...
    def list(self) -> list[str]: ...

    def get_partial(self, key: str, ranges: Iterable[dict]) -> list[bytes] | None:
        """Byte ranges of a value; a store that can seek reads no more than these."""
        data = self.get(check_key(key))
        return None if data is None else [byte_range(data, **r) for r in ranges]

    def set_partial(self, key: str, offset: int, value: bytes) -> None:
        """Patches a value; bytes between its end and the offset become zero."""
        old = self.get(key) or b""
        old = old.ljust(offset, b"\0")
        self.set(key, old[:offset] + value + old[offset + len(value) :])

    def erase_many(self, keys: Iterable[str]) -> None:
        for k in keys:
            self.erase(k)

    def erase_prefix(self, prefix: str) -> None:
        self.erase_many(self.list_prefix(prefix))

    def list_prefix(self, prefix: str) -> list[str]:
        check_prefix(prefix)
        return [k for k in self.list() if k.startswith(prefix)]

    def list_dir(self, prefix: str) -> tuple[list[str], list[str]]:
        """Keys and prefixes one level down."""
        own = self.list_prefix(prefix)
        keys = [k for k in own if "/" not in k[len(prefix) :]]
        return keys, sorted({prefix + k[len(prefix) :].split("/")[0] + "/" for k in own if "/" in k[len(prefix) :]})

    def children(self, prefix: str) -> list[str]:
        return [p for p in self.list_dir(prefix)[1] if not p[len(prefix) :].startswith("__")]

    def size_key(self, key: str) -> int | None:
        data = self.get(key)
        return None if data is None else len(data)

    def size_prefix(self, prefix: str) -> int:
        return sum(self.size_key(k) or 0 for k in self.list_prefix(prefix))

    def size(self) -> int:
        return self.size_prefix("")

    def rename(self, old: str, new: str) -> None:
        data = self.get(old)
        if data is None:
            raise KeyError(old)
        self.set(new, data)
        self.erase(old)


class MemoryStore(Store):
    def __init__(self, values: dict[str, bytes] | None = None):
        self.values = dict(values or {})

    def get(self, key: str) -> bytes | None:
        return self.values.get(check_key(key))

    def set(self, key: str, value: bytes) -> None:
        self.values[check_key(key)] = bytes(value)

    def erase(self, key: str) -> None:
        self.values.pop(check_key(key), None)

    def list(self) -> list[str]:
        return sorted(self.values)


class SparkStore(Store):
    """A folder of any file system that the session knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, key: str):
        return self._path(f"{self.root}/{check_key(key)}")

    def get(self, key: str) -> bytes | None:
        if not self._fs.exists(self._at(key)):
            return None
        stream = self._fs.open(self._at(key))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def get_partial(self, key: str, ranges: Iterable[dict]) -> list[bytes] | None:
        at = self._at(key)
        if not self._fs.exists(at):
            return None
        size, out = self._fs.getFileStatus(at).getLen(), []
        stream = self._fs.open(at)
        try:
            for r in ranges:
                offset, length, suffix = r.get("offset"), r.get("length"), r.get("suffix")
                if suffix is not None:
                    offset, length = size - suffix, suffix
                length = size - offset if length is None else length
                if offset < 0 or offset + length > size:
                    raise RangeError(f"bytes {offset} to {offset + length} of {size}")
                stream.seek(offset)
                out.append(bytes(stream.readNBytes(length)))
        finally:
            stream.close()
        return out

    def set(self, key: str, value: bytes) -> None:
        """Readers see the old or the new value, whenever the driver stops: local files and hdfs by a rename that replaces, object stores by one whole write."""
        jvm, scheme = self.spark.sparkContext._jvm, self._fs.getScheme()
        whole = scheme not in ("file", "hdfs", "viewfs")
        at = self._at(key)
        part = at if whole else self._path(at.getParent(), f"_{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, True)
        stream.write(bytearray(value))
        stream.close()
        if scheme == "file":
            files, copy = jvm.java.nio.file, self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            copy[0] = files.StandardCopyOption.ATOMIC_MOVE
            local = lambda p: files.Paths.get(self._fs.makeQualified(p).toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            files.Files.move(local(part), local(at), copy)
            # the checksum beside the old value must not judge the new one
            self._fs.delete(self._path(part.getParent(), f".{part.getName()}.crc"), False)
            self._fs.delete(self._path(at.getParent(), f".{at.getName()}.crc"), False)
        elif not whole:
            options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, options)

    def erase(self, key: str) -> None:
        self._fs.delete(self._at(key), False)

    def erase_prefix(self, prefix: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{check_prefix(prefix)}"), True)

    def rename(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._at(new).getParent())
        if not self._fs.rename(self._at(old), self._at(new)):
            raise KeyError(old)

    def list(self) -> list[str]:
        return sorted(r["key"] for r in self.listing().select("key").toLocalIterator())

    def size_key(self, key: str) -> int | None:
        return self._fs.getFileStatus(self._at(key)).getLen() if self._fs.exists(self._at(key)) else None

    def size_prefix(self, prefix: str) -> int:
        found = self.listing().where(F.col("key").startswith(check_prefix(prefix)))
        return found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    # as DataFrames
    def listing(self, prefix: str = "") -> DataFrame:
        """key, length, modificationTime of all keys below a prefix; contents aren't read. The driver lists two levels, executors what lies below."""
        below = f"{self.root}/{check_prefix(prefix)}".rstrip("/")
        schema = "key string, length long, modificationTime timestamp"
        if not self._fs.exists(self._path(below)):
            return self.spark.createDataFrame([], schema)
        try:
            files, root = _opened(self.uri)
        except Exception:  # Arrow knows no such file system, or lacks its library
            at = self._fs.makeQualified(self._path(self.root)).toUri().getPath()
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(below)
            return found.select(F.expr(f"substring(path, locate('{at}/', path) + {len(at) + 1})").alias("key"), "length", "modificationTime")
        here, folders = [], [f"{root}/{prefix}".rstrip("/")]
        for _ in range(2):
            infos = [i for f in folders for i in files.get_file_info(pyarrow.fs.FileSelector(f))]
            here += [r for i in infos if (r := _listed(i, root))]
            folders = [i.path for i in infos if i.type == pyarrow.fs.FileType.Directory]
        rows = self.spark.createDataFrame(here, schema)
        if not folders:
            return rows
        uri, spread = self.uri, self.spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 1000))

        def run(batches):
            files, root = _opened(uri)
            for b in batches:
                for folder in b.column(0).to_pylist():
                    found = [r for i in files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True)) if (r := _listed(i, root))]
                    for k in range(0, len(found), 10_000):
                        part = list(zip(*found[k : k + 10_000], strict=True))
                        yield pyarrow.RecordBatch.from_arrays([pyarrow.array(part[0]), pyarrow.array(part[1], pyarrow.int64()), pyarrow.array(part[2], pyarrow.timestamp("us", "UTC"))], names=["key", "length", "modificationTime"])

        return rows.unionByName(spread.mapInArrow(run, schema))

    def blobs(self, prefix: str = "", names: str | None = None) -> DataFrame:
        """key, value of the keys below a prefix; with `names`, only of those that this regular expression finds: no other value is read."""
        prefix = prefix + "/" if prefix and not prefix.endswith("/") else prefix
        try:
            _opened(self.uri)
        except Exception:
            root = self._fs.makeQualified(self._path(self.root)).toUri().getPath()
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{prefix}".rstrip("/"))
            found = files.select(F.expr(f"substring(path, locate('{root}/', path) + {len(root) + 1})").alias("key"), F.col("content").alias("value"))
            return found if names is None else found.where(F.col("key").rlike(names))
        keys, uri = self.listing(prefix).select("key"), self.uri

        def run(batches):
            files, root = _opened(uri)
            for b in batches:
                for key in b.column(0).to_pylist():
                    with files.open_input_file(f"{root}/{key}") as f:
                        yield pyarrow.RecordBatch.from_arrays([pyarrow.array([key]), pyarrow.array([f.read()], pyarrow.binary())], names=["key", "value"])

        return (keys if names is None else keys.where(F.col("key").rlike(names))).mapInArrow(run, "key string, value binary")

    @property
    def uri(self) -> str:
        """The root with its scheme."""
        return self._fs.makeQualified(self._path(self.root)).toUri().toString()

    def write_blobs(self, blobs: DataFrame) -> DataFrame:
        """Writes key, value rows from the executors; a lazy DataFrame of the keys written.

        Each value goes to a temporary name and is moved over the old one, so repeated and speculative tasks do no harm. File systems that
        Arrow can't write (it knows local, hdfs, s3 and gs) go by `write_blobs_here`.
        """
        return bounded(blobs.select("key", "value")).mapInArrow(_writer(self.uri), "key string")

    def erase_keys(self, keys: DataFrame) -> DataFrame:
        """Deletes keys from the executors; a lazy DataFrame of them."""
        return keys.select("key").mapInArrow(_eraser(self.uri), "key string")

    def write_blobs_here(self, blobs: DataFrame) -> int:
        """Writes key, value rows by the driver, one partition at a time."""
        n = 0
        for r in blobs.select("key", "value").toLocalIterator(prefetchPartitions=True):
            self.set(r["key"], bytes(r["value"]))
            n += 1
        return n


_HIDDEN = re.compile(r"_[0-9a-f]{32}\.part|\..*\.crc")


def _listed(info, root: str) -> tuple | None:
    """A file's key, length and time; None for folders, values that are being written, and checksums that Hadoop keeps beside local files."""
    if info.type != pyarrow.fs.FileType.File or _HIDDEN.fullmatch(info.base_name):
        return None
    return info.path[len(root) + 1 :], info.size, info.mtime


def _opened(uri: str):
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def _writer(uri: str):
    def run(batches):
        files, root = _opened(uri)
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{root}/{key}"
                files.create_dir(at.rpartition("/")[0], recursive=True)
                # hidden from listings until it is moved
                part = f"{at.rpartition('/')[0]}/_{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as f:
                    f.write(value)
                files.move(part, at)
            yield b.select(["key"])

    return run


def _eraser(uri: str):
    def run(batches):
        files, root = _opened(uri)
        for b in batches:
            for key in b.column(0).to_pylist():
                if files.get_file_info(f"{root}/{key}").is_file:
                    files.delete_file(f"{root}/{key}")
            yield b.select(["key"])

    return run


@dataclass
class Metrics:
    bytes_read: int = 0
    bytes_written: int = 0
    reads: int = 0
    writes: int = 0
    keys_erased: int = 0


class MeteredStore(Store):
    """Counts what passes through to another store."""

    def __init__(self, inner: Store):
        self.inner, self.metrics = inner, Metrics()

    def reset(self) -> None:
        self.metrics = Metrics()

    def get(self, key: str) -> bytes | None:
        data = self.inner.get(key)
        self.metrics.reads += 1
        self.metrics.bytes_read += len(data or b"")
        return data

    def set(self, key: str, value: bytes) -> None:
        self.metrics.writes += 1
        self.metrics.bytes_written += len(value)
        self.inner.set(key, value)

    def erase(self, key: str) -> None:
        self.metrics.keys_erased += 1
        self.inner.erase(key)

    def list(self) -> list[str]:
        return self.inner.list()


@dataclass
class LoggedStore(Store):
    """Logs every call to another store."""

    inner: Store
    log: list[tuple] = field(default_factory=list)

    def get(self, key: str) -> bytes | None:
        self.log.append(("get", key))
        return self.inner.get(key)

    def set(self, key: str, value: bytes) -> None:
        self.log.append(("set", key, len(value)))
        self.inner.set(key, value)

    def erase(self, key: str) -> None:
        self.log.append(("erase", key))
        self.inner.erase(key)

    def list(self) -> list[str]:
        self.log.append(("list",))
        return self.inner.list()


class ReadOnlyStore(Store):
    def __init__(self, inner: Store):
        self.inner = inner

    def get(self, key: str) -> bytes | None:
        return self.inner.get(key)

    def list(self) -> list[str]:
        return self.inner.list()

    def set(self, key: str, value: bytes) -> None:
        raise PermissionError("the store is read only")

    def erase(self, key: str) -> None:
        raise PermissionError("the store is read only")


class ValueReader:
    """Reads and seeks in one value."""

    def __init__(self, store: Store, key: str):
        import io

        data = store.get(key)
        if data is None:
            raise KeyError(key)
        self._file = io.BytesIO(data)

    def __getattr__(self, name: str):
        return getattr(self._file, name)


class Transformer:
    """A storage transformer: maps keys and values on their way to a store. Registered ones override what they change; executors use them, too, so they hold no driver state."""

    def __init__(self, config: dict):
        self.config = config

    def key(self, key: str) -> str:
        return key

    def encode(self, value: bytes) -> bytes:
        return value

    def decode(self, value: bytes) -> bytes:
        return value


def transformers(metas: Sequence[dict]) -> list[Transformer]:
    """An array's transformers, in the order in which a value passes them on its way to the store."""
    from gridloom.registry import TRANSFORMERS

    return [TRANSFORMERS.get(m["name"])(m.get("configuration") or {}) for m in metas]


class TransformedStore(Store):
    """A store seen through storage transformers. Keys of a transformer that renames them can't be listed."""

    def __init__(self, inner: Store, through: Sequence[Transformer]):
        self.inner, self.through = inner, list(through)

    def _key(self, key: str) -> str:
        for t in self.through:
            key = t.key(key)
        return key

    def get(self, key: str) -> bytes | None:
        data = self.inner.get(self._key(key))
        if data is not None:
            for t in reversed(self.through):
                data = t.decode(data)
        return data

    def set(self, key: str, value: bytes) -> None:
        for t in self.through:
            value = t.encode(value)
        self.inner.set(self._key(key), value)

    def erase(self, key: str) -> None:
        self.inner.erase(self._key(key))

    def list(self) -> list[str]:
        return self.inner.list()


def transformed(store: Store, metas: Sequence[dict]) -> Store:
    """A store seen through an array's storage transformers."""
    return TransformedStore(store, transformers(metas)) if metas else store
