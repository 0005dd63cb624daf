"""Chunk key encodings, metadata keys, and store keys and prefixes, as strings and as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.registry import KEY_ENCODINGS

#: The names of metadata documents.
V3_KEY, V2_ARRAY_KEY, V2_GROUP_KEY, V2_ATTRIBUTES_KEY = "zarr.json", ".zarray", ".zgroup", ".zattrs"


class KeyEncoding:
    """Chunk indices to keys: a prefix, the indices joined by a separator, a suffix; `alone` is a scalar's key."""

    def __init__(self, prefix: str, separator: str, alone: str, suffix: str = ""):
        if separator not in ("/", "."):
            raise ValueError(f"separator {separator!r}")
        self.prefix, self.separator, self.alone, self.suffix = prefix, separator, alone, suffix

    def key(self, chunk: Sequence[int]) -> str:
        parts = [*([self.prefix] if self.prefix else []), *map(str, chunk)]
        return (self.separator.join(parts) if chunk else self.alone) + self.suffix

    def column(self, chunk: Sequence[Column]) -> Column:
        if not chunk:
            return F.lit(self.alone + self.suffix)
        parts = [*([F.lit(self.prefix)] if self.prefix else []), *(c.cast("string") for c in chunk)]
        return F.concat(F.concat_ws(self.separator, *parts), F.lit(self.suffix))

    def chunk(self, key: str) -> tuple[int, ...] | None:
        """The indices of a key, None for other keys."""
        if not key.endswith(self.suffix):
            return None
        key = key[: len(key) - len(self.suffix)]
        if key == self.alone and self.prefix:
            return ()
        parts = key.split(self.separator)
        if self.prefix:
            if parts[0] != self.prefix:
                return None
            parts = parts[1:]
        return tuple(map(int, parts)) if parts and all(p.isdigit() for p in parts) else None


@KEY_ENCODINGS.add("default")
def default(config: dict) -> KeyEncoding:
    return KeyEncoding("c", config.get("separator", "/"), "c")


@KEY_ENCODINGS.add("v2")
def v2(config: dict) -> KeyEncoding:
    return KeyEncoding("", config.get("separator", "."), "0")


@KEY_ENCODINGS.add("default_suffix")
def default_suffix(config: dict) -> KeyEncoding:
    return KeyEncoding("c", config.get("separator", "/"), "c", config.get("suffix", ""))


def check_key(key: str) -> str:
    if not key or key.startswith("/") or key.endswith("/") or "//" in key:
        raise ValueError(f"not a store key: {key!r}")
    return key


def check_prefix(prefix: str) -> str:
    if prefix and (prefix.startswith("/") or not prefix.endswith("/") or "//" in prefix):
        raise ValueError(f"not a store prefix: {prefix!r}")
    return prefix


def check_path(path: str) -> str:
    """A node path: the root, or names after slashes; names aren't all periods and don't begin with two underscores."""
    if path != "/" and (not path.startswith("/") or path.endswith("/") or not all(map(valid_name, path[1:].split("/")))):
        raise ValueError(f"not a node path: {path!r}")
    return path


def valid_name(name: str) -> bool:
    return bool(name) and "/" not in name and not name.startswith("__") and bool(name.strip("."))


def parent(key: str) -> str:
    head, _, _ = key.rstrip("/").rpartition("/")
    return head + "/" if head else ""


def node_key(path: str, key: str) -> str:
    """A key below a node's path."""
    return key if path == "/" else f"{path[1:]}/{key}"


def node_key_column(path: str, key: Column) -> Column:
    return key if path == "/" else F.concat(F.lit(path[1:] + "/"), key)
