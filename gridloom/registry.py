"""Extension points by name: codecs, data types, chunk grids, key encodings, storage transformers.

Entries registered at run time go before the built-in ones. Names may carry a vendor prefix ("vendor.name"): the exact
name is looked up first, then the part after the last dot, then patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


class UnsupportedExtension(ValueError):
    """No extension of this name is known, or it can't run here."""


class Registry:
    def __init__(self, kind: str):
        self.kind, self.built_in, self.runtime = kind, {}, {}
        self.aliases: dict[str, str] = {}
        self.patterns: list[tuple[re.Pattern, str]] = []

    def add(self, *names: str) -> Callable[[Any], Any]:
        def keep(made: Any) -> Any:
            self.built_in[names[0]] = made
            self.aliases.update(dict.fromkeys(names[1:], names[0]))
            return made

        return keep

    def register(self, name: str, made: Any) -> None:
        self.runtime[name] = made

    def unregister(self, name: str) -> bool:
        return self.runtime.pop(name, None) is not None

    def match(self, pattern: str, name: str) -> None:
        self.patterns.append((re.compile(pattern), name))

    def canonical(self, name: str) -> str:
        for n in (name, name.rpartition(".")[2]):
            if n in self.runtime or n in self.built_in:
                return n
            if n in self.aliases:
                return self.aliases[n]
        return next((to for p, to in self.patterns if p.fullmatch(name)), name)

    def get(self, name: str) -> Any:
        if name in self.runtime:
            return self.runtime[name]
        n = self.canonical(name)
        if n in self.runtime:
            return self.runtime[n]
        if n not in self.built_in:
            raise UnsupportedExtension(f"unknown {self.kind}: {name}")
        return self.built_in[n]


CODECS, DATA_TYPES, GRIDS, KEY_ENCODINGS, TRANSFORMERS = (Registry(k) for k in ("codec", "data type", "chunk grid", "chunk key encoding", "storage transformer"))


_ALL = (CODECS, DATA_TYPES, GRIDS, KEY_ENCODINGS, TRANSFORMERS)


def registered() -> list[tuple[dict[str, Any], list]]:
    """What was registered at run time, by registry, and the patterns of names: executors get both with an array's metadata."""
    return [(dict(r.runtime), list(r.patterns)) for r in _ALL]


def register_all(entries: list[tuple[dict[str, Any], list]]) -> None:
    for registry, (own, patterns) in zip(_ALL, entries, strict=True):
        for name, made in own.items():
            registry.runtime.setdefault(name, made)
        registry.patterns += [p for p in patterns if p not in registry.patterns]
