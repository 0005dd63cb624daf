"""A public piece vocabulary and the lattice of its pieces over many words at once.

Substrings are matched through polynomial hashes modulo 2**64, so that all pieces of thousands of
words are found in a few array operations. Words of one length form a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

BLANK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SLOTS = 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def code_points(words: Sequence[str], length: int) -> np.ndarray:
    """(words, length) code points of words that all have that length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length).astype(np.uint64)


class Vocabulary:
    """Pieces, ids and a hash table from piece hashes to ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, self.size = path, model.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.piece: list[str] = []
        plain: list[int] = []
        for i in range(self.size):
            self.piece.append(p := model.id_to_piece(i))
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
        self.plain = plain
        self.longest = max(len(self.piece[i]) for i in plain)
        by_length: dict[int, list[int]] = {}
        for i in plain:
            by_length.setdefault(len(self.piece[i]), []).append(i)
        ids, hashes = [], []
        for n, group in sorted(by_length.items()):
            codes = code_points([self.piece[i] for i in group], n)
            ids.append(np.array(group, np.int32))
            hashes.append(self.prefixes(codes)[:, n])
        self._table(np.concatenate(ids), np.concatenate(hashes))

    @staticmethod
    def powers(n: int) -> list[int]:
        """The hash base to the powers 0 to n."""
        return [pow(int(_BASE), k, 1 << 64) for k in range(n + 1)]

    @staticmethod
    def prefixes(codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of each row of code points."""
        h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        for j in range(codes.shape[1]):
            h[:, j + 1] = h[:, j] * _BASE + mixed[:, j]
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _table(self, ids: np.ndarray, hashes: np.ndarray) -> None:
        """One slot for each hash, whose lowest bit tells whether others met the slot taken; these go to a sorted rest."""
        if len(np.unique(hashes >> np.uint64(1))) != len(hashes):
            raise ValueError("two pieces of the vocabulary have one hash")
        self._key, self._id = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
        slot = self._slot(hashes)
        _, first = np.unique(slot, return_index=True)
        self._key[slot[first]], self._id[slot[first]] = hashes[first] & ~np.uint64(1), ids[first]
        over = np.delete(np.arange(len(ids)), first)
        self._key[slot[over]] |= np.uint64(1)
        order = np.argsort(hashes[over])
        self._rest_key, self._rest_id = np.append(hashes[over][order], np.uint64(0)), np.append(ids[over][order], np.int32(-1))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        slot = self._slot(h).ravel()
        key = self._key[slot]
        other = (key ^ h.ravel()) > np.uint64(1)
        out = np.full(len(slot), -1, np.int32)
        hit = np.flatnonzero(~other)
        out[hit] = self._id[slot[hit]]
        more = np.flatnonzero(other & (key & np.uint64(1)).astype(bool))
        if len(more):
            wanted = h.ravel()[more]
            at = np.searchsorted(self._rest_key[:-1], wanted)
            out[more] = np.where(self._rest_key[at] == wanted, self._rest_id[at], -1)
        return out.reshape(h.shape)

    def edges(self, words: Sequence[str] | np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first start, end, ids) over words of one length (or their code points), ends ascending; ids has a column for each start from the first one to end - 1, -1 where no piece covers start to end."""
        h = self.prefixes(words if isinstance(words, np.ndarray) else code_points(words, length))
        power = np.array([pow(int(_BASE), n, 1 << 64) for n in range(self.longest, 0, -1)], np.uint64)
        for end in range(1, length + 1):
            first = max(0, end - self.longest)
            yield first, end, self.lookup(h[:, end, None] - h[:, first:end] * power[self.longest - (end - first) :])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def by_length(words: Sequence[str], most: int = 20_000) -> Iterator[tuple[int, list[str]]]:
    """Blocks of words of equal length."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, group in groups.items():
        for i in range(0, len(group), most):
            yield n, group[i : i + most]
