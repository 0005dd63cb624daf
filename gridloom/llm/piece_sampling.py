"""Encoding into pieces of a public vocabulary: distinct sampled segmentations by Gumbel top-k, and decoding.

A text is cut where no piece of the vocabulary spans the cut: before blanks that follow other characters, between runs of letters and runs of other characters, around line breaks. Such
parts have a lattice of pieces each, whatever their length, and the text's lattice is their chain: cutting loses no segmentation. A segmentation's probability is the product of its pieces' weights over the sum for all segmentations,
which a backward sum gives. Pieces weigh by Zipf's law over the vocabulary's order, to the power `alpha`.
Characters without a piece are spelled in byte pieces.

The k segmentations with the largest Gumbel-perturbed log-probabilities are a sample without replacement. They are found
by an A-star search over the lattice: a node is a prefix with the set of its continuations not yet taken, its key the largest perturbed value
below it, which is drawn top down, given its parent's. Taking the best node walks to one segmentation, whose
siblings at every step become nodes in turn (all steps of a path as one node, until it is the best). Walks of many texts run
together in array operations. With `threshold`, the (k+1)-th value, a segmentation's inclusion
probability is 1 - exp(-exp(log_prob - threshold)); `log_inclusion` is its logarithm, for long texts far below zero.

Draws are hashes of the row's key and the place in the text: reruns and other partitionings agree, repeated rows agree. Null and empty texts have
one segmentation, without pieces. Texts with fewer than k segmentations give all of them, with inclusion 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import claim, map_texts
from gridloom.llm.pieces import BLANK, code_points, default_vocabulary, vocabulary
from gridloom.llm.words import mix

#: A blank mark that the text itself holds is a part of its own, spelled in bytes, lest it be read as a blank.
_PART = re.compile(rf" *[a-zA-Zß-öø-ÿ]+(?![^\W\d_])| *[^\W\d_]+| *(?:[^\w \n{BLANK}]|[\d_])+| +|[\n{BLANK}]")
#: The same for ASCII texts, by plain character sets.
_ASCII_PART = re.compile(r" *[a-zA-Z]+| *[^a-zA-Z \n]+| +|\n")
#: What a worker's table of lattices holds before parts that weren't met again leave it: edges (25 bytes each) and parts (some 150 bytes each).
_TABLE_EDGES, _TABLE_PARTS = 1_200_000, 60_000
#: Longer parts get their lattice position by position, in stretches of _STRETCH positions, and aren't kept.
_LONG, _STRETCH = 64, 1 << 14
#: Characters of the texts that are walked together.
_TOGETHER = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _joints(voc) -> frozenset[str]:
    """Pairs of neighbours that some piece holds and _PART would part."""
    if not hasattr(voc, "joints"):
        found = set()
        for i in voc.plain:
            s = voc.piece[i].replace(BLANK, " ")
            ends = [m.end() for m in _PART.finditer(s)]
            found.update(s[e - 1 : e + 1] for e in ends[:-1])
        voc.joints = frozenset(found)
    return voc.joints


def parts_of(text: str, joints: frozenset[str] = frozenset()) -> list[str]:
    """The text's parts; joined they are a blank and the text."""
    parts = (_ASCII_PART if text.isascii() else _PART).findall(" " + text)
    if any(j in text for j in joints):
        out = parts[:1]
        for p in parts[1:]:
            if out[-1][-1] + p[0] in joints:
                out[-1] += p
            else:
                out.append(p)
        return out
    return parts


class Lattices:
    """Lattices of distinct parts as one table: a state for each part and position, its edges with cumulative probabilities.

    A part's numbers depend on the part alone, so draws don't depend on what else the table holds.
    """

    def __init__(self, path: str, alpha: float):
        self.voc, self.alpha = vocabulary(path), alpha
        weight = np.zeros(self.voc.size + 1)
        weight[self.voc.plain] = 1.0 / (np.arange(len(self.voc.plain)) + 50.0)
        weight /= weight.sum()
        self.weight = weight**alpha
        self.unknown = (1e-8) ** alpha
        self.clear()
        self.base, self.first = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.cum, self.piece, self.next, self.logq = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int8), np.empty(0)

    def clear(self) -> None:
        """Forgets all parts; the arrays stay for the next ones."""
        self.known: dict[str, int] = {}
        self.states = self.edges = 0
        self.met = np.empty(0, np.int64)

    def count(self, unit: np.ndarray) -> None:
        """Counts how often parts were met."""
        times = np.bincount(unit, minlength=len(self.known))
        times[: len(self.met)] += self.met
        self.met = times

    def shed(self) -> None:
        """Lets parts go that were met once, and more of them while these fill over half of the table; long ones always go."""
        names, n = list(self.known), len(self.known)
        start = self.base[:n]
        stop = np.append(start[1:], self.states)
        edges = self.first[stop] - self.first[start]
        keep = (self.met > 1) & (stop - start <= _LONG)
        order = np.argsort(-self.met[keep], kind="stable")
        fits = (np.cumsum(edges[keep][order]) <= _TABLE_EDGES // 2) & (np.arange(len(order)) < _TABLE_PARTS // 2)
        stays = np.sort(np.flatnonzero(keep)[order[fits]])
        sizes, held = (stop - start)[stays], edges[stays]
        places = lambda at, size: np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        of_states, of_edges = places(start[stays], sizes), places(self.first[start[stays]], held)
        widths = self.first[of_states + 1] - self.first[of_states]
        self.known = {names[k]: i for i, k in enumerate(stays.tolist())}
        self.met = np.minimum(self.met[stays] >> 1, 1 << 20)  # what was met long ago counts less
        self.states, self.edges = len(of_states), len(of_edges)
        self.base[: len(stays)] = np.cumsum(sizes) - sizes
        self.first[1 : self.states + 1] = np.cumsum(widths)
        for name in ("cum", "piece", "next", "logq"):
            own = getattr(self, name)
            own[: self.edges] = own[of_edges]

    def _append(self, name: str, start: int, values: np.ndarray) -> None:
        """Writes values from a place on; the array grows by a quarter when it is full."""
        own = getattr(self, name)
        if start + len(values) > len(own):
            larger = np.empty(max(start + len(values), len(own) + len(own) // 4), own.dtype)
            larger[:start] = own[:start]
            setattr(self, name, own := larger)
        own[start : start + len(values)] = values

    @property
    def full(self) -> bool:
        return self.edges > _TABLE_EDGES or len(self.known) > _TABLE_PARTS

    def add(self, parts: Sequence[str]) -> None:
        """Enters new parts."""
        groups: dict[int, list[str]] = {}
        for p in parts:
            groups.setdefault(len(p), []).append(p)
        for n, group in groups.items():
            width = min(n, self.voc.longest)
            most = 1 if n > _LONG else max(20, 400_000 // (n * width))
            for i in range(0, len(group), most):
                block = group[i : i + most]
                numbers = self._long(block[0], width) if n > _LONG else self._block(block, n, width)
                state = numbers[0]
                last = self.edges + np.cumsum(np.bincount(state, minlength=n * len(block)))
                self._append("base", len(self.known), self.states + n * np.arange(len(block)))
                self._append("first", self.states + 1, last)
                for name, x in zip(("cum", "piece", "next", "logq"), numbers[1:], strict=True):
                    self._append(name, self.edges, x)
                self.known.update(zip(block, range(len(self.known), len(self.known) + len(block)), strict=True))
                self.states += n * len(block)
                self.edges += len(state)

    @staticmethod
    def _codes(parts: Sequence[str], n: int) -> np.ndarray:
        """Code points, with blanks as the vocabulary writes them."""
        codes = code_points(parts, n)
        codes[codes == 32] = ord(BLANK)
        return codes

    def _weigh(self, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Weights of the pieces; where no piece covers a single character, its code stands for one, and weighs little."""
        weight = self.weight[ids]  # -1 reads the last weight, which is 0
        single = ids[..., -1] < 0
        ids[..., -1][single] = self.voc.size + codes[single].astype(np.int64)
        weight[..., -1][single] = self.unknown
        return weight

    def _edges(self, weight: np.ndarray, ids: np.ndarray, width: int, n: int, first: int = 0):
        """state, cum, piece, next, logq of the edges. weight: for each state and step (longest first) the mass of the segmentations by it, in any unit of the state's own."""
        share = weight / weight.sum(1, keepdims=True)
        held = np.flatnonzero(weight.ravel() > 0)
        state = np.repeat(np.arange(len(weight)), np.count_nonzero(weight > 0, 1))
        back = held - state * width
        q, cum = share.ravel()[held], np.cumsum(share, 1).ravel()[held]
        cum[np.flatnonzero(np.append(state[1:] != state[:-1], True))] = 1.0
        logq = np.log(q)
        # near 1 the logarithm comes from the other edges' share
        near = np.flatnonzero(q > 0.9999)
        others = share[state[near]]
        others[np.arange(len(near)), back[near]] = 0.0
        logq[near] = np.log1p(-others.sum(1))
        step = width - back
        step[(first + state) % n + step == n] = 0  # how far the next state is; 0: the part ends
        return state, cum, ids.ravel()[held], step.astype(np.int8), logq

    def _block(self, block: list[str], n: int, width: int):
        m = len(block)
        codes = self._codes(block, n)
        # places for pieces from each position, longest first: the likeliest edge mostly is the first that a walk looks at
        ids = np.full((m, n, width), -1, np.int32)
        for first, end, found in self.voc.edges(codes, n):
            starts = np.arange(first, end)
            ids[:, starts, width - (end - starts)] = found
        if n == 1:
            ids[[k for k, p in enumerate(block) if p == BLANK]] = -1
        weight = self._weigh(ids, codes)
        beta = np.zeros((m, n + width))
        beta[:, n] = 1.0
        for start in range(n - 1, -1, -1):
            weight[:, start, :] *= beta[:, start + width : start : -1]
            beta[:, start] = weight[:, start, :].sum(1)
            if n > 24 and start % 8 == 0:  # only ratios count: sums stay in range
                beta[:, start : start + width] /= beta[:, start : start + width].max(1, keepdims=True)
        return self._edges(weight.reshape(m * n, width), ids.reshape(m * n, width), width, n)

    def _long(self, part: str, width: int):
        """As _block, for one long part; stretches from its end on."""
        n = len(part)
        codes = self._codes([part], n)
        sums = self.voc.prefixes(codes)[0]
        power = [np.uint64(x) for x in self.voc.powers(width)]
        made, tail = [], np.zeros(width)
        tail[0] = 1.0  # the sums of the positions after the stretch
        for a in range((n - 1) // _STRETCH * _STRETCH, -1, -_STRETCH):
            b = min(a + _STRETCH, n)
            ids = np.full((b - a, width), -1, np.int32)
            for size in range(1, width + 1):
                stop = min(b, n - size + 1)
                if stop > a:
                    ids[: stop - a, width - size] = self.voc.lookup(sums[a + size : stop + size] - sums[a:stop] * power[size])
            weight = self._weigh(ids, codes[0, a:b])
            beta = np.concatenate([np.zeros(b - a), tail])
            for k in range(b - a - 1, -1, -1):
                row = weight[k]
                row *= beta[k + width : k : -1]
                beta[k] = total = row.sum()
                if total < 1e-100:
                    beta[k : k + width] /= total
            tail = beta[:width].copy()
            state, *rest = self._edges(weight, ids, width, n, a)
            made.append((state + a, *rest))
        return [np.concatenate(x) for x in zip(*reversed(made), strict=True)]


_tables: dict[tuple[str, float], Lattices] = {}


def _uniform(key: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) by hashes of the key and counters."""
    h = key.astype(np.uint64)
    for x in more:
        h = mix((h ^ np.asarray(x).astype(np.uint64)) * _ODD + np.uint64(0x632BE59BD9B4E019))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _walk(t: Lattices, part: np.ndarray, state: np.ndarray, key: np.ndarray, sample: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks from each state to its part's end: (part number, step number, edge). Steps count from begin."""
    out: tuple[list, list, list] = ([], [], [])
    count = begin.copy()
    while len(part):
        h = (key ^ (count + (sample << 32)).astype(np.uint64) * _ODD) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        x = (h >> np.uint64(11)) * 2.0**-53  # below 1, where the last edge's cumulative probability stands
        edge = t.first[state]
        late = np.flatnonzero(t.cum[edge] <= x)
        while len(late):
            edge[late] += 1
            late = late[t.cum[edge[late]] <= x[late]]
        for to, v in zip(out, (part, count, edge), strict=True):
            to.append(v)
        step = t.next[edge]
        go = step > 0
        part, key, state, count = part[go], key[go], state[go] + step[go], count[go] + 1
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def _ordered(n_parts: int, part: np.ndarray, number: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in the order of parts and steps, and the bounds of each part."""
    bounds = np.zeros(n_parts + 1, np.int64)
    np.cumsum(np.bincount(part, minlength=n_parts), out=bounds[1:])
    out = np.empty(len(edge), np.int64)
    out[bounds[part] + number] = edge
    return out, bounds


#: Below this share, masses are summed step by step: differences of logarithms would lose them.
_SMALL = 1e-3


def _under(bound: float, log_mass: float, u: float) -> float:
    """The largest perturbed value of a set of segmentations of this mass, given that it lies below the bound."""
    g = log_mass - math.log(-math.log(u))
    return -(max(-bound, -g) + math.log1p(math.exp(-abs(bound - g))))


class _Search:
    """The queue of one text. A node is a part of the segmentations not yet taken, with the largest perturbed value in it.

    Two kinds: the siblings at one step of a path without the edges already taken there, and all siblings along the rest of a
    path, from one step on, without the steps already opened. The latter's mass telescopes, so opening one costs a binary search.
    """

    def __init__(self, table: Lattices, seed: int):
        self.t, self.seed, self.drawn, self.nodes = table, seed, 0, []

    def draw(self) -> float:
        """The next number in (0, 1) of the text's own sequence."""
        self.drawn += 1
        x = self.seed + self.drawn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        return (((x ^ x >> 31) >> 11) + 0.5) / (1 << 53)

    def rest(self, bound: float, path: np.ndarray, falls: np.ndarray, begin: int, opened: tuple[int, ...]) -> None:
        """falls: log masses of the path's prefixes, one more than steps."""
        mass = self._left(path, falls, begin, opened)
        if mass > 0:
            self.nodes.append((_under(bound, float(falls[begin]) + math.log(mass), self.draw()), path, falls, begin, opened, None))

    def _left(self, path: np.ndarray, falls: np.ndarray, begin: int, opened: tuple[int, ...]) -> float:
        """The mass of all siblings from a step on, without the opened steps, as a share of the prefix: by the difference where it is large, else step by step."""
        mass = -math.expm1(falls[-1] - falls[begin]) - sum(self._own(path, falls, begin, s) for s in opened)
        return mass if mass > _SMALL else float(self._each(path, falls, begin, opened).sum())

    def _each(self, path: np.ndarray, falls: np.ndarray, begin: int, opened: tuple[int, ...]) -> np.ndarray:
        """The mass of the siblings at each step."""
        own = np.exp(falls[begin:-1] - falls[begin]) * -np.expm1(self.t.logq[path[begin:]])
        own[[s - begin for s in opened]] = 0.0
        return own

    def _own(self, path: np.ndarray, falls: np.ndarray, begin: int, step: int) -> float:
        return math.exp(falls[step] - falls[begin]) * -math.expm1(float(self.t.logq[path[step]]))

    def siblings(self, bound: float, path: np.ndarray, falls: np.ndarray, step: int, taken: tuple[int, ...]) -> None:
        edges = self._edges(int(path[step]), taken)
        left = sum(self._shares(edges))
        if left > 0:
            self.nodes.append((_under(bound, float(falls[step]) + math.log(left), self.draw()), path, falls, step, taken, edges))

    def _edges(self, edge: int, taken: tuple[int, ...]) -> list[int]:
        """The edges beside this one, without those taken."""
        state = int(np.searchsorted(self.t.first[: self.t.states + 1], edge, "right")) - 1
        return [e for e in range(int(self.t.first[state]), int(self.t.first[state + 1])) if e not in taken]

    def _shares(self, edges: list[int]) -> list[float]:
        return [math.exp(x) for x in self.t.logq[edges].tolist()]

    def take(self) -> tuple[float, np.ndarray, np.ndarray, int, int] | None:
        """Opens the best node: its value, the path and its falls, the step and the edge where the new segmentation leaves it."""
        if not self.nodes:
            return None
        node = max(self.nodes, key=lambda x: x[0])
        self.nodes = [x for x in self.nodes if x is not node]
        value, path, falls, step, taken, edges = node
        if edges is None:
            begin, opened = step, taken
            step = self._drawn_step(path, falls, begin, opened)
            self.rest(value, path, falls, begin, (*opened, step))
            taken = (int(path[step]),)
            edges = self._edges(taken[0], taken)
        q = self._shares(edges)
        r, chosen = self.draw() * sum(q), edges[-1]
        for e, p in zip(edges, q, strict=True):
            r -= p
            if r < 0:
                chosen = e
                break
        if len(edges) > 1:
            self.siblings(value, path, falls, step, (*taken, chosen))
        return value, path, falls, step, chosen

    def _drawn_step(self, path: np.ndarray, falls: np.ndarray, begin: int, opened: tuple[int, ...]) -> int:
        """A step by the masses of its siblings."""
        shares = [(s, self._own(path, falls, begin, s)) for s in sorted(opened)]
        mass = -math.expm1(falls[-1] - falls[begin]) - sum(m for _, m in shares)
        if mass > _SMALL:
            r = self.draw() * mass
            for s, m in shares:
                if r >= -math.expm1(falls[s] - falls[begin]):
                    r += m
            # the last step whose prefix still has the mass that lies beyond r
            step = int(np.searchsorted(-falls, -(falls[begin] + math.log(max(1.0 - r, 1e-300))), "right")) - 1
            step = min(max(step, begin), len(path) - 1)
            if step not in opened and self.t.logq[path[step]] < 0:
                return step
        own = self._each(path, falls, begin, opened)
        up = np.cumsum(own)
        step = int(np.searchsorted(up, self.draw() * up[-1], "right"))
        return begin + (step if step < len(own) and own[step] > 0 else int(own.argmax()))

    def best(self) -> float:
        return max((x[0] for x in self.nodes), default=-math.inf)


def sample(texts: Sequence[str | None], seeds: np.ndarray, k: int, table: Lattices) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its sampled segmentations, best first: (piece ids, log probability, perturbed value); one more value, without pieces, is the threshold."""
    joints = _joints(table.voc)
    cut = [parts_of(t, joints) if t else [] for t in texts]
    coded = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if table.full:
        table.shed()
    places = list(map(table.known.get, distinct))
    if None in places:
        table.add([p for p, place in zip(distinct, places, strict=True) if place is None])
        places = list(map(table.known.__getitem__, distinct))
    seeds = seeds.astype(np.uint64)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(c) for c in cut], out=bounds[1:])
    n = int(bounds[-1])
    unit = np.array(places, np.int64)[coded.indices.to_numpy()]
    table.count(unit)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    key = mix(seeds[owner] * _ODD + (np.arange(n) - bounds[:-1][owner]).astype(np.uint64))
    base = table.base[unit]
    path, at_part = _ordered(n, *_walk(table, np.arange(n), base, key, 0, np.zeros(n, np.int64)))
    at = at_part[bounds]
    top = -np.log(-np.log(_uniform(seeds, 5)))
    live = np.flatnonzero(np.diff(bounds) > 0)
    search = {i: _Search(table, int(seeds[i])) for i in live.tolist()}
    begin = np.zeros(len(texts), np.int64)
    out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
    for s in range(k):
        pieces, steps = table.piece[path], table.logq[path]
        for i in live.tolist():
            a, b = at[i], at[i + 1]
            own = np.zeros(b - a + 1)  # summed for each text alone, so that no rounding depends on its neighbours
            np.cumsum(steps[a:b], out=own[1:])
            out[i].append((pieces[a:b], float(own[-1]), float(top[i])))
            search[i].rest(float(top[i]), path[a:b], own, int(begin[i]), ())
        if s == k - 1:
            break
        # the best node of each text becomes its next path
        kept_part, kept_number, kept_edge, go_state, go_part, go_begin, still = [], [], [], [], [], [], []
        for i in live.tolist():
            node = search[i].take()
            if node is None:
                continue
            still.append(i)
            top[i], old, _, step, chosen = node
            begin[i] = step + 1
            # where the step lies: its part and its number in the part
            ends = np.flatnonzero(table.next[old[:step]] == 0)
            done = len(ends)
            lengths = np.diff(np.concatenate([[0], ends + 1, [step + 1]]))
            kept_part.append(bounds[i] + np.repeat(np.arange(done + 1), lengths))
            kept_number.append(np.arange(step + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths))
            kept_edge.append(np.append(old[:step], chosen))
            if table.next[chosen]:
                state = int(np.searchsorted(table.first[: table.states + 1], chosen, "right")) - 1
                go_part.append(np.array([bounds[i] + done]))
                go_state.append(np.array([state + int(table.next[chosen])]))
                go_begin.append(lengths[-1:])
            later = np.arange(bounds[i] + done + 1, bounds[i + 1])
            go_part.append(later)
            go_state.append(base[later])
            go_begin.append(np.zeros(len(later), np.int64))
        live = np.array(still, np.int64)
        if not still:
            break
        join = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.empty(0, np.int64)
        go_part = join(go_part)
        walked = _walk(table, go_part, join(go_state), key[go_part], s + 1, join(go_begin))
        path, at_part = _ordered(n, *(np.concatenate([a, b]) for a, b in zip((join(kept_part), join(kept_number), join(kept_edge)), walked, strict=True)))
        at = at_part[bounds]
    empty = np.empty(0, np.int32)
    for i, own in enumerate(out):
        if not cut[i]:
            own.append((empty, 0.0, float(top[i])))
        own.append((empty, 0.0, search[i].best() if i in search else -math.inf))
    return out


def spelled(ids: np.ndarray, voc, lengths: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Ids with characters beyond the vocabulary replaced by their byte pieces; with the lengths of several sequences, their new lengths, too."""
    over = ids >= voc.size
    if not over.any():
        return ids if lengths is None else (ids, lengths)
    if not hasattr(voc, "byte_ids"):
        voc.byte_ids = np.array([voc.bytes[b] for b in range(256)], np.int32)
    code = ids[over] - voc.size
    n = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
    size = np.ones(len(ids), np.int64)
    size[over] = n
    out = np.repeat(ids, size).astype(np.int32)
    start = (np.cumsum(size) - size)[over]
    for k in range(4):
        has = n > k
        c, m = code[has], n[has]
        low = 0x80 | (c >> (6 * (m - 1 - k))) & 0x3F
        head = np.where(m == 1, c, np.where(m == 2, 0xC0 | c >> 6, np.where(m == 3, 0xE0 | c >> 12, 0xF0 | c >> 18)))
        out[start[has] + k] = voc.byte_ids[head if k == 0 else low]
    if lengths is None:
        return out
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])]
    return out, np.diff(ends)


def _bytes_of(voc) -> pa.Array:
    """The bytes of all pieces."""
    if not hasattr(voc, "spelling"):
        back = {i: bytes([b]) for b, i in voc.bytes.items()}
        voc.spelling = pa.array([back[i] if i in back else voc.piece[i].replace(BLANK, " ").encode() for i in range(voc.size)], pa.large_binary())
    return voc.spelling


def decoded(ids: np.ndarray, lengths: np.ndarray, path: str | None = None) -> pa.Array:
    """The texts of piece ids; lengths tells how many ids each text has. The blank that encoding puts before a text goes; bytes that aren't UTF-8 are replaced."""
    spelled_out = _bytes_of(vocabulary(path or default_vocabulary())).take(pa.array(ids))
    _, ends, data = spelled_out.buffers()
    ends = np.frombuffer(ends, np.int64)[spelled_out.offset :][: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    out = np.frombuffer(data, np.uint8)[: ends[-1]] if data else np.empty(0, np.uint8)
    bounds = ends[np.concatenate([[0], np.cumsum(lengths)])]
    filled = np.flatnonzero(bounds[:-1] < bounds[1:])
    filled = filled[out[bounds[filled]] == 32]
    gone = np.zeros(len(bounds), np.int64)
    gone[filled + 1] = 1
    kept = bounds - np.cumsum(gone)
    texts = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(kept), pa.py_buffer(np.delete(out, bounds[filled]))])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([b.decode("utf-8", "replace") for b in texts.cast(pa.large_binary(), safe=False).to_pylist()], pa.large_string())
    return texts


def encode(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", k: int = 2, seed: int = 17, alpha: float = 1.0, path: str | None = None, check: bool = False) -> DataFrame:
    """k rows for each row (fewer where a text has fewer segmentations): the columns in keep, rank, pieces, n_pieces, log_prob, perturbed, threshold, log_inclusion.

    With `check` the pieces are decoded again; `exact` tells whether they give the text (null: an empty one).
    """
    path = path or default_vocabulary()
    made = T.StructType(
        [T.StructField("rank", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("log_prob", "perturbed", "threshold", "log_inclusion")]
    )
    if check:
        made.add("exact", T.BooleanType())
    kept = [c for c in keep if c not in made.names]
    schema = T.StructType([*(docs.schema[c] for c in kept), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces", _tables.clear)
        table = _tables.setdefault((path, alpha), Lattices(path, alpha))
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            keys = b.column(b.schema.get_field_index(key)).to_pylist()
            seeds = mix(np.array([hash_key(x) for x in keys], np.uint64) + np.uint64(seed))
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or "") <= _TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                yield _batch(b.slice(start, end - start), sample(texts[start:end], seeds[start:end], k, table))
                start = end
            pa.default_memory_pool().release_unused()

    def _batch(b: pa.RecordBatch, found) -> pa.RecordBatch:
        voc = vocabulary(path)
        rows, rank, pieces, numbers = [], [], [], []
        for i, own in enumerate(found):
            threshold = own[-1][2]
            for r, (ids, log_prob, value) in enumerate(own[:-1], 1):
                rows.append(i)
                rank.append(r)
                pieces.append(ids)
                x = log_prob - threshold
                inclusion = 0.0 if threshold == -np.inf else x - np.exp(x) / 2 if x < -20 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))
                numbers.append((log_prob, value, threshold, inclusion))
        joined = np.concatenate(pieces) if pieces else np.empty(0, np.int32)
        joined, lengths = spelled(joined, voc, np.array([len(p) for p in pieces], np.int64))
        del pieces
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined, pa.int32()))
        take = pa.array(rows, pa.int64())
        columns = [b.column(b.schema.get_field_index(c)).take(take) for c in kept]
        values = np.array(numbers, float).reshape(-1, 4)
        own = [pa.array(rank, pa.int32()), lists, pa.array(lengths.astype(np.int32)), *(pa.array(np.ascontiguousarray(values[:, c])) for c in range(4))]
        if check:
            texts = pc.fill_null(b.column(b.schema.get_field_index(text)), "").cast(pa.large_string()).take(take)
            own.append(pc.equal(decoded(joined, lengths, path), texts))
        return pa.RecordBatch.from_arrays([*columns, *own], names=schema.names)

    return docs.select(*dict.fromkeys([*kept, key, text])).mapInArrow(run, schema)


def hash_key(key) -> int:
    """64 bits of a row's key; null counts as a key of its own."""
    if isinstance(key, int):
        return key & 0xFFFFFFFFFFFFFFFF
    import zlib

    data = repr(key).encode()
    return zlib.crc32(data) << 32 | zlib.adler32(data)


def decode(rows: DataFrame, keep: list[str], pieces: str = "pieces", path: str | None = None) -> DataFrame:
    """Appends `decoded`, the text of each row's pieces; null pieces give null."""

    def run(column: pa.Array):
        lists = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = decoded(lists.flatten().to_numpy(zero_copy_only=False), lengths, path).cast(pa.string())
        return [pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string())) if column.null_count else texts]

    return map_texts(rows, pieces, run, [T.StructField("decoded", T.StringType())], keep)
