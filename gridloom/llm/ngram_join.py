"""Similarity join of documents on word n-grams by chosen paths: Jaccard similarity of at least 0.8 on sets of five-word shingles.

A document's set holds the hashes of its five-word windows (all its words as one, if they are fewer; no words: no set and no
links). Equal sets are one class representative with a number of copies, so copies never meet each other.

Chosen paths: in each of RUNS runs a set chooses one of its tokens as the smallest under the run's hash, then the next one
under a hash that depends on the path so far, DEPTH times. Sets that chose the same path share a bucket. Two sets that share 0.8 of
their tokens choose alike with that chance at each step. Buckets of at most BUCKET sets are compared at once by brute force
over sketches; larger ones, which a count by key finds before any row moves, are split by the next token of the path. A bucket that is still larger at the last depth is dealt to units of UNIT sets. Each unit
finds leaders: sets less similar to all earlier leaders than LEADER; then every set of every unit is tied to all leaders of the bucket, block by block, that it could
share a neighbour with, so that what a small bucket would propose is tied here, too: the part of 64 held ranges that differ is a metric, and a pair
alike in LIKE of them lies within 1 - LIKE + 1 - LEADER of the leader. In both kinds of bucket a pair of similarity 0.8 is passed over where its
sketches are alike in less than LIKE (35 of 64 ranges or fewer: chance 4e-6; runs share the sketch). The runs are repeated to a
recall of 1 - (1 - 0.8**d)**RUNS for a pair that is split d times (above 1 - 1e-8 for d = 1); RUNS follows from `runs_for`.

Sketches (the smallest hash in each of 64 ranges, a byte each) only propose; with ties they form candidate components. Inside these all
pairs are compared by their exact sets, so also pairs whose own paths never met. Large components are cut into
blocks and each pair of blocks is one unit of work with bounded memory. What leaves a unit is one row for each set, with the
number of its links, not one per pair.

Null texts count as empty. A document without words, or without links, is its own class with 0 links. Rows are told apart by their texts, not by their ids: an id
may be null or stand for several texts, and rows repeated in full count as copies. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import words as W
from gridloom.llm.common import SIDE_ROWS, claim, map_texts, sided, written
from gridloom.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8


def runs_for(recall: float, splits: int) -> int:
    """So many runs find a pair at the least similarity that is split so often with at least this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - SIMILARITY**splits))


DEPTH, BUCKET = 4, 256
#: 1 - 1e-8 for a pair whose first buckets are small; 1 - 5e-6 after one more split, 0.998 after all four.
RUNS = runs_for(1 - 1e-8, 1)
#: Sets of a unit of a bucket that is too large at the last depth, and leaders of a block that meets it.
UNIT, LEADERS = 512, 2048
BINS, NONE = 64, 255
#: Sketch similarities: of a candidate pair, of a set that its leader stands for, and of one that could share a neighbour with a leader
#: (LIKE + LEADER - 1: no pair that a small bucket would propose is parted).
LIKE, LEADER, NEAR = 0.55, 0.85, 0.4
#: Sets and tokens of a block of a large component.
BLOCK_SETS, BLOCK_TOKENS = 1024, 2_000_000
#: Keys of large buckets and places of candidates are broadcast up to this number (one column of eight bytes each).
BROADCAST_ROWS = 500_000
SALTS = 32
_SEEDS = W.mix(np.arange(1, RUNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0xD6E8FEB86659FD93)
_RANGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in W.pieces(offsets):
        bounds = offsets[i : j + 1]
        part = data[bounds[0] : bounds[-1]]
        start, end, at = W.find_words(part, bounds - bounds[0])
        word = W.spans(W.prefix_sums(part), start, end)
        for k in range(j - i):
            own = word[at[k] : at[k + 1]]
            yield np.unique(W.windows(own, min(SHINGLE, len(own)))) if len(own) else own


def _sketch(s: np.ndarray) -> bytes:
    at = np.searchsorted(s, _RANGES)
    value = s[np.minimum(at, len(s) - 1)]
    held = (at < len(s)) & ((value >> np.uint64(58)) == np.arange(BINS, dtype=np.uint64))
    return np.where(held, W.mix(value) % np.uint64(NONE), NONE).astype(np.uint8).tobytes()


def _paths(s: np.ndarray) -> bytes:
    """RUNS x DEPTH path keys of eight bytes."""
    keys = np.empty((RUNS, DEPTH), np.uint64)
    key = _SEEDS.copy()
    taken = np.empty((RUNS, 0), np.int64)
    rows = np.arange(RUNS)
    for d in range(DEPTH):
        if d < len(s):
            order = (s[None, :] ^ key[:, None]) * _ODD
            if d:
                order[rows[:, None], taken] = np.uint64(0xFFFFFFFFFFFFFFFF)
            chosen = order.argmin(1)
            taken = np.concatenate([taken, chosen[:, None]], 1)
            key = W.mix(key * _ODD + s[chosen])
        keys[:, d] = key
    return keys.tobytes()


def _hashes(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a whole set."""
    return W.mix(s).sum(dtype=np.uint64), W.mix(s ^ _ODD).sum(dtype=np.uint64)


def signatures(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep, n (size of the set), two hashes of the whole set, sketch and path keys; n is 0 where there are no words."""
    fields = [T.StructField("n", T.IntegerType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("paths", T.BinaryType())]

    def run(column: pa.Array):
        claim("shingles", lambda: None)
        n, a, b, sketch, paths = [], [], [], [], []
        for s in shingle_sets(*W.buffers(column)):
            n.append(len(s))
            own = _hashes(s)
            a.append(own[0])
            b.append(own[1])
            sketch.append(_sketch(s) if len(s) else None)
            paths.append(_paths(s) if len(s) else None)
        to_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.array(n, pa.int32()), to_long(a), to_long(b), pa.array(sketch, pa.binary()), pa.array(paths, pa.binary())

    return map_texts(docs, text, run, fields, list(keep))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of sketches: equal ranges over the ranges that either holds."""
    both = ((a != NONE) | (b != NONE)).sum(-1)
    return ((a == b) & (a != NONE)).sum(-1) / np.maximum(both, 1)


def _smallest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest index in its component."""
    n = len(linked)
    label = np.arange(n, dtype=np.int32)
    while True:
        low = label.copy()
        for r in range(0, n, 256):
            low[r : r + 256] = np.minimum(label[r : r + 256], np.where(linked[r : r + 256], label, np.int32(n)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _within(reps: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties (set, smallest set of its candidate component) in a small bucket."""
    alike = np.stack([_alike(sketches[i][None, :], sketches) >= LIKE for i in range(len(reps))])
    root = _smallest(alike)
    own = np.flatnonzero(root != np.arange(len(reps)))
    return reps[own], reps[root[own]]


_TIES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of one key after another, from batches sorted by the named columns; groups are small."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(n).to_pylist() for n in names]
        keys = list(zip(*columns, strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if keys[lo] != last:
                if held:
                    yield pa.Table.from_batches(held)
                held, last = [], keys[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _sketches(part: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)


def _ties(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], schema=_TIES)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties inside small buckets. Rows come sorted by key."""
    for part in _groups(batches, ["key"]):
        if part.num_rows > 1:
            a, b = _within(part.column("rep").to_numpy(), _sketches(part))
            if len(a):
                yield _ties(a, b)


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaders of each unit. Rows come sorted by key and unit."""
    for part in _groups(batches, ["key", "unit"]):
        sketches, led = _sketches(part), np.zeros(part.num_rows, bool)
        chosen = []
        for k in range(part.num_rows):
            if not led[k]:
                chosen.append(k)
                led[k:] |= _alike(sketches[k][None, :], sketches[k:]) >= LEADER
        yield pa.RecordBatch.from_arrays([part.column(n).take(pa.array(chosen)).combine_chunks() for n in ("key", "rep", "sketch")], names=["key", "rep", "sketch"])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties the sets of a unit to the leaders of a block that could share a neighbour with them. Rows come sorted by key, unit, block, leaders first."""
    for part in _groups(batches, ["key", "unit", "block"]):
        lead = part.column("leader").to_numpy(zero_copy_only=False).astype(bool)
        reps, sketches = part.column("rep").to_numpy(), _sketches(part)
        leaders, marks = reps[lead], sketches[lead]
        if not len(leaders) or lead.all():
            continue
        root = np.arange(len(leaders))  # leaders that one set ties are one component

        def find(k: int, root: np.ndarray = root) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return int(k)

        a, b = [], []
        for rep, sketch in zip(reps[~lead].tolist(), sketches[~lead], strict=True):
            roots = sorted({find(k) for k in np.flatnonzero(_alike(sketch[None, :], marks) >= NEAR).tolist()})
            for k in roots[1:]:
                root[k] = roots[0]
                a.append(leaders[k])
                b.append(leaders[roots[0]])
            if roots and leaders[roots[0]] != rep:
                a.append(rep)
                b.append(leaders[roots[0]])
        if a:
            yield _ties(a, b)


def _with_counts(rows: DataFrame, counts: DataFrame, few: bool, how: str) -> DataFrame:
    """Joins figures of large buckets to their rows: by broadcast where these buckets are few, else over salted keys, so that no bucket is one task."""
    if few:
        return rows.join(F.broadcast(counts), "key", how)
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS))).join(salted.hint("merge"), ["key", "salt"], how).drop("salt")


def _large_ties(rows: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """Ties in the buckets that are still large at the last depth."""
    units = F.ceil(F.col("n") / UNIT).cast("int")
    dealt = written(_with_counts(rows, counts.select("key", units.alias("units")), few, "inner").withColumn("unit", F.pmod(F.xxhash64("rep"), F.col("units")).cast("int")))
    leaders = written(dealt.repartition("key", "unit").sortWithinPartitions("key", "unit", "rep").select("key", "unit", "rep", "sketch").mapInArrow(_lead, "key binary, rep long, sketch binary"))
    figures = leaders.groupBy("key").agg(F.count("*").alias("leaders")).join(counts, "key").select("key", units.alias("units"), F.ceil(F.col("leaders") / LEADERS).cast("int").alias("blocks"))
    figures = written(figures)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    marks = _with_counts(leaders, figures, few, "inner").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("unit", each("units"))
    sets = _with_counts(dealt.select("key", "unit", "rep", "sketch"), figures.select("key", "blocks"), few, "inner").withColumn("block", each("blocks"))
    names = ["key", "unit", "block", "rep", "sketch"]
    both = marks.select(*names, F.lit(True).alias("leader")).unionByName(sets.select(*names, F.lit(False).alias("leader")))
    met = both.repartition("key", "unit", "block").sortWithinPartitions("key", "unit", "block", F.desc("leader"), "rep")
    return met.mapInArrow(_tied, "a long, b long")


def candidate_ties(sets: DataFrame) -> DataFrame:
    """Ties (a, b) between representatives; their components hold every pair above the threshold."""
    found = []
    size = 8 * DEPTH
    rows = sets.select("rep", "sketch", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"), "paths").select("rep", "sketch", F.expr(f"substring(paths, run * {size} + 1, {size})").alias("path"))
    for d in range(DEPTH):
        keyed = rows.select(F.expr(f"substring(path, {8 * d + 1}, 8)").alias("key"), "rep", "sketch", "path")
        # a few rows, if any; kept in storage, from which a lost part is computed again
        counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).persist()
        large = counts.count()
        few = large <= BROADCAST_ROWS
        small = _with_counts(keyed, counts.select("key"), few, "left_anti") if large else keyed
        found.append(small.select("key", "rep", "sketch").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_small, "a long, b long"))
        if not large:
            break
        if d == DEPTH - 1:
            found.append(_large_ties(keyed.select("key", "rep", "sketch"), counts, few))
        else:
            rows = written(_with_counts(keyed, counts.select("key"), few, "left_semi").select("rep", "sketch", "path"))
    ties = found[0]
    for more in found[1:]:
        ties = ties.union(more)
    return ties


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the sets' intersections: frequent tokens by matrix products, rare ones pair by pair."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    times = np.diff(np.append(first, len(token)))
    common = np.zeros((n, n), np.float32)
    rare = max(3, n // 64)
    dense = np.flatnonzero(times > rare)
    width = max(64, (4 << 20) // n)
    for i in range(0, len(dense), width):
        columns = dense[i : i + width]
        x = np.zeros((n, len(columns)), np.float32)
        lengths = times[columns]
        at = np.repeat(first[columns] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        x[owner[at], np.repeat(np.arange(len(columns)), lengths)] = 1.0
        common += x @ x.T
    for f in range(2, rare + 1):
        members = owner[first[times == f][:, None] + np.arange(f)[None, :]] if (times == f).any() else None
        if members is None:
            continue
        for i in range(f):
            for j in range(f):
                if i != j:
                    np.add.at(common, (members[:, i], members[:, j]), 1.0)
    return common


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the exact links of each set in a unit (one component, or two blocks of one). Rows come sorted by unit."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("parts", pa.int32())])
    unit, rows = None, {}

    def closed() -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        reps = sorted(rows)
        copies = np.array([rows[r][0] for r in reps], np.int64)
        block = np.array([rows[r][1] for r in reps])
        sets = [np.frombuffer(rows[r][2], np.uint64) for r in reps]
        size = np.array([len(s) for s in sets], np.float32)
        common = _common(sets)
        linked = np.empty(common.shape, bool)
        for r in range(0, len(sets), 256):
            linked[r : r + 256] = 9.0 * common[r : r + 256] >= 4.0 * (size[r : r + 256, None] + size)
        del common
        np.fill_diagonal(linked, False)
        if unit[1] != unit[2]:
            linked &= block[:, None] != block[None, :]
        links = np.concatenate([linked[r : r + 256] @ copies for r in range(0, len(sets), 256)])
        reps = np.array(reps, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(links), pa.array(reps[_smallest(linked)]), pa.array(np.full(len(reps), unit[3], np.int32))], schema=schema)

    for batch in batches:
        d = batch.to_pydict()
        for comp, i, j, parts, rep, copies, block, tokens in zip(d["comp"], d["i"], d["j"], d["parts"], d["rep"], d["copies"], d["block"], d["tokens"], strict=True):
            if (comp, i, j) != (unit and unit[:3]):
                if unit and (out := closed()):
                    yield out
                unit, rows = (comp, i, j, parts), {}
            rows[rep] = (copies, block, tokens)
    if unit and (out := closed()):
        yield out


def _place(text: str = "text"):
    """A hash by which a set's text is found again among the documents; the set itself tells whether it is the one."""
    return F.xxhash64("doc_id", text)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each set's text, once for each set and task. Rows whose text only shares its hash go."""
    claim("shingles", lambda: None)
    seen: set[int] = set()
    for b in batches:
        d = {c: b.column(c).to_pylist() for c in ("rep", "set_a", "set_b")}
        held, tokens = [], []
        for k, s in enumerate(shingle_sets(*W.buffers(b.column("text")))):
            own = tuple(int(x.view(np.int64)) for x in _hashes(s))
            if own == (d["set_a"][k], d["set_b"][k]) and d["rep"][k] not in seen:
                seen.add(d["rep"][k])
                held.append(k)
                tokens.append(s.tobytes())
        take = pa.array(held, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("rep", "comp", "copies", "parts")), pa.array(tokens, pa.binary())], names=["rep", "comp", "copies", "parts", "tokens"])


def exact_links(docs: DataFrame, sets: DataFrame, components: DataFrame) -> DataFrame:
    """(rep, links, root, parts) of each set in each unit of its candidate component."""
    few = components.count() <= SIDE_ROWS
    members = sets.select("rep", "place", "n", "set_a", "set_b", "copies").join(sided(components.select(F.col("node").alias("rep"), F.col("label").alias("comp")), few), "rep")
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    members = written(members.join(sided(sizes.select("comp", parts.alias("parts")), few), "comp").select("place", "rep", "set_a", "set_b", "comp", "copies", "parts"))
    chosen = docs.select("text", _place().alias("place"))
    if not few and members.count() <= BROADCAST_ROWS:  # the places alone go to all executors, then only the candidates' texts move
        chosen = chosen.join(F.broadcast(members.select("place")), "place", "left_semi")
    chosen = chosen.join(sided(members, few), "place")
    held = chosen.select("text", "rep", "set_a", "set_b", "comp", "copies", "parts").mapInArrow(_tokens, "rep long, comp long, copies long, parts int, tokens binary")
    block = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    units = (
        held.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "parts", "rep", "copies", "block", "tokens")
    )
    return units.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_exact, "rep long, links long, root long, parts int")


def join(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns in keep, class_id (smallest doc_id of the class of linked documents), n_links (documents at similarity 0.8 or more), class_key (a number of the class, of this run alone) for each row.

    docs has doc_id (an integer) and text. A class whose ids are all null has a null class_id; class_key is null where there is no link.
    """
    docs = docs.select("doc_id", "text", *keep)
    marked = written(signatures(docs.withColumn("place", _place()), ["doc_id", *keep, "place"]))
    key = ["n", "set_a", "set_b"]
    first = F.min(F.struct("place", "sketch", "paths"))
    found = marked.where("n > 0").groupBy(*key).agg(first.alias("f"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    # the numbers hold from here on, since the table is written
    sets = written(found.select(F.monotonically_increasing_id().alias("rep"), *key, "first_id", "copies", "f.place", "f.sketch", "f.paths"))
    components = connected_components(candidate_ties(sets.select("rep", "sketch", "paths")))
    found = written(exact_links(docs, sets, components))
    whole = found.where("parts = 1").select("rep", "links", F.col("root").alias("class_key"))
    cut = found.where("parts > 1")
    if not cut.isEmpty():
        counts = cut.groupBy("rep").agg(F.sum("links").alias("links"))
        roots = connected_components(cut.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
        joined = counts.join(roots.hint("merge"), counts.rep == roots.node, "left").select("rep", "links", F.coalesce("label", "rep").alias("class_key"))
        whole = whole.union(joined)
    few = found.count() <= SIDE_ROWS
    linked = written(
        sets.select(*key, "rep", "first_id", "copies")
        .join(sided(whole, few), "rep", "left")
        .select(*key, "first_id", F.coalesce("class_key", "rep").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .where("n_links > 0")
    )
    firsts = linked.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    classes = linked.drop("first_id").join(sided(firsts, linked.count() <= SIDE_ROWS), "class_key")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = marked.select("doc_id", *keep, *key).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    out = salted.join(classes.hint("merge"), [*key, "salt"], "left")  # SALTS rows a class: never a broadcast
    class_id = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", *keep, class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key")
