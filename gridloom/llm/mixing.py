"""Mixing sources to target weights by pivotal dependent rounding. DataFrame and SQL functions only.

A document of a source with target t and size s is wanted t / s times: its whole part is certain, its fraction is a copy
probability. Fractions are rounded dependently: two of them meet, and words move at random from one to the other until one's probability is 0 or 1, so that
every document keeps its probability while the words of the two together stay what they were. Documents of one source and similar size meet first, the longest first, inside
groups of at most about FAN rows; each group leaves at most one fraction, and these meet again in a reduction
tree whose groups come from the documents' hashes: level k has (rows / FAN**k) hash buckets, so that no group grows with
a source's size, and log(rows) / log(FAN) levels bring one fraction per source and size class, then one per source, which
a last draw rounds. A source's words therefore miss its target by less than the size of that one document. All draws are hashes of the document and its place, so reruns and other partitionings agree.

Sizes are words (runs of anything but ASCII blanks; null text: 0). Sources stand in code point order, null last; an empty table gives
an empty result; documents of size 0 take 0 words, and their copies are drawn each for itself. Equal rows are rounded as one with as many copies, then told apart by their number:
neither repeated rows nor null or repeated ids make a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_PATTERN, checkpointed

FAN = 128
#: A source's rows are spread over so many keys where per-source figures join.
SALTS = 256
#: Per-source figures are broadcast up to so many sources.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the water level at which capped and weighted targets use up the total.

    One row per source goes through one ordered window; sources are counted in thousands, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("n", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # sources reach their caps in the order of cap / weight; the level is the largest that the rest of the total supports
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", F.greatest(level, F.lit(0.0))).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.max(F.when(F.col("free"), F.col("level"))).over(everything)
    return leveled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap"))).alias("target"))


def with_source_figures(docs: DataFrame, figures: DataFrame, key: Column) -> DataFrame:
    """Joins one row per source to the documents: by broadcast where the sources are few, else over salted keys."""
    named = lambda df: df.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit(""))).drop("source")
    if figures.count() <= BROADCAST_SOURCES:
        return docs.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit(""))).join(F.broadcast(named(figures)), ["_null", "_name"]).drop("_null", "_name")
    left = docs.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit(""))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    right = named(figures).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, ["_null", "_name", "_salt"]).drop("_null", "_name", "_salt")


def _fold(seed: int, level: int, who: str) -> str:
    """Folds an ordered array `m` of (size, key, p, who): what is decided, and the one fraction that is left (p null: none).

    The running fraction may rise and the next one fall by the same `up` words, or the other way round by `down` words, as far as one of them gets integral;
    the chances, down to up, keep both expectations. who: the type of the column `who`.
    """
    r, u = "acc.rest", "(pmod(xxhash64(x.key, acc.rest.key, {seed}, {level}), 1099511627776L) / 1099511627776D)".format(seed=seed, level=level)
    keep = lambda one, p: f"named_struct('size', {one}.size, 'key', {one}.key, 'p', {p}, 'who', {one}.who)"
    done = lambda one, taken: f"concat(acc.done, array(named_struct('size', {one}.size, 'who', {one}.who, 'taken', {taken})))"
    nothing = f"named_struct('size', CAST(NULL AS BIGINT), 'key', CAST(NULL AS BIGINT), 'p', CAST(NULL AS DOUBLE), 'who', CAST(NULL AS {who}))"
    state = lambda d, rest: f"named_struct('done', {d}, 'rest', {rest})"
    rise, fall = f"(1D - {r}.p) * {r}.size", f"{r}.p * {r}.size"
    return f"""
        aggregate(m, {state(f"CAST(array() AS array<struct<size: bigint, who: {who}, taken: int>>)", nothing)}, (acc, x) -> CASE
            WHEN x.p <= 1e-12 THEN {state(done("x", "0"), r)}
            WHEN x.p >= 1D - 1e-12 THEN {state(done("x", "1"), r)}
            WHEN {r}.p IS NULL THEN {state("acc.done", keep("x", "x.p"))}
            ELSE element_at(transform(array(named_struct('up', least({rise}, x.p * x.size), 'down', least({fall}, (1D - x.p) * x.size))), w -> CASE
                WHEN {u} * (w.up + w.down) < w.down THEN CASE
                    WHEN {rise} <= x.p * x.size THEN {state(done(r, "1"), keep("x", "x.p - w.up / x.size"))}
                    ELSE {state(done("x", "0"), keep(r, f"{r}.p + w.up / {r}.size"))} END
                WHEN {fall} <= (1D - x.p) * x.size THEN {state(done(r, "0"), keep("x", "x.p + w.down / x.size"))}
                ELSE {state(done("x", "1"), keep(r, f"{r}.p - w.down / {r}.size"))} END), 1) END)
    """


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, most: float = 3.0, seed: int = 11, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, the columns in keep, size, source_size, target, copies and taken (= copies * size) for every document.

    docs has doc_id, text and source. Weights repeat over the sources in order; a target stops at `most` times its source.
    """
    own = ["doc_id", *keep]
    measured = docs.select(*own, "source", words(F.col(text)).alias("size"), F.xxhash64("doc_id", "source", text).alias("key"))
    sized = checkpointed(measured.groupBy(*own, "source", "size", "key").agg(F.count("*").alias("n")))
    figures = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    figures = checkpointed(figures)
    total = figures.agg(F.sum("rows")).first()[0] or 0
    goals = checkpointed(targets(figures.select("source", "source_size"), weights, share, most))
    joined = with_source_figures(sized, goals, F.col("key"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a hair below a whole number is that number; equal rows share one fraction, beyond the whole copies that they get together
    whole = F.floor(wanted + 1e-12)
    base = joined.withColumn("whole", whole.cast("int")).withColumn("together", F.greatest(wanted - whole, F.lit(0.0)) * F.col("n"))
    base = base.withColumn("more", F.floor(F.col("together") + 1e-12)).withColumn("p", F.greatest(F.col("together") - F.col("more"), F.lit(0.0)))
    fixed = ["source", "source_size", "target", "whole"]
    size_class = F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")
    rest = base.select(*fixed, size_class.alias("class"), "size", "key", "p", F.struct(*own, "n", "more").alias("who"))
    who = rest.schema["who"].dataType.simpleString()
    deepest = next(k for k in range(64) if FAN ** (k + 1) >= total)
    drawn = F.pmod(F.xxhash64(F.col("key"), F.lit(seed), F.lit(-1)), F.lit(1 << 40)) / float(1 << 40)
    draw = lambda df: df.select(*fixed, "size", "who", (drawn < F.col("p")).cast("int").alias("taken"))
    parts = [draw(rest.where("size = 0"))]
    rest = rest.where("size > 0")
    hashed = F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(1 << 62))
    # the buckets of a level are unions of FAN buckets of the level before; the last level joins a source's size classes
    for level, modulus in enumerate([*(FAN**k for k in range(deepest, -1, -1)), None]):
        keys = [*fixed, "class", "bucket"] if modulus else fixed
        groups = rest.withColumn("bucket", hashed % (modulus or 1)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("size", "key", "p", "who")), asc=False).alias("m"))
        size_class = F.col("class") if modulus else F.lit(0).alias("class")
        folded = checkpointed(groups.select(*fixed, size_class, F.expr(_fold(seed, level, who)).alias("f")))
        parts.append(folded.select(*fixed, F.explode("f.done").alias("d")).select(*fixed, "d.size", "d.who", "d.taken"))
        rest = folded.where(F.col("f.rest.p").isNotNull()).select(*fixed, "class", "f.rest.size", "f.rest.key", "f.rest.p", "f.rest.who")
    out = draw(rest)
    for part in parts:
        out = out.unionByName(part)
    # equal rows in a row of their own each: the first ones get the copies beyond the whole ones
    each = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("who.n"))))
    copies = (F.col("whole") + (F.col("_k") <= F.col("who.more") + F.col("taken")).cast("int")).cast("int")
    return each.select(*(F.col(f"who.{c}").alias(c) for c in own), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
