"""Texts with equal word sets as one class, and similarity of classes checked on the words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflode.functions.words import jaccard, word_set
from difflode.plans.lineage import stored

GOLD = np.uint64(0x9E3779B97F4A7C15)


def salt(k: int) -> np.uint64:
    """The k-th multiple of an odd constant, in 64 bits."""
    return np.uint64((k * int(GOLD)) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_classes(docs: DataFrame, group: str, text: str, min_words: int = 1) -> DataFrame:
    """``docs`` with ``words`` and ``cls``, a 64-bit name of group and word set; texts of fewer words are left out.

    The word sets cost more than all later steps, so they are made once and stored.
    """
    w = docs.withColumn("words", word_set(F.col(text))).drop(text).withColumn("cls", F.xxhash64(group, "words"))
    # the condition follows the table: before it, the optimiser would make the word sets twice; a name that
    # cannot be null keeps all readers of the class table on one shuffle, as no condition on it is pushed below
    return stored(w).withColumn("cls", F.coalesce("cls", F.lit(0))).where(F.size("words") >= max(1, min_words))


def class_table(docs: DataFrame, group: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """One row for each class: ``cls, words, grp`` (a hash of its group) and the maximum of each flag; copies fold before the shuffle."""
    return docs.groupBy("cls").agg(F.first("words").alias("words"), F.max(F.xxhash64(group)).alias("grp"), *[F.max(f).alias(f) for f in flags])


def bucketed(classes: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], keep: tuple[str, ...] = (), block: int = 2048, read: tuple[str, ...] = ()) -> DataFrame:
    """A row ``key, cls, s0, s1`` and flags for each class and table; the group is part of the key.

    ``read`` names columns that are read but not kept: readers of a class table that need
    the same columns of it share its shuffle.

    ``kernel`` takes list offsets and the hashed words of many classes at once and gives
    bucket keys (classes x tables) and sketches (classes x 2), both 64-bit integers.
    """
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}
    types, keep = dict(classes.dtypes), ("grp", *keep)
    schema = pa.schema([("cls", pa.int64()), *[(k, kinds[types[k]]) for k in keep], ("keys", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                lists = part.column("words")
                offsets = np.asarray(lists.offsets, dtype=np.int64)
                flat = np.asarray(lists.values)[offsets[0] : offsets[-1]]
                keys, sketch = kernel(offsets - offsets[0], flat)
                n = part.num_rows
                arr = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls"), *[part.column(k) for k in keep], arr, pa.array(np.ascontiguousarray(sketch[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(sketch[:, 1]).view(np.int64))],
                    schema=schema,
                )

    ddl = ", ".join(["cls long", *[f"{k} {types[k]}" for k in keep], "keys array<long>", "s0 long", "s1 long"])
    rows = classes.select("cls", *keep, *read, "words").mapInArrow(run, ddl).withColumn("key", F.explode("keys"))
    return rows.select(F.col("key").bitwiseXOR(F.col("grp")).alias("key"), "cls", "s0", "s1", *keep[1:])


def near(a: str, b: str, radius: int | Column) -> Column:
    """Whether the sketches of two aliased sides differ in at most ``radius`` bits."""
    return F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))) + F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) <= radius


def plausible(candidates: DataFrame, classes: DataFrame, threshold: float, flags: tuple[str, ...] = (), also: Column | None = None) -> DataFrame:
    """The candidate pairs ``c1, c2`` whose sizes, and the bits in which their words differ, allow the threshold; none that reaches it is lost.

    A bit tells whether an odd number of words falls on it, so two sets differ in at least
    as many words as bits. The check moves a few bytes a pair, where verification moves words.
    ``also`` is a further condition on the aliased sides ``a`` and ``b``, with the flags it needs.
    """
    def half(k: int) -> Column:
        bit = lambda w: F.when(w.bitwiseAND(64) == 64 * k, F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(63))).otherwise(F.lit(0).cast("long"))
        return F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(bit(w)))

    narrow = classes.select("cls", "grp", *flags, F.size("words").alias("size"), half(0).alias("s0"), half(1).alias("s1"))
    a, b = narrow.alias("a"), narrow.alias("b")
    sizes = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * F.lit(threshold - 1e-6)
    differ = (F.col("a.size") + F.col("b.size")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
    ok = sizes & near("a", "b", differ) & (F.col("a.grp").bitwiseXOR(F.col("b.grp")) == 0)
    return candidates.join(a, F.col("c1") == F.col("a.cls")).join(b, F.col("c2") == F.col("b.cls")).where(ok if also is None else ok & also).select("c1", "c2")


def verified(candidates: DataFrame, classes: DataFrame, threshold: float, also: Column | None = None) -> DataFrame:
    """``c1, c2, similarity`` of the candidate pairs of one group whose word sets reach the threshold.

    ``also`` is a further condition on the aliased sides ``a`` and ``b``. Both sides read the
    class table as the buckets do, so that its shuffle is made once and used by all readers;
    the groups are compared after the join, for as a key they would shuffle it again.
    """
    a, b = classes.alias("a"), classes.alias("b")
    j = candidates.join(a, F.col("c1") == F.col("a.cls")).join(b, F.col("c2") == F.col("b.cls")).where(F.col("a.grp").bitwiseXOR(F.col("b.grp")) == 0)
    if also is not None:
        j = j.where(also)
    j = j.select("c1", "c2", jaccard(F.col("a.words"), F.col("b.words")).alias("similarity"))
    return j.where(F.col("similarity") >= threshold - 1e-12)
