"""Near-duplicate records with small edits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflode.llm.classes import GOLD, bucketed, class_table, mix, near, salt, verified, with_classes
from difflode.operators.components import connected_components
from difflode.plans.lineage import cut

#: Bands and rows of the signature. A pair of similarity s shares a bucket with the chance
#: 1 - (1 - s^5)^25: 0.990 at 0.70, 0.9988 at 0.75, 0.99995 at 0.80, and more above. No later step loses a pair.
BANDS, ROWS = 25, 5
REGISTERS = 128
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def prob_minhash(offsets: np.ndarray, elements: np.ndarray, m: int = REGISTERS, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """The element that arrives first at each of ``m`` registers, for many weighted sets at once.

    Every element sends a Poisson process of arrivals, at a rate of its weight, to registers
    drawn at random; times and registers depend on the element alone, so that equal elements
    of different sets agree. Two sets agree at a register with the chance of their
    probability Jaccard similarity; with equal weights that is the plain Jaccard similarity.
    An element stops as soon as its next arrival is later than what all registers of its set
    hold (early termination). Arrival and element are packed into one integer, of which
    each register keeps the least. An empty set holds the largest integer everywhere.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    low = elements.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
    base = mix(low + salt(seed))
    rate = None if weights is None else weights.astype(np.float64)
    if rate is not None:
        ok = rate > 0
        doc, low, base, rate = doc[ok], low[ok], base[ok], rate[ok]
    held = np.full(n * m, EMPTY, dtype=np.uint64)
    at = np.zeros(len(doc))
    latest = np.full(n, np.inf)
    step = 0
    while len(doc):
        step += 1
        u = mix(base + salt(step))
        gap = -np.log(((u >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32)
        at = at + (gap if rate is None else gap / rate)
        go = at < latest[doc]
        if not go.all():
            doc, low, base, at, u = doc[go], low[go], base[go], at[go], u[go]
            rate = None if rate is None else rate[go]
        register = ((u & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        packed = (at.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
        np.minimum.at(held, doc * m + register.astype(np.int64), packed)
        if step % 3 == 0 and len(doc):
            worst = held.reshape(n, m).max(axis=1)
            late = (worst >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(np.float64)
            latest = np.where(worst == EMPTY, np.inf, late)
    return np.where(held == EMPTY, EMPTY, held & np.uint64(0xFFFFFFFF)).reshape(n, m)


def parity_bits(offsets: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """128 bits of each set: how often, modulo two, its elements fall on a bit. Two sets differ in at least as many elements as in bits."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    at = mix(elements.astype(np.int64).view(np.uint64) + salt(11)) & np.uint64(127)
    odd = np.bincount(doc * 128 + at.astype(np.int64), minlength=n * 128) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, 128), axis=1).view(np.uint64)


def _kernel(offsets: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sig = mix(prob_minhash(offsets, elements))
    n = len(sig)
    keys = np.empty((n, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(n, b + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = mix(h * GOLD + sig[:, b * ROWS + r])
        keys[:, b] = h
    return keys, parity_bits(offsets, elements)


def similar_classes(docs: DataFrame, group: str, text: str, min_words: int = 8, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: the documents with their class, and the verified pairs of classes.

    Signatures are cut into bands and classes of a bucket are joined. A pair passes only if
    its sizes and the bits in which the sets differ allow the threshold, which holds for
    every pair that reaches it, and is then verified on the word sets. Copies count once
    (by class), so a text that fills a third of the rows adds one row to its buckets.
    """
    d = with_classes(docs, group, text, min_words)
    classes = class_table(d, group)
    banded = bucketed(classes.withColumn("size", F.size("words")), _kernel, keep=("size",))
    sizes = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * F.lit(threshold - 1e-6)
    differ = (F.col("a.size") + F.col("b.size")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
    cand = (
        banded.alias("a").join(banded.alias("b"), F.col("a.key") == F.col("b.key"))
        .where((F.col("a.cls") < F.col("b.cls")) & sizes & near("a", "b", differ))
        .select(F.col("a.cls").alias("c1"), F.col("b.cls").alias("c2")).distinct()
    )
    return d.drop("words"), verified(cand, classes, threshold)


def near_copies(docs: DataFrame, group: str, key: str, text: str, min_words: int = 8, threshold: float = 0.7) -> DataFrame:
    """``group, id_a, id_b``: all pairs of different records of a group with similar texts, once each.

    Similarity is that of the sets of distinct words. Texts that are null or have fewer
    words are left out, as are null keys; repeated deliveries of a record count once, and
    a record is no pair with itself even if its deliveries differ. Extra columns are not read.
    """
    d = docs.select(group, key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    members, pairs = similar_classes(d, group, text, min_words, threshold)
    m = cut(members.select("cls", group, key).distinct())
    same = m.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cls").alias("c1"), F.col("cls").alias("c2"))
    a = m.select(F.col("cls").alias("c1"), F.col(group).alias(group), F.col(key).alias("x"))
    b = m.select(F.col("cls").alias("c2"), F.col(key).alias("y"))
    both = pairs.select("c1", "c2").union(same).join(a, "c1").join(b, "c2")
    both = both.where((F.col("c1") != F.col("c2")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    return both.select(group, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_groups(docs: DataFrame, group: str, key: str, text: str, min_words: int = 8, threshold: float = 0.7) -> DataFrame:
    """``group, key, class_id, group_id, links``: one row for each record.

    ``class_id`` is the smallest key with the same word set, ``group_id`` the smallest key
    of the transitive group, ``links`` the number of other word sets that are similar.
    """
    d = docs.select(group, key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    members, pairs = similar_classes(d, group, text, min_words, threshold)
    m = cut(members.select("cls", group, key).distinct())
    p = cut(pairs.select("c1", "c2"))
    links = p.select(F.col("c1").alias("cls")).union(p.select(F.col("c2").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    comp = connected_components(p, "c1", "c2").withColumnRenamed("node", "cls")
    first = m.groupBy("cls").agg(F.min(key).alias("class_id"))
    table = first.join(links, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    low = table.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return m.join(table.join(low, "component"), "cls").select(group, key, "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links")).distinct()
