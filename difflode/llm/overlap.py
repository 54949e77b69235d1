"""Same or near-same records across splits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflode.functions.repo import canonical_repo, canonical_sha, canonical_split
from difflode.llm.classes import GOLD, bucketed, class_table, mix, near, plausible, salt, verified, with_classes
from difflode.operators.shortids import resolve_short_ids
from difflode.plans.lineage import cut

#: Segments of the fingerprint and bits of each. A bit agrees with the chance 1 - angle/pi,
#: 0.81 at a similarity of 0.70, 0.83 at 0.75, 0.85 at 0.80, 0.92 at 0.90.
SEGMENTS, BITS = 80, 14
#: Bits of 128 that may differ: 25 at a similarity of 0.7, and 3.5 deviations.
RADIUS = 41
#: Pairs with at most so many shared words are found by those words, as long as no set has more subsets than this.
SHARED, SUBSETS = 8, 200
LANES = -(-SEGMENTS * BITS // 64) + 2


def simhash(offsets: np.ndarray, elements: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Similarity-hash fingerprints of ``64 * lanes`` bits, for many sets at once.

    A bit is the majority of that bit over the hashes of the elements. The votes are
    counted in bit planes, 64 bits at a time: the p-th elements of all sets are added in
    one step with carries, and the counts are compared with half the size plane by plane.
    A set of even size also counts one fixed element, the same for all, so that no vote is tied.
    """
    size = np.diff(offsets)
    n = len(size)
    order = np.argsort(-size, kind="stable")
    starts = offsets[:-1][order]
    sizes = size[order]
    votes = sizes + (sizes % 2 == 0) * (sizes > 0)
    out = np.zeros((n, lanes), dtype=np.uint64)
    if not n or not len(elements):
        return out
    unique, where = np.unique(elements, return_inverse=True)
    seed = mix(np.append(unique.astype(np.int64), -(1 << 40)).view(np.uint64) + salt(7))
    rows = mix(seed[:, None] + np.arange(1, lanes + 1, dtype=np.uint64)[None, :] * GOLD)
    planes: list[np.ndarray] = []
    top = int(votes[0])
    act = n
    for p in range(top):
        while act and votes[act - 1] <= p:
            act -= 1
        own = p < sizes[:act]
        carry = rows[np.where(own, where[np.where(own, starts[:act] + p, 0)], len(unique))]
        for k in range(int(p + 1).bit_length()):
            if k == len(planes):
                planes.append(np.zeros((n, lanes), dtype=np.uint64))
            more = planes[k][:act] & carry
            planes[k][:act] ^= carry
            carry = more
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    above, equal = np.zeros((n, lanes), dtype=np.uint64), np.full((n, lanes), full)
    half = votes // 2
    for k in reversed(range(len(planes))):
        t = np.where((half >> k) & 1, full, np.uint64(0))[:, None]
        above |= equal & planes[k] & ~t
        equal &= ~(planes[k] ^ t)
    out[order] = above
    return out


def _kernel(offsets: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = simhash(offsets, elements)
    bits = np.unpackbits(np.ascontiguousarray(code[:, : LANES - 2]).view(np.uint8), axis=1)[:, : SEGMENTS * BITS]
    parts = bits.reshape(len(code), SEGMENTS, BITS).astype(np.int64)
    keys = (parts << np.arange(BITS, dtype=np.int64)).sum(axis=2) + (np.arange(SEGMENTS, dtype=np.int64) << BITS)
    return keys, code[:, LANES - 2 :]


def subset_sizes(threshold: float) -> dict[int, range]:
    """For sets of each size, how many words they may share with one that reaches the threshold, as far as all such pairs are covered.

    A set of n words shares at least ``threshold * n``. The numbers go up to ``SHARED``, or
    to what ``SUBSETS`` allows at low thresholds.
    """
    for top in range(SHARED, 0, -1):
        least = {n: max(1, math.ceil(threshold * n - 1e-9)) for n in range(1, int(top / max(threshold, 0.1)) + 2)}
        sizes = {n: range(k, min(n, top) + 1) for n, k in least.items() if k <= top}
        if all(sum(math.comb(n, k) for k in ks) <= SUBSETS for n, ks in sizes.items()):
            return sizes
    return {}


def subset_rows(classes: DataFrame, threshold: float) -> DataFrame:
    """``key, cls``: a row for each set of words that a small class may share with another; the group is part of the key."""
    sizes = subset_sizes(threshold)
    picks = {n: [np.array(list(combinations(range(n), k))) for k in ks] for n, ks in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            flat = mix(np.asarray(lists.values).astype(np.int64).view(np.uint64) + salt(13))
            size = np.diff(offsets)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                words = flat[offsets[at][:, None] + np.arange(n)]
                keys = np.concatenate([mix(words[:, c].sum(axis=2, dtype=np.uint64) + salt(c.shape[1])) for c in picks[int(n)]], axis=1)
                part = batch.take(pa.array(at))
                arr = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("grp"), arr], names=["cls", "grp", "keys"])

    small = classes.where(F.size("words").isin(list(sizes))).select("cls", "grp", "is_train", "is_eval", "words")
    rows = small.mapInArrow(run, "cls long, grp long, keys array<long>").withColumn("key", F.explode("keys"))
    return rows.select(F.col("key").bitwiseXOR(F.col("grp")).alias("key"), "cls")


def similar_across(docs: DataFrame, group: str, key: str, text: str, split: str = "split", threshold: float = 0.7) -> DataFrame:
    """``group, id_train, id_eval`` for all similar texts of which one is in training and one in an evaluation split.

    Fingerprints are cut into segments; a training and an evaluation class that agree in a
    segment and differ in few bits of another 128 are verified on their words. Pairs with
    few shared words, whose fingerprints say little, are all found by those words. ``split``
    holds train, dev and test; other values and null take no part, nor do texts without a
    word. Classes fold copies, so repeated texts never multiply in the buckets.
    """
    m, pairs = across_classes(docs, group, key, text, split, threshold)
    same = m.groupBy("cls").agg(F.max("is_train").alias("t"), F.min("is_train").alias("e")).where("t and not e").select(F.col("cls").alias("c1"), F.col("cls").alias("c2"))
    a = m.where("not is_train").select(F.col("cls").alias("c1"), F.col(group).alias(group), F.col(key).alias("id_eval"))
    b = m.where("is_train").select(F.col("cls").alias("c2"), F.col(group).alias("g2"), F.col(key).alias("id_train"))
    both = pairs.union(same).join(a, "c1").join(b, "c2").where((F.col(group) == F.col("g2")) & (F.col("id_eval") != F.col("id_train")))
    return both.select(group, "id_train", "id_eval").distinct()


def across_classes(docs: DataFrame, group: str, key: str, text: str, split: str = "split", threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: the documents with their class and side, and the verified pairs of classes of which one has evaluation and the other training texts."""
    d = docs.where(F.col(key).isNotNull() & F.col(split).isin("train", "dev", "test")).select(
        group, key, text, (F.col(split) == "train").alias("is_train"), (F.col(split) != "train").alias("is_eval")
    )
    d = with_classes(d, group, text)
    flags = ("is_train", "is_eval")
    classes = class_table(d, group, flags)
    # a class of so few words has no pair that its shared words do not find
    covered = max((ks.stop - 1 for ks in subset_sizes(threshold).values()), default=0)
    large = classes.where(F.size("words") > covered)
    cand = (
        bucketed(large.where("is_eval"), _kernel, read=flags).alias("a").join(bucketed(large.where("is_train"), _kernel, read=flags).alias("b"), F.col("a.key") == F.col("b.key"))
        .where((F.col("a.cls") != F.col("b.cls")) & near("a", "b", RADIUS))
        .select(F.col("a.cls").alias("c1"), F.col("b.cls").alias("c2"))
    )
    cand = cand.union(
        subset_rows(classes.where("is_eval"), threshold).alias("a").join(subset_rows(classes.where("is_train"), threshold).alias("b"), F.col("a.key") == F.col("b.key"))
        .where(F.col("a.cls") != F.col("b.cls")).select(F.col("a.cls").alias("c1"), F.col("b.cls").alias("c2"))
    ).distinct()
    across = (F.col("a.is_eval") & F.col("b.is_train")) | (F.col("b.is_eval") & F.col("a.is_train"))
    pairs = verified(plausible(cand, classes, threshold, flags, across), classes, threshold, across).select("c1", "c2")
    return cut(d.select("cls", group, key, "is_train").distinct()), pairs


def overlap_groups(docs: DataFrame, group: str, key: str, text: str, split: str = "split", threshold: float = 0.7) -> DataFrame:
    """``group, key, is_train, class_id, links``: one row for each document that has a similar one on the other side of the splits.

    ``class_id`` is the smallest key with the same word set; ``links`` is the number of
    word sets of the other side that are similar, the own one included if it lies on both
    sides. Copies are not paired, so the result has at most a row a document and side.
    """
    m, pairs = across_classes(docs, group, key, text, split, threshold)
    p = cut(pairs)
    side = m.groupBy("cls").agg(F.min(key).alias("class_id"), F.max("is_train").alias("t"), F.max(~F.col("is_train")).alias("e"))
    both = side.where("t and e").select("cls", F.lit(True).alias("is_train"), F.col("cls").alias("other")).union(side.where("t and e").select("cls", F.lit(False), F.col("cls")))
    # c1 and c2 name an evaluation and a training class, or, as a class can be both, either
    ends = p.join(side.select(F.col("cls").alias("c1"), F.col("t").alias("t1"), F.col("e").alias("e1")), "c1").join(side.select(F.col("cls").alias("c2"), F.col("t").alias("t2"), F.col("e").alias("e2")), "c2")
    parts = [("c1", False, "c2", "e1", "t2"), ("c1", True, "c2", "t1", "e2"), ("c2", False, "c1", "e2", "t1"), ("c2", True, "c1", "t2", "e1")]
    links = both
    for own, train, other, have, need in parts:
        links = links.union(ends.where(F.col(have) & F.col(need)).select(F.col(own).alias("cls"), F.lit(train).alias("is_train"), F.col(other).alias("other")))
    n = links.distinct().groupBy("cls", "is_train").agg(F.count(F.lit(1)).alias("links"))
    return m.join(n, ["cls", "is_train"]).join(side.select("cls", "class_id"), "cls").select(group, key, "is_train", "class_id", "links").distinct()


def same_revision_across(records: DataFrame, key: str, sha: str, split: str = "split") -> DataFrame:
    """``id_train, id_eval`` of records of the same revision; a short id names those it begins."""
    r = records.where(F.col(key).isNotNull() & F.col(split).isin("train", "dev", "test")).select(F.col(key).alias("k"), canonical_sha(F.col(sha)).alias("id"), (F.col(split) == "train").alias("is_train"))
    r = cut(r.where(F.col("id").isNotNull()).distinct())
    full = r.join(resolve_short_ids(r, "id"), "id").select("full_id", "k", "is_train")
    e = full.where("not is_train").select("full_id", F.col("k").alias("id_eval"))
    t = full.where("is_train").select("full_id", F.col("k").alias("id_train"))
    return e.join(t, "full_id").where("id_eval != id_train").select("id_train", "id_eval").distinct()


def split_texts(samples: DataFrame, examples: DataFrame) -> DataFrame:
    """``origin, id, text, split`` of the samples' diffs and the examples' subjects."""
    s = samples.select(F.lit("attribution_samples").alias("origin"), F.col("sample_id").alias("id"), F.col("diff_text").alias("text"), canonical_split(F.col("split")).alias("split"))
    return s.union(examples.select(F.lit("fewshot_pool").alias("origin"), F.col("example_id").alias("id"), F.col("subject").alias("text"), canonical_split(F.col("split")).alias("split")))


def split_overlaps(samples: DataFrame, examples: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``origin, id_train, id_eval``: overlaps of the samples' diffs, and of the examples' revisions or subjects."""
    texts = similar_across(split_texts(samples, examples), "origin", "id", "text", threshold=threshold)
    revisions = same_revision_across(examples.withColumn("split", canonical_split(F.col("split"))), "example_id", "sha")
    return texts.union(revisions.select(F.lit("fewshot_pool").alias("origin"), "id_train", "id_eval")).distinct()


def overlap_report(pairs: DataFrame, samples: DataFrame, examples: DataFrame) -> DataFrame:
    """Overlapping pairs, and evaluation records in them, by origin, evaluation split and canonical repository."""
    s = samples.select(F.lit("attribution_samples").alias("origin"), F.col("sample_id").alias("id_eval"), canonical_split(F.col("split")).alias("split"), canonical_repo(F.col("repo")).alias("repo"))
    x = examples.select(F.lit("fewshot_pool").alias("origin"), F.col("example_id").alias("id_eval"), canonical_split(F.col("split")).alias("split"), canonical_repo(F.col("repo")).alias("repo"))
    meta = s.union(x).where(F.col("split").isin("dev", "test")).groupBy("origin", "id_eval").agg(F.min("split").alias("split"), F.min("repo").alias("repo"))
    return pairs.join(meta, ["origin", "id_eval"]).groupBy("origin", "split", "repo").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("id_eval").alias("eval_records"))
