"""Splits that keep related records together."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from difflode.functions.repo import canonical_repo, canonical_sha
from difflode.operators.components import connected_components
from difflode.operators.shortids import resolve_short_ids
from difflode.plans.lineage import cut

FAMILIES_A_CHUNK = 20_000
BINS_A_CHUNK = 32
BINS = 64


def families(samples: DataFrame, links: DataFrame) -> DataFrame:
    """``(sample_id, family_key)`` for every distinct sample.

    ``samples`` has ``sample_id, repo``; ``links`` has ``sample_id, commit_id`` (one source
    commit each). Samples with the same canonical repository or the same source commit
    belong together, transitively. Nodes of the graph are repositories (and samples
    without one), not samples, so a repository with a third of the rows is one node, and
    a commit links its nodes to the smallest of them instead of in pairs.

    The key is the smallest repository of the family, or its smallest sample id where no
    sample of it has a repository. Null and blank repositories and ids link nothing; null
    sample ids are left out; links of unknown samples are ignored.
    """
    own = samples.where(F.col("sample_id").isNotNull()).select(
        "sample_id", F.coalesce(F.concat(F.lit("0"), canonical_repo(F.col("repo"))), F.concat(F.lit("1"), "sample_id")).alias("key")
    ).distinct()
    node = cut(own.select("sample_id", "key", F.min("key").over(Window.partitionBy("sample_id")).alias("node")))
    direct = node.where(F.col("key") != F.col("node")).where(~F.col("key").startswith("1")).select(F.col("node").alias("u"), F.col("key").alias("v"))
    ids = links.select("sample_id", canonical_sha(F.col("commit_id")).alias("id")).where(F.col("id").isNotNull()).distinct()
    nodes = node.select("sample_id", "node").distinct()
    touched = cut(ids.join(nodes, "sample_id").select("id", "node").distinct())
    named = resolve_short_ids(touched, "id")
    by_commit = touched.join(named, "id").select(F.col("full_id").alias("id"), "node").distinct()
    least = by_commit.groupBy("id").agg(F.min("node").alias("low"))
    edges = by_commit.join(least, "id").where(F.col("node") != F.col("low")).select(F.col("low").alias("u"), F.col("node").alias("v"))
    found = connected_components(edges.union(direct).distinct())
    return nodes.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "sample_id", F.expr("substring(coalesce(component, node), 2)").alias("family_key")
    )


def largest_differencing(weights: list[float], k: int) -> list[list[int]]:
    """Indices of ``weights`` in ``k`` bins of near-equal sum.

    Each weight starts as a partial partition with one filled bin. The two partitions of
    the largest spread are joined again and again, the heaviest bin of one with the
    lightest of the other, so that extreme weights cancel; the last one is the result.
    """
    if not weights:
        return [[] for _ in range(k)]
    heap = []
    for i, w in enumerate(weights):
        heap.append((-float(w), i, [(0.0, None)] * (k - 1) + [(float(w), i)]))
    heapq.heapify(heap)
    tick = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        bins = [(x[0] + y[0], y[1] if x[1] is None else x[1] if y[1] is None else (x[1], y[1])) for x, y in zip(a, reversed(b))]
        bins.sort(key=lambda t: t[0])
        low = bins[0][0]
        # what all bins share no longer matters for the spread, but is kept as weight
        heapq.heappush(heap, (-(bins[-1][0] - low), tick, bins))
        tick += 1
    out = []
    for _, tree in heap[0][2]:
        members, stack = [], [] if tree is None else [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            else:
                members.append(t)
        out.append(members)
    return out


def allocate_bins(weights: list[float], plan: list[tuple[str, float]]) -> list[str]:
    """A split for each bin: heaviest first, each to the split with the most still to come."""
    total, share = sum(weights), sum(p for _, p in plan)
    left = {s: (p / share) * total for s, p in plan}
    out = [""] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        best = max(plan, key=lambda sp: (left[sp[0]], sp[1], sp[0]))[0]
        out[i] = best
        left[best] -= weights[i]
    return out


def _binned(weights: DataFrame, key: str) -> DataFrame:
    """``key, weight, bin``: chunks of about ``FAMILIES_A_CHUNK`` keys, each differenced into ``BINS_A_CHUNK`` bins by one task."""
    chunks = max(1, -(-weights.count() // FAMILIES_A_CHUNK))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", key], ascending=[False, True], ignore_index=True)
        pdf["bin"] = 0
        for b, part in enumerate(largest_differencing(pdf["weight"].tolist(), BINS_A_CHUNK)):
            pdf.loc[part, "bin"] = int(pdf["chunk"].iloc[0]) * BINS_A_CHUNK + b
        return pdf[[key, "weight", "bin"]]

    dealt = weights.select(key, "weight", F.pmod(F.xxhash64(key), F.lit(chunks)).alias("chunk"))
    return cut(dealt.groupBy("chunk").applyInPandas(run, f"{key} {dict(weights.dtypes)[key]}, weight long, bin long"))


def assign_splits(members: DataFrame, plan: DataFrame, group: str = "family_key") -> DataFrame:
    """``members`` with a ``split`` such that no group is divided.

    Groups are balanced in levels: chunks of about ``FAMILIES_A_CHUNK`` groups each are
    differenced into ``BINS_A_CHUNK`` bins by the executors, and the bins again likewise
    as long as more than ``FAMILIES_A_CHUNK`` are left; the rest (their number and weights
    only) comes to the driver and is differenced into ``BINS`` near-equal bins, which go
    whole to the splits by target proportion. ``plan`` has ``split, proportion``; rows
    with null or no positive proportion are ignored, and a plan without any other row is
    an error. A group heavier than a bin stays whole and goes to the split with the most
    room. An empty table gives an empty result.
    """
    spark: SparkSession = members.sparkSession
    targets = [(r[0], float(r[1])) for r in plan.select("split", "proportion").collect() if r[0] and r[1] and r[1] > 0]
    if not targets:
        raise ValueError("the split plan has no split with a positive proportion")
    levels = [_binned(members.groupBy(group).agg(F.count(F.lit(1)).alias("weight")), group)]
    while True:
        bins = levels[-1].groupBy("bin").agg(F.sum("weight").alias("weight"))
        if bins.count() <= FAMILIES_A_CHUNK:
            break
        levels.append(_binned(bins.withColumnRenamed("bin", "below"), "below"))
    rows = bins.orderBy(F.desc("weight"), "bin").collect()
    large = largest_differencing([r["weight"] for r in rows], BINS)
    splits = allocate_bins([float(sum(rows[i]["weight"] for i in part)) for part in large], targets)
    chosen = spark.createDataFrame([(rows[i]["bin"], splits[b]) for b, part in enumerate(large) for i in part], "bin long, __split string")
    for level in reversed(levels[1:]):
        chosen = level.join(chosen, "bin").select(F.col("below").alias("bin"), "__split")
    chosen = levels[0].join(chosen, "bin").select(F.col(group).alias("__g"), "__split")
    return members.drop("split").join(chosen, F.col(group) == F.col("__g")).select(*[c for c in members.columns if c != "split"], F.col("__split").alias("split"))
