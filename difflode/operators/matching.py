"""Label matching and greedy packing of groups, on bounded inputs of one group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflode.functions.scores import stable_key
from difflode.operators.ranking import running_sums
from difflode.plans.lineage import cut


def best_matching(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest total gain (shortest augmenting paths with potentials)."""
    n, m = gain.shape
    if n > m:
        return [(r, c) for c, r in best_matching(gain.T)]
    cost = gain.max(initial=0) - gain
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[j] = True
            row = owner[j]
            slack = cost[row - 1] - u[row] - v[1:]
            free = ~done[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            came[1:][better] = j
            nxt = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[came[j]]
            j = came[j]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def matched_accuracy(units: DataFrame, by: str, gold: str, pred: str) -> DataFrame:
    """``by, units, accuracy``: share of units that agree under the best one-to-one matching of predicted to gold labels.

    Only the contingency counts of a group reach a task, folded before the shuffle, and
    groups stream through sorted batches one at a time; the labels of one group (a
    sample's intents and files) are few by nature. Null labels are left out.
    """
    cell = units.where(F.col(by).isNotNull() & F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(by).alias("g"), F.col(gold).cast("string").alias("a"), F.col(pred).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    kind = dict(units.dtypes)[by]

    def result(rows: list[tuple]) -> tuple[int, float]:
        a, b = ({v: i for i, v in enumerate(sorted({r[k] for r in rows}))} for k in (0, 1))
        t = np.zeros((len(a), len(b)))
        for x, y, n in rows:
            t[a[x], b[y]] = n
        return int(t.sum()), round(float(sum(t[r, c] for r, c in best_matching(t)) / t.sum()), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kind_ = None, [], None
        for batch in batches:
            out = []
            kind_ = batch.schema.field("g").type
            for g, *row in zip(*[batch.column(c).to_pylist() for c in ("g", "a", "b", "n")]):
                if held and g != at:
                    out.append((at, *result(held)))
                    held = []
                at = g
                held.append(tuple(row))
            yield record(out, kind_)
        if held:
            yield record([(at, *result(held))], kind_)

    def record(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["g", "units", "accuracy"])

    return cell.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"g {kind}, units long, accuracy double").withColumnRenamed("g", by)


#: Groups of more than this part of all weight are packed one by one.
HEAVY = 1e-4


def pack_groups(weights: DataFrame, group: str, weight: str, targets: list[tuple[str, float]], seed: str) -> DataFrame:
    """``group, split``: whole groups to splits, so that their weights come near the targets.

    Groups of more than ``HEAVY`` of all weight, of which there are at most ``1 / HEAVY``,
    come to the driver and go to the split with the largest remaining deficit, heaviest
    first, ties by hash. All others fill what is left in hash order by running sums on the
    executors. Every group is placed; weights below zero count as zero.
    """
    spark = weights.sparkSession
    w = cut(weights.where(F.col(group).isNotNull()).select(group, F.greatest(F.col(weight), F.lit(0)).alias("w"), stable_key(seed, F.col(group)).alias("k")))
    total = float(w.agg(F.sum("w")).first()[0] or 0)
    left = {name: share * total for name, share in targets}
    placed = []
    for r in w.where(F.col("w") > HEAVY * total).orderBy(F.desc("w"), "k").collect():
        best = max(left, key=lambda s: (left[s], s))
        left[best] -= r["w"]
        placed.append((r[group], best))
    heavy = spark.createDataFrame(placed, f"{group} string, split string")
    light = w.where(F.col("w") <= HEAVY * total)
    rest = {s: max(v, 0.0) for s, v in left.items()}
    part = sum(rest.values()) or 1.0
    mass = float(light.agg(F.sum("w")).first()[0] or 0)
    upto, split = 0.0, None
    middle = F.col("upto") - F.col("w") / 2
    for s, v in rest.items():
        upto += v / part
        split = F.when(middle <= upto * mass, s) if split is None else split.when(middle <= upto * mass, s)
    last = max(rest, key=lambda s: (rest[s], s))
    filled = running_sums(light, [F.col("k").asc(), F.col(group).asc()], {"upto": "w"}).select(F.col(group).cast("string").alias(group), split.otherwise(last).alias("split"))
    return heavy.union(filled)
