"""Clusters of the units of one sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How much a shared file, folder and role and the overlap of identifiers count.
WEIGHTS = {"file": 1.0, "folder": 0.4, "role": 0.2, "identifiers": 0.8}


def similarity(paths: list[str | None], roles: list[str | None], identifiers: list[set[str]]) -> np.ndarray:
    """Similarity of every two units: shared file, folder and role, and the Jaccard overlap of identifiers (0 for two empty sets)."""
    n = len(paths)
    out = np.zeros((n, n))
    folder = [None if p is None else p.rpartition("/")[0] for p in paths]
    for i in range(n):
        for j in range(i + 1, n):
            s = WEIGHTS["file"] * (bool(paths[i]) and paths[i] == paths[j]) + WEIGHTS["folder"] * (bool(paths[i]) and bool(paths[j]) and folder[i] == folder[j])
            s += WEIGHTS["role"] * ((roles[i] or "").lower() == (roles[j] or "").lower())
            union = identifiers[i] | identifiers[j]
            s += WEIGHTS["identifiers"] * (len(identifiers[i] & identifiers[j]) / len(union) if union else 0.0)
            out[i, j] = out[j, i] = s
    return out


def merge(sim: np.ndarray, k: int) -> np.ndarray:
    """The cluster of each unit after merging the two clusters of the highest mean similarity until ``k`` are left; ties go to the earlier pair.

    The sums between clusters are kept, so that a merge adds two rows instead of averaging anew.
    """
    n = len(sim)
    of = np.arange(n)
    if not n:
        return of
    sums, size, live = sim.copy(), np.ones(n), np.ones(n, bool)
    for _ in range(n - max(1, k)):
        mean = np.where(np.triu(np.outer(live, live), 1), sums / np.outer(size, size), -np.inf)
        i, j = divmod(int(mean.argmax()), n)
        of[of == j] = i
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        size[i] += size[j]
        live[j] = False
    return of


def average_link(units: DataFrame, by: str, key: str, gold: str) -> DataFrame:
    """``by, units, clusters, pair_f1``: units merged into as many clusters as the group has gold labels, against these labels.

    ``units`` also has ``file_path, file_role, identifiers``. Groups stream through sorted
    batches, one at a time; a group is a sample's units, few by nature, and its work grows
    with their square. F1 is 0 where no pair is in one cluster or label.
    """
    kind = dict(units.dtypes)[by]

    def result(rows: list[tuple]) -> tuple[int, int, float]:
        rows.sort(key=lambda r: str(r[0]))
        sim = similarity([r[1] for r in rows], [r[2] for r in rows], [set(r[3] or []) for r in rows])
        labels = [r[4] for r in rows]
        of = merge(sim, len(set(labels)))
        same, true = of[:, None] == of[None, :], np.array([[x == y for y in labels] for x in labels])
        up = np.triu(np.ones_like(same), 1).astype(bool)
        tp, p, t = (same & true & up).sum(), (same & up).sum(), (true & up).sum()
        return len(rows), len(set(of.tolist())), round(float(2 * tp / (p + t)), 6) if tp else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            out = []
            for g, *row in zip(*[batch.column(c).to_pylist() for c in (by, key, "file_path", "file_role", "identifiers", gold)]):
                if held and g != at:
                    out.append((at, *result(held)))
                    held = []
                at = g
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(by).type), *[pa.array([r[i] for r in out], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))]], names=[by, "units", "clusters", "pair_f1"])
        if held:
            n, c, f = result(held)
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n], pa.int64()), pa.array([c], pa.int64()), pa.array([f])], names=[by, "units", "clusters", "pair_f1"])

    own = units.where(F.col(by).isNotNull() & F.col(gold).isNotNull()).select(by, key, "file_path", "file_role", "identifiers", gold)
    return own.repartition(by).sortWithinPartitions(by).mapInArrow(run, f"{by} {kind}, units long, clusters long, pair_f1 double")
