"""Filling containers of fixed capacity with texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflode.plans.lineage import cut

#: Items packed by one task at a time, and how full a container must be not to be packed again.
ITEMS_A_CHUNK, FULL = 10_000, 0.97
ROUNDS = 3
KINDS_A_BLOCK = 64


def pack_vectors(items: np.ndarray, limits: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The container of each item, by the dot-product heuristic for vector bin packing.

    ``items`` has a row of demands for each item, ``limits`` what a container holds in each
    dimension. One container is open at a time. Of the kinds of items that still fit in
    every dimension, the one whose demand has the largest weighted dot product with the
    remaining room goes in, as often as it fits; the container closes when nothing fits.
    Items with equal demands are one kind with a count. An item beyond a limit gets a
    container alone.

    Kinds lie in blocks of similar demand with their least and largest demands. The largest
    bound the dot product of a block, so that only the blocks that can hold the best kind
    are searched.
    """
    n = len(items)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    kinds, back = np.unique(-items, axis=0, return_inverse=True)
    kinds, back = -kinds, back.reshape(-1)
    order = np.argsort(back, kind="stable")
    count = np.bincount(back, minlength=len(kinds))
    at = np.concatenate([[0], np.cumsum(count)])[:-1]
    gain = kinds / limits**2 * (np.ones(len(limits)) if weights is None else weights)
    container = -1
    for k in np.flatnonzero((kinds > limits).any(axis=1)):
        m = count[k]
        out[order[at[k] : at[k] + m]] = container + 1 + np.arange(m)
        container, count[k] = container + m, 0
    left = int(count.sum())
    starts = np.arange(0, len(kinds), KINDS_A_BLOCK)
    ends = np.minimum(starts + KINDS_A_BLOCK, len(kinds))
    live = [np.arange(a, b)[count[a:b] > 0] for a, b in zip(starts, ends)]
    full = np.array([len(x) > 0 for x in live])
    least = np.array([kinds[x].min(axis=0) if len(x) else limits * 2 for x in live])
    most = np.array([gain[x].max(axis=0) if len(x) else limits * 0 for x in live])
    while left:
        container += 1
        room = limits.astype(np.float64)
        while True:
            open_ = np.flatnonzero(full & (least <= room).all(axis=1))
            bound = most[open_] @ room
            best, score = -1, -1.0
            for j in np.argsort(-bound, kind="stable"):
                if bound[j] <= score:
                    break
                own = live[open_[j]]
                own = own[(kinds[own] <= room).all(axis=1)]
                if len(own):
                    value = gain[own] @ room
                    i = int(value.argmax())
                    if value[i] > score:
                        best, score = int(own[i]), float(value[i])
            if best < 0:
                break
            need = kinds[best] > 0
            take = min(int(count[best]), max(1, int((room[need] // kinds[best][need]).min()))) if need.any() else int(count[best])
            out[order[at[best] : at[best] + take]] = container
            at[best] += take
            count[best] -= take
            left -= take
            room = room - take * kinds[best]
            if not count[best]:
                b = best // KINDS_A_BLOCK
                live[b] = live[b][live[b] != best]
                if len(live[b]):
                    least[b], most[b] = kinds[live[b]].min(axis=0), gain[live[b]].max(axis=0)
                else:
                    full[b] = False
            if not left:
                break
    return out


def split_items(sizes: DataFrame, plans: DataFrame) -> DataFrame:
    """``plan_id, capacity, doc_id, part, start, tokens, loss``: a text in one part, or full parts and a rest if it exceeds the capacity.

    ``sizes`` has ``tokenizer, doc_id, tokens, loss``. Texts without tokens take no space
    and have no row; plans with a null or no positive capacity are left out.
    """
    p = plans.where("capacity > 0").select("plan_id", "tokenizer", "capacity")
    x = sizes.where("tokens > 0").join(p, "tokenizer")
    parts = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr("cast((tokens - 1) div capacity as int)"))))
    start = F.col("part").cast("long") * F.col("capacity")
    head = F.col("tokens") - F.col("loss")
    end = F.least(start + F.col("capacity"), F.col("tokens"))
    return parts.select(
        "plan_id", F.col("capacity").cast("long").alias("capacity"), "doc_id", "part", start.alias("start"), (end - start).alias("tokens"),
        F.greatest(end - F.greatest(start, head), F.lit(0)).alias("loss"),
    )


def pack(items: DataFrame, max_segments: int | None = None, loss_share: float = 1.0) -> DataFrame:
    """``plan_id, container_id, doc_id, part, start, tokens``: every item in one container.

    A container holds at most ``capacity`` tokens, ``max_segments`` items (an eighth of
    the capacity unless given) and ``loss_share`` of its capacity in loss-bearing tokens.
    Items are dealt by hash into chunks of about ``ITEMS_A_CHUNK``, packed by one task
    each; containers left short of ``FULL`` are opened and their items packed again with
    those of other chunks, so that chunking costs at most a container a plan in the end. A
    plan of one chunk is packed once. Every plan is packed as if it were alone. No item is
    dropped; an empty table gives an empty result.
    """
    schema = "plan_id int, container_id long, capacity long, doc_id long, part int, start long, tokens long, loss long, fill double"
    todo = cut(items.select(F.col("plan_id").cast("int").alias("plan_id"), "capacity", F.col("doc_id").cast("long").alias("doc_id"), "part", "start", "tokens", "loss"))
    done = None
    for turn in range(ROUNDS):
        # one count a plan; the plan table is small by nature
        chunks = {r["plan_id"]: max(1, -(-r["n"] // ITEMS_A_CHUNK)) for r in todo.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not chunks:
            break
        by_plan = F.create_map(*[x for p, n in chunks.items() for x in (F.lit(p), F.lit(n))])
        single = [p for p, n in chunks.items() if n == 1 or turn == ROUNDS - 1]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            turn = int(pdf["turn"].iloc[0])
            pdf = pdf.sort_values(["tokens", "loss", "doc_id", "part"], ascending=[False, False, True, True], ignore_index=True)
            cap = int(pdf["capacity"].iloc[0])
            limits = np.array([cap, max_segments or max(1, cap // 8), max(1.0, loss_share * cap)], dtype=np.float64)
            demand = np.stack([pdf["tokens"].to_numpy(np.float64), np.ones(len(pdf)), pdf["loss"].to_numpy(np.float64)], axis=1)
            where = pack_vectors(demand, limits, np.array([1.0, 0.05, 0.2]))
            pdf["container_id"] = (turn << 56) + (int(pdf["chunk"].iloc[0]) << 24) + where
            pdf["fill"] = np.bincount(where, weights=demand[:, 0])[where] / cap
            return pdf[["plan_id", "container_id", "capacity", "doc_id", "part", "start", "tokens", "loss", "fill"]]

        dealt = todo.withColumn("turn", F.lit(turn)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "part", F.lit(turn)), by_plan[F.col("plan_id")]))
        # twice as many tasks as chunks, so that few chunks share a task; a given number is not coalesced
        packed = cut(dealt.repartition(2 * sum(chunks.values()), "plan_id", "chunk").groupBy("plan_id", "chunk").applyInPandas(run, schema))
        final = F.col("plan_id").isin(single) | (F.col("fill") >= FULL)
        kept = packed.where(final)
        done = kept if done is None else done.union(kept)
        todo = packed.where(~final).select("plan_id", "capacity", "doc_id", "part", "start", "tokens", "loss")
        if len(single) == len(chunks):
            break
    if done is None:
        done = items.sparkSession.createDataFrame([], schema)
    return done.select("plan_id", "container_id", "doc_id", "part", "start", "tokens")


def pack_summary(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """``plan_id, containers, tokens, least, fill``: how many containers, the least possible by volume, and the share of space used."""
    p = packed.groupBy("plan_id", "container_id").agg(F.sum("tokens").alias("t")).groupBy("plan_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return p.join(plans.select(F.col("plan_id").cast("int").alias("plan_id"), "capacity"), "plan_id").select(
        "plan_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill")
    )
