"""Learning from all rows where they lie: shards take their steps from the same weights, and weights and moments are averaged by rows.

Rows are dealt into shards that a task holds one at a time. In an epoch each shard
passes all its rows once. A task sums what its shards learned, some tasks sum the
tasks, and the driver holds a few copies of the weights whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filtering import cut

TASKS = 256  # that deal with the shards of an epoch


def deal(rows: DataFrame, shards: int, *order: str) -> DataFrame:
    """Rows with a column `shard`, in order of (shard, order), kept for all epochs; a shard lies in one partition."""
    parts = min(shards, TASKS)
    return cut(rows.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", *order))


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.asarray(v, np.float64).ravel() for v in weights.values()])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([np.size(v) for v in like.values()])
    return {k: x.reshape(np.shape(v)).copy() for (k, v), x in zip(like.items(), np.split(values, ends[:-1]))}


def _added(rows: pa.Table) -> pa.RecordBatch:
    """One row with the sums, in order of shards, so that the same rows give the same bits."""
    rows = rows.sort_by("shard")
    total = np.zeros(len(rows["total"][0].as_buffer()) // 8)
    for x in rows["total"]:
        total += np.frombuffer(x.as_buffer())
    return _sums(rows["shard"][0].as_py(), float(np.sum(rows["n"].to_numpy())), float(np.sum(rows["loss"].to_numpy())), total)


def _sums(shard: int, n: float, loss: float, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=["shard", "n", "loss", "total"])


def epoch(dealt: DataFrame, shards: int, weights: dict[str, np.ndarray], learn: Callable) -> tuple[dict[str, np.ndarray], float]:
    """(weights, mean loss) after `learn(weights, rows of a shard, shard)`, which gives (weights, rows, summed loss), has passed each shard."""
    shared = dealt.sparkSession.sparkContext.broadcast(weights)  # a few MB whatever the input

    def passed(batches):
        first, n, loss, total, now, held = None, 0.0, 0.0, None, None, []

        def done():
            nonlocal first, n, loss, total
            if held:
                learned, m, x = learn(shared.value, pa.Table.from_batches(held).combine_chunks(), now)
                first, n, loss = now if first is None else first, n + m, loss + x
                total = flat(learned) * m + (0.0 if total is None else total)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if shard[lo] != now:
                    done()
                    now, held = int(shard[lo]), []
                held.append(batch.slice(lo, hi - lo))
        done()
        if total is not None:
            yield _sums(first, n, loss, total)

    def summed(batches):
        rows = list(batches)
        if sum(b.num_rows for b in rows):
            yield _added(pa.Table.from_batches(rows))

    kind, groups = "shard bigint, n double, loss double, total binary", int(np.ceil(min(shards, TASKS) ** 0.5))
    sums = dealt.mapInArrow(passed, kind)
    found = _added(sums.repartitionById(groups, F.pmod("shard", F.lit(groups)).cast("int")).mapInArrow(summed, kind).toArrow())  # a copy of the weights a group
    n = found.column("n")[0].as_py()
    values = np.frombuffer(found.column("total")[0].as_buffer())
    shared.unpersist()
    return (shaped(values / n, weights), found.column("loss")[0].as_py() / n) if n else (weights, 0.0)
