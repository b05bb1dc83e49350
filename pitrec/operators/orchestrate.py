"""Snapshots built one after the other: weights are tuned on the first, frozen with its cutoffs, and reused on the rest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrec.sources import versions

from . import candidates, metrics, retrieval, snapshots, tuning


def freeze(spark: SparkSession, path: str, cutoffs: list[int], weights: dict[str, float]) -> None:
    """Stores weights with the digest that binds them to the cutoffs they were tuned on."""
    row = (json.dumps(weights, sort_keys=True), cutoffs, candidates.weight_fingerprint(cutoffs, weights))
    versions.write(spark.createDataFrame([row], "weights string, cutoffs array<long>, fingerprint string"), path)


def frozen(spark: SparkSession, path: str, cutoffs: list[int]) -> dict[str, float]:
    """The stored weights; raises if there are none or if they belong to other cutoffs."""
    if versions.current(spark, path) is None:
        raise FileNotFoundError(f"{path}: build the first snapshot before the others")
    row = versions.read(spark, path).first()
    weights = json.loads(row["weights"])
    candidates.check_fingerprint(row["fingerprint"], cutoffs, weights)
    return weights


class Built:
    """One snapshot's parts: history, targets, users, pool, seen pairs."""

    def __init__(self, rows: DataFrame, cutoff: int, end: int, least: int = 5):
        self.hist = rows.where(F.col("ts") < cutoff)
        self.targets = metrics.truth_sets(rows.where((F.col("ts") >= cutoff) & (F.col("ts") < end)))
        self.users = self.targets.select("user_id").distinct()
        self.pool, self.seen = retrieval.eligible(self.hist, least), retrieval.seen(self.hist, self.users)


def tune(snapshot: Built, items: DataFrame, grid: list[dict[str, float]], k: int) -> list[tuple[int, float]]:
    """(grid index, recall at k) of the rule source, all vectors in one pass."""
    found = tuning.tune(snapshot.users, snapshot.hist, items, snapshot.pool, snapshot.seen, snapshot.targets, grid, [k], k)
    return sorted((r["grid_index"], r[f"recall_{k}"]) for r in found.collect())  # a row a vector


def build(snapshot: Built, items: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """The labelled union of the popularity and the rule source."""
    lists = {
        "popularity": retrieval.top_unseen(snapshot.users, retrieval.popularity(snapshot.hist), snapshot.pool, snapshot.seen, k),
        "rule": retrieval.rule_scores(snapshot.users, snapshot.hist, items, snapshot.pool, snapshot.seen, weights, k),
    }
    label = snapshot.targets.withColumn("label", F.lit(1))
    return candidates.union_sources(lists).join(label, ["user_id", "item_id"], "left").fillna(0, subset=["label"])


def build_all(rows: DataFrame, items: DataFrame, folder: str, grid: list[dict[str, float]], k: int, names=("train", "select", "test"), cutoffs: list[int] | None = None) -> dict[str, DataFrame]:
    """{snapshot: candidate table}, written below the folder; the first one tunes and freezes, the others only read what was frozen.

    cutoffs: one more than names. A table of a name replaces an older one; others below the folder stay.
    """
    spark, cuts = rows.sparkSession, cutoffs or snapshots.resolve_four_cutoffs(rows)
    out = {}
    for n, name in enumerate(names):
        now = Built(rows, cuts[n], cuts[n + 1])
        if n == 0:
            recalls = tune(now, items, grid, k)
            best = max(recalls, key=lambda x: (x[1], -x[0]))[0]
            freeze(spark, f"{folder}/weights", cuts, grid[best])
        weights = frozen(spark, f"{folder}/weights", cuts)
        versions.write(build(now, items, weights, k).withColumn("snapshot", F.lit(name)), f"{folder}/{name}")
        out[name] = versions.read(spark, f"{folder}/{name}")
    return out
