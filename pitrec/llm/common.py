"""Reading tables, cutting lineage and grouping linked rows; shared by the corpus operators."""

from __future__ import annotations

import ctypes
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import pitrec

cloudpickle.register_pickle_by_value(pitrec)  # executors need no copy of this package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver's JVM ends."""
    place = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive a lost executor and the plan starts anew."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, n_rows: int, limit: int = 200_000) -> DataFrame:
    """A broadcast hint only when the counted rows are within the limit; else Spark plans a shuffled join."""
    return F.broadcast(df) if n_rows <= limit else df


def spanning_forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of the links (i, j) that keep the same groups among n nodes with at most n - 1 links."""
    if len(i) <= 1:
        return np.arange(len(i))
    parent, kept, at = np.arange(n), [], np.arange(len(i))
    a, b = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)
    while len(at):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((lo, hi))
        first = order[np.r_[True, hi[order][1:] != hi[order][:-1]]]
        kept.append(at[first])
        parent[hi[first]] = lo[first]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b, at = a[open_], b[open_], at[open_]
    return np.concatenate(kept)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of `links`; component is the smallest node that it reaches.

    Alternating large-star and small-star steps: each is a grouped minimum and an
    equi-join, rounds grow with the logarithm of the size, and no group of links
    or labels is gathered anywhere. Nulls and self-links are ignored; no links
    give no rows.
    """
    edges = cut(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = cut(small)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def kept_in_worker(key: tuple, make: Callable):
    """One object for all tasks of a Python worker, such as a tokenizer and its memo; the one before it goes."""
    held = vars(sys).setdefault("_pitrec_worker", {})
    if key not in held:
        held.clear()
        give_back()
        held[key] = make()
    return held[key]


def forget_kept() -> None:
    """Frees what earlier tasks of this worker kept, and gives unused memory back."""
    vars(sys).pop("_pitrec_worker", None)
    give_back()


def give_back() -> None:
    """Idle workers would otherwise hold what their last task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def share(spark: SparkSession, thing) -> Callable:
    """Broadcasts a small object; the function gives it back on an executor."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 21):
    """Parts of a batch with about `most` bytes in a text column, so that Python holds few of its texts at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
