"""SimHash near-duplicates: 64-bit fingerprints, exact tiled comparison, groups by reachability.

A fingerprint bit is set when it is set in more than half of the XXH64 values
(seed 42) of a text's word 3-shingles. Equal fingerprints collapse first, so
copies cost nothing. Distinct fingerprints form tiles by the population counts
of their four 16-bit parts: two fingerprints within `radius` bits differ by at
most `radius` in the sum of those counts, so every other pair of tiles is
skipped. A tile holds at most about `tile_rows` values; larger cells are
salted into several tiles. Each pair of tiles is a row of its own, dealt by its
two cells and salts over as many tasks as its comparisons ask for, so that one
large cell is no task's alone.

Null and empty texts get fingerprint zero and link like any other. An empty
table gives no rows. Repeated rows stay repeated. Null ids never name a component:
one that has no id at all gets null. A very long text is taken whole, in one task.
Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, forget_kept, spanning_forest, table

PARTS = 4  # of 16 bits: at most 17 ** 4 cells, whatever the input


def fingerprint(text: str | None, words: int = 3) -> int:
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    h = np.fromiter(map(_xxh64, shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _xxh64(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, 42)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint's 64 bits as a signed long."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        forget_kept()
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, fp bigint")


def _offsets(radius: int) -> list[list[int]]:
    """Half of the cell differences within the radius, and zero."""
    every = [d for d in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return [list(d) for d in every if d >= (0,) * PARTS]


def tile_pairs(distinct: DataFrame, radius: int, tile_rows: int, task_comparisons: float = 1e9) -> DataFrame:
    """(own, fps_a, fps_b): the pairs of tiles to compare; `own` marks a tile with itself."""
    spark = distinct.sparkSession
    part = [F.expr(f"cast(bit_count(shiftrightunsigned(fp, {16 * k}) & 65535L) as int)") for k in range(PARTS)]
    cells = distinct.select("fp", F.array(*part).alias("cell"))
    sizes = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / tile_rows).cast("int")))  # at most 17 ** PARTS rows, by construction
    tiles = (
        cells.join(F.broadcast(sizes.select("cell", "salts")), "cell")
        .groupBy("cell", F.expr("cast(pmod(xxhash64(fp), salts) as int)").alias("salt"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    offsets = F.posexplode(F.array(*[F.array(*[F.lit(x) for x in d]) for d in _offsets(radius)])).alias("off", "d")
    zero = _offsets(radius).index([0] * PARTS)
    moved = lambda c, sign: F.expr(f"zip_with({c}, d, (x, y) -> x {sign} y)")
    other = sizes.select(F.col("cell").alias("at"), F.col("n").alias("m"), F.col("salts").alias("others"))
    work = sizes.select("cell", "n", offsets).withColumn("at", moved("cell", "+")).join(F.broadcast(other), "at").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, math.ceil((work or 0) / task_comparisons)))
    key, ordered = ["cell", "off", "salt_a", "salt_b"], f"off <> {zero} or salt_a <= salt_b"

    def side(sign: str, mine: str, theirs: str, fps: str) -> DataFrame:
        """Each tile once for each tile that it meets: as the first of a pair it looks up the cells ahead, as the second those behind."""
        met = tiles.select("cell", F.col("salt").alias(mine), F.col("fps").alias(fps), offsets).withColumn("at", moved("cell", sign)).join(F.broadcast(other), "at")
        met = met.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("others") - 1))).where(ordered)
        return met.select(F.col("at" if sign == "+" else "cell").alias("cell"), "off", "salt_a", "salt_b", fps).repartition(tasks, *key)

    pairs = side("+", "salt_a", "salt_b", "fps_a").join(side("-", "salt_b", "salt_a", "fps_b").hint("shuffle_hash"), key)
    return pairs.select(F.expr(f"off = {zero} and salt_a = salt_b").alias("own"), "fps_a", "fps_b")


def near_pairs(a: np.ndarray, b: np.ndarray, own: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between two tiles, thinned to a forest. `own`: b holds a's values, but in any order, as each side of the pairs gathers its tiles anew."""
    if own:
        b = a
    ii, jj = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        i += at
        if own:
            i, j = i[i < j], j[i < j]
        ii.append(i)
        jj.append(j)
    i, j = np.concatenate(ii), np.concatenate(jj)
    keep = spanning_forest(i, j, len(a)) if own else spanning_forest(i, j + len(a), len(a) + len(b))
    return a[i[keep]], b[j[keep]]


def links_within(distinct: DataFrame, radius: int = 3, tile_rows: int = 8192) -> DataFrame:
    """(a, b): links between distinct fingerprints at most `radius` bits apart, thinned to forests inside each tile pair."""
    pairs = tile_pairs(distinct, radius, tile_rows)

    def compare(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            (xa, oa), (xb, ob) = ((np.asarray(c.values).view(np.uint64), np.asarray(c.offsets)) for c in (batch.column(1), batch.column(2)))
            found = [near_pairs(xa[oa[k] : oa[k + 1]], xb[ob[k] : ob[k + 1]], own[k], radius) for k in range(batch.num_rows)]
            if any(len(a) for a, _ in found):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most `radius` bits, itself included."""
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    groups = connected_components(links_within(distinct.select("fp"), radius))
    labelled = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    component = labelled.join(labelled.groupBy("label").agg(F.min("first").alias("component")), "label").select("fp", "component")
    return prints.join(component, "fp").select("id", "fp", "component")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
