"""Embedding near-duplicates: p-stable hashing in several tables, then exact cosines.

A unit vector's place along a Gaussian direction, shifted and divided into
steps of `width`, is one hash; `k` hashes make a bucket key, and there are
`tables` keys. k follows from the number of vectors and the wished bucket
size, the number of tables from the wished recall at the limit, both through
the collision probability of the p-stable scheme for Euclidean distance.
Vectors that share a bucket are compared exactly, in double precision. A pair
counts in the first table that holds it, so nothing is counted twice and pairs
are never listed: a bucket gives counts by vector and a spanning forest.

Equal vectors form one class beforehand, linked among themselves. Classes have
numbers of their own, fixed by a checkpoint; ids are looked up at the end, so rows
that share an id, or have none, are vectors like any other. Buckets
above `block` are salted into blocks and all pairs of blocks are compared. A
vector travels once a table, beside its place and nothing else: which earlier table
held a pair is found by hashing those vectors again that have a link.
Null vectors, zero vectors and those with null or non-finite components link
with nothing, nor do vectors of another length. Vectors are scaled by powers of
two before squares are taken, so that large and tiny magnitudes link as others do.
Repeated ids stay repeated, each row with the links of its own vector. Null ids
never name a component: one that has no id at all gets null, and its rows keep
themselves. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, connected_components, cut, forget_kept, spanning_forest, table


def collision(distance: float, width: float) -> float:
    """The chance that one p-stable hash puts two vectors at this distance into the same step."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, widths=(1.5, 2.0, 2.5, 3.0), bucket: int = 256, recall: float = 0.985) -> tuple[int, int, float]:
    """(hashes a key, tables, width): the fewest tables that the widths give."""
    found = []
    for width in widths:
        near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
        k = max(2, round(math.log(max(n / bucket, 1)) / -math.log(far)))
        found.append((max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k))), k, width))
    tables, k, width = min(found)
    return k, tables, width


class Hashes:
    """The p-stable hashes of all tables; equal for a vector in whatever batch it is."""

    def __init__(self, dim: int, k: int, tables: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.directions, self.shifts = rng.normal(size=(dim, tables * k)), rng.uniform(0, width, tables * k)
        self.factors = rng.integers(1, 1 << 62, size=k, dtype=np.int64) * 2 + 1
        self.k, self.width = k, width

    def keys(self, unit: np.ndarray, tables: int) -> np.ndarray:
        """A key for each unit vector in each of the first `tables` tables."""
        n = tables * self.k
        directions, shifts = self.directions[:, :n], self.shifts[:n]
        place = (unit @ directions + shifts) / self.width
        steps = np.floor(place)
        # a matrix product's last digits may differ with its shape: places at the edge of a step are computed one by one
        for i, j in np.argwhere(np.abs(place - np.rint(place)) < 1e-9):
            steps[i, j] = math.floor(((unit[i] * directions[:, j]).sum() + shifts[j]) / self.width)
        return (steps.astype(np.int64).reshape(-1, tables, self.k) * self.factors).sum(axis=2)


def _unit(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values, ends = np.asarray(batch.values, dtype=np.float64), np.asarray(batch.offsets)
    dim = int(ends[1] - ends[0]) if len(ends) > 1 else 0
    x = values[ends[0] : ends[-1]].reshape(-1, dim)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])  # exact
    return x, x / np.sqrt((x * x).sum(axis=1))[:, None]


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, cls, size, least): equal usable vectors once, with a number, the rows that hold it and their smallest id."""
    usable = f"vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)"
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where(usable)
    distinct = src.groupBy("vec").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    return cut(distinct.select("vec", F.monotonically_increasing_id().alias("cls"), "size", "least"))


def bucketed(distinct: DataFrame, hashes: Hashes, tables: int) -> DataFrame:
    """(tab, key, cls, size, vec): each vector once a table."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            _, unit = _unit(batch.column(0))
            keys = hashes.keys(unit, tables)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["vec", "cls", "size", "keys"])

    kind = dict(distinct.dtypes)
    hashed = distinct.select("vec", "cls", "size").mapInArrow(run, f"vec {kind['vec']}, cls {kind['cls']}, size bigint, keys array<bigint>")
    return hashed.select(F.posexplode("keys").alias("tab", "key"), "cls", "size", "vec")


def compare(rows: DataFrame, hashes: Hashes, cosine: float, block: int) -> DataFrame:
    """(a, b, n): counts (b null: n vectors linked with a) and links that hold the groups together (n is 0)."""
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("held"))
    busy = cut(sizes.where("held > 1"))
    hot = busy.where(F.col("held") > block).select("tab", "key", F.ceil(F.col("held") / block).cast("int").alias("salts"))
    salted = (
        rows.join(bounded_broadcast(hot, hot.count()), ["tab", "key"], "left")
        .withColumn("salts", F.coalesce("salts", F.lit(1)))
        .withColumn("salt", F.expr("cast(pmod(xxhash64(cls, 17), salts) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, salts - 1)")))
        .select("tab", "key", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "salt", "cls", "size", "vec")
    )
    placed = salted.repartition("tab", "key", "lo", "hi").sortWithinPartitions("tab", "key", "lo", "hi", "salt", "cls")

    def one(group: pa.Table, out: list) -> None:
        n = group.num_rows
        if n < 2:
            return
        tab, lo, hi = (group.column(c)[0].as_py() for c in ("tab", "lo", "hi"))
        salt = group.column("salt").to_numpy()
        vec, cls, size = group.column("vec").combine_chunks(), group.column("cls").to_numpy(), group.column("size").to_numpy()
        lengths = np.diff(np.asarray(vec.offsets))
        if (lengths != lengths[0]).any():
            raise ValueError("vectors of different lengths in one bucket")
        x, unit = _unit(vec)
        norm = np.sqrt((x * x).sum(axis=1))
        found_i, found_j, step = [], [], max(1, (1 << 21) // n)
        keys, hashed = None, np.zeros(n, dtype=bool)  # in the tables before, of vectors that have a link
        for at in range(0, n, step):
            near = (x[at : at + step] @ x.T) / (norm[at : at + step, None] * norm[None, :]) >= cosine
            i, j = np.nonzero(near)
            i += at
            ok = i < j
            if lo != hi:
                ok &= salt[i] != salt[j]
            i, j = i[ok], j[ok]
            if tab and len(i):
                if keys is None:
                    keys = np.zeros((n, tab), dtype=np.int64)
                linked = np.zeros(n, dtype=bool)
                linked[i] = linked[j] = True
                fresh = np.flatnonzero(linked & ~hashed)
                hashed |= linked
                for q in range(0, len(fresh), 1024):
                    keys[fresh[q : q + 1024]] = hashes.keys(unit[fresh[q : q + 1024]], tab)
                new = np.ones(len(i), dtype=bool)
                most = max(1, (1 << 23) // tab)
                for q in range(0, len(i), most):
                    new[q : q + most] = ~(keys[i[q : q + most]] == keys[j[q : q + most]]).any(axis=1)
                i, j = i[new], j[new]
            found_i.append(i)
            found_j.append(j)
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        if not len(i):
            return
        n_links = np.bincount(i, weights=size[j], minlength=n) + np.bincount(j, weights=size[i], minlength=n)
        some = np.flatnonzero(n_links)
        keep = spanning_forest(i, j, n)
        a = np.concatenate([cls[some], cls[i[keep]]])
        b = np.ma.concatenate([np.ma.masked_all(len(some), dtype=cls.dtype), cls[j[keep]]])
        c = np.concatenate([n_links[some].astype(np.int64), np.zeros(len(keep), dtype=np.int64)])
        out.append(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.filled(0), mask=np.ma.getmaskarray(b)), pa.array(c)], names=["a", "b", "n"]))

    def run(batches):
        forget_kept()
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            place = np.stack([held.column(c).to_numpy() for c in ("tab", "key", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1)]
            out: list = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1:
                    one(held.slice(a, b - a), out)
            yield from out
            held = held.slice(cuts[-1])  # the last group may go on in the next batch
        if held is not None:
            out = []
            one(held, out)
            yield from out

    kind = dict(rows.dtypes)["cls"]
    return placed.mapInArrow(run, f"a {kind}, b {kind}, n bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, bucket: int = 256, recall: float = 0.985, block: int = 384) -> DataFrame:
    """(id, n_links, component): other vectors linked directly, and the smallest id reachable, itself included; a row a vector."""
    distinct = classes(vectors, id_col, vector_col)
    shape = distinct.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()
    found = None
    for row in shape:  # vectors of different lengths do not link
        k, tables, width = plan(row["n"], cosine, bucket=bucket, recall=recall)
        hashes = Hashes(row["dim"], k, tables, width)  # grows with the logarithm of the rows
        part = compare(bucketed(distinct.where(F.size("vec") == row["dim"]), hashes, tables), hashes, cosine, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = distinct.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(0).cast("bigint").alias("n")).limit(0)
    found = cut(found)
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    groups = cut(connected_components(found.where("b is not null").select("a", "b")))
    named = groups.join(distinct.select(F.col("cls").alias("node"), "least"), "node")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    known = (
        distinct.select(F.col("vec").alias("__vec"), "cls", "size", "least")
        .join(counts, "cls", "left")
        .join(groups.join(smallest, "component").select(F.col("node").alias("cls"), "smallest", F.lit(True).alias("grouped")), "cls", "left")
        .select("__vec", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.when(F.col("grouped"), F.col("smallest")).otherwise(F.col("least")).alias("component"), F.lit(True).alias("usable"))
    )
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("__vec"))
    return src.join(known, "__vec", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("usable"), F.col("component")).otherwise(F.col("id")).alias("component"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


# All pairs of the small table, by brute force.
OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), n AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS len FROM v
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id
  WHERE list_inner_product(x.e, y.e) / (x.len * y.len) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT c.node AS vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, c.node = c.component_id AS kept
FROM comp c LEFT JOIN deg d ON d.a = c.node
"""
