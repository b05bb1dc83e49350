"""Total orders and exact quantiles without a task that sorts all rows.

Rows are range-partitioned and sorted within partitions; offsets come from the
partitions' sizes, a row each. The partitions are fixed by a reliable checkpoint,
so that places do not change when one of them is computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filtering import cut

POSITION = (1 << 33) - 1  # the part of a monotonically increasing id that counts within a partition


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows in order over partitions, with `__part` and, from 0 within it, `__at`. The order must be total for places to be fixed."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    return held.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND(POSITION)}).drop("__id")


def offsets(held: DataFrame, size: Column) -> DataFrame:
    """(__part, __before): the sum of `size` over the partitions before; a row a partition."""
    sizes = held.groupBy("__part").agg(size.alias("__size"))
    own = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__part", F.coalesce(F.sum("__size").over(own), F.lit(0)).alias("__before"))


def places(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds `place`, from 1, in a total order."""
    held = ranged(df, *order)
    return held.join(F.broadcast(offsets(held, F.count("*"))), "__part").withColumn("place", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def running(df: DataFrame, amount: str, *order: Column | str) -> DataFrame:
    """Adds `before`, the sum of `amount` over the rows before in a total order."""
    held = ranged(df, *order)
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(F.broadcast(offsets(held, F.sum(amount))), "__part")
    return out.withColumn("before", F.col("__before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("__part", "__at", "__before")


def grouped_quantiles(df: DataFrame, column: str, qs: list[float], by: str | None = None) -> dict:
    """{group: [value a q]}: exact linear-interpolated quantiles of each of a few groups (None if `by` is not given).

    Rows fold to counts by value; only the values around the wanted positions come to the driver.
    """
    keyed = df.select((F.col(by) if by else F.lit(None).cast("int")).alias("g"), F.col(column).cast("double").alias("v")).where("v is not null")
    held = running(keyed.groupBy("g", "v").agg(F.count("*").alias("n")), "n", F.asc_nulls_first("g"), "v")
    sizes = sorted(((r["g"], r["first"], r["n"]) for r in held.groupBy("g").agg(F.min("before").alias("first"), F.sum("n").alias("n")).collect()), key=lambda r: r[1])  # a row a group
    wanted = {first + min(int(q * (n - 1)) + k, n - 1) for _, first, n in sizes for q in qs for k in (0, 1)}
    if not wanted:
        return {}
    spots = df.sparkSession.createDataFrame([(p,) for p in sorted(wanted)], "p long")
    found = held.join(F.broadcast(spots), (F.col("p") >= F.col("before")) & (F.col("p") < F.col("before") + F.col("n")))  # two rows a quantile and group
    at = {r["p"]: r["v"] for r in found.select("p", "v").collect()}
    out = {}
    for g, first, n in sizes:
        out[g] = []
        for q in qs:
            x = q * (n - 1)
            low, high = at[first + int(x)], at[first + min(int(x) + 1, n - 1)]
            out[g].append(low + (high - low) * (x - int(x)))
    return out


def quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Exact linear-interpolated quantiles of a column; nulls if it has no values."""
    return grouped_quantiles(df, column, qs).get(None, [None] * len(qs))
