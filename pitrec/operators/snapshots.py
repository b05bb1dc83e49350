"""Point-in-time snapshots: cutoffs, histories, label windows and their statistics."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filtering import cut
from .rounding import r6

BUCKETS, FEW = 2048, 20_000


def iso_to_ms(text: str) -> int:
    """Epoch milliseconds; a time without a zone is UTC."""
    t = datetime.fromisoformat(text)
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return int(t.timestamp() * 1000)


def ms_to_iso(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, tz=timezone.utc).isoformat()


def _value_at(counts: DataFrame, lo: int, hi: int, rank: int) -> int:
    """The value at a position of the sorted values that (v, n) counts: equal-width buckets are narrowed until few values are left."""
    part = counts
    while hi - lo >= FEW:
        width = (hi - lo) // BUCKETS + 1
        sizes = sorted((r["k"], r["n"]) for r in part.groupBy(F.expr(f"(v - {lo}L) div {width}L").alias("k")).agg(F.sum("n").alias("n")).collect())  # at most BUCKETS
        for k, n in sizes:
            if rank < n:
                lo, hi = lo + k * width, min(hi, lo + (k + 1) * width - 1)
                part = counts.where(F.col("v").between(lo, hi))
                break
            rank -= n
    for v, n in sorted((r["v"], r["n"]) for r in part.collect()):  # below FEW
        if rank < n:
            return v
        rank -= n
    raise AssertionError("no such position")


def quantiles(rows: DataFrame, column: str, qs: list[float]) -> list[float]:
    """Exact linear-interpolated quantiles of whole numbers.

    Rows fold to counts by value. A few thousand values come to the driver; of
    more, only the buckets around each position do, and no task sorts them all.
    """
    counts = rows.select(F.col(column).cast("long").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    few = counts.limit(FEW + 1).collect()
    if not few:
        raise ValueError("no rows")
    if len(few) <= FEW:
        held = sorted((r["v"], r["n"]) for r in few)
        total = sum(n for _, n in held)

        def value(rank: int) -> int:
            for v, n in held:
                if rank < n:
                    return v
                rank -= n
            raise AssertionError("no such position")

    else:
        counts = cut(counts)
        lo, hi, total = counts.agg(F.min("v"), F.max("v"), F.sum("n")).first()
        value = lambda rank: _value_at(counts, lo, hi, rank)
    out = []
    for q in qs:
        at = q * (total - 1)
        a = value(int(at))
        out.append(a + (value(min(int(at) + 1, total - 1)) - a) * (at - int(at)))
    return out


def resolve_cutoffs(rows: DataFrame, dates: list[str] | None = None, qs=(0.8, 0.9)) -> list[int]:
    """Cutoffs and the end: explicit dates, or truncated quantiles of the times; the end is the last time + 1 ms."""
    cuts = [iso_to_ms(d) for d in dates] if dates else [int(x) for x in quantiles(rows, "ts", list(qs))]
    cuts.append(int(rows.agg(F.max("ts")).first()[0]) + 1)
    if any(a >= b for a, b in zip(cuts[:-2], cuts[1:-1])) or cuts[-2] > cuts[-1]:
        raise ValueError(f"cutoffs are not in order: {cuts}")
    return cuts


def resolve_four_cutoffs(rows: DataFrame, dates: list[str | None] | None = None, qs=(0.7, 0.8, 0.9)) -> list[int]:
    """T0 to T3, strictly increasing; some but not all dates given is an error."""
    if dates and any(d is None for d in dates) and not all(d is None for d in dates):
        raise ValueError("give all dates or none")
    cuts = resolve_cutoffs(rows, dates if dates and dates[0] else None, qs)
    if any(a >= b for a, b in zip(cuts[:-1], cuts[1:])):
        raise ValueError(f"cutoffs are not in order: {cuts}")
    return cuts


def bounds_frame(spark, bounds: list[tuple[str, int, int]]) -> DataFrame:
    """(snapshot, cutoff, end), a row a snapshot."""
    return spark.createDataFrame(bounds, "snapshot string, cutoff long, end long")


def first_positives(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A user's earliest positive; ties by item."""
    own = Window.partitionBy(*(by or []), "user_id").orderBy("ts", "item_id")
    return rows.where("label = 1").withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn")


def all_positives(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The distinct positive (user, item) pairs, the earliest row of each."""
    own = Window.partitionBy(*(by or []), "user_id", "item_id").orderBy("ts", "rating")
    return rows.where("label = 1").withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn")


def history(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows strictly before each snapshot's cutoff, in one pass over the rows; histories nest."""
    return rows.join(F.broadcast(bounds.select("snapshot", "cutoff")), F.col("ts") < F.col("cutoff"))  # a row a snapshot


def window(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of each snapshot's label window [cutoff, end)."""
    return rows.join(F.broadcast(bounds), (F.col("ts") >= F.col("cutoff")) & (F.col("ts") < F.col("end"))).drop("end")


def eligible_items(hist: DataFrame, least: int = 5) -> DataFrame:
    return hist.groupBy("snapshot", "item_id").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least).select("snapshot", "item_id")


def annotate(labels: DataFrame, hist: DataFrame, least_item: int = 5, least_user: int = 3) -> DataFrame:
    """Labels with n_history_events, item_in_history, item_in_eligible_pool, is_warm_user; nobody is dropped."""
    users = hist.groupBy("snapshot", "user_id").agg(F.count("*").alias("n_history_events"))
    items = hist.groupBy("snapshot", "item_id").agg(F.count("*").alias("n_item"))
    out = labels.join(users, ["snapshot", "user_id"], "left").join(items, ["snapshot", "item_id"], "left")
    n, k = F.coalesce("n_history_events", F.lit(0)), F.coalesce("n_item", F.lit(0))
    return out.withColumns({"n_history_events": n, "item_in_history": (k > 0).cast("int"), "item_in_eligible_pool": (k >= least_item).cast("int"), "is_warm_user": (n >= least_user).cast("int")}).drop("n_item")


def ground_truth(rows: DataFrame, bounds: DataFrame, mode: str = "all", least_item: int = 5, least_user: int = 3) -> DataFrame:
    """The label frame of each snapshot; mode is `first` or `all` positives."""
    inside = window(rows, bounds)
    labels = first_positives(inside, ["snapshot"]) if mode == "first" else all_positives(inside, ["snapshot"])
    return annotate(labels, history(rows, bounds), least_item, least_user).drop("cutoff")


def snapshot_stats(rows: DataFrame, bounds: DataFrame, truth: DataFrame) -> DataFrame:
    """Sizes, distinct users, and coverage of the label items, pooled and as a mean over users."""
    hist = history(rows, bounds)
    h = hist.groupBy("snapshot").agg(F.count("*").alias("n_history"), F.countDistinct("user_id").alias("n_history_users"), F.countDistinct("item_id").alias("n_history_items"))
    users = truth.groupBy("snapshot", "user_id").agg(F.count("*").alias("n"), F.sum("item_in_history").alias("seen"), F.sum("item_in_eligible_pool").alias("pool"), F.max("is_warm_user").alias("warm"))
    t = users.groupBy("snapshot").agg(
        F.count("*").alias("n_users"), F.sum("n").alias("n_pairs"), F.sum("warm").alias("n_warm_users"),
        r6(F.avg(F.col("seen") / F.col("n"))).alias("history_rate"), r6(F.sum("seen") / F.sum("n")).alias("history_rate_per_positive"),
        r6(F.avg(F.col("pool") / F.col("n"))).alias("eligible_rate"), r6(F.sum("pool") / F.sum("n")).alias("eligible_rate_per_positive"),
    )
    return h.join(t, "snapshot", "left")


def label_checks(first: DataFrame, every: DataFrame) -> DataFrame:
    """Counts that must be zero: first labels not among all, repeated pairs, users in one frame only."""
    keys = ["snapshot", "user_id", "item_id"]
    a = first.join(every, keys, "left_anti").agg(F.count("*").alias("first_not_in_all"))
    b = every.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("repeated_pairs"))
    u, v = first.select("snapshot", "user_id").distinct(), every.select("snapshot", "user_id").distinct()
    c = u.join(v, ["snapshot", "user_id"], "left_anti").unionByName(v.join(u, ["snapshot", "user_id"], "left_anti")).agg(F.count("*").alias("users_differ"))
    return reduce(lambda x, y: x.crossJoin(y), [a, b, c])  # one row each


def assert_before(rows: DataFrame, as_of: int) -> DataFrame:
    """The rows, which raise when read if one is not strictly before the time."""
    ok = F.when(F.col("ts") >= as_of, F.raise_error(F.concat(F.lit("row at or after the cutoff: "), F.col("ts").cast("string")))).otherwise(F.col("ts"))
    return rows.withColumn("ts", ok)
