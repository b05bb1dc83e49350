"""k-core filtering, chronological splits and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitrec.sources.io import shared_dir

from .rounding import r6


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_frequent(rows: DataFrame, key: str, least: int) -> DataFrame:
    enough = rows.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") >= least).select(key)
    return rows.join(enough, key, "left_semi").select(*rows.columns)


def iterative_kcore(rows: DataFrame, min_user: int, min_item: int, first: str = "user", max_iter: int = 100) -> tuple[DataFrame, list[tuple]]:
    """(core, report): keeps users and items with enough rows, round by round, to a fixed point.

    A round filters one side, then the other, and is checkpointed, so plans stay
    flat. The report has a row a round: (round, users, items, rows, removed).
    The last round removes nothing; without a fixed point within `max_iter` rounds it raises.
    """
    order = [("user_id", min_user), ("item_id", min_item)]
    order = order if first == "user" else order[::-1]
    now, report = cut(rows), []
    before = now.count()
    for k in range(1, max_iter + 1):
        after = now
        for key, least in order:
            after = keep_frequent(after, key, least)
        now = cut(after)
        u, i, n = now.agg(F.countDistinct("user_id"), F.countDistinct("item_id"), F.count("*")).first()
        report.append((k, u, i, n, before - n))
        if n == before:
            break
        before = n
    else:
        raise RuntimeError(f"no fixed point after {max_iter} rounds")
    return now, report


def report_frame(spark, report: list[tuple]) -> DataFrame:
    return spark.createDataFrame(report, "round int, n_users long, n_items long, n_rows long, n_removed long")


def frame_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_rows"))


def leave_last_two(rows: DataFrame) -> DataFrame:
    """Adds `split`: a user's last row is test, the one before is val, the rest train; users with fewer than three rows go."""
    own = Window.partitionBy("user_id")
    ranked = rows.withColumns({"back": F.row_number().over(own.orderBy(F.desc("ts"), F.desc("item_id"))), "held": F.count("*").over(own)}).where("held >= 3")
    return ranked.withColumn("split", F.when(F.col("back") == 1, "test").when(F.col("back") == 2, "val").otherwise("train")).drop("back", "held")


def dropped_users(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("user_id").agg(F.count("*").alias("c"))
    return per.agg(F.count_if(F.col("c") < 3).alias("n_users_dropped"), F.coalesce(F.sum(F.when(F.col("c") < 3, F.col("c"))), F.lit(0)).alias("n_rows_dropped"))


def split_manifest(split: DataFrame) -> DataFrame:
    """Per split: sizes, label rate, time range, and how many of its distinct positive items the train rows contain."""
    train_items = split.where("split = 'train'").select("item_id").distinct().withColumn("known", F.lit(1))
    cover = split.where("label = 1").select("split", "item_id").distinct().join(train_items, "item_id", "left").groupBy("split").agg(F.count("*").alias("n_positive_items"), F.count("known").alias("n_known_items"))
    stats = split.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), r6(F.avg("label")).alias("label_rate"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    return stats.join(cover, "split", "left").withColumn("coverage", r6(F.col("n_known_items") / F.col("n_positive_items")))


def tie_rates(rows: DataFrame) -> DataFrame:
    """Users with two rows at one time, and users for whom a tie touches the boundaries among their last three rows."""
    own = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"))
    flagged = rows.select("user_id", F.row_number().over(own).alias("back"), (F.col("ts") == F.lead("ts").over(own)).alias("tied"))
    users = flagged.groupBy("user_id").agg(F.max(F.coalesce("tied", F.lit(False)).cast("int")).alias("any_tie"), F.max(F.when(F.col("back") <= 2, F.coalesce("tied", F.lit(False)).cast("int")).otherwise(0)).alias("edge_tie"))
    return users.agg(F.count("*").alias("n_users"), F.sum("any_tie").alias("n_any_tie"), F.sum("edge_tie").alias("n_edge_tie"), r6(F.avg("any_tie")).alias("any_tie_rate"), r6(F.avg("edge_tie")).alias("edge_tie_rate"))


def split_gate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts what two derivations of a split do not share; all zero if they agree."""
    keys = ["user_id", "item_id", "split"]
    left, right = a.select(*keys, F.lit(1).alias("in_a")), b.select(*keys, F.lit(1).alias("in_b"))
    both = left.join(right, keys, "full")
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count("*").alias("n_rows"))


def user_holdout(users: DataFrame, share: float = 0.2, seed: str = "holdout") -> DataFrame:
    """Adds `part` (train or held): the users of lowest hash, at least one, are held. Counts below a hash come from buckets, not from one sorted list."""
    hashed = users.select("user_id").distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("user_id").cast("string")))).withColumn("b", F.substring("h", 1, 3))
    sizes = hashed.groupBy("b").agg(F.count("*").alias("c"))  # at most 4096 rows
    running = sizes.withColumns({"before": F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("c").over(Window.partitionBy())})
    placed = hashed.join(F.broadcast(running), "b").withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h")))
    return placed.select("user_id", F.when(F.col("pos") <= F.greatest(F.floor(F.col("total") * share), F.lit(1)), "held").otherwise("train").alias("part"))
