"""Profiling aggregations: histograms, percentiles, overlaps, facet statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitrec.functions.expressions import helpful_bin

from .order import quantiles
from .rounding import r6


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("user_id").alias("n_users"))


def stream_stats(rows: DataFrame) -> DataFrame:
    """(section, bin, n): totals, the rating histogram clipped to 1-5, helpful votes in five bins. One pass over the rows for the histograms."""
    rating = F.greatest(F.least(F.round("rating").cast("int"), F.lit(5)), F.lit(1)).cast("string")
    long = rows.select(F.explode(F.array(F.struct(F.lit("rating").alias("section"), rating.alias("bin")), F.struct(F.lit("helpful").alias("section"), helpful_bin(F.col("helpful")).alias("bin")))).alias("x"))
    bins = long.groupBy("x.section", "x.bin").agg(F.count("*").alias("n"))
    t = totals(rows).select(F.expr("stack(3, 'rows', n_rows, 'items', n_items, 'users', n_users) as (bin, n)")).select(F.lit("total").alias("section"), "bin", "n")
    return bins.unionByName(t)


def count_percentiles(rows: DataFrame, key: str, qs=(0.2, 0.5, 0.9, 0.99)) -> DataFrame:
    """Linear-interpolated percentiles of the rows per key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    names = ", ".join(f"p{round(100 * q)} double" for q in qs)
    return rows.sparkSession.createDataFrame([tuple(quantiles(counts, "n", list(qs)))], names)


def filtering_table(rows: DataFrame, item_grid, user_grid) -> DataFrame:
    """For each pair of thresholds the surviving items and users, and the reviews of surviving items (an upper bound).

    Counts per key collapse to a histogram of counts first, so the grid meets a few rows.
    """

    def survivors(key: str, grid, name: str) -> DataFrame:
        hist = rows.groupBy(key).agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("k"))
        aggs = [F.coalesce(F.sum(F.when(F.col("c") >= g, F.col("k"))), F.lit(0)).alias(f"k{g}") for g in grid]
        aggs += [F.coalesce(F.sum(F.when(F.col("c") >= g, F.col("k") * F.col("c"))), F.lit(0)).alias(f"r{g}") for g in grid]
        stacked = ", ".join(f"{g}, k{g}, r{g}" for g in grid)
        return hist.agg(*aggs).select(F.expr(f"stack({len(grid)}, {stacked}) as (min_{name}, n_{name}s, r_{name})"))

    items, users = survivors("item_id", item_grid, "item"), survivors("user_id", user_grid, "user")
    return items.crossJoin(F.broadcast(users)).select("min_item", "min_user", "n_items", "n_users", F.col("r_item").alias("est_reviews"))  # the grid


def bought_together_rate(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Users who have an item from the co-purchase list of another of their items. lists: (item_id, others array)."""
    pairs = lists.select("item_id", F.explode("others").alias("other")).distinct()
    own = rows.select("user_id", "item_id").distinct()
    hit = own.join(pairs, "item_id").select("user_id", F.col("other").alias("item_id")).join(own, ["user_id", "item_id"], "left_semi").select("user_id").distinct()
    able = own.join(pairs.select("item_id").distinct(), "item_id", "left_semi").select("user_id").distinct()
    flags = own.select("user_id").distinct().join(hit.withColumn("hit", F.lit(1)), "user_id", "left").join(able.withColumn("able", F.lit(1)), "user_id", "left")
    n, h, a = F.count("*"), F.count("hit"), F.count("able")
    return flags.agg(n.alias("n_users"), h.alias("n_hit"), a.alias("n_able"), r6(h / n).alias("rate"), r6(h / F.nullif(a, F.lit(0))).alias("conditional_rate"))


def category_overlap(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, a, b, n): users per category, users by number of categories, users of each pair of categories, all users."""
    own = rows.join(items.select("item_id", "main_category"), "item_id").select("user_id", "main_category").distinct()
    sets = own.groupBy("user_id").agg(F.array_sort(F.collect_set("main_category")).alias("cats"))
    each = F.transform("cats", lambda c: F.struct(F.lit("users").alias("kind"), c.alias("a"), F.lit("").alias("b")))
    size = F.array(F.struct(F.lit("n_categories").alias("kind"), F.size("cats").cast("string").alias("a"), F.lit("").alias("b")), F.struct(F.lit("union").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b")))
    pairs = F.flatten(F.transform("cats", lambda a: F.transform(F.filter("cats", lambda b: b > a), lambda b: F.struct(F.lit("pair").alias("kind"), a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(F.concat(each, size, pairs)).alias("x")).groupBy("x.kind", "x.a", "x.b").agg(F.count("*").alias("n"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate, empty, non_empty, mean_length, max_length) in one pass; list statistics are null for other columns."""
    kinds, n, aggs, rows = dict(df.dtypes), F.count("*"), [], []
    for c in columns:
        is_list = kinds[c].startswith("array")
        size = F.size(c) if is_list else F.lit(None).cast("int")
        aggs += [r6(F.count_if(F.col(c).isNull()) / n).alias(f"{c}_0"), F.count_if(size == 0).alias(f"{c}_1"), F.count_if(size > 0).alias(f"{c}_2"), r6(F.avg(size)).alias(f"{c}_3"), F.max(size).cast("long").alias(f"{c}_4")]
        blank = "" if is_list else "cast(null as bigint)"
        rows.append(f"'{c}', {c}_0, {blank or f'{c}_1'}, {blank or f'{c}_2'}, {c}_3, {c}_4")
    return df.agg(*aggs).select(F.expr(f"stack({len(columns)}, {', '.join(rows)}) as (column_name, null_rate, empty, non_empty, mean_length, max_length)"))


def schema_report(df: DataFrame, columns: list[str], canonical: DataFrame, features: list[str]) -> DataFrame:
    """The summary of all rows and of the canonical ones, with the share of non-zero values of the features."""

    def one(scope: str, rows: DataFrame) -> DataFrame:
        n = F.count("*")
        nonzero = rows.agg(*[r6(F.count_if(F.col(c) != 0) / n).alias(c) for c in features]).select(F.expr(f"stack({len(features)}, {', '.join(f"'{c}', {c}" for c in features)}) as (column_name, nonzero_rate)"))
        return column_summary(rows, columns).join(nonzero, "column_name", "left").withColumn("scope", F.lit(scope))

    return one("all", df).unionByName(one("canonical", df.join(canonical.select("item_id").distinct(), "item_id", "left_semi")))


def preflight(df: DataFrame, columns: list[str]) -> None:
    """Raises if a list column is empty in every row."""
    row = df.agg(*[F.max(F.coalesce(F.size(c), F.lit(0))).alias(c) for c in columns]).first()
    dead = [c for c in columns if not row[c]]
    if dead:
        raise ValueError(f"always empty: {', '.join(dead)}")


def entropy(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    total = F.sum("__n")
    return counts.agg(r6(F.log2(total) - F.sum(F.col("__n") * F.log2("__n")) / total).alias("entropy_bits"))


def facet_distribution(df: DataFrame, facet: str, top: int = 20) -> DataFrame:
    """One row: values, largest share, entropy, and the tail sizes; see `facet_top` for the head."""
    counts = df.groupBy(facet).agg(F.count("*").alias("__n"))
    total = F.sum("__n")
    return counts.agg(F.count("*").alias("n_unique"), r6(F.max("__n") / total).alias("max_share"), r6(F.log2(total) - F.sum(F.col("__n") * F.log2("__n")) / total).alias("entropy_bits"), F.count_if(F.col("__n") == 1).alias("n_singletons"), F.count_if(F.col("__n") < 5).alias("n_below_5"))


def facet_top(df: DataFrame, facet: str, top: int = 20) -> DataFrame:
    """(rank, value, n): the most frequent values, ties by value."""
    counts = df.groupBy(F.col(facet).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def facet_match(train: DataFrame, held: DataFrame, items: DataFrame, facet: str) -> DataFrame:
    """Of the held-out positives, those whose facet the user already has: pooled rate, and mean and median of the users' rates."""
    f = items.select("item_id", F.col(facet).alias("facet"))
    seen = train.where("label = 1").join(f, "item_id").select("user_id", "facet").distinct().withColumn("hit", F.lit(1))
    pairs = held.where("label = 1").join(f, "item_id").join(seen, ["user_id", "facet"], "left")
    users = pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.count("hit").alias("h")).withColumn("rate", F.col("h") / F.col("n"))
    return users.agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_users"), r6(F.sum("h") / F.sum("n")).alias("micro"), r6(F.avg("rate")).alias("macro_mean"), r6(F.median("rate")).alias("macro_median"))


def rating_by_helpful(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rating").agg(r6(F.avg("helpful")).alias("mean_helpful"), r6(F.median("helpful")).alias("median_helpful"), F.count("*").alias("n"))


def positive_rate_histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n_users): users by the tenth in which their positive rate lies; 1 is in the last."""
    users = rows.groupBy("user_id").agg((F.sum("label") * bins).alias("s"), F.count("*").alias("n"))
    return users.groupBy(F.least(F.floor(F.col("s") / F.col("n")), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n_users"))


def split_consistency(splits: dict[str, DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("split"), "user_id", "item_id", "label", "rating") for s, df in splits.items()])
    return every.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), r6(F.avg("label")).alias("label_rate"), r6(F.avg("rating")).alias("mean_rating"))


def dedup_summary(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("user_id", "item_id").agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_pairs"), (F.sum("c") - F.count("*")).alias("n_dropped"), F.count_if(F.col("c") > 1).alias("n_repeated_pairs"))


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.expr(f"stack({len(columns)}, {', '.join(f"'{c}', {c}" for c in columns)}) as (column_name, n_missing)"))
