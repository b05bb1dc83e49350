"""User, item and sequence features, and the transforms that models read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitrec.functions.expressions import DAY_MS, list_length, price

from .order import places, quantiles
from .rounding import r6


def _user_aggs() -> dict[str, Column]:
    return {
        "n_interactions": F.count("*"),
        "mean_rating": r6(F.avg("rating")),
        "std_rating": r6(F.coalesce(F.stddev_samp("rating"), F.lit(0.0))),
        "n_items": F.countDistinct("item_id"),
        "span_days": r6((F.max("ts") - F.min("ts")) / float(DAY_MS)),
        "verified_sum": F.sum(F.col("verified").cast("int")),
        "verified_rate": r6(F.avg(F.col("verified").cast("int"))),
        "helpful_mean": r6(F.avg("helpful")),
        "helpful_sum": F.sum("helpful"),
    }


def _named(aggs: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in aggs.items()]


def with_defaults(rows: DataFrame) -> DataFrame:
    """Fills source columns that are missing, so that the feature columns are always the same."""
    fill = {"verified": F.lit(False), "helpful": F.lit(0)}
    return rows.withColumns({c: x for c, x in fill.items() if c not in rows.columns})


def user_features(train: DataFrame) -> DataFrame:
    """One aggregate a user; the deviation is the sample's, 0 for a single row."""
    return with_defaults(train).groupBy("user_id").agg(*_named(_user_aggs()))


def user_features_at(hist: DataFrame, as_of: int, recent_days: int = 30) -> DataFrame:
    """User features of a history, with recency and the counts in the last days before the cutoff."""
    recent = F.col("ts") >= as_of - recent_days * DAY_MS
    aggs = _user_aggs() | {
        "days_since_last": r6((F.lit(as_of) - F.max("ts")) / float(DAY_MS)),
        "recent_interactions": F.count_if(recent),
        "recent_positives": F.count_if(recent & (F.col("label") == 1)),
    }
    return with_defaults(hist).groupBy("user_id").agg(*_named(aggs))


def item_features(items: DataFrame, train: DataFrame, filtered: DataFrame) -> DataFrame:
    """Catalog columns, training aggregates and membership flags of every item; price flags come before the median fill."""
    priced = items.select("item_id", "store", "main_category", F.coalesce("rating_number", F.lit(0)).alias("rating_number"), price(F.col("price")).alias("price"), list_length(F.col("categories")).alias("n_categories"))
    (median,) = quantiles(priced, "price", [0.5])
    aggs = with_defaults(train).groupBy("item_id").agg(F.count("*").alias("n_reviews"), r6(F.avg("rating")).alias("avg_rating"), F.sum("label").alias("n_positive"), r6(F.avg(F.col("verified").cast("int"))).alias("verified_rate"))
    universe = filtered.select("item_id").distinct().withColumn("in_filtered", F.lit(1))
    out = priced.withColumn("median_price", F.lit(median).cast("double")).join(aggs, "item_id", "left").join(universe, "item_id", "left")
    zero = F.lit(0)
    return out.select(
        "item_id", "store", "main_category", "rating_number",
        F.col("price").isNull().cast("int").alias("price_missing"),
        r6(F.coalesce("price", "median_price", F.lit(0.0))).alias("price"),
        "n_categories",
        F.coalesce("n_reviews", zero).alias("n_reviews"),
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce("n_positive", zero).alias("n_positive"),
        F.coalesce("verified_rate", F.lit(0.0)).alias("verified_rate"),
        F.col("n_reviews").isNotNull().cast("int").alias("in_train_catalog"),
        (F.coalesce("n_positive", zero) > 0).cast("int").alias("in_train_positive_catalog"),
        F.coalesce("in_filtered", zero).alias("in_filtered_universe"),
    )


def item_features_at(items: DataFrame, hist: DataFrame, least: int = 5) -> DataFrame:
    """Statics and history aggregates; the whole catalog stays, with 0 for items without history."""
    statics = items.select("item_id", "store", "main_category", F.coalesce("rating_number", F.lit(0)).alias("rating_number"), list_length(F.col("categories")).alias("n_categories"))
    aggs = with_defaults(hist).groupBy("item_id").agg(F.count("*").alias("n"), r6(F.avg("rating")).alias("avg"), F.sum("label").alias("pos"), F.countDistinct("user_id").alias("users"), F.max("ts").alias("last_ts"))
    zero = F.lit(0)
    return statics.join(aggs, "item_id", "left").select(
        "item_id", "store", "main_category", "rating_number", "n_categories",
        F.coalesce("n", zero).alias("n_reviews_hist"), F.coalesce("avg", F.lit(0.0)).alias("avg_rating_hist"), F.coalesce("pos", zero).alias("n_positive_hist"), F.coalesce("users", zero).alias("n_users_hist"),
        F.col("n").isNotNull().cast("int").alias("in_history"), (F.coalesce("n", zero) >= least).cast("int").alias("in_eligible_pool"),
    )


def category_path(lists: DataFrame) -> DataFrame:
    """(item_id, path): an item's longest category list, ties by the list itself, joined with ` | `."""
    best = lists.groupBy("item_id").agg(F.min(F.struct((-list_length(F.col("categories"))).alias("o"), "categories")).alias("b"))
    return best.select("item_id", F.coalesce(F.array_join("b.categories", " | "), F.lit("")).alias("path"))


def top_facet(rows: DataFrame, items: DataFrame, facet: str) -> DataFrame:
    """(user_id, top): the most frequent facet among a user's positives, ties alphabetical."""
    counts = rows.where("label = 1").join(items.select("item_id", F.col(facet).alias("f")), "item_id").where("f is not null").groupBy("user_id", "f").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "f")).alias("b")).select("user_id", F.col("b.f").alias("top"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, idx): sorted distinct values from 1; 0 is kept for padding and unseen values."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return places(values, "value").select("value", F.col("place").cast("int").alias("idx"))


def encode(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    return df.join(vocab.select(F.col("value"), F.col("idx").alias(out)), df[column].cast("string") == F.col("value"), "left").drop("value").withColumn(out, F.coalesce(out, F.lit(0)))


def scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """log1p of the value floored at 0, then z-scores with the population deviation (1 if it is at most 1e-9)."""
    value = {c: F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in columns}
    stats = (fit_on if fit_on is not None else df).agg(*[F.avg(value[c]).alias(f"{c}_m") for c in columns], *[F.stddev_pop(value[c]).alias(f"{c}_s") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    fixed = {c: F.when(F.col(f"{c}_s") <= 1e-9, 1.0).otherwise(F.col(f"{c}_s")) for c in columns}
    return out.withColumns({c: r6((value[c] - F.col(f"{c}_m")) / fixed[c]) for c in columns}).drop(*[f"{c}_{k}" for c in columns for k in "ms"])


def assemble(df: DataFrame, base: list[str], pattern: str = r"^(source_|.*_rank$|.*_score$)") -> tuple[DataFrame, list[str]]:
    """Adds the `features` vector of the base columns and of every discovered source column, nulls as 0."""
    import re

    from pyspark.ml.feature import VectorAssembler

    extra = [c for c in df.columns if re.search(pattern, c) and c not in base]
    columns = [*base, *extra]
    filled = df.fillna(0, subset=columns)
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled), columns


GAP_DAYS = (1, 7, 30, 90, 365)


def gap_bucket(ms: Column) -> Column:
    days = ms / float(DAY_MS)
    out = F.lit(len(GAP_DAYS) + 1)
    for k, d in reversed(list(enumerate(GAP_DAYS))):
        out = F.when(days < d, k + 1).otherwise(out)
    return out.cast("int")


def sequences(hist: DataFrame, items: DataFrame, vocab: DataFrame, cutoff: int, length: int = 20) -> DataFrame:
    """(user_id, events): the last events in order; item index (1 is unseen), month, bucket of the gap to the next event or the cutoff, rating."""
    own = Window.partitionBy("user_id")
    ranked = hist.withColumns({"back": F.row_number().over(own.orderBy(F.desc("ts"), F.desc("item_id"))), "next": F.lead("ts", 1, cutoff).over(own.orderBy("ts", "item_id"))}).where(F.col("back") <= length)
    coded = ranked.join(vocab.select(F.col("value").alias("v"), "idx"), ranked.item_id.cast("string") == F.col("v"), "left").join(items.select("item_id", "main_category", "store"), "item_id", "left")
    event = F.struct(
        (-F.col("back")).alias("o"),
        F.coalesce(F.col("idx") + 1, F.lit(1)).alias("item"),
        F.coalesce("main_category", F.lit("Unknown")).alias("category"),
        F.coalesce("store", F.lit("Unknown")).alias("store"),
        F.month(F.timestamp_millis("ts")).alias("month"),
        gap_bucket(F.col("next") - F.col("ts")).alias("gap"),
        F.col("rating").cast("int").alias("rating"),
    )
    return coded.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(event)), lambda e: e.dropFields("o")).alias("events"))  # at most `length` a user


def taste_history(hist: DataFrame, pool: DataFrame, as_of: int, length: int = 50, days: float | None = None) -> DataFrame:
    """(user_id, item_id, pos, weight): a user's last positives within the pool, with weight 1 or exp(-age / days)."""
    own = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item_id")
    kept = hist.where("label = 1").join(pool.select("item_id").distinct(), "item_id", "left_semi").withColumn("pos", F.row_number().over(own)).where(F.col("pos") <= length)
    weight = F.lit(1.0) if days is None else F.exp(-(F.lit(as_of) - F.col("ts")) / float(DAY_MS) / days)
    return kept.select("user_id", "item_id", "pos", r6(weight).alias("weight"))


def pos_weight(rows: DataFrame) -> DataFrame:
    positive = F.sum("label")
    return rows.agg(F.count("*").alias("n"), positive.alias("n_pos"), r6((F.count("*") - positive) / F.greatest(positive, F.lit(1))).alias("pos_weight"))
