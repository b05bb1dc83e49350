"""Cleaning and identity: one canonical id for the listings of a product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitrec.functions.expressions import clean_value, item_text, normalize_title, store_merge_key

from .rounding import r6


def dedup_metadata(items: DataFrame) -> DataFrame:
    """One row an item: the one with the most ratings; the rest of the columns break ties."""
    rest = [c for c in items.columns if c not in ("item_id", "rating_number") and not dict(items.dtypes)[c].startswith("map")]
    order = Window.partitionBy("item_id").orderBy(F.desc_nulls_last("rating_number"), *rest)
    return items.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def canonical_map(items: DataFrame, key: list[Column] | None = None) -> DataFrame:
    """(raw_item_id, canonical_item_id): items that agree on all legs of the key, none of them blank, take the id of the one with the most ratings.

    The key is the normalised title and the store unless given; without a title or a store column every item keeps its id.
    """
    if key is None and not {"title", "store"} <= set(items.columns):
        return items.select(F.col("item_id").alias("raw_item_id"), F.col("item_id").alias("canonical_item_id"))
    legs = key or [normalize_title(F.col("title")), store_merge_key(F.col("store"))]
    names = [f"leg{k}" for k in range(len(legs))]
    keyed = items.select("item_id", "rating_number", *[x.alias(n) for x, n in zip(legs, names)])
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(n), F.lit("")) != "" for n in names])
    # the best by an aggregate, so that a hot key is combined before the shuffle
    best = keyed.where(whole).groupBy(*names).agg(F.min(F.struct((-F.coalesce("rating_number", F.lit(-1))).alias("o"), "item_id")).alias("b")).select(*names, F.col("b.item_id").alias("best"))
    joined = keyed.join(best, names, "left")
    return joined.select(F.col("item_id").alias("raw_item_id"), F.coalesce("best", "item_id").alias("canonical_item_id"))


def canonicalize(rows: DataFrame, mapping: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Interactions under canonical ids: rows without user, item, rating or time go, then orphans; the earliest of a pair stays and is labelled."""
    full = rows.where("user_id is not null and item_id is not null and rating is not null and ts is not null")
    known = full.join(mapping, full.item_id == mapping.raw_item_id)  # inner: orphans go
    moved = known.drop("item_id", "raw_item_id").withColumnRenamed("canonical_item_id", "item_id")
    rest = [c for c in moved.columns if c not in ("user_id", "item_id", "ts", "rating")]
    order = Window.partitionBy("user_id", "item_id").orderBy("ts", "rating", *rest)
    one = moved.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    return binarize(one, threshold)


def binarize(rows: DataFrame, threshold: float = 3.0) -> DataFrame:
    positive = F.col("rating") >= threshold
    return rows.withColumns({"label": positive.cast("int"), "label_type": F.when(positive, "positive").otherwise("hard_negative")})


def canonicalize_stats(rows: DataFrame, mapping: DataFrame, out: DataFrame) -> DataFrame:
    """One row of counters for the whole step."""
    complete = rows.where("user_id is not null and item_id is not null and rating is not null and ts is not null")
    joined = complete.join(mapping, complete.item_id == mapping.raw_item_id, "left")
    pre = rows.agg(F.count("*").alias("n_raw"))
    mid = joined.agg(F.count("*").alias("n_complete"), F.count("canonical_item_id").alias("n_known"), F.count_if(F.col("canonical_item_id") != F.col("item_id")).alias("n_remapped"))
    post = out.agg(F.count("*").alias("n_out"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_positive"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"))
    maps = mapping.agg(F.count("*").alias("n_raw_items"), F.countDistinct("canonical_item_id").alias("n_canonical_items"))
    one = reduce(lambda a, b: a.crossJoin(b), [pre, mid, post, maps])  # one row each
    return one.withColumns({"n_null_dropped": F.col("n_raw") - F.col("n_complete"), "n_orphans": F.col("n_complete") - F.col("n_known"), "n_duplicates": F.col("n_known") - F.col("n_out"), "positive_rate": r6(F.col("n_positive") / F.col("n_out")), "remap_rate": r6(F.col("n_remapped") / F.col("n_known"))})


def earliest_per_pair(rows: DataFrame) -> DataFrame:
    """The earliest row of each (user, item) by (ts, rating) and then every other column."""
    rest = [c for c in rows.columns if c not in ("user_id", "item_id", "ts", "rating")]
    order = Window.partitionBy("user_id", "item_id").orderBy("ts", "rating", *rest)
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def restrict_to_canonical(items: DataFrame, keys: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of the canonical items; raises if one of them has no row."""
    if strict and (n := keys.join(items, "item_id", "left_anti").count()):
        raise ValueError(f"{n} canonical items have no metadata")
    return items.join(keys, "item_id", "left_semi")


def audit_summary(mapping: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: groups of two or more, folded ids, catalog size, and the reviews whose item changes."""
    per_item = rows.groupBy("item_id").agg(F.count("*").alias("c"))
    joined = mapping.join(per_item, mapping.raw_item_id == per_item.item_id, "left").withColumn("c", F.coalesce("c", F.lit(0)))
    moved = F.col("raw_item_id") != F.col("canonical_item_id")
    groups = joined.groupBy("canonical_item_id").agg(F.count("*").alias("size"), F.count_if(moved).alias("folded"), F.sum("c").alias("c"), F.coalesce(F.sum(F.when(moved, F.col("c"))), F.lit(0)).alias("moved"))
    n, size = F.sum("size"), F.sum("folded")
    return groups.agg(F.count_if(F.col("size") > 1).alias("n_groups"), size.alias("n_folded"), n.alias("n_catalog"), r6(100 * size / n).alias("folded_percent"), F.sum("moved").alias("n_reviews_moved"), r6(100 * F.sum("moved") / F.sum("c")).alias("reviews_percent"))


def merge_options(items: DataFrame, rows: DataFrame) -> DataFrame:
    """The audit of four keys, from the loosest to none."""
    t, nt, sk = F.coalesce("title", F.lit("")), normalize_title(F.col("title")), store_merge_key(F.col("store"))
    same = items.select(F.col("item_id").alias("raw_item_id"), F.col("item_id").alias("canonical_item_id"))
    options = {"exact_title": canonical_map(items, [t]), "norm_title": canonical_map(items, [nt]), "norm_title_store": canonical_map(items, [nt, sk]), "none": same}
    return reduce(DataFrame.unionByName, [audit_summary(m, rows).withColumn("option", F.lit(k)) for k, m in options.items()])


def assert_monotone(options: DataFrame) -> None:
    """A stricter key folds no more ids."""
    folded = {r["option"]: r["n_folded"] for r in options.select("option", "n_folded").collect()}  # four rows
    if not folded["norm_title"] >= folded["norm_title_store"] >= folded["none"] or folded["norm_title"] < folded["exact_title"]:
        raise AssertionError(f"folded ids are not monotone: {folded}")


def genuineness(items: DataFrame) -> DataFrame:
    """(kind, n_groups, n_items): groups of one exact title by what their stores say."""
    key = store_merge_key(F.col("store"))
    groups = items.where("title is not null and title <> ''").groupBy("title").agg(F.count("*").alias("n"), F.countDistinct(F.nullif(key, F.lit(""))).alias("stores"), F.count_if(key == "").alias("blank")).where("n > 1")
    kind = F.when(F.col("stores") > 1, "cross_store").when(F.col("blank") > 0, "store_incomplete").otherwise("single_store")
    return groups.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_items"))


def store_conflicts(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Canonical ids that unite two known stores; must be empty."""
    joined = items.join(mapping, items.item_id == mapping.raw_item_id)
    return joined.groupBy("canonical_item_id").agg(F.countDistinct(F.nullif(store_merge_key(F.col("store")), F.lit(""))).alias("n_stores")).where("n_stores > 1")


def group_samples(items: DataFrame, top: int = 10, lots: int = 10, seed: str = "sample") -> DataFrame:
    """(pick, title, n): the largest groups of one title, and others drawn by hash."""
    groups = items.where("title is not null and title <> ''").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")
    largest = groups.orderBy(F.desc("n"), "title").limit(top)
    rest = groups.join(largest, "title", "left_anti").orderBy(F.md5(F.concat(F.lit(seed), "title")), "title").limit(lots)
    return largest.withColumn("pick", F.lit("largest")).unionByName(rest.withColumn("pick", F.lit("drawn")))


def item_texts(items: DataFrame, author_share: float = 0.5, author: Column | None = None) -> DataFrame:
    """(item_id, text). With an author column, it stands for the store when more than `author_share` of the stores are missing."""
    name = F.col("store")
    if author is not None:
        missing = items.agg(F.avg((clean_value(F.col("store")) == "").cast("double"))).first()[0]  # a scalar decides the recipe
        if (missing or 0) > author_share:
            name = F.when(clean_value(F.col("store")) == "", author).otherwise(F.col("store"))
    return items.select("item_id", item_text(F.col("title"), name, F.col("categories")).alias("text"))


def align_embeddings(vectors: DataFrame, mapping: DataFrame, keys: DataFrame, dim: int) -> DataFrame:
    """(item_id, embedding, status) for every key: the mean of the vectors mapped to it, zeros where there are none.

    status: aligned (one vector, its own), rebuilt (a mean, or another item's), not_present.
    """
    moved = vectors.join(mapping, vectors.item_id == mapping.raw_item_id).select(F.col("canonical_item_id").alias("item_id"), F.col("raw_item_id").alias("raw"), "embedding")
    moved = moved.join(keys.select("item_id").distinct(), "item_id", "left_semi")
    cells = moved.select("item_id", F.posexplode("embedding").alias("pos", "x")).groupBy("item_id", "pos").agg(F.avg("x").alias("x"))
    pooled = cells.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))  # dim values a key
    kinds = moved.groupBy("item_id").agg(((F.count("*") == 1) & F.bool_and(F.col("raw") == F.col("item_id"))).alias("own"))
    out = keys.select("item_id").distinct().join(pooled, "item_id", "left").join(kinds, "item_id", "left")
    status = F.when(F.col("own"), "aligned").when(F.col("own").isNotNull(), "rebuilt").otherwise("not_present")
    return out.select("item_id", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)).alias("embedding"), status.alias("status"))
