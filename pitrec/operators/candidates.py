"""Candidate tables: union of sources, fills, cross features, labels and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitrec.functions.expressions import cohort, known_or

from .rounding import r6


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """One row a (user, item) with source_{s}, {s}_rank and {s}_score for each source, num_sources and best_rank.

    One grouped pass over the tagged lists. Rank 0 means absent and is ignored by best_rank.
    """
    tagged = reduce(DataFrame.unionByName, [df.select("user_id", "item_id", "score", "rank", F.lit(s).alias("source")) for s, df in sources.items()])
    aggs = []
    for s in sources:
        own = F.col("source") == s
        aggs += [F.max(F.when(own, F.col("rank"))).alias(f"r_{s}"), F.max(F.when(own, F.col("score"))).alias(f"{s}_score")]
    wide = tagged.groupBy("user_id", "item_id").agg(*aggs)
    names = list(sources)
    flags = {f"source_{s}": F.col(f"r_{s}").isNotNull().cast("int") for s in names}
    ranks = {f"{s}_rank": F.coalesce(f"r_{s}", F.lit(0)) for s in names}
    best = F.least(*[F.col(f"r_{s}") for s in names]) if len(names) > 1 else F.col(f"r_{names[0]}")
    total = reduce(lambda a, b: a + b, [F.col(f"r_{s}").isNotNull().cast("int") for s in names])
    return wide.withColumns(flags | ranks | {"num_sources": total, "best_rank": best}).drop(*[f"r_{s}" for s in names])


def fill_scores(cands: DataFrame, pool_counts: DataFrame, two_tower: str | None = None, extra: list[str] = ()) -> DataFrame:
    """popularity_score is the pool's count, 0 outside; a missing two-tower score is the smallest one less 1; other sources 0."""
    out = cands.drop("popularity_score").join(pool_counts.select("item_id", F.col("score").alias("popularity_score")), "item_id", "left").withColumn("popularity_score", F.coalesce("popularity_score", F.lit(0.0)))
    if two_tower:
        low = cands.agg((F.coalesce(F.min(two_tower), F.lit(0.0)) - 1).alias("low"))
        out = out.crossJoin(F.broadcast(low)).withColumn(two_tower, F.coalesce(two_tower, "low")).drop("low")  # one row
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in extra})


VECTORS = 16_384  # that are sent to all tasks


def fill_content(cands: DataFrame, profiles: DataFrame, units: DataFrame, column: str = "content_score") -> DataFrame:
    """1 + cosine where the user has a profile and the item a vector (in 0 to 2), else 0; exact for rows of any source.

    Up to VECTORS vectors are sent, so that candidates are not shuffled with a profile each.
    """
    vectors = units.select("item_id", F.col("u"))
    few = vectors.limit(VECTORS + 1).count() <= VECTORS
    out = cands.drop(column).join(looked_up(profiles), "user_id", "left").join(F.broadcast(vectors) if few else vectors, "item_id", "left")
    dot = F.aggregate(F.zip_with("profile", "u", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    both = F.col("profile").isNotNull() & F.col("u").isNotNull()
    return out.withColumn(column, F.when(both, r6(F.least(F.greatest(1 + dot, F.lit(0.0)), F.lit(2.0)))).otherwise(0.0)).drop("profile", "u")


def cross_features(cands: DataFrame, items: DataFrame, affinity: dict[str, DataFrame], tops: dict[str, DataFrame]) -> DataFrame:
    """{facet}_affinity and same_top_{facet} of each row; unknown facets never agree. A user's affinities are a map, so that all that belongs to users joins by user alone."""
    out = cands.join(items.select("item_id", *affinity), "item_id", "left")
    for f, table in affinity.items():
        own = table.where("user_id is not null and facet is not null").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("facet", "affinity"))).alias("own"))  # a user's facets
        out = out.join(looked_up(own), "user_id", "left").withColumn(f"{f}_affinity", F.try_element_at("own", F.col(f))).drop("own")
        out = out.join(looked_up(tops[f].select("user_id", F.col("top").alias("top"))), "user_id", "left")
        out = out.withColumns({f"{f}_affinity": r6(F.coalesce(f"{f}_affinity", F.lit(0.0))), f"same_top_{f}": F.coalesce((F.col(f) == F.col("top")).cast("int"), F.lit(0)), f: known_or(F.col(f))}).drop("top")
    return out


def attach_features(cands: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """User and item feature blocks with prefixes, the flag user_has_history, missing numbers as 0."""
    u = users.select("user_id", *[F.col(c).alias(f"user_{c}") for c in users.columns if c != "user_id"], F.lit(1).alias("user_has_history"))
    i = items.select("item_id", *[F.col(c).alias(f"item_{c}") for c in items.columns if c != "item_id"])
    out = cands.join(u, "user_id", "left").join(i, "item_id", "left")
    numbers = [c for c, t in out.dtypes if t in ("int", "bigint", "double", "float", "tinyint", "smallint")]
    return out.fillna(0, subset=numbers)


def looked_up(pairs: DataFrame) -> DataFrame:
    """The pairs as the side of a join that is hashed a partition at a time.

    Candidates compress to a few bytes a row, so that the size of their files
    would have them broadcast, or hashed, instead of the targets.
    """
    return pairs.hint("shuffle_hash")


def hit_pairs(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """The distinct (user_id, item_id) of the candidates that are targets."""
    return cands.select("user_id", "item_id").join(looked_up(truth.select("user_id", "item_id").distinct()), ["user_id", "item_id"], "left_semi").distinct()


def attach_labels(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """label and the user's history length, both from the ground truth, a row a user of it."""
    users = truth.groupBy("user_id").agg(F.collect_set("item_id").alias("targets"), F.max("n_history_events").alias("n_history_events"))  # a user's targets
    out = cands.drop("label", "n_history_events").join(looked_up(users), "user_id", "left")
    return out.withColumns({"label": F.coalesce(F.array_contains("targets", F.col("item_id")).cast("int"), F.lit(0)), "n_history_events": F.coalesce("n_history_events", F.lit(0))}).select("user_id", "item_id", *[c for c in cands.columns if c not in ("user_id", "item_id", "label", "n_history_events")], "label", "n_history_events")


def relabel(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: positives before and after, lost ones (must be 0), and both positive weights."""
    pairs = truth.select("user_id", "item_id").distinct().withColumn("now", F.lit(1))
    both = cands.join(looked_up(pairs), ["user_id", "item_id"], "left").withColumn("now", F.coalesce("now", F.lit(0)))
    n, a, b = F.count("*"), F.sum("label"), F.sum("now")
    return both.agg(n.alias("n_rows"), a.alias("n_before"), b.alias("n_after"), F.count_if((F.col("label") == 1) & (F.col("now") == 0)).alias("n_lost"), r6((n - a) / F.greatest(a, F.lit(1))).alias("weight_before"), r6((n - b) / F.greatest(b, F.lit(1))).alias("weight_after"))


def label_gate(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """Both must be 0: labelled rows outside the truth, and truth rows among the candidates without a label."""
    pairs = looked_up(truth.select("user_id", "item_id").distinct())
    wrong = cands.where("label = 1").join(pairs, ["user_id", "item_id"], "left_anti").agg(F.count("*").alias("not_in_truth"))
    missed = cands.where("label = 0").join(pairs, ["user_id", "item_id"], "left_semi").agg(F.count("*").alias("not_labelled"))
    return wrong.crossJoin(missed)  # one row each


def target_status(truth: DataFrame, cands: DataFrame, hist: DataFrame, least: int = 5) -> DataFrame:
    """(status, n): what became of each distinct target: retrieved, eligible_not_retrieved, low_support or cold, in this order."""
    targets = truth.select("user_id", "item_id").distinct()
    got = looked_up(hit_pairs(cands, targets).withColumn("got", F.lit(1)))
    support = hist.groupBy("item_id").agg(F.count("*").alias("n_item"))
    joined = targets.join(got, ["user_id", "item_id"], "left").join(support, "item_id", "left")
    status = F.when(F.col("got") == 1, "retrieved").when(F.col("n_item") >= least, "eligible_not_retrieved").when(F.col("n_item") > 0, "low_support").otherwise("cold")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def source_overlap(cands: DataFrame, sources: list[str]) -> DataFrame:
    """(sources, n): rows by the exact set of sources that gave them."""
    which = F.concat_ws("+", *[F.when(F.col(f"source_{s}") == 1, s) for s in sources])
    return cands.groupBy(which.alias("sources")).agg(F.count("*").alias("n"))


def duplicate_over_splits(cands: DataFrame, splits: list[str]) -> DataFrame:
    """The table once for each split name."""
    return cands.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))


def coverage_report(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: mean and pooled coverage, users with any hit, what history and the eligible pool would allow, cold targets, cohort sizes."""
    got = looked_up(hit_pairs(cands, truth).withColumn("got", F.lit(1)))
    pairs = truth.select("user_id", "item_id", "item_in_history", "item_in_eligible_pool", "n_history_events").join(got, ["user_id", "item_id"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    users = pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("got").alias("h"), F.sum("item_in_history").alias("hist"), F.sum("item_in_eligible_pool").alias("pool"), F.max("n_history_events").alias("k"))
    n = F.col("n")
    return users.agg(
        F.count("*").alias("n_users"), F.sum("n").alias("n_pairs"),
        r6(F.avg(F.col("h") / n)).alias("coverage_macro"), r6(F.avg((F.col("h") > 0).cast("int"))).alias("coverage_any"), r6(F.sum("h") / F.sum("n")).alias("coverage_per_positive"),
        r6(F.sum("hist") / F.sum("n")).alias("historical_coverage"), r6(F.sum("pool") / F.sum("n")).alias("eligible_coverage"), (F.sum("n") - F.sum("hist")).alias("n_cold_targets"),
        *[F.count_if(cohort(F.col("k")) == c).alias(f"users_{c}") for c in range(4)],
    )


def source_recall(cands: DataFrame, truth: DataFrame, sources: list[str], ks: list[int]) -> DataFrame:
    """(source, k, recall, precision): per-user means over all users with targets."""
    sizes = truth.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    hits = cands.join(looked_up(truth.select("user_id", "item_id").distinct()), ["user_id", "item_id"], "left_semi")
    aggs = [F.count_if((F.col(f"{s}_rank") > 0) & (F.col(f"{s}_rank") <= k)).alias(f"{s}_{k}") for s in sources for k in ks]
    users = sizes.join(looked_up(hits.groupBy("user_id").agg(*aggs)), "user_id", "left").fillna(0)
    out = users.agg(*[x for s in sources for k in ks for x in (r6(F.avg(F.col(f"{s}_{k}") / F.col("n"))).alias(f"r_{s}_{k}"), r6(F.avg(F.col(f"{s}_{k}") / F.lit(float(k)))).alias(f"p_{s}_{k}"))])
    rows = ", ".join(f"'{s}', {k}, r_{s}_{k}, p_{s}_{k}" for s in sources for k in ks)
    return out.select(F.expr(f"stack({len(sources) * len(ks)}, {rows}) as (source, k, recall, precision)"))


def weight_fingerprint(cutoffs: list[int], weights: dict[str, float]) -> str:
    """A digest that binds frozen weights to the cutoffs they were tuned on."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({"cutoffs": cutoffs, "weights": weights}, sort_keys=True).encode()).hexdigest()


def check_fingerprint(stored: str, cutoffs: list[int], weights: dict[str, float]) -> None:
    if stored != weight_fingerprint(cutoffs, weights):
        raise ValueError("weights were frozen for other cutoffs")
