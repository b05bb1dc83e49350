"""Ranking metrics over flat rows: (user_id, score, label) and ranked lists against ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitrec.functions.expressions import cohort, fine_cohort
from pitrec.sources.io import digests

from .candidates import hit_pairs, looked_up
from .order import running
from .rounding import r6


def truth_sets(rows: DataFrame) -> DataFrame:
    """Distinct positive pairs; users without positives are not in it."""
    return rows.where("label = 1").select("user_id", "item_id").distinct()


def pool_coverage(truth: DataFrame, pool: DataFrame) -> DataFrame:
    """Share of target pairs whose item is in the pool."""
    flagged = truth.join(pool.select("item_id").distinct().withColumn("inside", F.lit(1)), "item_id", "left")
    return flagged.agg(F.count("*").alias("n_pairs"), r6(F.avg(F.coalesce("inside", F.lit(0)))).alias("coverage"))


def user_hits(truth: DataFrame, lists: DataFrame, ks: list[int], by: list[str] = ()) -> DataFrame:
    """(by, user_id, n, h{k}...): targets of each user and hits within each depth; users without a list count 0."""
    keys = [*by, "user_id"]
    sizes = truth.groupBy(*keys).agg(F.count("*").alias("n"))
    hits = lists.select(*keys, "item_id", "rank").join(looked_up(truth), [*keys, "item_id"]).groupBy(*keys).agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    return sizes.join(looked_up(hits), keys, "left").fillna(0, subset=[f"h{k}" for k in ks])


def recall_precision(truth: DataFrame, lists: DataFrame, ks: list[int], by: list[str] = ()) -> DataFrame:
    """(by, k, recall, precision, n_users): means over users; the precision denominator is k also for short lists."""
    users = user_hits(truth, lists, ks, by)
    aggs = [F.count("*").alias("n_users")] + [x for k in ks for x in (r6(F.avg(F.col(f"h{k}") / F.col("n"))).alias(f"r{k}"), r6(F.avg(F.col(f"h{k}") / F.lit(float(k)))).alias(f"p{k}"))]
    wide = users.groupBy(*by).agg(*aggs) if by else users.agg(*aggs)
    return wide.select(*by, "n_users", F.expr(f"stack({len(ks)}, {', '.join(f'{k}, r{k}, p{k}' for k in ks)}) as (k, recall, precision)"))


def split_report(rows: DataFrame, lists: DataFrame, pool: DataFrame, ks: list[int]) -> DataFrame:
    """One row: totals, positive rate, coverage of the pool, recall and precision at each depth."""
    truth = truth_sets(rows)
    t = rows.agg(F.count("*").alias("n_total"), F.sum("label").alias("n_positive"), r6(F.avg("label")).alias("positive_rate"), F.countDistinct("user_id").alias("n_users_total"))
    m = user_hits(truth, lists, ks).agg(F.count("*").alias("n_users"), *[x for k in ks for x in (r6(F.avg(F.col(f"h{k}") / F.col("n"))).alias(f"recall_{k}"), r6(F.avg(F.col(f"h{k}") / F.lit(float(k)))).alias(f"precision_{k}"))])
    return t.crossJoin(pool_coverage(truth, pool)).crossJoin(m)  # one row each


def warm_cold_report(truth: DataFrame, lists: DataFrame, ks: list[int]) -> DataFrame:
    """Recall and precision for all, warm and cold users, as grouping sets over one table of users. truth has is_warm_user."""
    users = user_hits(truth.select("user_id", "item_id").distinct(), lists, ks).join(truth.groupBy("user_id").agg(F.max("is_warm_user").alias("warm")), "user_id")
    aggs = [F.count("*").alias("n_users")] + [x for k in ks for x in (r6(F.avg(F.col(f"h{k}") / F.col("n"))).alias(f"recall_{k}"), r6(F.avg(F.col(f"h{k}") / F.lit(float(k)))).alias(f"precision_{k}"))]
    out = users.groupingSets([[], [F.col("warm")]], "warm").agg(F.grouping("warm").alias("g"), *aggs)
    return out.withColumn("view", F.when(F.col("g") == 1, "all").when(F.col("warm") == 1, "warm").otherwise("cold")).drop("g", "warm")


def ceiling(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """The best that any ranking of the candidates could reach."""
    users = user_hits(truth, hit_pairs(cands, truth).withColumn("rank", F.lit(1)), [1])
    return users.agg(F.count("*").alias("n_users"), r6(F.avg(F.col("h1") / F.col("n"))).alias("macro"), r6(F.avg((F.col("h1") > 0).cast("int"))).alias("any_hit"), r6(F.sum("h1") / F.sum("n")).alias("per_positive"))


def conditional_recall(truth: DataFrame, cands: DataFrame, lists: DataFrame, ks: list[int]) -> DataFrame:
    """Recall over the users with at least one target among the candidates."""
    able = hit_pairs(cands, truth).select("user_id").distinct()
    return recall_precision(truth.join(looked_up(able), "user_id", "left_semi"), lists, ks)


def cohort_report(truth: DataFrame, lists: DataFrame, ks: list[int], fine: bool = False) -> DataFrame:
    """Recall and precision by the user's history length."""
    bucket = fine_cohort(F.col("k0")) if fine else cohort(F.col("k0")).cast("string")
    users = user_hits(truth.select("user_id", "item_id").distinct(), lists, ks).join(truth.groupBy("user_id").agg(F.max("n_history_events").alias("k0")), "user_id").withColumn("cohort", bucket)
    return users.groupBy("cohort").agg(F.count("*").alias("n_users"), *[x for k in ks for x in (r6(F.avg(F.col(f"h{k}") / F.col("n"))).alias(f"recall_{k}"), r6(F.avg(F.col(f"h{k}") / F.lit(float(k)))).alias(f"precision_{k}"))])


def item_cohort_report(truth: DataFrame, lists: DataFrame, ks: list[int]) -> DataFrame:
    """Recall by target item: those in the history and those not, a pair at a time."""
    pairs = truth.select("user_id", "item_id", "item_in_history").distinct().withColumn("cohort", F.when(F.col("item_in_history") == 1, "warm_item").otherwise("cold_item"))
    got = pairs.join(lists.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")
    return got.groupBy("cohort").agg(F.count("*").alias("n_pairs"), F.countDistinct("user_id").alias("n_users"), *[r6(F.avg(F.when(F.col("rank") <= k, 1).otherwise(0))).alias(f"recall_{k}") for k in ks])


def _ranks(rows: DataFrame) -> DataFrame:
    """Adds the average rank of the score in its user (ascending), and the place in conservative order: score descending, negatives first."""
    up, same = Window.partitionBy("user_id").orderBy("score"), Window.partitionBy("user_id", "score")
    down = Window.partitionBy("user_id").orderBy(F.desc("score"), "label")
    return rows.withColumns({"avg_rank": F.rank().over(up) + (F.count("*").over(same) - 1) / 2.0, "place": F.row_number().over(down)})


def user_auc(rows: DataFrame) -> DataFrame:
    """(user_id, n, n_pos, auc): Mann-Whitney with half credit for ties; users without both labels have none."""
    per = _ranks(rows).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.sum(F.when(F.col("label") == 1, F.col("avg_rank"))).alias("rank_sum"))
    p = F.col("n_pos").cast("double")
    return per.where("n_pos > 0 and n_pos < n").select("user_id", "n", "n_pos", r6((F.col("rank_sum") - p * (p + 1) / 2) / (p * (F.col("n") - p))).alias("auc"))


def grouped_auc(rows: DataFrame) -> DataFrame:
    """The users' AUC weighted by list length, and its plain mean."""
    return user_auc(rows).agg(F.count("*").alias("n_users"), r6(F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("gauc"), r6(F.avg("auc")).alias("mean_auc"))


def global_auc(rows: DataFrame) -> DataFrame:
    """Pooled AUC. Rows fold to distinct scores, whose ranks come from a range-partitioned order, so that no task orders all rows."""
    by_score = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    ranked = running(by_score, "n", "score").withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2.0)
    tot = ranked.agg(F.sum("n").alias("n"), F.sum("p").cast("double").alias("p"), F.sum(F.col("p") * F.col("avg_rank")).alias("s"))
    return tot.select("n", F.col("p").cast("bigint").alias("n_pos"), r6((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def idcg_table(spark, depth: int) -> DataFrame:
    """(m, idcg): the gain of m relevant items at the top."""
    return spark.range(1, depth + 1).select(F.col("id").cast("int").alias("m"), F.expr("aggregate(transform(sequence(1, cast(id as int)), i -> 1.0d / log2(i + 1.0d)), 0.0d, (s, x) -> s + x)").alias("idcg"))


def grouped_metrics(rows: DataFrame, sizes: DataFrame, ks: list[int]) -> DataFrame:
    """One row of the whole flat evaluation. sizes: (user_id, n_targets) for every user with targets, listed or not.

    MRR and nDCG average over listed users with a positive; precision over
    listed users; recall in three forms: over listed users with a positive
    (conditional), over listed users, over all users with targets.
    """
    ranked = _ranks(rows)
    gain = F.col("label") / F.log2(F.col("place") + 1.0)
    aggs = [F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.min(F.when(F.col("label") == 1, F.col("place"))).alias("first")]
    for k in ks:
        aggs += [F.sum(F.when(F.col("place") <= k, F.col("label")).otherwise(0)).alias(f"h{k}"), F.sum(F.when(F.col("place") <= k, gain).otherwise(0.0)).alias(f"g{k}")]
    return _over_users(ranked.groupBy("user_id").agg(*aggs), sizes, ks)


def list_metrics(lists: DataFrame, sizes: DataFrame, ks: list[int]) -> DataFrame:
    """`grouped_metrics` of (user_id, list of score and label), a row a user: a list is ordered where it lies, so that no row is shuffled or sorted with those of other users."""
    order = F.array_sort(F.transform("list", lambda x: F.struct((-x["score"]).alias("s"), x["label"].alias("label"))))
    found = F.filter(F.transform(order, lambda x, i: F.when(x["label"] == 1, i + 1)), lambda p: p.isNotNull())
    hit = F.exists("list", lambda x: x["label"] == 1)  # most lists have none
    placed = lists.where(F.size("list") > 0).select("user_id", F.size("list").cast("long").alias("n"), F.when(hit, found).otherwise(F.array().cast("array<int>")).alias("places"))
    out = [F.size("places").cast("long").alias("n_pos"), F.get("places", F.lit(0)).alias("first")]
    for k in ks:
        near = F.filter("places", lambda p: p <= k)  # noqa: B023
        out += [F.size(near).cast("long").alias(f"h{k}"), F.aggregate(near, F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0)).alias(f"g{k}")]
    return _over_users(placed.select("user_id", "n", *out), sizes, ks)


def _over_users(users: DataFrame, sizes: DataFrame, ks: list[int]) -> DataFrame:
    """The one row of `grouped_metrics` from (user_id, n, n_pos, first, h{k}, g{k}...)."""
    spark = users.sparkSession
    users = users.join(sizes, "user_id", "left").withColumn("t", F.greatest(F.coalesce("n_targets", F.lit(0)), F.col("n_pos")))
    table = F.broadcast(idcg_table(spark, max(ks)))
    for k in ks:
        users = users.join(table.select(F.col("m").alias(f"m{k}"), F.col("idcg").alias(f"i{k}")), F.least(F.col("t"), F.lit(k)) == F.col(f"m{k}"), "left").drop(f"m{k}")
    has = F.col("n_pos") > 0
    one = [F.count("*").alias("n_listed"), F.count_if(has).alias("n_with_positive"), r6(F.avg(F.when(has, 1.0 / F.col("first")))).alias("mrr")]
    for k in ks:
        ratio = F.col(f"h{k}") / F.col("t")
        one += [
            r6(F.avg(F.when(has, F.col(f"g{k}") / F.col(f"i{k}")))).alias(f"ndcg_{k}"), r6(F.avg(F.col(f"h{k}") / F.lit(float(k)))).alias(f"precision_{k}"),
            r6(F.avg(F.when(has, ratio))).alias(f"recall_conditional_{k}"), r6(F.avg(F.when(F.col("t") > 0, ratio).otherwise(0.0))).alias(f"recall_listed_{k}"), F.sum(F.when(F.col("t") > 0, ratio).otherwise(0.0)).alias(f"s{k}"),
            r6(F.avg((F.col(f"h{k}") > 0).cast("int"))).alias(f"hit_rate_{k}"), F.sum(f"h{k}").alias(f"hits{k}"),
        ]
    out = users.agg(*one).crossJoin(sizes.agg(F.count("*").alias("n_truth_users")))  # one row each
    for k in ks:
        out = out.withColumns({f"recall_overall_{k}": r6(F.col(f"s{k}") / F.col("n_truth_users")), f"hits_per_user_{k}": r6(F.col(f"hits{k}") / F.col("n_truth_users"))}).drop(f"s{k}", f"hits{k}")
    return out


def full_evaluation(rows: DataFrame, sizes: DataFrame, ks: list[int]) -> DataFrame:
    """Grouped metrics with grouped and global AUC; the rows are read three times."""
    rows = rows.persist()
    g, a = grouped_auc(rows).select("gauc", "mean_auc"), global_auc(rows).select(F.col("auc").alias("global_auc"))
    return grouped_metrics(rows, sizes, ks).crossJoin(g).crossJoin(a)  # one row each


def auc_context(rows: DataFrame, k: int) -> DataFrame:
    """Mean negatives a list, the rank of a positive that the AUC implies, and the AUC at which it would be k."""
    per = user_auc(rows).withColumn("neg", F.col("n") - F.col("n_pos"))
    out = per.agg(F.avg("neg").alias("m"), F.avg("auc").alias("a"))
    return out.select(r6(F.col("m")).alias("mean_negatives"), r6(1 + (1 - F.col("a")) * F.col("m")).alias("implied_rank"), r6(1 - (k - 1) / F.col("m")).alias("auc_for_top_k"))


def check_inputs(rows: DataFrame, sizes: DataFrame) -> None:
    """Raises on scores that are not finite, labels other than 0 and 1, and users with more listed positives than targets."""
    bad = rows.agg(F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("s"), F.count_if(~F.col("label").isin(0, 1)).alias("l")).first()
    if bad["s"] or bad["l"]:
        raise ValueError(f"{bad['s']} scores are not finite, {bad['l']} labels are not 0 or 1")
    over = rows.groupBy("user_id").agg(F.sum("label").alias("p")).join(sizes, "user_id", "left").where("p > coalesce(n_targets, 0)").count()
    if over:
        raise ValueError(f"{over} users have more listed positives than targets")


def batch_metrics(rows: DataFrame, ks: list[int]) -> DataFrame:
    """The front-end variant: MRR and nDCG average over all lists, those without a positive as 0."""
    ranked = _ranks(rows)
    aggs = [F.sum("label").alias("n_pos"), F.min(F.when(F.col("label") == 1, F.col("place"))).alias("first")]
    for k in ks:
        aggs += [F.sum(F.when(F.col("place") <= k, F.col("label")).otherwise(0)).alias(f"h{k}"), F.sum(F.when(F.col("place") <= k, F.col("label") / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias(f"g{k}")]
    users = ranked.groupBy("user_id").agg(*aggs)
    table = F.broadcast(idcg_table(rows.sparkSession, max(ks)))
    for k in ks:
        users = users.join(table.select(F.col("m").alias(f"m{k}"), F.col("idcg").alias(f"i{k}")), F.least(F.col("n_pos"), F.lit(k)) == F.col(f"m{k}"), "left").drop(f"m{k}")
    out = [F.count("*").alias("n_lists"), r6(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr")]
    for k in ks:
        out += [r6(F.avg(F.coalesce(F.col(f"g{k}") / F.col(f"i{k}"), F.lit(0.0)))).alias(f"ndcg_{k}"), r6(F.avg(F.col(f"h{k}") / F.lit(float(k)))).alias(f"precision_{k}"), r6(F.avg(F.when(F.col("n_pos") > 0, F.col(f"h{k}") / F.col("n_pos")))).alias(f"recall_{k}")]
    return users.agg(*out)


def horizon_report(truth: DataFrame, lists: DataFrame, lo: int, hi: int, ks: list[int]) -> DataFrame:
    """Recall and precision against the targets of [lo, hi) alone. truth has ts."""
    return recall_precision(truth.where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("user_id", "item_id").distinct(), lists, ks)


def target_ranks(truth: DataFrame, lists: DataFrame) -> DataFrame:
    """(source, k..): rank of every target in each source's list; 0 is absent. lists has source."""
    got = truth.select("user_id", "item_id").distinct().join(lists.select("source", "user_id", "item_id", "rank"), ["user_id", "item_id"])
    return got.select("source", "user_id", "item_id", "rank")


def source_hits(truth: DataFrame, lists: DataFrame, ks: list[int]) -> DataFrame:
    """(source, k, user_hits, pair_hits)."""
    got = target_ranks(truth, lists)
    users = got.groupBy("source", "user_id").agg(F.min("rank").alias("best"), *[F.count_if(F.col("rank") <= k).alias(f"c{k}") for k in ks])
    out = users.groupBy("source").agg(*[x for k in ks for x in (F.count_if(F.col("best") <= k).alias(f"u{k}"), F.sum(f"c{k}").alias(f"p{k}"))])
    return out.select("source", F.expr(f"stack({len(ks)}, {', '.join(f'{k}, u{k}, p{k}' for k in ks)}) as (k, user_hits, pair_hits)"))


def union_stats(truth: DataFrame, lists: DataFrame, ks: list[int]) -> DataFrame:
    """(k, union_hits, avg_candidates) and unique hits of each source at each depth, as (k, source, hits); source `*` is the union."""
    at = lists.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    pairs = at.groupBy("k", "user_id", "item_id").agg(F.count("*").alias("n"), F.min("source").alias("only"))
    hits = pairs.join(truth.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
    unique = hits.where("n = 1").groupBy("k", F.col("only").alias("source")).agg(F.count("*").alias("hits"))
    every = hits.groupBy("k").agg(F.count("*").alias("hits")).select("k", F.lit("*").alias("source"), "hits")
    return every.unionByName(unique)


def avg_candidates(lists: DataFrame, ks: list[int]) -> DataFrame:
    """(k, avg_candidates, n_rows): distinct candidates of a user and in total, when each source gives k."""
    at = lists.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k")).select("k", "user_id", "item_id").distinct()
    return at.groupBy("k", "user_id").agg(F.count("*").alias("n")).groupBy("k").agg(r6(F.avg("n")).alias("avg_candidates"), F.sum("n").alias("n_rows"))


def list_overlap(lists: DataFrame, k: int) -> DataFrame:
    """(a, b, shared): pairs of sources and the candidates both give within k; sources are few, so pairs come from each candidate's set."""
    sets = lists.where(F.col("rank") <= k).groupBy("user_id", "item_id").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def concentration(rows: DataFrame, share: float = 0.01) -> DataFrame:
    """The part of all positives that the most popular items hold."""
    counts = rows.where("label = 1").groupBy("item_id").agg(F.count("*").alias("c"))
    n = counts.count()
    top = counts.orderBy(F.desc("c"), "item_id").limit(max(1, int(n * share))).agg(F.sum("c").alias("t"), F.count("*").alias("n_top"))
    return counts.agg(F.sum("c").alias("total"), F.count("*").alias("n_items")).crossJoin(top).select("n_items", "n_top", r6(F.col("t") / F.col("total")).alias("share"))  # one row each


def bucket_hits(truth: DataFrame, lists: DataFrame, hist: DataFrame, k: int) -> DataFrame:
    """(source, bucket, hits): hits by the target item's history: 0, 1-2, 3-4, 5 or more."""
    support = hist.groupBy("item_id").agg(F.count("*").alias("c"))
    got = target_ranks(truth, lists.where(F.col("rank") <= k)).join(support, "item_id", "left")
    c = F.coalesce("c", F.lit(0))
    bucket = F.when(c == 0, "0").when(c <= 2, "1-2").when(c <= 4, "3-4").otherwise(">=5")
    return got.groupBy("source", bucket.alias("bucket")).agg(F.count("*").alias("hits"))


def configuration_probe(truth: DataFrame, configs: dict[str, DataFrame], base: str) -> DataFrame:
    """(config, covered, only_here, delta): targets that each configuration's union covers, those that the base does not, and the change."""
    want = truth.select("user_id", "item_id").distinct()
    got = reduce(DataFrame.unionByName, [df.select("user_id", "item_id").distinct().withColumn("config", F.lit(c)) for c, df in configs.items()]).join(want, ["user_id", "item_id"], "left_semi")
    flags = got.groupBy("user_id", "item_id").agg(*[F.max((F.col("config") == c).cast("int")).alias(c) for c in configs])
    out = flags.agg(*[x for c in configs for x in (F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}"), F.count_if((F.col(c) == 1) & (F.col(base) == 0)).alias(f"o_{c}"))])
    rows = ", ".join(f"'{c}', n_{c}, o_{c}, n_{c} - n_{base}" for c in configs)
    return out.select(F.expr(f"stack({len(configs)}, {rows}) as (config, covered, only_here, delta)"))


def stage_gate(recalls: DataFrame, sizes: DataFrame, base: str, max_ratio: float = 1.6, bytes_per_row: float = 1100.0, max_gib: float = 120.0) -> DataFrame:
    """(arm, ..., allowed, place): arms whose table stays within the row ratio and the projected memory, ordered by recall; the first two are short-listed."""
    joined = recalls.join(sizes, "arm")
    ref = sizes.where(F.col("arm") == base).select(F.col("n_rows").alias("base_rows"))
    out = joined.crossJoin(F.broadcast(ref)).withColumns({"ratio": r6(F.col("n_rows") / F.col("base_rows")), "gib": r6(F.col("n_rows") * bytes_per_row / float(1 << 30))})  # one row
    out = out.withColumn("allowed", (F.col("ratio") <= max_ratio) & (F.col("gib") <= max_gib))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("allowed").cast("int")), F.desc("recall"), "arm"))  # a row an arm
    return out.withColumn("place", place).withColumn("shortlisted", F.col("allowed") & (F.col("place") <= 2)).drop("base_rows")


def freeze_choice(arms: DataFrame, base: str, tolerance: float = 5e-4) -> DataFrame:
    """(arm, chosen): an arm must hold the base's recall at 10 and beat its recall at 100; near ties go by recall at 10, fewer rows, name. The base if none does."""
    ref = arms.where(F.col("arm") == base).select(F.col("r10").alias("b10"), F.col("r100").alias("b100"))
    able = arms.crossJoin(F.broadcast(ref)).withColumn("able", (F.col("arm") != base) & (F.col("r10") >= F.col("b10")) & (F.col("r100") > F.col("b100")))  # one row
    best = F.max(F.when(F.col("able"), F.col("r100"))).over(Window.partitionBy())
    close = able.withColumn("near", F.col("able") & (F.col("r100") >= best - tolerance))
    order = Window.orderBy(F.desc(F.col("near").cast("int")), F.desc(F.when(F.col("near"), F.col("r10"))), F.when(F.col("near"), F.col("n_rows")), F.when(F.col("arm") == base, 0).otherwise(1), "arm")  # a row an arm
    placed = close.withColumn("place", F.row_number().over(order))
    return placed.select("arm", ((F.col("place") == 1) & (F.col("near") | (F.col("arm") == base))).alias("chosen"))


def anchor_score(lists: DataFrame, drop: DataFrame, tests: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall, ndcg, n_users): lists without the validation items, closed up; one test item a user, gain 1 / log2(1 + rank)."""
    kept = lists.join(drop.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    closed = kept.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("rank")))
    got = tests.select("user_id", "item_id").join(closed.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")
    aggs = [F.count("*").alias("n_users")] + [x for k in ks for x in (r6(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))).alias(f"r{k}"), r6(F.avg(F.when(F.col("rank") <= k, 1 / F.log2(1.0 + F.col("rank"))).otherwise(0.0))).alias(f"n{k}"))]
    return got.agg(*aggs).select("n_users", F.expr(f"stack({len(ks)}, {', '.join(f'{k}, r{k}, n{k}' for k in ks)}) as (k, recall, ndcg)"))


def anchor_checks(tests: DataFrame, catalog: DataFrame, lists: DataFrame) -> DataFrame:
    """One row: test items outside the catalog, and test users without a list."""
    known = catalog.select("item_id").distinct().withColumn("known", F.lit(1))
    listed = lists.select("user_id").distinct().withColumn("listed", F.lit(1))
    both = tests.select("user_id", "item_id").join(known, "item_id", "left").join(listed, "user_id", "left")
    return both.agg(F.count("*").alias("n_tests"), F.count_if(F.col("known").isNull()).alias("n_outside"), r6(F.avg(F.col("known").isNull().cast("int"))).alias("outside_rate"), F.count_if(F.col("listed").isNull()).alias("n_without_list"))


def regression_report(rows: DataFrame) -> DataFrame:
    """(rmse, mae, accuracy, n) of `pred` clipped to 1-5 against `rating`; classes by rounding half to even."""
    p = F.least(F.greatest(F.col("pred"), F.lit(1.0)), F.lit(5.0))
    cls = F.bround(p).cast("int")
    return rows.agg(F.count("*").alias("n"), r6(F.sqrt(F.avg((p - F.col("rating")) * (p - F.col("rating"))))).alias("rmse"), r6(F.avg(F.abs(p - F.col("rating")))).alias("mae"), r6(F.avg((cls == F.col("rating")).cast("int"))).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    """(rating, pred_class, n, share): counts, and shares of each true class."""
    cls = F.bround(F.least(F.greatest(F.col("pred"), F.lit(1.0)), F.lit(5.0))).cast("int")
    n = rows.groupBy("rating", cls.alias("pred_class")).agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("rating"))))


def macro_f1(rows: DataFrame) -> DataFrame:
    cls = F.bround(F.least(F.greatest(F.col("pred"), F.lit(1.0)), F.lit(5.0))).cast("int")
    pairs = rows.select(F.col("rating").cast("int").alias("t"), cls.alias("p"))
    flags = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("is_t"), (F.col("p") == F.col("t")).cast("int").alias("tp"), F.lit(0).alias("is_p")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_t"), F.lit(0).alias("tp"), F.lit(1).alias("is_p")))).alias("x"))
    per = flags.groupBy("x.c").agg(F.sum("x.is_t").alias("t"), F.sum("x.tp").alias("tp"), F.sum("x.is_p").alias("p"))
    return per.agg(F.count("*").alias("n_classes"), r6(F.avg(2.0 * F.col("tp") / (F.col("t") + F.col("p")))).alias("macro_f1"))


def freeze_provenance(spark, paths: dict[str, str], n_rows: dict[str, int]) -> DataFrame:
    """(name, file, sha256, n_rows) of the files a decision rests on, in any store; raises for a missing one or an arm without rows."""
    empty = [a for a, n in n_rows.items() if n <= 0]
    if empty:
        raise ValueError(f"no rows: {', '.join(empty)}")
    found = [(name, file, sha, n_rows.get(name)) for name, path in paths.items() for file, sha in digests(spark, path).items()]
    return spark.createDataFrame(found, "name string, file string, sha256 string, n_rows long")
