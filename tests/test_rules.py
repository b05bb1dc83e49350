import random

from pyspark.sql import functions as F

from pitrec.operators import metrics, retrieval, rules, tuning


def frames(spark, seed):
    rng = random.Random(seed)
    items = spark.createDataFrame([(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])) for i in range(40)], "item_id long, store string, main_category string")
    rows = spark.createDataFrame([(u, rng.randrange(40), rng.randrange(2)) for u in range(15) for _ in range(rng.randrange(12))], "user_id long, item_id long, label int").dropDuplicates(["user_id", "item_id"])
    return items, rows, spark.range(16).selectExpr("id as user_id"), items.where("item_id < 36").select("item_id")


def test_lists_come_from_heads_that_users_pass(spark):
    """No join of users with groups or their items, and the lists are those of all pairs."""
    items, rows, users, pool = frames(spark, 3)
    seen = retrieval.seen(rows)
    weights = {"store": 1.0, "main_category": 0.5, "prior": 0.5}
    got = retrieval.rule_scores(users, rows, items, pool, seen, weights, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "running" not in plan
    pairs = users.crossJoin(retrieval.popularity_prior(rows, pool)).join(items, "item_id").join(seen, ["user_id", "item_id"], "left_anti")
    for f in ("store", "main_category"):
        pairs = pairs.join(retrieval.facet_affinity(rows, items, f).select("user_id", F.col("facet").alias(f), F.col("affinity").alias(f"a_{f}")), ["user_id", f], "left").fillna(0.0, [f"a_{f}"])
    score = F.round(F.col("a_store") + 0.5 * F.col("a_main_category") + 0.5 * F.col("prior"), 6)
    want = retrieval.top_k(pairs.select("user_id", "item_id", score.alias("score")), 5)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_a_grid_gives_the_places_of_targets_alone(spark):
    items, rows, users, pool = frames(spark, 5)
    seen, grid = retrieval.seen(rows), tuning.weight_grid(["store"])
    targets = metrics.truth_sets(frames(spark, 6)[1])
    got = rules.ranked(users, rows, items, pool, seen, grid, 7, targets)
    for n in (0, 5, 8):
        want = retrieval.rule_scores(users, rows, items, pool, seen, grid[n], 7).join(targets, ["user_id", "item_id"])
        pick = lambda df: sorted(df.select("user_id", "item_id", "rank").collect())
        assert pick(got.where(F.col("grid_index") == n)) == pick(want)


def test_basket_pairs_are_made_where_they_are_counted(spark):
    rows = spark.createDataFrame([(u, i, 1, i) for u in range(6) for i in range(u, u + 4)] + [(9, 1, 1, 0)], "user_id long, item_id long, label int, ts long")
    got = retrieval.covisitation(rows, cosine=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    baskets = [set(range(u, u + 4)) for u in range(6)]
    want = {(a, b): n for a in range(9) for b in range(9) if a != b and (n := sum({a, b} <= x for x in baskets)) >= 2}
    assert {(r["a"], r["b"]): r["support"] for r in got.collect()} == want
