import math
import random

import pytest
from pyspark.sql import functions as F

from pitrec.functions.expressions import DAY_MS, sigmoid
from pitrec.operators import calibration, candidates, metrics, models, retrieval

ROWS = "user_id long, item_id long, ts long, rating int, label int"


def rows(spark, data):
    return spark.createDataFrame([(u, i, t, r, int(r >= 3)) for u, i, t, r in data], ROWS)


def ids(spark, values, name="item_id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["user_id"], []).append(r["item_id"])
    return out


DATA = [(1, 10, 1, 5), (1, 11, 2, 1), (2, 10, 1, 5), (2, 12, 2, 4), (3, 12, 1, 5), (3, 13, 5, 3), (4, 10, 1, 4)]


def test_popularity_lists_skip_all_seen_items(spark):
    h = rows(spark, DATA)
    users = ids(spark, [1, 2, 99], "user_id")
    got = lists(retrieval.top_unseen(users, retrieval.popularity(h), ids(spark, [10, 11, 12, 13, 14]), retrieval.seen(h), 3))
    assert got == {1: [12, 13, 14], 2: [13, 11, 14], 99: [10, 12, 13]}
    everything = lists(retrieval.top_unseen(users, retrieval.popularity(h), ids(spark, [10, 11]), retrieval.seen(h), 9))
    assert 1 not in everything and everything[99] == [10, 11]


def test_long_histories_go_beyond_the_broadcast_head(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 6)
    h = rows(spark, [(1, i, i, 5) for i in range(30)] + [(2, 3, 1, 5), (3, 40, 1, 2)])
    users, pool = ids(spark, [1, 2, 9], "user_id"), ids(spark, range(45))
    order = sorted(range(45), key=lambda i: (-sum(1 for u, x in [(1, i) for i in range(30)] + [(2, 3)] if x == i), i))
    got = lists(retrieval.top_unseen(users, retrieval.popularity(h), pool, retrieval.seen(h), 4))
    assert got == {1: [i for i in order if i >= 30][:4], 2: [i for i in order if i != 3][:4], 9: order[:4]}


def test_head_order_and_row_order(spark):
    scores = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0)], "item_id long, score double")
    got = retrieval.ranked_pool(scores, ids(spark, [1, 2, 3, 4])).collect()
    assert {r["item_id"]: r["place"] for r in got} == {2: 1, 1: 2, 3: 3, 4: 4}


def test_decay_and_window(spark):
    h = rows(spark, [(1, 1, 0, 5), (1, 2, 10 * DAY_MS, 5), (2, 1, 10 * DAY_MS, 5), (3, 3, 5, 1)])
    got = {r["item_id"]: r["score"] for r in retrieval.decayed_popularity(h, 20 * DAY_MS, 10.0).collect()}
    assert got == {1: 0.75, 2: 0.5}
    assert {r["item_id"] for r in retrieval.windowed_popularity(h, 20 * DAY_MS, 10).collect()} == {1, 2}
    assert {r["item_id"] for r in retrieval.windowed_popularity(h, 10 * DAY_MS, 5).collect()} == set()


def brute_rule(h, items, pool, user, weights, k):
    pos = [(u, i) for u, i, _, r in h if r >= 3]
    cnt = {i: sum(1 for _, x in pos if x == i) for i in pool}
    top = max(1.0, max(cnt.values()))
    seen = {i for u, i, _, _ in h if u == user}

    def affinity(f):
        own = [items[i][f] for u, i in pos if u == user]
        return {x: own.count(x) / max(own.count(y) for y in own) for x in own} if own else {}

    aff = {f: affinity(f) for f in ("store", "main_category")}
    score = {i: round(sum(weights.get(f, 0) * aff[f].get(items[i][f], 0) for f in aff) + weights.get("prior", 0) * cnt[i] / top, 6) for i in pool if i not in seen}
    return sorted(score, key=lambda i: (-score[i], i))[:k]


@pytest.mark.parametrize("weights", [{"store": 1.0, "main_category": 0.5, "prior": 0.5}, {"store": 1.0, "prior": 0.0}, {"store": 0.0, "main_category": 0.0, "prior": 1.0}, {"main_category": 0.5, "prior": 0.0}])
def test_rule_lists_equal_a_full_cross_product(spark, weights):
    rng = random.Random(1)
    items = {i: {"store": f"s{rng.randrange(6)}", "main_category": f"c{rng.randrange(3)}"} for i in range(40)}
    h = [(u, i, 1, rng.randint(1, 5)) for u in range(8) for i in rng.sample(range(40), rng.randint(0, 12))]
    frame = spark.createDataFrame([(i, v["store"], v["main_category"]) for i, v in items.items()], "item_id long, store string, main_category string")
    pool = list(range(3, 40))
    df = rows(spark, h)
    got = lists(retrieval.rule_scores(ids(spark, range(9), "user_id"), df, frame, ids(spark, pool), retrieval.seen(df), weights, 7))
    for u in range(9):
        assert got.get(u, []) == brute_rule(h, items, pool, u, weights, 7)


def test_covisitation_supports(spark):
    h = rows(spark, [(u, i, i, 5) for u in (1, 2) for i in (1, 2, 3)] + [(3, 1, 1, 5), (3, 4, 2, 1)])
    e = {(r["a"], r["b"]): (r["support"], r["score"]) for r in retrieval.covisitation(h).collect()}
    assert e[1, 2] == (2, round(2 / math.sqrt(3 * 2), 6)) and e[2, 3] == (2, 1.0) and (1, 4) not in e
    got = lists(retrieval.covisitation_top_k(ids(spark, [3, 9], "user_id"), h, retrieval.covisitation(h), ids(spark, [2, 3]), retrieval.seen(h), 5))
    assert got == {3: [2, 3]}


def test_profiles_and_dense_lists(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "item_id long, embedding array<double>")
    h = rows(spark, [(1, 7, 9, 5), (1, 1, 5, 5), (2, 4, 1, 5), (3, 2, 1, 5)])
    p = {r["user_id"]: r["profile"] for r in retrieval.content_profiles(h, v).collect()}
    assert set(p) == {1, 3} and p[1] == [1.0, 0.0]
    got = lists(retrieval.dense_top_k(retrieval.content_profiles(h, v), v, ids(spark, [1, 2, 3, 4]), retrieval.seen(h), 2, block=2))
    assert got == {1: [3, 2], 3: [3, 1]}


def test_union_ranks_and_fills(spark):
    s = "user_id long, item_id long, score double, rank int"
    a = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2)], s)
    b = spark.createDataFrame([(1, 11, 9.0, 1), (2, 12, 8.0, 1)], s)
    u = {(r["user_id"], r["item_id"]): r for r in candidates.union_sources({"popularity": a, "tt": b}).collect()}
    assert u[1, 10]["tt_rank"] == 0 and u[1, 10]["best_rank"] == 1 and u[1, 11]["best_rank"] == 1 and u[1, 11]["num_sources"] == 2
    pool = spark.createDataFrame([(10, 3.0)], "item_id long, score double")
    f = {(r["user_id"], r["item_id"]): r for r in candidates.fill_scores(candidates.union_sources({"popularity": a, "tt": b}), pool, "tt_score").collect()}
    assert f[1, 10]["tt_score"] == 7.0 and f[1, 11]["popularity_score"] == 0.0


def test_status_order(spark):
    truth = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "user_id long, item_id long")
    got = spark.createDataFrame([(1, 1)], "user_id long, item_id long")
    h = rows(spark, [(u, 2, u, 5) for u in range(5)] + [(9, 3, 1, 5)])
    assert {r["status"]: r["n"] for r in candidates.target_status(truth, got, h).collect()} == {"retrieved": 1, "eligible_not_retrieved": 1, "low_support": 1, "cold": 1}


def naive(groups, sizes, k):
    aucs, mrr, ndcg = [], [], []
    for u, pairs in groups.items():
        pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        if pos and neg:
            aucs.append((len(pairs), sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))))
        order = sorted(pairs, key=lambda x: (-x[0], x[1]))
        if pos:
            mrr.append(1 / next(r for r, x in enumerate(order, 1) if x[1]))
            t = max(sizes.get(u, 0), len(pos))
            ideal = sum(1 / math.log2(r + 1) for r in range(1, min(t, k) + 1))
            ndcg.append(sum(1 / math.log2(r + 1) for r, x in enumerate(order[:k], 1) if x[1]) / ideal)
    return sum(n * a for n, a in aucs) / sum(n for n, _ in aucs), sum(mrr) / len(mrr), sum(ndcg) / len(ndcg)


def test_metrics_equal_a_naive_loop(spark):
    rng = random.Random(1)
    groups = {u: [(rng.randint(0, 6) / 2, int(rng.random() < 0.15)) for _ in range(rng.randint(1, 24))] for u in range(40)}
    flat = spark.createDataFrame([(u, s, y) for u, pairs in groups.items() for s, y in pairs], "user_id long, score double, label int")
    sizes = {u: sum(y for _, y in pairs) + u % 2 for u, pairs in groups.items()} | {99: 2}
    size = spark.createDataFrame([(u, n) for u, n in sizes.items() if n], "user_id long, n_targets long")
    g, m, n = naive(groups, sizes, 5)
    e = metrics.full_evaluation(flat, size, [5]).first()
    assert e["gauc"] == pytest.approx(g, abs=1e-5) and e["mrr"] == pytest.approx(m, abs=1e-5) and e["ndcg_5"] == pytest.approx(n, abs=1e-5)
    every = [x for p in groups.values() for x in p]
    pos, neg = [s for s, y in every if y], [s for s, y in every if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert e["global_auc"] == pytest.approx(want, abs=1e-6)
    # a monotone transform and another row order change nothing
    moved = flat.withColumn("score", F.exp("score") * 3 + 1).orderBy(F.rand(3)).repartition(5)
    assert metrics.full_evaluation(moved, size, [5]).first() == e


def test_guards_raise(spark):
    flat = spark.createDataFrame([(1, float("nan"), 1)], "user_id long, score double, label int")
    size = spark.createDataFrame([(1, 1)], "user_id long, n_targets long")
    with pytest.raises(ValueError):
        metrics.check_inputs(flat, size)
    with pytest.raises(ValueError):
        metrics.check_inputs(spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 1)], flat.schema), size)
    with pytest.raises(ValueError):
        calibration.check_in_sync(spark.createDataFrame([(1, 5, 1)], "user_id long, item_id long, label int"), spark.createDataFrame([(1, 6)], "user_id long, item_id long"))
    with pytest.raises(ValueError):
        candidates.check_fingerprint(candidates.weight_fingerprint([1], {"a": 1.0}), [2], {"a": 1.0})


def test_short_lists_divide_by_k(spark):
    truth = spark.createDataFrame([(1, 10), (2, 11)], "user_id long, item_id long")
    got = spark.createDataFrame([(1, 10, 1)], "user_id long, item_id long, rank int")
    r = metrics.recall_precision(truth, got, [10]).first()
    assert (r["recall"], r["precision"], r["n_users"]) == (0.5, 0.05, 2)


def test_anchor_closes_gaps(spark):
    l = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "user_id long, item_id long, rank int")
    val, test = (spark.createDataFrame([(1, i)], "user_id long, item_id long") for i in (5, 7))
    got = metrics.anchor_score(l, val, test, [2]).first()
    assert got["recall"] == 1.0 and got["ndcg"] == round(1 / math.log2(3), 6)


def test_freeze_rule(spark):
    schema = "arm string, r10 double, r100 double, n_rows long"
    pick = lambda data: [r["arm"] for r in metrics.freeze_choice(spark.createDataFrame(data, schema), "A0").where("chosen").collect()]
    assert pick([("A0", 0.3, 0.5, 10), ("A1", 0.29, 0.9, 10)]) == ["A0"]
    assert pick([("A0", 0.3, 0.5, 10), ("A1", 0.31, 0.6000, 20), ("A2", 0.32, 0.5997, 30)]) == ["A2"]
    assert pick([("A0", 0.3, 0.5, 10), ("A1", 0.31, 0.6, 20), ("A2", 0.31, 0.6, 10)]) == ["A2"]


def test_calibration(spark):
    rng = random.Random(2)
    data = []
    for k in range(4000):
        z = rng.gauss(0, 2)
        data.append((k % 50, k, int(rng.random() < 1 / (1 + math.exp(-(0.7 * z - 1)))), z, k % 5, k % 400))
    df = spark.createDataFrame(data, "user_id long, item_id long, label int, logit double, n_history_events long, item_n_reviews long")
    a, b, losses = calibration.platt(df, 5.0)
    assert abs(a - 0.7) < 0.08 and abs(b + 1) < 0.15 and losses[-1] < losses[0]
    p = df.withColumn("p", sigmoid(F.col("logit") * a + b))
    assert calibration.ece_equal(p).first()["ece"] < 0.03 and calibration.ece_quantile(p).first()["ece"] < 0.04
    constant = df.withColumn("p", F.lit(0.5))
    assert calibration.ece_quantile(constant).first()["ece"] == calibration.ece_equal(constant).first()["ece"]
    fitted = calibration.fit_stage(df, 5.0)
    sizes = df.where("label = 1").groupBy("user_id").agg(F.count("*").alias("n_targets"))
    assert calibration.locked_stage(df, sizes, fitted, [10]).count() == 1
    with pytest.raises(ValueError):
        calibration.locked_stage(df, sizes, fitted | {"a": 9.0}, [10])
    assert sorted(r["view"] for r in calibration.view_blocks(calibration.with_views(p)).collect()).count("all") == 1


def test_sampler_never_draws_seen_items(spark):
    h = rows(spark, [(u, i, i, 1 + (u + i) % 5) for u in range(6) for i in range(5)])
    out = models.sample_pairs(h, ids(spark, range(30)), 2)
    soft = out.where("kind = 'soft_negative'")
    want = {r["user_id"]: 2 * r["n"] for r in h.where("label = 1").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert {r["user_id"]: r["count"] for r in soft.groupBy("user_id").count().collect()} == want
    assert soft.join(h, ["user_id", "item_id"], "left_semi").count() == 0
    a, b = (sorted((r[0], r[1]) for r in models.sample_pairs(h, ids(spark, range(30)), 2, epoch=e).where("kind = 'soft_negative'").collect()) for e in (0, 1))
    assert a != b


def test_random_lists_are_distinct_unseen_and_even(spark):
    h = rows(spark, [(1, i, 1, 5) for i in range(5)])
    users, pool = ids(spark, range(1, 300), "user_id"), ids(spark, range(20))
    got = lists(retrieval.random_top_k(users, pool, retrieval.seen(h), 6, 3))
    assert all(len(v) == len(set(v)) == 6 for v in got.values()) and not set(got[1]) & set(range(5))
    first = [v[0] for v in got.values()]
    assert len(set(first)) == 20 and max(first.count(x) for x in set(first)) < 40
    assert lists(retrieval.random_top_k(users, pool, retrieval.seen(h), 6, 4)) != got
    assert len(lists(retrieval.random_top_k(users, pool, retrieval.seen(h), 50, 3))[1]) == 15
