import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitrec.operators import candidates, itemknn, metrics, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_candidates_with_small_files_are_never_broadcast(spark, tmp_path):
    spark.range(5000).selectExpr("id % 50 as user_id", "id div 50 as item_id", "1 as source_a", "1 as a_rank").write.parquet(str(tmp_path / "c"))
    cands = spark.read.parquet(str(tmp_path / "c"))
    truth = spark.range(60).selectExpr("id as user_id", "id * 3 as item_id", "1 as item_in_history", "1 as item_in_eligible_pool", "id % 5 as n_history_events")
    pairs, lists = truth.select("user_id", "item_id"), cands.selectExpr("user_id", "item_id", "a_rank as rank")
    cover = candidates.coverage_report(cands, truth)
    recall = metrics.conditional_recall(pairs, cands, lists, [1])
    for df in (cover, recall, candidates.attach_labels(cands, truth)):
        left = [line for line in plan(df).split("\n") if "BroadcastExchange" in line]
        assert not left, left
    assert cover.first()["coverage_macro"] == round(34 / 60, 6)
    assert recall.first()["n_users"] == 34 and recall.first()["recall"] == 1.0


def test_global_lists_are_written_by_gaps(spark):
    rng = random.Random(4)
    seen = [(u, rng.randrange(30)) for u in range(12) for _ in range(rng.randint(0, 25))] + [(99, 3), (None, 4)]  # repeated pairs, a user not asked for, no user
    pairs = spark.createDataFrame(seen, "user_id long, item_id long")
    pool, scores = ids(spark, range(28), "item_id"), spark.createDataFrame([(i, float(i % 7)) for i in range(28)], "item_id long, score double")
    asked = list(range(13)) + [None]
    got = retrieval.top_unseen(spark.createDataFrame([(u,) for u in asked], "user_id long"), scores, pool, pairs, 6)
    assert "LeftAnti" not in plan(got)
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["user_id"], []).append((r["item_id"], r["rank"], r["score"]))
    order = sorted(range(28), key=lambda i: (-(i % 7), i))
    for u in asked:
        own = [i for i in order if u is None or (u, i) not in seen][:6]
        assert found.get(u, []) == [(i, n, float(i % 7)) for n, i in enumerate(own, 1)]
    assert set(found) <= set(asked)


def test_lists_of_several_sources_meet_without_a_shuffle_of_rows(spark):
    users, pool = ids(spark, range(20), "user_id"), ids(spark, range(30), "item_id")
    scores = lambda m: spark.createDataFrame([(i, float(i % m)) for i in range(30)], "item_id long, score double")
    seen = spark.createDataFrame([(u, u) for u in range(20)], "user_id long, item_id long")
    union = candidates.union_sources({n: retrieval.top_unseen(users, scores(m), pool, seen, 5) for n, m in (("a", 3), ("b", 7))})
    assert "hashpartitioning(user_id" in plan(union) and "item_id" not in "".join(x.split("hashpartitioning(")[1].split(")")[0] for x in plan(union).split("\n") if "hashpartitioning(" in x and "user_id" in x.split("hashpartitioning(")[1].split(")")[0])


@pytest.mark.parametrize("band, grid", [(65_536, 24), (3, 4)])
def test_dense_lists_equal_the_whole_product(spark, monkeypatch, band, grid):
    monkeypatch.setattr(retrieval, "BAND", band)
    monkeypatch.setattr(retrieval, "GRID", grid)
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties, some without a direction
    p = rng.normal(size=(11, 4))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, embedding array<double>")
    users = spark.createDataFrame([(u, x.tolist()) for u, x in enumerate(p)], "user_id long, profile array<double>")
    seen = {(u, int(i)) for u in range(9) for i in rng.integers(0, 60, 3 * u)} | {(10, i) for i in range(57)}
    pairs = spark.createDataFrame(list(seen), "user_id long, item_id long")
    got = retrieval.dense_top_k(users, items, ids(spark, range(2, 70), "item_id"), pairs, 7, block=5, group=2)
    with np.errstate(invalid="ignore"):
        cos = np.round(p @ (v / np.linalg.norm(v, axis=1)[:, None]).T, 6)
    want = {(u, i, n, cos[u, i] + 0.0) for u in range(11) for n, i in enumerate(sorted((i for i in range(2, 60) if v[i].any() and (u, i) not in seen), key=lambda i: (-cos[u, i], i))[:7], 1)}
    assert {(r["user_id"], r["item_id"], r["rank"], r["score"] + 0.0) for r in got.collect()} == want
    assert "LeftAnti" not in plan(got)


@pytest.mark.parametrize("users, block", [(65_536, 256), (3, 4)])
def test_item_neighbours_are_counted_without_a_shuffle_of_pairs(spark, monkeypatch, users, block):
    monkeypatch.setattr(itemknn, "USERS", users)
    rng = random.Random(8)
    held = {u: rng.sample(range(25), rng.randint(1, 12)) for u in range(14)}
    rows = spark.createDataFrame([(u, i) for u, x in held.items() for i in x], "user_id long, item_id long")
    got = itemknn.neighbours(rows, 4, block=block)
    assert "hashpartitioning(a#" in plan(got) and not re.search(r"hashpartitioning\(\S+, b#", plan(got))
    have = {i: {u for u in held if i in held[u]} for i in range(25)}
    want = set()
    for a in have:
        cos = {b: round(len(have[a] & have[b]) / (len(have[a]) * len(have[b])) ** 0.5, 6) for b in have if b != a and have[a] & have[b]}
        want |= {(a, b, cos[b], n) for n, b in enumerate(sorted(cos, key=lambda b: (-cos[b], b))[:4], 1)}
    assert {tuple(r) for r in got.select("item_id", "neighbour", "score", "place").collect()} == want


def test_rounding_keeps_the_sign_of_what_becomes_zero(spark):
    from pitrec.operators.rounding import r6_signed

    got = [r["x"] for r in spark.createDataFrame([(-3e-7,), (3e-7,), (-0.1234567,), (0.0,)], "x double").select(r6_signed(F.col("x")).alias("x")).collect()]
    assert [str(x) for x in got] == ["-0.0", "0.0", "-0.123457", "0.0"]


def test_sequences_are_not_kept_once_a_candidate(spark, sf):
    from pitrec.plans import more

    rows, items = more.interactions(spark, sf), more.adapters.catalog(spark, sf)
    t = more.snapshots.resolve_four_cutoffs(rows)
    _, table = more._table(rows, items, t[1], t[2], events=True)
    kept = table._jdf.queryExecution().withCachedData().toString().split("InMemoryRelation [")[1].split("]")[0]
    assert "events" in table.columns and "user_n_events#" in kept and not re.search(r"\bevents#", kept)


@pytest.mark.parametrize("band, grid, most", [(65_536, 24, 1 << 21), (4, 5, 3)])
def test_neighbours_lists_are_summed_where_users_lie(spark, monkeypatch, band, grid, most):
    for name, value in (("BAND", band), ("GRID", grid), ("MOST", most)):
        monkeypatch.setattr(itemknn, name, value)
    rng = random.Random(6)
    held = {u: rng.sample(range(30), rng.randint(1, 12)) for u in range(20)}
    rows = spark.createDataFrame([(u, i) for u, x in held.items() for i in x] + [(None, 3), (0, held[0][0])], "user_id long, item_id long")
    near = {(i, j): round(rng.choice([0.25, 0.5, rng.random()]), 6) for i in range(30) for j in rng.sample(range(30), 8) if i != j}  # many ties
    known = {(u, i) for u, x in held.items() for i in x if u % 3} | {(u, 7) for u in range(20)}
    users, pool = ids(spark, [*range(18), 99, 2], "user_id"), ids(spark, range(3, 40), "item_id")
    got = itemknn.knn_top_k(users, rows, spark.createDataFrame([(i, j, s) for (i, j), s in near.items()], "item_id long, neighbour long, score double"), pool, spark.createDataFrame(list(known), "user_id long, item_id long"), 5)
    assert "LeftAnti" not in plan(got) and not re.search(r"hashpartitioning\(user_id#\S+, item_id#|hashpartitioning\(neighbour#", plan(got))
    want = set()
    for u in range(18):
        score = {i: round(sum(near.get((i, j), 0.0) for j in held[u]), 6) for i in range(3, 30) if (u, i) not in known and any((i, j) in near for j in held[u])}
        want |= {(u, i, score[i], n) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1)}
    assert {tuple(r) for r in got.select("user_id", "item_id", "score", "rank").collect()} == want


@pytest.mark.parametrize("k", [4, None])
def test_random_lists_are_thinned_where_users_lie(spark, monkeypatch, k):
    rng = random.Random(2)
    seen = {(u, rng.randrange(30)) for u in range(12) for _ in range(u)}
    pairs, pool = spark.createDataFrame([*seen, (None, 4)], "user_id long, item_id long"), ids(spark, range(24), "item_id")
    users = spark.createDataFrame([(u, 1 + 2 * u) for u in range(14)], "user_id long, want long")
    ready = retrieval.placed(pool, pairs)
    got = retrieval.random_top_k(users, pool, pairs, k, 5, ready)
    if k:
        assert "LeftAnti" not in plan(got) and "Window" not in plan(got)
    place = {r["idx"]: r["item_id"] for r in ready[0].collect()}
    numbers = spark.range(14).selectExpr("id", *[f"conv(substring(md5(concat('5:{x}:', id)), 1, 12), 16, 10) as {x}" for x in "ab"])
    want = set()
    for u, a, b in numbers.collect():
        order = [place.get((int(a) % 29 + (1 + int(b) % 28) * i) % 29) for i in range(1, 30)]
        own = [x for x in order if x is not None and (u, x) not in seen][: k or 1 + 2 * u]
        want |= {(u, x, -float(n), n) for n, x in enumerate(own, 1)}
    assert {tuple(r) for r in got.collect()} == want
    monkeypatch.setattr(retrieval, "LONG", 9)
    assert {tuple(r) for r in retrieval.random_top_k(users, pool, pairs, k, 5).collect()} == want


def test_what_belongs_to_users_joins_candidates_by_user_alone(spark):
    cands = spark.createDataFrame([(u, i) for u in range(6) for i in range(9)] + [(1, None)], "user_id long, item_id long")
    items = spark.createDataFrame([(i, f"s{i % 3}" if i else None) for i in range(8)], "item_id long, store string")
    share = {(u, f"s{n}"): (u + n + 1) / 10 for u in range(5) for n in range(u % 3 + 1)}
    affinity = spark.createDataFrame([(u, s, x) for (u, s), x in share.items()], "user_id long, facet string, affinity double")
    tops = spark.createDataFrame([(u, "s1") for u in range(4)], "user_id long, top string")
    targets = {(u, 2 * u) for u in range(5)} | {(2, 3)}
    truth = spark.createDataFrame([(u, i, 7 * u) for u, i in targets], "user_id long, item_id long, n_history_events int")
    got = candidates.attach_labels(candidates.cross_features(cands, items, {"store": affinity}, {"store": tops}), truth)
    assert not re.search(r"hashpartitioning\(user_id#\w+, \w+#", plan(got))
    for r in got.collect():
        s = f"s{r['item_id'] % 3}" if r["item_id"] and r["item_id"] < 8 else None
        assert (r["store_affinity"], r["same_top_store"]) == (share.get((r["user_id"], s), 0.0), int(s == "s1" and r["user_id"] < 4))
        assert (r["label"], r["n_history_events"]) == (int((r["user_id"], r["item_id"]) in targets), 7 * r["user_id"] if r["user_id"] < 5 else 0)


def test_few_vectors_are_sent_to_the_candidates(spark, monkeypatch):
    cands = spark.createDataFrame([(u, i) for u in range(6) for i in range(9)], "user_id long, item_id long")
    vector = {i: [1.0, 0.0] if i % 2 else [0.6, 0.8] for i in range(7)}
    profiles = spark.createDataFrame([(u, [0.0, 1.0]) for u in range(4)], "user_id long, profile array<double>")
    units = spark.createDataFrame(list(vector.items()), "item_id long, u array<double>")
    want = {(u, i, (1.0 if i % 2 else 1.8) if u < 4 and i < 7 else 0.0) for u in range(6) for i in range(9)}
    sent = candidates.fill_content(cands, profiles, units)
    monkeypatch.setattr(candidates, "VECTORS", 3)
    joined = candidates.fill_content(cands, profiles, units)
    for df in (sent, joined):
        assert {tuple(r) for r in df.select("user_id", "item_id", "content_score").collect()} == want
    assert "hashpartitioning(item_id" not in plan(sent)
