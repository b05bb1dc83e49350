"""One-pass runners and gates against plain versions of themselves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pitrec.functions.expressions import DAY_MS
from pitrec.operators import anchor, digest, features, gates, itemknn, metrics, models, retrieval, segments, snapshots, tuning
from pitrec.sources import versions

ROWS = "user_id long, item_id long, ts long, rating int, label int, verified boolean, helpful long"


def some_rows(spark, seed, n=300, users=12, items=25, repeated=False):
    rng, rows, pairs = random.Random(seed), [], set()
    for _ in range(n):
        u, i, r = rng.randrange(users), rng.randrange(items), rng.randint(1, 5)
        if repeated or (u, i) not in pairs:
            pairs.add((u, i))
            rows.append((u, i, rng.randrange(100 * DAY_MS), r, int(r >= 3), rng.random() < 0.5, rng.randrange(4)))
    return spark.createDataFrame(rows, ROWS)


ITEMS = "item_id long, store string, main_category string, rating_number long, categories array<string>"


def catalog(spark, seed=0, n=30):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, rng.choice([None, "s1", "s2", "s3"]), rng.choice(["c1", "c2", None]), k, ["a"]) for k in range(n)], ITEMS)


@pytest.mark.parametrize("repeated", [False, True])
def test_features_of_all_snapshots_equal_those_of_each(spark, tmp_path, repeated):
    rows, items = some_rows(spark, 3, repeated=repeated), catalog(spark)
    names, cuts = ["a", "b", "c"], [20 * DAY_MS, 55 * DAY_MS, 80 * DAY_MS, 100 * DAY_MS]
    out = segments.run(rows, items, str(tmp_path), names, cuts)
    for j, name in enumerate(names):
        hist = rows.where(F.col("ts") < cuts[j])
        for got, want in ((out["user_features"], features.user_features_at(hist, cuts[j])), (out["item_features"], features.item_features_at(items, hist))):
            got = got.where(F.col("snapshot") == name)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert digest.digest_of(segments.history(str(tmp_path), spark, name, names)) == digest.digest_of(hist)
    facts = {(r["snapshot"], r["name"]): r["value"] for r in out["manifest"].collect()}
    assert facts["b", "n_history"] == rows.where(F.col("ts") < cuts[1]).count() and facts["", "version of groundtruth"] == 1
    with pytest.raises(ValueError):
        segments.run(rows, items, str(tmp_path), names, cuts[:-1])


def test_one_pass_over_a_grid_equals_a_run_a_point(spark):
    rows, items = some_rows(spark, 8, 260, 14, 30), catalog(spark, 4)
    hist, late = rows.where(F.col("ts") < 60 * DAY_MS), rows.where(F.col("ts") >= 60 * DAY_MS)
    truth = metrics.truth_sets(late)
    users, pool = truth.select("user_id").distinct(), hist.select("item_id").distinct()
    seen = retrieval.seen(hist, users)
    grid = tuning.weight_grid(["store", "main_category"])
    assert len(grid) == 27 and len(tuning.weight_grid(["store"])) == 9
    grid += [{"store": 0.0, "main_category": 1.0, "prior": 0.0}]
    got = {r["grid_index"]: r for r in tuning.tune(users, hist, items, pool, seen, truth, grid, [3, 6], 6).collect()}
    for n in (0, 2, 7, 13, 26, 27):
        lists = retrieval.rule_scores(users, hist, items, pool, seen, grid[n], 6)
        want = {r["k"]: r for r in metrics.recall_precision(truth, lists, [3, 6]).collect()}
        assert (got[n]["recall_3"], got[n]["precision_6"]) == (want[3]["recall"], want[6]["precision"])
    best = max(got.values(), key=lambda r: (r["recall_6"], -r["grid_index"]))
    assert [r["grid_index"] for r in got.values() if r["best"]] == [best["grid_index"]]


def test_the_superset_holds_every_vectors_list(spark):
    rows, items = some_rows(spark, 9, 200, 10, 30), catalog(spark, 5)
    users, pool = rows.select("user_id").distinct(), rows.select("item_id").distinct()
    seen = retrieval.seen(rows, users)
    grid = tuning.weight_grid(["store", "main_category"])
    held = {(r["user_id"], r["item_id"]) for r in tuning.superset(users, rows, items, pool, seen, grid, 4).collect()}
    for w in grid[::5]:
        assert {(r["user_id"], r["item_id"]) for r in retrieval.rule_scores(users, rows, items, pool, seen, w, 4).collect()} <= held


@pytest.mark.parametrize(("block", "least", "k"), [(256, 0.0, 100), (3, 0.0, 4), (2, 0.35, 100)])
def test_item_neighbours_by_brute_force(spark, block, least, k):
    rng = random.Random(k)
    pairs = {(rng.randrange(9), rng.randrange(15)) for _ in range(60)} | {(77, i) for i in range(15)}
    rows = spark.createDataFrame([*pairs, *list(pairs)[:9]], "user_id long, item_id long")
    by = {i: {u for u, x in pairs if x == i} for i in range(15)}
    want = {}
    for a in by:
        near = sorted((-round(len(by[a] & by[b]) / math.sqrt(len(by[a]) * len(by[b])), 6), b) for b in by if b != a and by[a] & by[b])
        want |= {(a, b): (-s, n + 1) for n, (s, b) in enumerate([x for x in near if -x[0] >= least][:k])}
    near = itemknn.neighbours(rows, k, least=least, block=block)
    assert {(r["item_id"], r["neighbour"]): (r["score"], r["place"]) for r in near.collect()} == want
    users, pool = rows.select("user_id"), rows.select("item_id")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in itemknn.knn_top_k(users, rows, near, pool, retrieval.seen(rows), 3).collect()}
    for (u, i), s in got.items():
        assert (u, i) not in pairs and abs(s - sum(x for (a, b), (x, _) in want.items() if a == i and (u, b) in pairs)) < 1e-5


def test_digests_of_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (2, None, "b"), (3, "", "c")], "k long, x string, y string")
    one = digest.digest_of(df)
    assert digest.digest_of(df.repartition(7)) == digest.digest_of(df.select("y", "k", "x").orderBy(F.desc("k"))) == one
    others = [df.limit(3), df.union(df.where("k = 1")), df.withColumn("x", F.coalesce("x", F.lit(""))), df.withColumn("k", F.col("k") + 1), df.withColumnRenamed("x", "z"), df.distinct()]
    assert len({one, *map(digest.digest_of, others)}) == 7
    assert digest.digest_of(df.limit(0)) == digest.digest_of(df.where("k > 9"))
    found = digest.row_differences(df, df.distinct().union(spark.createDataFrame([(9, "n", None)], df.schema))).collect()
    assert sorted((r["side"], r["k"]) for r in found) == [("first", 2), ("second", 9)]


def test_backfill(spark, tmp_path):
    rows, table = some_rows(spark, 5), str(tmp_path / "all")
    bounds = snapshots.bounds_frame(spark, [("v", 30 * DAY_MS, 60 * DAY_MS), ("t", 60 * DAY_MS, 100 * DAY_MS)])
    frozen = snapshots.ground_truth(rows, bounds, "first")
    report = {r["snapshot"]: r for r in gates.backfill_all_positive(rows, bounds, frozen, table, dry_run=True).collect()}
    assert versions.current(spark, table) is None and report["v"]["n_rows"] >= report["v"]["n_frozen"] == report["v"]["n_users"]
    gates.backfill_all_positive(rows, bounds, frozen, table)
    assert digest.digest_of(versions.read(spark, table)) == digest.digest_of(snapshots.ground_truth(rows, bounds, "all"))
    for bad in (frozen.where("user_id <> 3"), frozen.withColumn("n_history_events", F.col("n_history_events") + 1), frozen.union(frozen.limit(1))):
        with pytest.raises(digest.Differs, match="user_id"):
            gates.backfill_all_positive(rows, bounds, bad, str(tmp_path / "bad"))
    assert versions.current(spark, str(tmp_path / "bad")) is None


def test_official_split(spark, tmp_path):
    rows = [(u, i, 5, t, s) for u in range(6) for t, (i, s) in enumerate([(u, "train"), (u + 1, "train"), (u + 2, "val"), (u + 3, "test")])]
    splits = spark.createDataFrame(rows, "user_id long, item_id long, rating int, ts long, split string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("official", "")
    facts = gates.official_split(splits, str(tmp_path / "ok"), (6, 9, 24))
    n_jobs = len(tracker.getJobIdsForGroup("official"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert facts == {"users": 6, "items": 9, "interactions": 24} and 0 < n_jobs <= 8  # two writes with the stages of their shuffles, and the schemas of what is read back
    assert versions.read(spark, str(tmp_path / "ok/interactions")).count() == 24
    cases = {"other triple": (splits, (6, 9, 25)), "other items": (splits, (6, 8, 24)), "two test rows": (splits.union(spark.createDataFrame([(1, 50, 5, 9, "test")], splits.schema)), (6, 10, 25)), "no val row": (splits.where("not (user_id = 2 and split = 'val')"), (6, 9, 23))}
    for name, (bad, expected) in cases.items():
        with pytest.raises(gates.Refused):
            gates.official_split(bad, str(tmp_path / name.replace(" ", "_")), expected)
        assert versions.current(spark, str(tmp_path / name.replace(" ", "_") / "items")) is None


def test_calibrations_are_bound_to_their_dump(spark, tmp_path):
    dump = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 0, -1.0), (2, 10, 0, 0.0)], "user_id long, item_id long, label int, logit double")
    truth = spark.createDataFrame([(1, 10), (2, 12)], "user_id long, item_id long")
    table, frozen = str(tmp_path / "dump"), str(tmp_path / "frozen")
    gates.write_dump(dump, table, seed=1)
    assert not gates.read_dump(spark, table)[1]["capped"] and gates.label_mode(truth) == "first_positive"
    gates.freeze_calibration(spark, frozen, table, {"a": 1.5}, "first_positive")
    assert gates.frozen_calibration(spark, frozen, table, truth) == {"a": 1.5}
    several = truth.union(spark.createDataFrame([(1, 12)], truth.schema))
    assert gates.label_mode(several) == "all_positive" and gates.label_mode(several, "first_positive") == "first_positive" and gates.label_mode(truth.limit(0)) == "unknown"
    with pytest.raises(gates.Refused, match="labels"):
        gates.frozen_calibration(spark, frozen, table, several)
    gates.write_dump(dump.withColumn("logit", F.col("logit") + 1), table)
    with pytest.raises(gates.Refused, match="dump"):
        gates.frozen_calibration(spark, frozen, table, truth)
    gates.write_dump(dump, table, max_users=5)
    with pytest.raises(gates.Refused, match="capped"):
        gates.freeze_calibration(spark, frozen, table, {}, "first_positive")
    number = gates.write_dump(dump, table)
    versions.write(dump.union(dump.limit(1)), f"{table}/rows")  # rows without a meta row are not read
    assert gates.read_dump(spark, table)[0].count() == 3 and versions.entries(spark, f"{table}/rows")[-1][0] == number + 1


def test_dumps_are_found_scored_and_compared(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        anchor.read_legs(spark, folder)
    lists = lambda *rows: spark.createDataFrame(list(rows), "user_id long, item_id long, rank int")
    anchor.write_leg(lists((1, 7, 1), (1, 5, 2), (2, 6, 1), (2, 8, 2)), folder, "a")  # 7 is user 1's validation item
    anchor.write_leg(lists((1, 9, 1), (2, 8, 1), (2, 6, 2)), folder, "b")
    (tmp_path / "leg=half").mkdir()  # a dump whose writer died
    assert anchor.discover(spark, folder) == ["a", "b"]
    with pytest.raises(FileNotFoundError, match="half"):
        anchor.read_legs(spark, folder, ["a", "half"])
    val, tests = (spark.createDataFrame(x, "user_id long, item_id long") for x in ([(1, 7)], [(1, 5), (2, 6), (3, 1)]))
    table = anchor.comparison(anchor.score(anchor.read_legs(spark, folder), val, tests, [1, 2]), ["b", "a", "c"])
    got = {(r["metric"], r["k"]): (r["a"], r["b"], r["c"]) for r in table.collect()}
    assert table.columns == ["metric", "k", "b", "a", "c"]
    assert got["recall", 1] == (round(2 / 3, 6), 0.0, None) and got["recall", 2] == (round(2 / 3, 6), round(1 / 3, 6), None)
    assert got["ndcg", 2] == (round(2 / 3, 6), round(1 / math.log2(3) / 3, 6), None)


def test_text_models_find_a_planted_signal(spark):
    """The three learned text models beat the majority class by far on words that tell the classes apart."""
    rng = random.Random(6)
    common = [f"word{k}" for k in range(30)]
    mark = {0: ["plain", "usual"], 1: ["splendid", "brilliant"], 2: ["dreadful", "broken"]}
    rows = []
    for k in range(400):
        y = rng.choices([0, 1, 2], [0.7, 0.2, 0.1])[0]
        rows.append((k, " ".join([rng.choice(common) for _ in range(8)] + [rng.choice(mark[y])]), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    train, held = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")

    def f1(df):
        pairs = [(int(r["rating"]), int(round(r["pred"]))) for r in df.collect()]
        assert len(pairs) == 100
        score = lambda c: 2 * sum(a == b == c for a, b in pairs) / max(1, sum((a == c) + (b == c) for a, b in pairs))
        return sum(map(score, (0, 1, 2))) / 3

    assert f1(models.text_classifier(train, held, "y")) > 0.9
    assert f1(models.text_network(train, held, "y", hidden=6, iterations=40)) > 0.9
    majority = held.select("doc_id", F.col("y").alias("rating"), F.lit(0.0).alias("pred"))
    assert f1(majority) < 0.35
    near = models.text_regression(train, held, "y").agg(F.corr("rating", "pred")).first()[0]
    assert near > 0.8
    with pytest.raises(Exception):
        models.text_network(train.limit(0), held, "y")
