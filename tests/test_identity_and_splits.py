import pytest
from pyspark.sql import functions as F

from pitrec.functions import expressions as X
from pitrec.operators import features, filtering, identity, profile, snapshots

ROWS = "user_id long, item_id long, ts long, rating int, label int"
DAY = X.DAY_MS


def rows(spark, data):
    return spark.createDataFrame([(u, i, t, r, int(r >= 3)) for u, i, t, r in data], ROWS)


ITEMS = "item_id long, title string, store string, rating_number int, price string, main_category string, categories array<string>"


def catalog(spark):
    return spark.createDataFrame(
        [
            (1, "Red  Lamp", "Acme", 10, "$12.99", "Home", ["Home", "Lamps"]),
            (2, "red lamp ", "Acme", 30, "from 14.99", "Home", ["Home"]),
            (3, "Red Lamp", "Other", 50, "junk", "Home", []),
            (4, None, "Acme", 5, None, "Home", None),
            (5, "Blue Lamp", None, 7, "3", "Home", ["Home"]),
            (6, "Blue Lamp", "  ", 9, "", None, ["Home"]),
        ],
        ITEMS,
    )


def test_titles_and_stores(spark):
    got = catalog(spark).select("item_id", X.normalize_title(F.col("title")).alias("t"), X.store_merge_key(F.col("store")).alias("s")).collect()
    t, s = {r[0]: r["t"] for r in got}, {r[0]: r["s"] for r in got}
    assert t[1] == t[2] == t[3] == "red lamp" and t[4] == "" and s[5] == s[6] == "" and s[1] == "Acme"


def test_canonical_map_merges_only_known_legs(spark):
    got = {r["raw_item_id"]: r["canonical_item_id"] for r in identity.canonical_map(catalog(spark)).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    assert identity.store_conflicts(catalog(spark), identity.canonical_map(catalog(spark))).count() == 0
    plain = identity.canonical_map(catalog(spark).drop("store"))
    assert plain.where("raw_item_id <> canonical_item_id").count() == 0


def test_canonicalize_drops_orphans_and_duplicates(spark):
    data = [(1, 1, 5, 4), (1, 2, 3, 2), (1, 9, 1, 5), (2, 3, 1, None), (2, 3, 4, 3)]
    df = spark.createDataFrame(data, "user_id long, item_id long, ts long, rating int")
    out = identity.canonicalize(df, identity.canonical_map(catalog(spark)))
    assert sorted((r["user_id"], r["item_id"], r["ts"], r["label_type"]) for r in out.collect()) == [(1, 2, 3, "hard_negative"), (2, 3, 4, "positive")]
    stats = identity.canonicalize_stats(df, identity.canonical_map(catalog(spark)), out).first()
    assert (stats["n_null_dropped"], stats["n_orphans"], stats["n_duplicates"], stats["n_remapped"]) == (1, 1, 1, 1)


def test_row_order_does_not_matter(spark):
    a = catalog(spark)
    b = a.orderBy(F.desc("item_id")).repartition(3)
    assert sorted(identity.canonical_map(a).collect()) == sorted(identity.canonical_map(b).collect())


def test_prices_and_texts(spark):
    got = {r[0]: r[1] for r in catalog(spark).select("item_id", X.price(F.col("price"))).collect()}
    assert got == {1: 12.99, 2: 14.99, 3: None, 4: None, 5: 3.0, 6: None}
    texts = {r["item_id"]: r["text"] for r in identity.item_texts(catalog(spark)).collect()}
    assert texts[1] == "Red  Lamp | Acme | Home | Lamps" and texts[4] == "Acme" and texts[6] == "Blue Lamp | Home"
    alone = spark.createDataFrame([(7, "nan", None, ["None"])], "item_id long, title string, store string, categories array<string>")
    assert identity.item_texts(alone).first()["text"] == "unknown item"


def test_missing_price_is_flagged_before_the_fill(spark):
    train = rows(spark, [(1, 1, 1, 5), (2, 1, 2, 1)])
    got = {r["item_id"]: r for r in features.item_features(catalog(spark), train, train).collect()}
    assert got[3]["price_missing"] == 1 and got[3]["price"] == 12.99 and got[1]["n_reviews"] == 2 and got[1]["in_train_positive_catalog"] == 1 and got[5]["avg_rating"] == 0.0


def test_kcore_reaches_a_fixed_point(spark):
    data = [(u, i, u, 5) for u in range(4) for i in range(4)] + [(9, 0, 1, 5), (8, 77, 1, 5), (8, 0, 1, 5), (8, 1, 2, 5)]
    core, report = filtering.iterative_kcore(rows(spark, data), 3, 2)
    assert core.count() == 16 and report[-1][-1] == 0 and core.where("user_id in (8, 9)").count() == 0
    empty, last = filtering.iterative_kcore(rows(spark, data), 50, 50)
    assert empty.count() == 0 and last[-1][3] == 0


def test_leave_last_two_breaks_ties_by_item(spark):
    data = [(1, 3, 10, 5), (1, 2, 10, 5), (1, 1, 10, 5), (1, 9, 1, 5), (2, 1, 1, 5), (2, 2, 2, 5)]
    got = {(r["user_id"], r["item_id"]): r["split"] for r in filtering.leave_last_two(rows(spark, data)).collect()}
    assert got == {(1, 3): "test", (1, 2): "val", (1, 1): "train", (1, 9): "train"}
    d = filtering.dropped_users(rows(spark, data)).first()
    assert (d["n_users_dropped"], d["n_rows_dropped"]) == (1, 2)
    t = filtering.tie_rates(rows(spark, data)).first()
    assert (t["n_any_tie"], t["n_edge_tie"]) == (1, 1)


def test_holdout_has_the_share(spark):
    users = spark.range(1000).withColumnRenamed("id", "user_id")
    assert filtering.user_holdout(users).where("part = 'held'").count() == 200
    assert filtering.user_holdout(users.limit(1)).where("part = 'held'").count() == 1


def test_quantiles_are_exact(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 10**12, 5000)
    df = spark.createDataFrame([(int(v),) for v in values], "ts long")
    want = [float(np.quantile(values, q)) for q in (0.0, 0.7, 0.81, 1.0)]
    assert snapshots.quantiles(df, "ts", [0.0, 0.7, 0.81, 1.0]) == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(snapshots, "FEW", 50)
    monkeypatch.setattr(snapshots, "BUCKETS", 16)
    assert snapshots.quantiles(df, "ts", [0.0, 0.7, 0.81, 1.0]) == pytest.approx(want, rel=1e-12)


def test_cutoff_rules(spark):
    df = rows(spark, [(1, k, k * DAY, 5) for k in range(100)])
    a, b, end = snapshots.resolve_cutoffs(df)
    assert (a, b, end) == (79 * DAY + DAY // 5, 89 * DAY + DAY // 10, 99 * DAY + 1)
    with pytest.raises(ValueError):
        snapshots.resolve_cutoffs(df, ["1970-03-01", "1970-02-01"])
    with pytest.raises(ValueError):
        snapshots.resolve_four_cutoffs(df, ["1970-02-01", None, None])
    assert snapshots.iso_to_ms("1970-01-02") == DAY and snapshots.ms_to_iso(DAY).startswith("1970-01-02")


def test_history_is_strictly_before_the_cutoff(spark):
    data = [(1, 1, 9, 5), (1, 2, 10, 5), (1, 3, 15, 2), (2, 2, 20, 5)]
    bounds = snapshots.bounds_frame(spark, [("a", 10, 20), ("b", 20, 30)])
    hist = snapshots.history(rows(spark, data), bounds)
    assert sorted((r["snapshot"], r["ts"]) for r in hist.collect()) == [("a", 9), ("b", 9), ("b", 10), ("b", 15)]
    truth = snapshots.ground_truth(rows(spark, data), bounds, least_item=1, least_user=1).collect()
    assert sorted((r["snapshot"], r["user_id"], r["item_id"], r["n_history_events"], r["item_in_history"]) for r in truth) == [("a", 1, 2, 1, 0), ("b", 2, 2, 0, 1)]
    assert snapshots.assert_before(rows(spark, data), 21).count() == 4
    with pytest.raises(Exception):
        snapshots.assert_before(rows(spark, data), 20).collect()


def test_future_rows_change_nothing(spark):
    data = [(u, i, u + i, 1 + (u * i) % 5) for u in range(8) for i in range(6)]
    late = [(u, 99, 1000 + u, 5) for u in range(8)]
    a, b = rows(spark, data), rows(spark, data + late)
    keep = lambda df: sorted(features.user_features_at(df.where("ts < 10"), 10).collect())
    assert keep(a) == keep(b)


def test_single_row_deviation_is_zero(spark):
    got = features.user_features(rows(spark, [(1, 1, 1, 4)])).first()
    assert got["std_rating"] == 0.0 and got["span_days"] == 0.0 and got["verified_sum"] == 0


def test_vocabulary_and_scaling(spark):
    df = spark.createDataFrame([("b",), ("a",), ("zz",), ("a",), (None,)], "c string")
    vocab = features.vocabulary(df, "c")
    assert sorted((r["value"], r["idx"]) for r in vocab.collect()) == [("a", 1), ("b", 2), ("zz", 3)]
    coded = features.encode(spark.createDataFrame([("zz",), ("new",), (None,)], "c string"), "c", vocab, "i")
    assert sorted(r["i"] for r in coded.collect()) == [0, 0, 3]
    same = features.scale(spark.createDataFrame([(5,), (5,)], "x int"), ["x"]).collect()
    assert [r["x"] for r in same] == [0.0, 0.0]


def test_profile_small_cases(spark):
    df = spark.createDataFrame([(1, None, []), (2, "a", ["x", "y"]), (3, "b", None)], "item_id long, s string, l array<string>")
    got = {r["column_name"]: r for r in profile.column_summary(df, ["s", "l"]).collect()}
    assert got["l"]["empty"] == 1 and got["l"]["max_length"] == 2 and got["s"]["null_rate"] == pytest.approx(1 / 3, abs=1e-6)
    with pytest.raises(ValueError):
        profile.preflight(df.where("item_id <> 2"), ["l"])
    profile.preflight(df, ["l"])
    assert profile.entropy(spark.createDataFrame([("a",), ("b",)], "c string"), "c").first()[0] == 1.0


def test_alignment_statuses(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 2.0])], "item_id long, embedding array<double>")
    mapping = spark.createDataFrame([(1, 2), (2, 2), (3, 3)], "raw_item_id long, canonical_item_id long")
    keys = spark.createDataFrame([(2,), (3,), (4,)], "item_id long")
    got = {r["item_id"]: (r["embedding"], r["status"]) for r in identity.align_embeddings(vectors, mapping, keys, 2).collect()}
    assert got == {2: ([0.5, 0.5], "rebuilt"), 3: ([2.0, 2.0], "aligned"), 4: ([0.0, 0.0], "not_present")}


def test_kcore_without_a_fixed_point_raises(spark):
    chain = [(k, k, 1, 5) for k in range(30)] + [(k, k + 1, 1, 5) for k in range(30)]  # a path loses one end a round
    with pytest.raises(RuntimeError):
        filtering.iterative_kcore(rows(spark, chain), 2, 2, max_iter=3)
