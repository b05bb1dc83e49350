import random
import re

import pytest
from pyspark.sql import functions as F

from pitrec.operators import candidates, lists, metrics, retrieval
from pitrec.plans import registry
from pitrec.plans.frames import Snapshot

from .test_scale_of_lists import ids, plan


@pytest.mark.parametrize("near, rows", [(200_000, 100_000), (6, 1)])
def test_lists_made_by_user_equal_the_grouped_union(spark, monkeypatch, near, rows):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", near)
    monkeypatch.setattr(lists, "ROWS", rows)
    rng = random.Random(6)
    pairs = [(u, rng.randrange(30)) for u in range(15) for _ in range(rng.randint(0, 25))] + [(99, 3), (None, 4)]
    seen = spark.createDataFrame(pairs, "user_id long, item_id long").distinct()
    users = spark.createDataFrame([(u,) for u in [*range(18), None]], "user_id long")
    pool = spark.createDataFrame([(i, i + 5) for i in range(28)] + [(None, 9)], "item_id long, n long")
    orders = {n: spark.createDataFrame([(i, -float(i % m)) for i in range(28)], "item_id long, score double") for n, m in (("a", 7), ("b", 5))}
    met = spark.createDataFrame([(u, i, i / 10, r) for u in range(12) for r, i in enumerate(rng.sample(range(28), 4), 1)], "user_id long, item_id long, score double, rank int")
    truth = spark.createDataFrame([(u, i, 10 if u is None else u) for u in [*range(18), None] for i in [*rng.sample(range(28), 5), None]], "user_id long, item_id long, n_history_events long")
    made = lists.user_lists(users, orders, {"c": met.join(pool, "item_id")}, pool, seen, truth, 6)
    got = lists.candidates(made, ["a", "b", "c"])
    union = candidates.union_sources({n: retrieval.top_unseen(users, s, pool, seen, 6) for n, s in orders.items()} | {"c": met})
    want = candidates.attach_labels(union, truth).join(pool.select("item_id", F.col("n").alias("item_n_reviews")), "item_id", "left").fillna(0, subset=["item_n_reviews"]).select(*got.columns)
    assert got.count() == want.count() > 100 and got.where("label = 1").count() > 10 and got.where("item_id is null").count()
    assert not got.exceptAll(want).count() and not want.exceptAll(got).count()


def test_candidates_come_with_labels_and_support_without_a_shuffle(spark, sf):
    s = Snapshot(spark, sf)
    for df in (s.candidates(10), s.scored(10), s.union(10)):
        assert "Exchange" not in plan(df) and "Join" not in plan(df)


def test_metrics_of_lists_equal_those_of_rows(spark, sf):
    s = Snapshot(spark, sf)
    sizes = s.targets.groupBy("user_id").agg(F.count("*").alias("n_targets"))
    got = metrics.list_metrics(s.scored_lists(10), sizes, [3, 10])
    assert got.first() == metrics.grouped_metrics(s.scored(10), sizes, [3, 10]).first()
    rng = random.Random(1)
    rows = spark.createDataFrame([(u, float(rng.randrange(-2, 3)), int(rng.random() < 0.3)) for u in range(20) for _ in range(rng.randint(1, 9))], "user_id long, score double, label int")
    held = rows.groupBy("user_id").agg(F.collect_list(F.struct("score", "label")).alias("list"))
    few = spark.createDataFrame([(u, 4) for u in range(25)], "user_id long, n_targets long")
    lists_of, rows_of = metrics.list_metrics(held, few, [1, 5]), metrics.grouped_metrics(rows, few, [1, 5])
    assert lists_of.dtypes == rows_of.dtypes and lists_of.first() == rows_of.first()
    assert not re.search(r"score#\d+L? (ASC|DESC)", plan(got))


@pytest.mark.parametrize("name", ["e13_mrr", "e14_ndcg", "e15_denominators"])
def test_list_queries_do_not_sort_candidates(spark, sf, name):
    assert not re.search(r"score#\d+L? (ASC|DESC)", plan(registry.queries()[name](spark, sf)))


@pytest.mark.parametrize("name", ["b2_review_buckets", "b12_view_blocks"])
def test_calibration_reads_candidates_without_joins(spark, sf, name):
    assert "Join" not in plan(registry.queries()[name](spark, sf))


def test_conditional_recall_shuffles_hits_only(spark, sf):
    text = plan(registry.queries()["e7_conditional_recall"](spark, sf))
    assert len(re.findall(r"Filter \(?.*label#\d+ = 1", text)) >= 2 and "sequence(" not in text


def test_basket_pairs_are_counted_without_an_aggregate_of_pairs(spark):
    rng = random.Random(2)
    held = {u: rng.sample(range(12), rng.randint(1, 9)) for u in range(30)}
    rows = spark.createDataFrame([(u, i, u, 1) for u, x in held.items() for i in x], "user_id long, item_id long, ts long, label int")
    got = retrieval.covisitation(rows, cosine=False)
    assert not re.search(r"HashAggregate\(keys=\[a#\d+L?, b#", plan(got))
    want = {(a, b): n for a in range(12) for b in range(12) if a != b and (n := sum(a in x and b in x for x in held.values())) >= 2}
    assert {(r["a"], r["b"]): r["support"] for r in got.collect()} == want


@pytest.mark.parametrize("size, most", [(1, 1), (3, 4), (1000, 1 << 20)])
def test_counts_of_an_item_go_on_over_batches(size, most):
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((a, rng.sample(range(a + 1, a + 9), rng.randint(1, 6))) for a in (1, 1, 2, 4, 4, 4, 4, 4, 4, 4, 7, 9, 9))
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in x]), pa.array([b for _, b in x])], names=["a", "bs"]) for x in (rows[k : k + size] for k in range(0, len(rows), size))]
    found = [r for out in retrieval.met_often(2, most)(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns))]
    n = {}
    for a, bs in rows:
        for b in bs:
            n[a, b] = n.get((a, b), 0) + 1
    half = [(a, b, c) for (a, b), c in n.items() if c >= 2]
    assert sorted(found) == sorted(half + [(b, a, c) for a, b, c in half])
