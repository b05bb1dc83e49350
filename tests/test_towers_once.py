"""What the towers' queries do once: keys drawn, inputs fetched, vectors made, towers fitted (F14)."""

import numpy as np
import pyarrow as pa

import __spark_entry__
from pitrec.operators import autograd as A
from pitrec.operators import orchestrate, towers

from .test_learned import planted


def test_vectors_are_made_once(spark, monkeypatch):
    df, items = planted(spark)
    now, made = orchestrate.Built(df, 100, 10**9, 1), spark.sparkContext.accumulator(0)
    encode = towers.encode

    def counted(inputs, model, side):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        vectors = encode(inputs, model, side)
        return vectors.mapInArrow(run, vectors.schema)

    monkeypatch.setattr(towers, "encode", counted)
    lists = towers.tower_lists(towers.Towers(), now.hist, items, now.users, now.pool, now.seen, 100, 10)
    assert lists.count() == 123 * 10
    assert made.value == 123 + 80


def test_the_first_snapshot_is_not_refitted(spark, sf, monkeypatch):
    train, calls = towers.train, []

    def counted(*args, **kw):
        calls.append(kw.get("epochs"))
        return train(*args, **kw)

    monkeypatch.setattr(towers, "train", counted)
    got = __spark_entry__.queries()["m6_frozen_refits"](spark, sf).collect()
    assert [r["snapshot"] for r in got] == ["train", "select", "test"] and all(r["same_config"] for r in got)
    assert len(calls) == 3 and calls[0] is None and calls[1] == calls[2] >= 1


def test_samples_equal_a_plain_join(spark):
    df, items = planted(spark)
    df, items = df.withColumn("item_id", df["item_id"] * 3), items.where("item_id <> 4").withColumn("item_id", items["item_id"] * 3)
    now = orchestrate.Built(df, 100, 10**9, 1)
    sample = towers.gather(now.hist, items, now.pool, 100)
    own = {r["item_id"]: r for r in towers.item_inputs(items, now.hist).collect()}
    asked = {r["user_id"]: r for r in towers.user_inputs(now.hist, now.users, 100).collect()}
    pairs = sorted((r["user_id"], r["item_id"]) for r in now.hist.where("label = 1").select("user_id", "item_id").distinct().collect() if r["item_id"] in own)
    assert pairs == list(zip(sample.user_key.tolist(), sample.item_key.tolist()))
    tail = sorted(r["item_id"] for r in now.pool.collect() if r["item_id"] in own)
    assert tail == sample.tail_key.tolist()
    for n, (u, i) in enumerate(pairs):
        taste = asked[u]["taste"]
        assert sample.users["bucket"][n] == asked[u]["bucket"] and sample.users["taste"][n].tolist() == taste + [0] * (20 - len(taste)) and sample.users["numbers"][n].tolist() == asked[u]["numbers"]
        assert [sample.items[c][n] for c in ("bucket", "store", "category")] == [own[i][c] for c in ("bucket", "store", "category")] and sample.items["numbers"][n].tolist() == own[i]["numbers"]
    for n, i in enumerate(tail):
        assert sample.tail["bucket"][n] == own[i]["bucket"] and sample.tail["numbers"][n].tolist() == own[i]["numbers"]
    assert np.isfinite(sample.q).all() and (sample.q < 0).all() and sample.label.tolist() == [1.0] * len(pairs)


def test_a_judge_equals_its_lists(spark):
    df, items = planted(spark)
    now = orchestrate.Built(df, 100, 10**9, 1)
    sample, model = towers.gather(now.hist, items, now.pool, 100), towers.Towers()
    judge = towers.recall_judge(towers.user_inputs(now.hist, now.users, 100), now.targets, now.seen, sample, k=10)
    inputs = towers.user_inputs(now.hist, now.users, 100).toArrow()
    scores = model.user(towers._users(inputs, 20)).data @ model.item(sample.tail).data.T
    seen, wanted, values = {(r["user_id"], r["item_id"]) for r in now.seen.collect()}, {}, []
    for r in now.targets.collect():
        wanted.setdefault(r["user_id"], set()).add(r["item_id"])
    for u, row in sorted(zip(inputs.column("user_id").to_pylist(), scores), key=lambda x: x[0]):
        order = sorted((i for i in sample.tail_key.tolist() if (u, i) not in seen), key=lambda i: (-row[np.searchsorted(sample.tail_key, i)], i))[:10]
        values.append(len(wanted[u] & set(order)) / len(wanted[u]))
    assert abs(judge(model) - np.mean(values)) < 1e-12


def test_first_places_equal_a_stable_sort():
    rng = np.random.default_rng(1)
    for n, k in ((1, 5), (50, 50), (300, 7)):
        for low in (0, -np.inf):
            scores = rng.integers(0, 6, n).astype(float)
            scores[rng.random(n) < 0.9] = low
            assert towers.first_places(scores, k).tolist() == np.argsort(-scores, kind="stable")[:k].tolist()


def test_long_empty_and_no_histories_as_columns():
    rows = pa.table({"bucket": pa.array([3, 4, 5], pa.int32()), "numbers": [[0.0, 1.0, 2.0]] * 3, "taste": pa.array([[1, 2, 3], [], [9]], pa.list_(pa.int32()))})
    assert towers._users(rows, 2)["taste"].tolist() == [[1, 2], [0, 0], [9, 0]]
    assert towers._users(rows.slice(1, 2), 2)["taste"].tolist() == [[0, 0], [9, 0]] and towers._users(rows.slice(0, 0), 2)["numbers"].shape == (0, 3)
    assert towers._users(rows.to_batches()[0].slice(2, 1), 2)["taste"].tolist() == [[9, 0]]


def test_gradients_of_rows_add_up_where_an_index_repeats():
    rng = np.random.default_rng(2)
    table, index, g = A.Var(rng.normal(size=(7, 3))), rng.integers(0, 7, (5, 4)), rng.normal(size=(5, 4, 3))
    want = np.zeros((7, 3))
    np.add.at(want, index.ravel(), g.reshape(-1, 3))
    want[0] = 0
    assert np.array_equal(A.rows(table, index)._back(g)[0], want)
