"""Models learn from all rows and are judged by all users, whatever the bounds of one pass (F16-F19)."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pitrec.operators import autograd as A
from pitrec.operators import averaging, metrics, orchestrate, rankers, retrieval, towers

from .test_learned import planted, slopes, some_rows

FEW = towers.CONFIG | {"max_pairs": 300, "max_items": 30, "max_users": 20, "ids": 512, "batch": 128, "tail": 32, "lr": 0.02}


def test_towers_learn_from_every_pair_and_the_whole_pool(spark):
    df, items = planted(spark)
    now = orchestrate.Built(df, 100, 10**9, 1)
    data, want = towers.gather(now.hist, items, now.pool, 100, FEW), towers.gather(now.hist, items, now.pool, 100, FEW | {"max_pairs": 10**6, "max_items": 10**6})
    assert isinstance(data, towers.Shards) and data.n == 5 and data.n_pool == want.n_pool == 80
    pairs, tail, shards = {}, {}, []
    rows = data.dealt.toArrow()
    for shard in range(data.n):
        own = towers._sample(rows.filter(pa.compute.equal(rows["shard"], shard)), 80, 20)
        shards.append(len(own.label))
        for n, key in enumerate(zip(own.user_key.tolist(), own.item_key.tolist())):
            assert key not in pairs
            pairs[key] = (own.users["taste"][n].tolist(), own.users["numbers"][n].tolist(), own.items["bucket"][n], own.items["numbers"][n].tolist(), own.q[n])
        for n, i in enumerate(own.tail_key.tolist()):
            assert i not in tail
            tail[i] = own.tail["bucket"][n]
    assert max(shards) < 600
    assert tail == dict(zip(want.tail_key.tolist(), want.tail["bucket"].tolist()))
    assert set(pairs) == set(zip(want.user_key.tolist(), want.item_key.tolist())) and len(pairs) == len(want.label) == 1440
    for n, key in enumerate(zip(want.user_key.tolist(), want.item_key.tolist())):
        assert pairs[key] == (want.users["taste"][n].tolist(), want.users["numbers"][n].tolist(), want.items["bucket"][n], want.items["numbers"][n].tolist(), want.q[n])


def test_an_epoch_is_the_mean_of_its_shards_by_rows(spark):
    rows = spark.range(40).selectExpr("cast(id % 5 as int) as shard", "id", "cast(id as double) as x").where("id > 3 or id = 0")
    dealt = averaging.deal(rows, 5, "id")

    def learn(weights, part, shard):
        return {"a": weights["a"] + part["x"].to_numpy().sum(), "b": weights["b"] * shard}, part.num_rows, float(part.num_rows * shard)

    got, loss = averaging.epoch(dealt, 5, {"a": np.ones((2, 2)), "b": np.array(2.0)}, learn)
    own = {s: [i for i in range(40) if i % 5 == s and (i > 3 or i == 0)] for s in range(5)}
    n = sum(map(len, own.values()))
    assert np.allclose(got["a"], 1 + sum(sum(v) * len(v) for v in own.values()) / n) and got["a"].shape == (2, 2)
    assert np.isclose(got["b"], sum(2.0 * s * len(v) for s, v in own.items()) / n) and np.isclose(loss, sum(s * len(v) for s, v in own.items()) / n)


def test_every_user_is_judged_over_the_whole_pool(spark):
    df, items = planted(spark)
    now = orchestrate.Built(df, 100, 10**9, 1)
    inputs, model = towers.user_inputs(now.hist, now.users, 100), towers.Towers()
    want = towers.recall_judge(inputs, now.targets, now.seen, towers.gather(now.hist, items, now.pool, 100), k=10)(model)
    few = {"max_users": 20}
    for config in (towers.CONFIG | few, towers.CONFIG | few | {"max_pairs": 300, "max_items": 30}):
        judge = towers.recall_judge(inputs, now.targets, now.seen, towers.gather(now.hist, items, now.pool, 100, config), config, 10)
        assert abs(judge(model) - want) < 1e-9


def test_towers_find_planted_taste_in_shards(spark):
    df, items = planted(spark)
    now = orchestrate.Built(df, 100, 10**9, 1)
    data = towers.gather(now.hist, items, now.pool, 100, FEW)
    model, n, losses = towers.train(data, FEW, 8)
    again = towers.train(data, FEW, 2)[2]
    assert n == 8 and losses[-1] < losses[0] and losses[:2] == again
    lists = towers.tower_lists(model, now.hist, items, now.users, now.pool, now.seen, 100, 10)
    known = now.targets.where("user_id < 900")
    found = metrics.recall_precision(known, lists, [10]).first()["recall"]
    drawn = metrics.recall_precision(known, retrieval.random_top_k(now.users, now.pool, now.seen, 10), [10]).first()["recall"]
    assert found > 1.3 * drawn


def some_candidates(spark, events=False):
    rng = random.Random(9)
    codes = {u: [rng.randrange(1, 6) for _ in range(5 * (u % 30))] for u in range(60)}  # some longer than LENGTH events, some empty
    rows = [(u, i, float(i), rng.random(), f"s{i % 3}", f"c{i % 2}", int(rng.random() < (0.5 if i < 5 else 0.02)), codes[u] if events else []) for u in range(60) for i in range(40)]
    return spark.createDataFrame(rows, "user_id long, item_id long, a double, b double, store string, main_category string, label int, events array<int>").persist()


def test_rankers_learn_from_every_row(spark):
    df = some_candidates(spark, True)
    scale, rows = rankers.moments(df, ["a", "b"]), rankers.inputs(df, ["a", "b"])
    whole, dealt = rankers.gathered(rows, scale), rankers.gathered(rows, scale, 400)
    assert len(whole.label) == 2400 and (whole.weight == 1).all() and dealt.n == 6
    parts = [rankers._shard(p, scale, True) for p in (dealt.dealt.where(f"shard = {s}").toArrow() for s in range(6)) if p.num_rows]
    got = rankers.Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in vars(whole)))
    order = np.lexsort((got.item, got.user))
    for c, want in vars(whole).items():
        assert np.array_equal(getattr(got, c)[order], want), c
    for e, codes in df.select("user_id", "events").distinct().toPandas().itertuples(index=False):
        own = whole.events[whole.user == e][0]
        assert own[own[:, 0] > 0].ravel().tolist() == list(codes)[-100:]


def test_many_positives_are_all_learned_from(spark):
    df = some_candidates(spark)
    rows = rankers.inputs(df.where("label = 1"), ["a", "b"])
    n = rows.count()
    assert len(rankers.gathered(rows, (np.zeros(2), np.ones(2)), n).label) == n


@pytest.mark.parametrize("kind", ["cross", "vanilla", "causal"])
def test_rankers_learn_in_shards(spark, kind):
    df = some_candidates(spark, kind != "cross")
    scale = rankers.moments(df, ["a", "b"])
    model, losses = rankers.refit(df, ["a", "b"], kind, 0.01, 6, 5.0, scale, 400)
    again = rankers.refit(df, ["a", "b"], kind, 0.01, 2, 5.0, scale, 400)[1]
    assert losses[-1] < losses[0] and losses[:2] == again
    lists = retrieval.top_k(rankers.score(rankers.inputs(df, ["a", "b"]), model, scale), 5)
    assert lists.where("item_id < 5").count() > 0.7 * lists.count()


def test_sequences_are_encoded_once_a_run(monkeypatch):
    rng = np.random.default_rng(3)
    data = some_rows(rng)
    data.events = np.repeat(data.events[:6], 4, axis=0)
    data.events[5] = data.events[0]
    model, seen = rankers.Ranker("hstu", 4, deep=(5, 3), dim=4), []
    for p in model.p.values():
        p.data = rng.normal(0, 0.5, p.data.shape)
    alone = np.concatenate([model.logits(data.take([k])).data for k in range(24)])
    pooled = model.pooled
    monkeypatch.setattr(model, "pooled", lambda events: seen.append(len(events)) or pooled(events))
    assert np.allclose(model.logits(data).data, alone) and seen == [1 + sum(not np.array_equal(a, b) for a, b in zip(data.events[1:], data.events[:-1]))]
    assert len(model.logits(data.take(slice(0, 0))).data) == 0
    x = A.Var(rng.normal(size=(3, 2)))
    slopes({"w_x": x}, lambda: A.total(A.taken(x, np.array([0, 2, 0, 1])) * A.var(np.arange(8.0).reshape(4, 2))), rng)


def test_all_held_users_are_judged(spark):
    df = some_candidates(spark)
    scale, rows = rankers.moments(df, ["a", "b"]), rankers.inputs(df, ["a", "b"])
    truth, model = df.where("label = 1").select("user_id", "item_id"), rankers.Ranker("mlp", 2)
    want = rankers.held_recall(rows, truth, scale, 5)(model)
    assert 0 < want and abs(rankers.held_recall(rows, truth, scale, 5, 20)(model) - want) < 1e-9
