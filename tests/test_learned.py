import math
import random

import numpy as np
import pytest

from pitrec.operators import autograd as A
from pitrec.operators import metrics, orchestrate, rankers, retrieval, towers

SMALL = towers.CONFIG | {"ids": 50, "stores": 8, "categories": 8, "id_dim": 4, "hidden": 6, "dim": 4, "last": 5, "batch": 64, "tail": 16}


def slopes(params, loss, rng, cells=3, h=1e-6):
    """Gradients against finite differences at some cells of every array that the loss reads."""
    loss().backward()
    grads = {k: None if p.grad is None else p.grad.copy() for k, p in params.items()}
    for k, p in params.items():
        for _ in range(cells):
            at = tuple(rng.integers(n) for n in p.data.shape)
            if grads[k] is None or (p.data.ndim == 2 and at[0] == 0 and not k.startswith("w_")):
                continue  # padding rows are not trained
            was = p.data[at] if p.data.ndim else float(p.data)

            def put(v):
                data = p.data.copy()
                data[at] = v
                p.data = data

            put(was + h)
            up = float(loss().data)
            put(was - h)
            down = float(loss().data)
            put(was)
            assert abs((up - down) / (2 * h) - grads[k][at]) < 1e-5 * max(1, abs(grads[k][at])), (k, at)


def some_users(rng, n):
    taste = rng.integers(1, 51, (n, 5)) * (rng.random((n, 5)) < 0.7)
    return {"bucket": rng.integers(1, 51, n), "numbers": rng.normal(size=(n, 3)), "taste": taste}


def some_items(rng, n):
    return {"bucket": rng.integers(1, 51, n), "store": rng.integers(0, 9, n), "category": rng.integers(0, 9, n), "numbers": rng.normal(size=(n, 3))}


def test_tower_gradients():
    rng = np.random.default_rng(1)
    model = towers.Towers(SMALL)
    for p in model.p.values():
        p.data = p.data * 4.0
    u, i, t = some_users(rng, 9), some_items(rng, 9), some_items(rng, 6)
    user_key, item_key = rng.integers(0, 5, 9), i["bucket"]
    model.p["scale"].data = np.array(1.1)

    def softmax():
        return towers.softmax_loss(model.user(u, i["bucket"]), model.item(i), user_key, item_key, np.log(rng_q), A.exp(model.p["scale"]), model.item(t), t["bucket"], -2.0)

    rng_q = rng.random(9)
    slopes(model.p, softmax, rng)
    y = rng.integers(0, 2, 9).astype(float)
    slopes(model.p, lambda: A.weighted_bce(A.total(model.user(u) * model.item(i), axis=1) * A.exp(model.p["scale"]), y, np.ones(9)), rng)


def test_softmax_masks_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    u, v, t = (A.Var(rng.normal(size=(n, 4))) for n in (6, 6, 5))
    user, item, tail = np.array([1, 1, 2, 3, 4, 2]), np.array([9, 8, 9, 7, 6, 5]), np.array([9, 1, 2, 6, 6])
    q, scale = np.log(rng.random(6)), 2.5
    total = 0.0
    for r in range(6):
        own = scale * float(u.data[r] @ v.data[r]) - q[r]
        cells = [own] + [scale * float(u.data[r] @ v.data[c]) - q[c] for c in range(6) if c != r and item[c] != item[r] and user[c] != user[r]]
        cells += [scale * float(u.data[r] @ t.data[c]) + 3.0 for c in range(5) if tail[c] != item[r]]
        total += math.log(sum(math.exp(x) for x in cells)) - own
    got = towers.softmax_loss(u, v, user, item, q, A.Var(scale), t, tail, -3.0)
    assert abs(float(got.data) - total / 6) < 1e-9


def test_history_pools_without_its_target_and_empty_ones_to_zero():
    model = towers.Towers(SMALL)
    taste = np.array([[3, 4, 0, 0, 0], [7, 7, 0, 0, 0], [0, 0, 0, 0, 0]])
    got = model.pooled(taste, np.array([4, 7, 1])).data
    assert np.allclose(got[0], model.p["item_id"].data[3]) and not got[1].any() and not got[2].any()
    assert np.allclose(model.pooled(taste).data[0], model.p["item_id"].data[[3, 4]].mean(axis=0))


def test_decay_is_for_weight_matrices_alone():
    model = towers.Towers(SMALL)
    before = {k: p.data.copy() for k, p in model.p.items()}
    steps = A.AdamW(model.p, 0.1, 0.5)
    for p in model.p.values():
        p.grad = np.zeros_like(p.data)
    steps.step()
    for k, p in model.p.items():
        assert np.allclose(p.data, before[k] * (0.95 if k.startswith("w_") else 1.0))


def planted(spark):
    """Users buy within their half of the catalog; the last purchases are the targets."""
    rng = random.Random(3)
    rows = []
    for u in range(120):
        own = rng.sample(range(u % 2, 80, 2), 16)
        rows += [(u, i, n if n < 12 else 100 + n, 5, 1, True, 0) for n, i in enumerate(own)]
    rows += [(900 + k, k, 200, 5, 1, True, 0) for k in range(3)]  # cold users
    df = spark.createDataFrame(rows, "user_id long, item_id long, ts long, rating int, label int, verified boolean, helpful int")
    items = spark.createDataFrame([(i, f"s{i % 2}", f"c{i % 4}", i % 7) for i in range(80)], "item_id long, store string, main_category string, rating_number int")
    return df, items


def test_towers_find_planted_taste_and_list_cold_users(spark):
    df, items = planted(spark)
    now = orchestrate.Built(df, 100, 10**9, 1)
    config = towers.CONFIG | {"ids": 512, "batch": 128, "tail": 32, "lr": 0.02}
    sample = towers.gather(now.hist, items, now.pool, 100, config)
    judge = towers.recall_judge(towers.user_inputs(now.hist, now.users, 100, config), now.targets, now.seen, sample, config, 10)
    _, epochs, losses = towers.train(sample, config, 8, judge=judge)
    model, n, again = towers.train(sample, config, epochs)
    assert n == epochs and losses[: len(again)] == again  # the refit repeats the chosen run
    lists = towers.tower_lists(model, now.hist, items, now.users, now.pool, now.seen, 100, 10)
    found = metrics.recall_precision(now.targets.where("user_id < 900"), lists, [10]).first()["recall"]
    drawn = metrics.recall_precision(now.targets.where("user_id < 900"), retrieval.random_top_k(now.users, now.pool, now.seen, 10), [10]).first()["recall"]
    assert found > 1.3 * drawn
    assert {r["user_id"] for r in lists.select("user_id").distinct().collect()} >= {900, 901, 902}
    assert towers.fingerprint(config, epochs) != towers.fingerprint(config, epochs + 1)


def some_rows(rng, n=24):
    events = rng.integers(1, 6, (n, rankers.LENGTH, 5)) * (np.arange(rankers.LENGTH)[None, :, None] < rng.integers(0, 8, n)[:, None, None])
    return rankers.Rows(np.repeat(np.arange(6), n // 6), np.arange(n), rng.normal(size=(n, 4)), rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 9, n), events, rng.integers(0, 2, n).astype(float), rng.random(n) + 0.5)


@pytest.mark.parametrize("kind", ["mlp", "cross", "vanilla", "mh_pool", "causal", "hstu"])
def test_ranker_gradients(kind):
    rng = np.random.default_rng(4)
    model, data = rankers.Ranker(kind, 4, deep=(5, 3), dim=4), some_rows(rng)
    for k, p in model.p.items():
        p.data = rng.normal(0, 0.5, p.data.shape)
        if not k.startswith(("w_", "b_")):
            p.data[0] = 0
    slopes(model.p, lambda: A.weighted_bce(model.logits(data), data.label, data.weight), rng)


def test_cross_without_weights_gives_its_input_back():
    model = rankers.Ranker("cross", 4)
    for k, p in model.p.items():
        if "cross" in k:
            p.data = np.zeros_like(p.data)
    x = A.Var(np.random.default_rng(5).normal(size=(7, 4 + 16)))
    assert np.array_equal(model.cross(x).data, x.data)


@pytest.mark.parametrize("kind", ["vanilla", "mh_pool", "causal", "hstu"])
def test_sequence_residual_starts_as_the_cross_network(kind):
    rng = np.random.default_rng(6)
    data, base, model = some_rows(rng), rankers.Ranker("cross", 4), rankers.Ranker(kind, 4)
    for k in base.p:
        model.p[k] = base.p[k]
    assert np.allclose(model.logits(data).data, base.logits(data).data)
    model.p["w_over_2"].data = np.ones((32, 1))
    later = model.logits(data).data
    assert not np.allclose(later, base.logits(data).data)
    data.events[:, 12:] = 3  # events of the padding's places are read once they are there
    assert not np.allclose(model.logits(data).data, later)


def test_causal_states_do_not_read_later_events():
    rng = np.random.default_rng(7)
    model, events = rankers.Ranker("causal", 4), rng.integers(1, 6, (3, rankers.LENGTH, 5))
    short = events.copy()
    short[:, 5:] = 0
    changed = events.copy()
    changed[:, :5] = short[:, :5]
    cut = model.pooled(short).data
    changed[:, 5:] = 0
    assert np.allclose(cut, model.pooled(changed).data) and not np.allclose(cut, model.pooled(events).data)


def test_recall_of_a_ranker_equals_a_plain_loop():
    rng = np.random.default_rng(8)
    model, data = rankers.Ranker("mlp", 4), some_rows(rng)
    score = model.logits(data).data
    sizes = {u: 3 for u in range(6)} | {99: 2}
    want = []
    for u, n in sizes.items():
        own = sorted((k for k in range(24) if data.user[k] == u), key=lambda k: (-score[k], data.item[k]))[:2]
        want.append(sum(data.label[k] for k in own) / n)
    assert abs(rankers.recall_of(model, data, sizes, 2) - np.mean(want)) < 1e-12


def test_ranker_sample_weights_and_learning(spark):
    rng = random.Random(9)
    rows = [(u, i, float(i), rng.random(), f"s{i % 3}", f"c{i % 2}", int(rng.random() < (0.5 if i < 5 else 0.02))) for u in range(60) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, a double, b double, store string, main_category string, label int").persist()
    scale = rankers.moments(df, ["a", "b"])
    few = rankers.collected(rankers.inputs(df, ["a", "b"]), scale, 400)
    assert len(few.label) < 500 and abs(few.weight.sum() / 2400 - 1) < 0.15 and abs((few.weight * few.label).sum() - df.where("label = 1").count()) < 60
    model, losses = rankers.refit(df, ["a", "b"], "cross", 0.01, 6, 5.0, scale)
    assert losses[-1] < losses[0]
    lists = retrieval.top_k(rankers.score(rankers.inputs(df, ["a", "b"]), model, scale), 5)
    assert lists.where("item_id < 5").count() > 0.9 * 300
    table, best, _, _ = rankers.select(df.where("user_id < 40"), df.where("user_id >= 40"), df.where("label = 1 and user_id >= 40").select("user_id", "item_id"), ["a", "b"], k=5, epochs=2)
    assert len(table) == 4 and best[3] == max(t[3] for t in table)


def test_snapshots_share_the_weights_of_the_first(spark, tmp_path):
    df, items = planted(spark)
    cuts = [6, 9, 100, 300]
    built = orchestrate.build_all(df, items, str(tmp_path), [{"store": 1.0, "prior": 0.0}, {"store": 0.0, "prior": 1.0}], 5, cutoffs=cuts)
    assert list(built) == ["train", "select", "test"] and orchestrate.frozen(spark, f"{tmp_path}/weights", cuts) == {"store": 1.0, "prior": 0.0}
    again = orchestrate.build_all(df, items, str(tmp_path), [{"store": 1.0, "prior": 0.0}], 5, names=("train",), cutoffs=cuts[:2])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["select", "test", "train", "weights"] and list(again) == ["train"]
    with pytest.raises(ValueError):
        orchestrate.frozen(spark, f"{tmp_path}/weights", cuts)
    with pytest.raises(FileNotFoundError):
        orchestrate.frozen(spark, f"{tmp_path}/none", cuts)
