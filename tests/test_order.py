import random

import numpy as np
from pyspark.sql import functions as F

from pitrec.operators import order


def test_places_are_those_of_a_sorted_list(spark):
    rng = random.Random(1)
    data = [(k, rng.choice([0.0, 1.5, 1.5, 1.5, rng.random()])) for k in range(500)]
    got = {r["k"]: r["place"] for r in order.places(spark.createDataFrame(data, "k int, v double").repartition(7), F.desc("v"), "k").collect()}
    want = {k: n for n, (k, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1)}
    assert got == want
    assert order.places(spark.createDataFrame([], "k int, v double"), "v", "k").count() == 0


def test_running_sums(spark):
    data = [(k, (k * 37) % 11) for k in range(200)]
    got = {r["k"]: r["before"] for r in order.running(spark.createDataFrame(data, "k int, n int"), "n", "k").collect()}
    assert got == {k: sum(n for q, n in data if q < k) for k, _ in data}


def test_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    data = [(g, v) for g in (0, 1, 3) for v in ([7.0] if g == 3 else [rng.choice([0.0, 0.5, rng.random()]) for _ in range(301 + g)])] + [(1, None)]
    df = spark.createDataFrame(data, "g int, v double").repartition(5)
    got = order.grouped_quantiles(df, "v", qs, "g")
    for g in (0, 1, 3):
        assert np.allclose(got[g], np.quantile([v for h, v in data if h == g and v is not None], qs))
    assert np.allclose(order.quantiles(df, "v", qs), np.quantile([v for _, v in data if v is not None], qs))
    assert order.quantiles(df.where("v > 9"), "v", [0.5]) == [None]
