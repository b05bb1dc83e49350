import math
from collections import Counter

from pitrec.llm import mixing

from .helpers import DOCS, frame


def test_sources_far_below_their_share_reach_it(spark):
    rows = [(k, "t", "en", "rare" if k < 8 else "big", 1) for k in range(8000)]
    out = mixing.mix(frame(spark, rows, DOCS), {"rare": 0.5, "big": 0.5}).select("doc_id", "source", "copy").collect()
    share = Counter(r["source"] for r in out)  # the rate of "rare" is 500
    assert abs(share["rare"] - 4000) < 6 * math.sqrt(4000) and abs(share["big"] - 4000) < 6 * math.sqrt(4000)
    per = Counter(r["doc_id"] for r in out if r["source"] == "rare")
    assert len(per) == 8 and all(abs(n - 500) < 6 * math.sqrt(500) for n in per.values())


def test_poisson_inversion_at_high_rates(spark):
    rates = spark.createDataFrame([(x,) for x in (64.5, 144.0, 1000.0)], "rate double")
    tables = rates.select("rate", mixing.least_count(rates.rate).alias("low"), mixing.cumulative(rates.rate).alias("cdf")).collect()
    for rate, low, cdf in tables:
        got = [low + sum(c < (k + 0.5) / 4000 for c in cdf) for k in range(4000)]
        mean = sum(got) / len(got)
        assert abs(mean - rate) < 0.02 * math.sqrt(rate)
        assert abs(sum((x - mean) ** 2 for x in got) / len(got) / rate - 1) < 0.03


def shares(df):
    n = Counter(r["source"] for r in df.select("source").collect())
    return {s: k / sum(n.values()) for s, k in n.items()}


def near(got, want, n):
    return abs(got - want) < 6 * math.sqrt(want / n)


def test_named_sources_get_their_share_and_the_others_the_rest(spark):
    rows = [(k, f"t{k}", "en", "hot" if k % 3 == 0 else f"s{k % 8}", 1) for k in range(24_000)]
    got = shares(mixing.mix(frame(spark, rows, DOCS), {"hot": 0.15, "s1": 0.25, "absent": 0.1}))
    assert near(got["hot"], 0.15, 24_000) and near(got["s1"], 0.25, 24_000)
    rest = [got[f"s{k}"] for k in (0, 2, 3, 4, 5, 6, 7)]
    assert abs(sum(rest) - 0.6) < 0.02 and all(abs(x - 0.6 / 7) < 0.01 for x in rest)
    over = shares(mixing.mix(frame(spark, rows, DOCS), {"hot": 3.0, "s1": 1.0}))
    assert set(over) == {"hot", "s1"} and near(over["hot"], 0.75, 24_000)


def test_rows_with_one_id_or_none_draw_for_themselves(spark):
    rows = [(None if k % 2 else 7, f"t{k}", "en", "s", 1) for k in range(4000)]
    out = mixing.mix(frame(spark, rows, DOCS)).select("text", "copy", "shuffle_key").collect()
    per = Counter(r["text"] for r in out)
    assert abs(len(per) / 4000 - (1 - math.exp(-1))) < 0.04 and abs(len(out) / 4000 - 1) < 0.08
    assert len({r["shuffle_key"] for r in out}) == len(out)


def test_equal_rows_draw_for_themselves_however_they_are_partitioned(spark):
    rows = [(None, "same", "en", "s", 1)] * 3000 + [(k, "x" * 100_000, "en", "s", 1) for k in range(3)]
    a, b = (mixing.mix(frame(spark, rows, DOCS).repartition(n)).select("doc_id", "copy", "shuffle_key").collect() for n in (3, 11))
    assert sorted(a, key=str) == sorted(b, key=str)
    same = [r for r in a if r["doc_id"] is None]
    assert abs(len(same) / 3000 - 1) < 0.1 and len({r["shuffle_key"] for r in same}) == len(same)
