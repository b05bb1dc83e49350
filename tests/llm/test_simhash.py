import random

import numpy as np

from pitrec.llm import simhash
from pitrec.llm.common import connected_components, spanning_forest

from .helpers import DOCS, ODD, documents, frame, prose


def groups(ids, fps, radius=3):
    """Brute force: all pairs, plain union-find."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if a < b and bin(x ^ y).count("1") <= radius:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_bits():
    rng = random.Random(1)
    for t in [*ODD, prose(rng, 50), "A B c", "a b C d"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_groups_match_brute_force(spark):
    rng = random.Random(2)
    texts = list(ODD)
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120)).split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            changed = list(base)
            changed[rng.randrange(len(changed))] = "changed"
            texts.append(" ".join(changed))
    texts += [texts[12]] * 5
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    fps = [simhash.fingerprint(t) for t in texts]
    assert {r["id"]: r["component"] for r in got} == groups(range(len(texts)), fps)
    assert all(r["fp"] & (2**64 - 1) == fps[r["id"]] for r in got)


def test_salted_tiles_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base} | {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)} | {rng.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.links_within(df, 3, tile_rows=16)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = groups(fps, fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    by_want, by_got = {}, {}
    for f in fps:
        by_want.setdefault(want[f], set()).add(f)
        by_got.setdefault(got.get(signed(f), signed(f)), set()).add(f)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_own_tile_in_two_orders():
    """The two sides gather a tile in orders of their own: no link may depend on them."""
    rng = np.random.default_rng(9)
    a = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)[rng.integers(0, 40, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    fps = [int(x) for x in a]
    want = groups(fps, fps)
    assert len(set(want.values())) < len(fps)
    for _ in range(20):
        x, y = simhash.near_pairs(rng.permutation(a), rng.permutation(a), True, 3)
        up = {f: f for f in fps}

        def find(f):
            while up[f] != f:
                f = up[f]
            return f

        for p, q in zip(x.tolist(), y.tolist()):
            p, q = find(p), find(q)
            up[max(p, q)] = min(p, q)
        assert {f: find(f) for f in fps} == want


def test_pairs_of_one_large_cell_are_spread(spark):
    """Fingerprints of one cell: its tile pairs are dealt over many tasks."""
    rng = random.Random(6)
    ones = [sum(1 << 16 * p + b for p in range(4) for b in rng.sample(range(16), 8)) for _ in range(1500)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(ones)], "fp long")
    pairs = simhash.tile_pairs(df, 3, tile_rows=100, task_comparisons=20_000).selectExpr("spark_partition_id() as p", "size(fps_a) * size(fps_b) as n")
    per = [r["n"] for r in pairs.groupBy("p").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()]
    assert len(per) > 40 and max(per) < 0.12 * sum(per)


def test_empty_repeated_and_extra_columns(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (None, None, None, None, None)]
    df = frame(spark, rows, DOCS).selectExpr("*", "1 as fp", "2 as component", "'x' as id")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r["id"] or 0, r["component"] or 0) for r in got) == [(0, 0), (1, 1), (1, 1)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in range(100, 160)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_forest_keeps_groups():
    rng = np.random.default_rng(4)
    i, j = rng.integers(0, 50, 200), rng.integers(0, 50, 200)
    keep = spanning_forest(i[i != j], j[i != j], 50)

    def sets(a, b):
        up = list(range(50))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for p, q in zip(a, b):
            up[find(p)] = find(q)
        return [[find(x) == find(y) for x in range(50)] for y in range(50)]

    i, j = i[i != j], j[i != j]
    assert sets(i, j) == sets(i[keep], j[keep]) and len(keep) < 50
