"""Packing: the contract of the pieces, exact complements, and no more sequences than plain methods need."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pitrec.llm import packing as pk
from pitrec.llm.token_ids import TokenIds

from .helpers import ODD, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def first_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for k, held in enumerate(bins):
            if held + n <= capacity:
                bins[k] += n
                break
        else:
            bins.append(n)
    return len(bins)


def counted(lengths):
    return {n: lengths.count(n) for n in set(lengths)}


@pytest.mark.parametrize("seed", range(12))
def test_a_plan_uses_the_counts_up(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 64, 200])
    lengths = [rng.choice([capacity, rng.randint(1, capacity), max(1, capacity // 2), max(1, int(rng.expovariate(5 / capacity))) % capacity + 1]) for _ in range(rng.choice([1, 20, 400]))]
    plan = pk.plan(counted(lengths), capacity)
    used: dict = {}
    for need, times in plan:
        assert times > 0 and sum(n * k for n, k in need.items()) <= capacity
        for n, k in need.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counted(lengths)
    total = sum(t for _, t in plan)
    assert -(-sum(lengths) // capacity) <= total <= first_fit(lengths, capacity)


def test_exact_complements_are_found():
    """Singles, pairs and triples that fill a gap leave no waste, where best fit alone needs more."""
    counts = {60: 5, 40: 5, 50: 4, 30: 4, 20: 4, 70: 3, 15: 6, 45: 2, 25: 1, 16: 1, 14: 1}
    plan = pk.plan(counts, 100)
    assert sum(t for _, t in plan) == -(-sum(n * k for n, k in counts.items()) // 100)
    left = np.zeros(11, dtype=np.int64)
    left[[6, 4, 3, 2, 1]] = [1, 3, 2, 2, 4]
    assert pk.exact_patterns(left.copy(), 10, 1) == [({6: 1, 4: 1}, 1)]
    triples = np.zeros(11, dtype=np.int64)
    triples[[5, 2, 1]] = [1, 2, 1]
    assert pk.exact_patterns(triples.copy(), 10, 3) == [({5: 1, 2: 2, 1: 1}, 1)]
    assert pk.exact_patterns(triples.copy(), 10, 2) == []


def test_many_rows_take_one_plan():
    """The plan of a billion pieces is as small as that of some thousand."""
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 10_000_000) for n in range(1, 1025)}
    plan = pk.plan(counts, 1024)
    assert sum(len(need) for need, _ in plan) < 20_000
    assert sum(t for _, t in plan) <= 1.005 * sum(n * k for n, k in counts.items()) / 1024 + 1


def test_pieces_and_sequences(spark, monkeypatch):
    rng = random.Random(7)
    texts = [*ODD, "<|endoftext|> in a text <|endoftext|>", "  spaces   and\n\n lines \t", *[prose(rng, rng.randint(1, 60)) for _ in range(60)], prose(rng, 9000), "ab" * 3000, *["copy " * 30] * 20]
    rows = [(None if k % 11 == 0 else k // 2, t, "x", 9) for k, t in enumerate(texts)]
    docs = frame(spark, rows, "doc_id long, text string, length string, offset int").repartition(5)
    found = pk.pack(pk.pieces(docs, PATH, capacity=128, keep_ids=True), 128)
    held = found.collect()
    library = TokenIds(PATH).library

    def expected(text):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        starts = pk.cut_points(len(ids), 128)
        return [(k, a, ids[a : b]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]

    want = sorted((str(i), k, a, ids, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, *_ in rows for k, a, ids in expected(t))
    assert sorted((str(r["id"]), r["piece"], r["start"], list(r["ids"]), r["ids_crc32"]) for r in held) == want
    assert all(r["length"] == len(r["ids"]) for r in held)
    by: dict = {}
    for r in held:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 128
    assert len(by) <= first_fit([r["length"] for r in held], 128)
    whole = pk.sequences(found).collect()
    assert sorted(len(r["ids"]) for r in whole) == sorted(sum(x[-1]) for x in by.values())
    at = {(r["sequence_id"], r["offset"]): list(r["ids"]) for r in held}
    assert all(list(r["ids"][p["offset"] : p["offset"] + p["length"]]) == at[r["sequence_id"], p["offset"]] for r in whole for p in r["parts"])


def test_cut_points():
    assert pk.cut_points(1, 4) == [0] and pk.cut_points(4, 4) == [0]
    assert pk.cut_points(5, 4) == [0, 1] and pk.cut_points(8, 4) == [0, 4] and pk.cut_points(10, 4) == [0, 2, 6]


def test_no_rows_and_wrong_lengths(spark):
    docs = frame(spark, [], "doc_id long, text string")
    assert pk.pack(pk.pieces(docs, PATH)).collect() == []
    with pytest.raises(ValueError):
        pk.pack(frame(spark, [(1, 2000)], "id long, length long"))


def test_ids_equal_the_library(spark, sf):
    tokens = TokenIds(PATH)
    assert tokens._ranks is not None
    rng = random.Random(1)
    texts = [t for t in ODD if t] + ["".join(rng.choice("ab é'sr\n\t  日1<|endoftext|>") for _ in range(rng.randrange(80))) for _ in range(800)]
    texts += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where(F.col("text").isNotNull()).collect()]
    assert all(tokens(t).tolist() == tokens.library.encode(t, add_special_tokens=False).ids for t in texts)
