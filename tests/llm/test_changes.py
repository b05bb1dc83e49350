"""The change applier against a simulation that takes one row at a time."""

import math
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitrec.llm import changes as ch

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, city string, balance double, row string"


def simulate(rows):
    """(change_id, client_id, status, batch, missed, city, cents, current) of each row, one at a time."""
    rows = sorted(set(rows), key=str)
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r[1], set()).add((r[2] is not None, r[2] or 0))
    stay = []
    for r in rows:
        h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
        if r[4] is None or h % 11 == 0:
            continue
        n = sorted(seqs[r[1]]).index((r[2] is not None, r[2] or 0)) + 1
        day = (r[4] - datetime(1970, 1, 1)).days + 2 * (h % 4)
        stay.append((min(8, max(1, 1 + math.floor((day - 19723) * 8 / 160))), day, r[0], n, r))
    stay.sort(key=lambda x: x[:3])
    nxt, held, now, out, last = {}, {}, {}, {}, {}

    def drain(c, b, missed):
        own = held.setdefault(c, {})
        while nxt.setdefault(c, 1) in own:
            day, r = own.pop(nxt[c])
            city, balance = now.get(c, (None, None))
            city, balance = {"I": r[6:8], "D": (None, None), "U": (city if r[6] is None else r[6], balance if r[7] is None else r[7])}.get(r[3], (city, balance))
            now[c], last[c] = (city, balance), r
            out[r] = (r[0], c, "applied", b, missed, city, None if balance is None else math.floor(100 * balance + 0.5))
            nxt[c] += 1
            missed = 0

    def jumps(b, limit):
        for c, own in held.items():
            while own and min(d for d, _ in own.values()) + 5 <= limit:
                missed = min(own) - nxt.setdefault(c, 1)
                nxt[c] = min(own)
                drain(c, b, missed)

    largest = -math.inf
    for b in range(1, 9):
        jumps(b, largest)
        for _, day, _, n, r in (x for x in stay if x[0] == b):
            c = r[1]
            if n in held.setdefault(c, {}) or n < nxt.setdefault(c, 1):
                out[r] = (r[0], c, "rejected", b, 0, None, None)
            else:
                held[c][n] = (day, r)
                drain(c, b, 0)
        largest = max([largest, *(x[1] for x in stay if x[0] == b)])
    jumps(9, math.inf)
    return sorted(((*v, v[2] == "applied" and last[k[1]] is k and k[3] != "D") for k, v in out.items()), key=str)


def some_changes(seed, n, clients, span=120, skip=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * span))
        if skip and (at - datetime(2024, 1, 1)).days // skip % 2:
            at = None
        c = 0 if rng.random() < 0.3 else rng.choice([None, *range(clients)])
        rows.append((k, c, rng.choice([None, *range(25)]) if rng.random() < 0.5 else k // 9, rng.choice(["I", "U", "U", "U", "D", None, "?"]), at, "s", rng.choice([None, "x", "y", ""]), rng.choice([None, -1.005, 2.5, 1234.567, 0.0]), "r"))
    return rows


def found(spark, rows, parts=3):
    got = ch.apply_changes(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")
    return sorted(map(tuple, got.collect()), key=str)


def test_whole_stream_with_odd_rows(spark, monkeypatch):
    """Nulls in every column, repeated rows, ties of sequence values, a hot client, batches without rows, ids and columns named as ours."""
    monkeypatch.setattr(ch, "BUCKET_ROWS", 40)
    rows = some_changes(4, 260, 9, skip=25)
    rows += rows[:20] + [(None, 1, 3, "U", datetime(2024, 2, 2), None, None, None, None), (10_000, 1, 3, "U", datetime(1999, 1, 1), None, None, None, None)]
    assert found(spark, rows) == simulate(rows)


def test_no_rows(spark):
    assert found(spark, [], 1) == []


@pytest.mark.parametrize("seed", range(25))
def test_buckets_without_a_stream(seed):
    """apply_batch, called batch by batch with the state it asked for, does what the simulation does."""
    rows = [r for r in some_changes(seed, 200, 6, span=random.Random(seed).choice([20, 120, 200])) if r[1] is not None and r[2] is not None and r[7] != -1.005]
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r[1], set()).add(r[2])
    new, seen = [], set()
    for k, r in enumerate(rows):
        h = zlib.crc32(str(r[0]).encode())
        if r[4] is None or h % 11 == 0:
            continue
        day = (r[4] - datetime(1970, 1, 1)).days + 2 * (h % 4)
        new.append((min(8, 1 + math.floor((day - 19723) * 8 / 160)), day, r[0], k, str(r[1]), sorted(seqs[r[1]]).index(r[2]) + 1, r[3], r[6], np.nan if r[7] is None else r[7]))
    new.sort()
    frame = pd.DataFrame(new, columns=["batch", "day", "id", "row", "client", "n", "op", "city", "balance"])
    frame["first"] = [not ((c, n) in seen or seen.add((c, n))) for c, n in zip(frame.client, frame.n)]
    state: dict = {}
    out, before = [], -(1 << 40)
    for b in range(1, 10):
        known = pd.DataFrame([(*k, *v) for k, v in state.items()], columns=["client", "n", "day", "row", "op", "city", "balance"])
        done, put, gone = ch.apply_batch(known, frame[frame.batch == b], b, (before if b < 9 else 1 << 40) - 5)
        for k in gone:
            del state[k]
        state |= dict(put)
        out.append(done)
        before = max([before, *frame.day[frame.batch == b]])
    done = pd.concat(out)
    got = sorted(((rows[r][0], int(c), s, b, m, None if x is None or x != x else x, None if y != y else math.floor(100 * y + 0.5)) for r, c, s, b, m, x, y in zip(done.row, done.client, done.status, done.batch, done.missed, done.city, done.balance)), key=str)
    assert got == sorted((x[:-1] for x in simulate(rows)), key=str)
    assert all(k[1] == 0 for k in state)  # nothing is left held


def test_ranks_of_a_client_over_partitions(spark):
    rows = [("a", k) for k in range(1000)] + [("b", None), ("b", 5)] + [(f"c{k}", 1) for k in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = ch.dense_ranks(spark.createDataFrame(rows, "client string, seq long").withColumn("first_row", F.lit(1)))
        assert got.columns == ["client", "seq", "first_row", "n"]
        assert {(r["client"], r["seq"]): r["n"] for r in got.collect()} == {("a", k): k + 1 for k in range(1000)} | {("b", None): 1, ("b", 5): 2} | {(f"c{k}", 1): 1 for k in range(50)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
