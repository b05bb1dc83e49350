"""Vectors whose ids are missing or shared: links and components of rows, by brute force."""

import math
import random

import pytest

from pitrec.llm import embedding_dedup as ed

from .helpers import frame


def brute(rows, cosine=0.9):
    """(id, n_links, component) of each row, all pairs of rows compared."""
    def scaled(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        top = max(map(abs, v))
        x = [a / top for a in v]
        n = math.sqrt(sum(a * a for a in x))
        return [a / n for a in x]

    units = [scaled(v) for _, v in rows]
    links = {i: [j for j, w in enumerate(units) if j != i and u and w and len(u) == len(w) and sum(a * b for a, b in zip(u, w)) >= cosine] for i, u in enumerate(units)}
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((key, len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(spark, rows):
    src = frame(spark, [(k, v, 7) for k, v in rows], "vec_id long, embedding array<double>, cls int")
    return sorted(map(tuple, ed.near_duplicates(src, recall=0.99999).collect()), key=str)


def near(v, eps):
    return [x + eps * (k % 3 - 1) for k, x in enumerate(v)]




def test_null_ids(spark):
    a = [1.0, 0.0, 0.2, 0.1]
    rows = [(1, a), (None, a), (None, a), (2, near(a, 0.01)), (9, [0.0, 1.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0, 5.0]), (None, near([0.0, 0.0, 1.0, 5.0], 0.01))]
    got = found(spark, rows)
    assert got == brute(rows)
    assert [n for k, n, c in got if c == 1] == [3, 3, 3, 3]
    assert [(n, c) for k, n, c in got if k is None and c is None] == [(1, None), (1, None)]


def test_one_id_with_two_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (2, near(a, 0.01)), (3, near(b, 0.01)), (4, near(b, 0.02))]
    got = found(spark, rows)
    assert got == brute(rows)
    assert sorted(n for k, n, _ in got if k == 1) == [1, 2]


def test_magnitudes(spark):
    a = [3.0, 1.0, -2.0, 0.5]
    rows = [(k, [x * s for x in a]) for k, s in enumerate((1.0, 1e200, 1e-200, 1e-300, 5e307 / 3))] + [(8, [float("inf"), 1.0, 1.0, 1.0]), (9, [0.0] * 4), (10, None), (11, []), (12, [None, 1.0, 1.0, 1.0]), (13, [3.0, 1.0])]
    got = found(spark, rows)
    assert got == brute(rows)
    assert [n for k, n, _ in got if k < 5] == [4] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for _ in range(160):
        c = centres[0] if rng.random() < 0.3 else rng.choice(centres)
        rows.append((rng.choice([None, rng.randrange(40)]), c if rng.random() < 0.4 else [x + rng.gauss(0, 0.15) for x in c]))
    assert found(spark, rows) == brute(rows)
