import random
from collections import Counter

import numpy as np
import pytest

from pitrec.llm import suffix_dedup as S

from .helpers import documents, frame, prose


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(r), sum(gone), spans, kept))
    return out


def planted(seed):
    rng = random.Random(seed)
    passages = [prose(rng, 90) for _ in range(4)]
    texts = [None, "", "short", "ab" * 400, "a" * 1000, "a" * 199, "a" * 200, "Stutter " * 90 + "x"]
    for _ in range(40):
        p = rng.choice(passages)
        texts.append(prose(rng, rng.randint(1, 60)) + " " + p[rng.randint(0, 150) : rng.randint(200, 500)] + " " + prose(rng, rng.randint(1, 60)))
    texts += [texts[10], texts[10], texts[11] + "z", passages[0] + passages[0], passages[1][:199], passages[1][:200], passages[1][:201], prose(rng, 8) + "ab" * 120]
    return texts


@pytest.mark.parametrize("seed, limits", [(1, (4096, 65_536)), (2, (4096, 65_536)), (1, (2, 1 << 30)), (2, (2, 2)), (3, (3, 6)), (4, (4, 20))])
def test_matches_brute_force(spark, seed, limits):
    """With each way of dealing out frequent k-grams."""
    texts = planted(seed)
    found = S.remove_repeats(documents(spark, texts).repartition(3), ranges_from=limits[0], exact_from=limits[1])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect()}
    want = brute(texts)
    assert [got[k] for k in range(len(texts))] == want


def test_anchors_do_not_depend_on_the_batch():
    texts = [x.encode() for x in planted(7) if x]
    select = S.Anchors()
    text, *together = select(texts)
    for k, raw in enumerate(texts):
        for x, alone in zip(together, select([raw])[1:]):
            assert np.array_equal(x[text == k], alone)


def test_null_and_repeated_ids(spark):
    rng = random.Random(3)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(None, a, "en", "s", 1), (None, a, "en", "s", 1), (None, b, "en", "s", 1), (4, b + "x", "en", "s", 1), (4, "y", "en", "s", 1), (4, "y", "en", "s", 1)]
    got = sorted((r["text"], bytes(r["kept"])) for r in S.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted((t, k[3]) for t, k in zip([r[1] for r in rows], brute([r[1] for r in rows])))


def test_short_lengths_and_many_contexts(spark):
    """A shorter length and a common passage give groups with many contexts."""
    rng = random.Random(5)
    texts = [prose(rng, 5) + prose(random.Random(9), 12)[k % 7 :] + prose(rng, 5) for k in range(80)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(documents(spark, texts), length=40, gram=12).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 40)


def test_text_form_and_columns(spark):
    long = "é" * 150
    df = documents(spark, [long, long + "x", None]).selectExpr("*", "7 as n_spans")
    got = {r["doc_id"]: r for r in S.remove_repeats(df, as_text=True).collect()}
    assert got[0]["kept"] == "" and got[2]["kept"] == "" and got[2]["text"] is None and got[0]["lang"] == "en"
    assert S.remove_repeats(frame(spark, [])).count() == 0


def test_merge_and_runs():
    rng = random.Random(6)
    rows = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"", k, 0, 0, 0) for k in range(300))
    runs = [S.read_run(S.write_run(rows[k::7])) for k in range(7)]
    merged = list(S.merge_runs(runs))
    assert [r[1] for r in merged] == [r[0] for r in rows]
    for a, b in zip(merged, merged[1:]):
        assert b[0] == S.common_prefix(a[1], b[1])
    assert list(S.merge_runs([])) == []


def test_union():
    assert S.union([(5, 9), (0, 3), (3, 4), (20, 30)], 25) == [(0, 4), (5, 9), (20, 25)]
