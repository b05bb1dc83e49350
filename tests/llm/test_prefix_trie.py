"""The trie against a dictionary of prefixes, in one part and in many."""

import hashlib
import random
import zlib

import pytest

from pitrec.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def rebuilt(rows):
    own: dict = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + x[h[c] :] for c, x in own.items()}


def brute(convs):
    nodes: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below),
            sum(p not in inner for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie(spark, rows):
    src = spark.createDataFrame(rows, SCHEMA)
    found = pt.prefix_trie(pt.with_shared_heads(pt.turns_of(src)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def conversations(seed, n, hot=0.3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 3), n):
        if rng.random() < hot:
            turns = [("user", "hello"), ("assistant", "how are you"), ("user", "fine")]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é日", "", None, "long " * 9])) for _ in range(rng.randint(1, 8))]
        rows += [(c, k, r, t, "x") for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "part_bytes", "run_bytes"), [(1, 300, 1 << 24, 1 << 22), (2, 400, 1500, 700), (3, 200, 300, 1), (4, 60, 64, 1 << 22)])
def test_nodes_are_those_of_a_dictionary(spark, monkeypatch, seed, n, part_bytes, run_bytes):
    monkeypatch.setattr(pt, "PART_BYTES", part_bytes)  # many parts: nodes at splitters, copies over several parts
    monkeypatch.setattr(pt, "RUN_BYTES", run_bytes)
    rows = conversations(seed, n)
    assert trie(spark, rows) == brute(rebuilt(rows))


def test_odd_rows(spark):
    """Null ids are left out; null turns come first, null roles and texts are empty, ties and repeated rows are turns, a conversation may lose all turns."""
    rows = [(None, 0, "user", "x", None), (5, None, None, None, None), (5, 1, "user", "b", None), (5, 1, "user", "a", None), (5, 1, "user", "a", None), (100, 0, "user", "q" * 100_000, None), (101, 7, "user", "z", None), (-3, 0, "u", "neg", None)]
    assert trie(spark, rows) == brute(rebuilt(rows))


def test_no_rows(spark):
    assert trie(spark, []) == []


def test_equal_conversations_only(spark, monkeypatch):
    monkeypatch.setattr(pt, "PART_BYTES", 400)
    rows = [(c, k, "user", f"t{k}", None) for c in range(0, 30_000, 100) for k in range(4)]
    assert trie(spark, rows) == brute(rebuilt(rows))


def test_merge_carries_prefixes(monkeypatch):
    """Shared turns are compared once for each entry of a run, not at each match."""
    rng = random.Random(5)
    heads = tuple((b"%016d" % k, "r", f"t{k}") for k in range(50))
    convs = [heads + ((b"%016d" % rng.randrange(9), "r", str(rng.randrange(9))),) for _ in range(400)]
    runs = [sorted((c, [k]) for k, c in enumerate(convs[at : at + 50])) for at in range(0, 400, 50)]
    looked = [0]

    def counted(a, b, known=0):
        m = known
        while m < min(len(a), len(b)) and a[m] == b[m]:
            m += 1
        looked[0] += m - known + 1
        return m

    coded = [list(pt.read_run(pt.write_run(r))) for r in runs]
    monkeypatch.setattr(pt, "common_turns", counted)
    got = list(pt.merge_runs([iter(r) for r in coded]))
    assert [t for _, t, _ in got] == sorted(convs)
    assert all(n == len([1 for x, y in zip(a, b) if x == y]) for (_, a, _), (n, b, _) in zip(got, got[1:]))
    assert looked[0] < 400 * 10  # 400 sequences of 51 turns; without prefixes at least 400 * 51


def test_text_of_nodes(spark):
    src = spark.createDataFrame([(1, 0, "user", "hi", None), (2, 0, "user", "hi", None)], SCHEMA)
    found = {(r["depth"], r["role"], r["text"]) for r in pt.prefix_trie(pt.turns_of(src), keep_text=True).collect()}
    assert found == {(0, None, None), (1, "user", "hi")}
