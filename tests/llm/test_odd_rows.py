"""Rows without ids and very long texts, in the near-copy operators."""

import random

from pitrec.llm import simhash, suffix_dedup
from pitrec.llm.token_counts import token_counts

from .helpers import frame, prose


def test_simhash_without_ids_and_with_a_very_long_text(spark):
    rng = random.Random(4)
    long = prose(rng, 60_000)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(None, a), (5, a), (None, b), (None, b), (7, long), (3, long + " end"), (None, None), (9, "")]
    got = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None), (None, None), (7, 3), (3, 3), (None, 9), (9, 9)], key=str)


def test_repeats_without_ids_and_in_a_very_long_text(spark):
    rng = random.Random(5)
    shared = prose(rng, 60)[:260]
    long = prose(rng, 40_000)
    rows = [(None, "first " + shared + " one"), (None, "second " + shared + " two"), (4, long + shared), (None, prose(rng, 50)), (6, None)]
    docs = frame(spark, rows, "doc_id long, text string")
    kept = {r["text"]: r["kept"] for r in suffix_dedup.remove_repeats(docs, as_text=True).collect()}
    assert shared not in kept[rows[0][1]] and shared not in kept[rows[1][1]] and shared not in kept[rows[2][1]]
    assert kept[rows[3][1]] == rows[3][1] and len(kept[long + shared]) >= len(long) - 2


def test_token_counts_of_a_very_long_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    long = prose(random.Random(6), 30_000) + "x" * 20_000
    got = {r["id"]: r["n_tokens"] for r in token_counts(frame(spark, [(1, long), (None, "a b")], "doc_id long, text string"), path).collect()}
    assert got == {1: len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids), None: 2}
