import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from pitrec.llm.pieces import Pieces, decode_ids, encode_texts, round_trips  # noqa: E402
from pitrec.llm.token_counts import PrefixCounter, chars_within, count_at, prefix_tables, token_counts  # noqa: E402

from .helpers import ODD, documents, frame, prose  # noqa: E402

BPE, SP = "byte_bpe_50k.json", "piece_bpe_32k.model"


def texts():
    rng = random.Random(1)
    alphabet = " \n\t'sta é😀 ▁0x<|>end"
    out = [t or "" for t in ODD] + ["a  b", "it'S we'll <|endoftext|> z<|endoftext|>", "<|endoftext", " " * 50 + "q", "▁▁a ▁ b", "١٢٣ abc", "é 　x\xa0\xa0y\x85\x1c z"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return out + [prose(rng, 80) for _ in range(20)]


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(P.path(BPE)), PrefixCounter(P.path(BPE))
    for t in texts():
        assert own.count(t) == len(tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_every_prefix_is_exact():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(P.path(BPE)), PrefixCounter(P.path(BPE))
    odd = ["a\n\n\t b", "  \n x", "we'll they've 're 'r", "!<|endoftext|> y", "a \n<|endoftext|>\n\n<|endoftext|", "é日本 'lé", "\t\t\t"]
    for t in odd + texts()[10:160]:
        t = t[:60]
        assert own.prefix_counts(t).tolist() == [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], repr(t)


def test_budget_cut():
    own = PrefixCounter(P.path(BPE))
    for t in (prose(random.Random(2), 100), "x" * 500, "a<|endoftext|>" * 9 + "é" * 40):
        for budget in (0, 7, 50, 10**6):
            n = own.cut(t, budget)
            assert own.count(t[:n]) <= budget and all(own.count(t[:k]) > budget for k in range(n + 1, min(len(t), n + 40) + 1))


def test_long_words_are_counted_in_windows():
    from tokenizers import Tokenizer

    tok, own, rng = Tokenizer.from_file(P.path(BPE)), PrefixCounter(P.path(BPE)), random.Random(6)
    word = "".join(rng.choice("abcdefghiétion") for _ in range(20_000))
    got = own.word_table(word)
    assert len(got) == len(word) + 1
    for k in (1, 4095, 4096, 4097, 9000, 20_000):
        assert got[k] == len(tok.encode(word[:k], add_special_tokens=False).ids)


def test_pieces_equal_the_library():
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=P.path(SP)), Pieces(P.path(SP))
    for t in texts():
        ids = own.encode(t)
        assert ids == sp.encode(t), repr(t)
        assert own.decode(ids) == sp.decode(ids)


def test_all_ids_come_from_commits_of_a_bounded_window(monkeypatch):
    """A text without boundaries, given in blocks: ids come out long before its end, and little is held."""
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=P.path(SP)), Pieces(P.path(SP))
    held, scan = [], own.rule.scan
    monkeypatch.setattr(own.rule, "scan", lambda text, base, last, back, stop: (held.append(stop - base), scan(text, base, last, back, stop))[1])
    rng = random.Random(3)
    for t in ("".join(rng.choice("abcdeé") for _ in range(100_000)), " " * 50_000, "ab" * 40_000, prose(rng, 20_000)):
        marked = "▁" + t.replace(" ", "▁")
        parts = list(own.commits(marked[k : k + 1000] for k in range(0, len(marked), 1000)))
        assert len(parts) > 40
        assert np.frombuffer(b"".join(parts), own.kind).tolist() == own.encode(t) == sp.encode(t)
    assert max(held) <= 12 * own.rule.longest
    assert not own._memo or max(map(len, own._memo)) <= 48


def test_ten_megabytes_in_bounded_memory():
    import tracemalloc

    own, rng = Pieces(P.path(SP)), random.Random(8)
    word = "".join(rng.choice("abcdefgh") for _ in range(1 << 16))
    list(own.commits([word]))
    tracemalloc.start()
    n = sum(len(part) for part in own.commits(word for _ in range(16)))  # a megabyte without a boundary
    assert n and tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_frames(spark):
    df = documents(spark, ODD)
    n = {r["id"]: r for r in token_counts(df, P.path(BPE)).collect()}
    assert n[0]["n_tokens"] == 0 and n[0]["n_bytes"] == 0 and n[7]["over_limit"] == (n[7]["n_tokens"] > 512)
    trips = {r["id"]: r for r in round_trips(df, P.path(SP)).collect()}
    assert len(trips) == len(ODD) and all(trips[k]["same"] for k in range(1, len(ODD)))
    back = {r["id"]: r["text"] for r in decode_ids(encode_texts(df, P.path(SP)), P.path(SP)).collect()}
    assert back == {k: t or "" for k, t in enumerate(ODD)}
    for f in (lambda x: token_counts(x, P.path(BPE)), lambda x: round_trips(x, P.path(SP)), lambda x: encode_texts(x, P.path(SP))):
        assert f(frame(spark, [])).count() == 0


def test_stored_tables_answer_budgets(spark):
    rng = random.Random(4)
    given = [prose(rng, 60), "", None, "a<|endoftext|>é b" * 5, "x" * 300]
    tables = prefix_tables(documents(spark, given), P.path(BPE))
    own = PrefixCounter(P.path(BPE))
    for budget in (0, 7, 40, 10**6):
        for r in chars_within(tables, budget).collect():
            t = given[r["id"]] or ""
            assert r["n_tokens"] <= budget and own.count(t[: r["n_chars"]]) == r["n_tokens"]
            if budget == 10**6:
                assert r["n_chars"] == len(t)
    for r in count_at(tables, 11).collect():
        assert r["n_tokens"] == own.count((given[r["id"]] or "")[:11])


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(None, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1), (7, "x", "en", "s", 1), (7, "x y", "en", "s", 1)]
    df = frame(spark, rows).selectExpr("*", "1 as n_tokens", "2 as counts", "3 as ids", "4 as id", "5 as same")
    got = [(r["id"], r["n_tokens"]) for r in token_counts(df, P.path(BPE)).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (None, 3), (7, 1), (7, 2)], key=str)
    assert sorted((r["id"], r["same"]) for r in round_trips(df, P.path(SP)).collect() if r["id"]) == [(7, True), (7, True)]
    assert encode_texts(df, P.path(SP)).where("id is null").count() == 2 and prefix_tables(df, P.path(BPE)).count() == 4


def test_meetings_of_paths_commit_on_documents(spark, sf):
    """Every text of some length has ids committed by a meeting, also when all its words are known."""
    own = Pieces(P.path(SP))
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("length(text) > 100").collect()]
    for _ in range(2):
        for t in texts:
            before = own.n_commits
            own.encode(t)
            assert own.n_commits - before >= len(t) // 400 + 1
