import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from pitrec.llm import embedding_dedup as E
from pitrec.llm import mixing, quality_rules, warc

from .helpers import DOCS, ODD, documents, frame, prose


# --- mixing ----------------------------------------------------------------


def test_poisson_inversion(spark):
    df = spark.range(2000).selectExpr("(id + 0.5) / 2000 as u", "2.5d as rate")
    counts = Counter(r[0] for r in df.select(mixing.poisson(df.u, mixing.cumulative(df.rate))).collect())
    for k in range(8):
        want = math.exp(-2.5) * 2.5**k / math.factorial(k)
        assert abs(counts[k] / 2000 - want) < 0.002


def test_mix_reaches_the_weights(spark):
    rows = [(k, f"t{k}", "en", "big" if k % 3 else "small", 2) for k in range(6000)]
    out = mixing.mix(frame(spark, rows), {"big": 0.5, "small": 0.5}).select("doc_id", "source", "copy", "shuffle_key").collect()
    share = Counter(r["source"] for r in out)
    assert abs(share["small"] / len(out) - 0.5) < 0.05 and abs(len(out) / 6000 - 1) < 0.08
    per = defaultdict(list)
    for r in out:
        per[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in per.values())
    again = mixing.mix(frame(spark, rows).repartition(7), {"big": 0.5, "small": 0.5}).select("doc_id", "source", "copy", "shuffle_key").collect()
    assert sorted(out) == sorted(again)


def test_mix_odd_cases(spark):
    assert mixing.mix(frame(spark, []), {"a": 1.0}).count() == 0
    rows = [(None, None, None, None, None), (1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "b", "en", "zero", 1)]
    out = mixing.mix(frame(spark, rows, DOCS).selectExpr("*", "5 as copy"), {"zero": 0.0}, size=20.0)
    got = out.collect()
    assert {r["source"] for r in got} == {None, "s"} and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


# --- quality rules ---------------------------------------------------------


def plain_rules(rows, least_docs, share):
    import re

    hosts, size = defaultdict(set), Counter(r[3] for r in rows)
    parsed = []
    for n, (doc, text, _, host, _) in enumerate(rows):
        t = text or ""
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower() for x in lines]
        for x in set(norm):
            hosts[host, x].add(n)
        parsed.append((t, lines, norm))
    out = []
    for (doc, _, _, host, _), (t, lines, norm) in zip(rows, parsed):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        wins = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        c = Counter(wins)
        cover = {k + j for k, w in enumerate(wins) if c[w] > 1 for j in range(5)}
        common = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x, y in zip(lines, norm) if len(hosts[host, y]) > max(least_docs, share * size[host]))
        bad = len(words) < 10 or 100 * len(cover) > 20 * len(words)
        rest = len(words) - common
        out.append((doc, len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover), common, bad, not bad and rest >= 10 and rest >= 0.3 * len(words)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least_docs, share, limit", [(4, 0.0, 200_000), (4, 0.0, 0), (2, 0.4, 200_000), (2, 0.4, 0)])
def test_quality_rules_match_plain_python(spark, least_docs, share, limit):
    rng = random.Random(1)
    texts = list(ODD)
    for k in range(40):
        lines = [prose(rng, rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        if k % 2:
            lines.insert(0, "Common  LINE of the host\tfor all")
        if k % 5 == 0:
            lines += [lines[0]] * 2
        texts.append("\n".join(lines) + rng.choice(["", "###", " <b> &"]))
    texts.append("again and again and over " * 30_000)
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 2}", 0) for k, t in enumerate(texts)] + [(3, texts[12], "en", "s1", 0)] * 2 + [(None, texts[13], "en", "s1", 0), (None, texts[14], "en", "s1", 0)]
    got = quality_rules.quality_rules(frame(spark, rows, DOCS).selectExpr("*", "1 as words", "2 as host"), least_docs=least_docs, share=share, limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_rules(rows, least_docs, share)


def test_depleted_documents_are_rejected(spark):
    rows = [(k, f"this line is the same in all of them\nown {k} and some more words than ten of them {k}\n", "en", "h", 0) for k in range(30)]
    rows += [(100, "this line is the same in all of them\nfour words are left", "en", "h", 0), (101, "x " * 12, "en", "h", 0)]
    got = {r["id"]: r for r in quality_rules.quality_rules(frame(spark, rows, DOCS)).collect()}
    assert all(got[k]["kept"] and got[k]["n_common_words"] == 9 for k in range(30))
    assert not got[100]["base_failed"] and not got[100]["kept"]


def test_quality_rules_of_nothing(spark):
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


# --- WARC ------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_round_trip_and_revisits(spark):
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", prose(rng, 50)) for k in range(60)] + [(100, None, rows_ := "same"), (99, "u\r\nv", rows_), (101, "", rows_), (102, "e", None), (103, "e", ""), (None, "x", "y")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as name")
    archives = warc.write_archives(df)
    every = warc.read_archives(archives).collect()
    assert len(every) == len(rows) and [(r["record_type"], bytes(r["payload"]), r["refers_to"]) for r in every if r["key"] is None] == [("response", b"y", None)]
    got = {r["key"]: r for r in every if r["key"] is not None}
    want = {r[0]: (r[2] or "").encode() for r in rows if r[0] is not None}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r["payload_bytes"] == len(want[k]) and r["payload_digest"] == warc.base32_sha1(want[k])
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == want[k] and r["refers_to"] is None
    assert got[99]["record_type"] == "response" and got[100]["refers_to"] == got[101]["refers_to"] == 99 and got[103]["refers_to"] == 102
    head = archives.first()["content"]
    assert struct.unpack("<I", bytes(head[:4]))[0] == warc.DICTIONARY_MAGIC


def test_export_is_readable_by_the_library(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"page {k} " * 20) for k in range(200)], PAGES)
    n = warc.export(warc.write_archives(df), str(tmp_path))
    files = list(tmp_path.iterdir())
    assert n == len(files) > 0
    raw = files[0].read_bytes()
    size = struct.unpack_from("<I", raw, 4)[0]
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size], max_output_size=1 << 24))
    first = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n")


def test_pages_without_or_with_one_id(spark):
    rows = [(None, "a", "p"), (None, "b", "p"), (5, "c", "p"), (9, "d", "p"), (5, "e", "p"), (7, "f", "q"), (7, "g", "r"), (None, "h", "z"), (None, "i", "z"), (3, "j", "y" * 3_000_000)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES))).collect()
    found = sorted(((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=str)
    want = [(None, "revisit", 5, 1)] * 2 + [(None, "response", None, 1)] * 2 + [(5, "response", None, 1)] * 2 + [(9, "revisit", 5, 1), (7, "response", None, 1), (7, "response", None, 1), (3, "response", None, 3_000_000)]
    assert found == sorted(want, key=str)


def test_reading_is_linear(monkeypatch):
    """The decoder is given a bounded slice for each record, however long the archive is."""
    w = warc.ArchiveWriter()
    for k in range(3000):
        text = f"{k} some page {k * k} with little in it {k % 7}".encode()
        w.add(warc.build_record(k, "u", text, warc.base32_sha1(text)))
    content, given = w.close(), [0]

    class Counting:
        def __init__(self, *args, **kw):
            self.inner = zstandard.ZstdDecompressor(*args, **kw)
            self.decompress = self.inner.decompress

        def decompressobj(self):
            one = self.inner.decompressobj()

            class Obj:
                eof = property(lambda _: one.eof)
                unused_data = property(lambda _: one.unused_data)

                def decompress(self, part):
                    given[0] += len(part)
                    return one.decompress(part)

            return Obj()

    class Module:
        ZstdDecompressor, ZstdCompressionDict = Counting, zstandard.ZstdCompressionDict

    monkeypatch.setattr(warc, "zstandard", Module)
    assert len(list(warc.read_archive(content))) == 3000
    assert given[0] <= 3000 * warc.FEED


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_broken_archives_raise():
    w = warc.ArchiveWriter()
    w.add(warc.build_record(1, "u", b"abc", warc.base32_sha1(b"abc")))
    good = w.close()
    assert len(list(warc.read_archive(good))) == 1
    for bad in (good[:-3], good + b"junk", b"\x00" + good):
        with pytest.raises(Exception):
            list(warc.read_archive(bad))
    record = warc.build_record(1, "u", b"abc", warc.base32_sha1(b"abc"))
    for broken in (record.replace(b"abc\r\n", b"abd\r\n"), record[:-1], record.replace(b"WARC-Date", b"X-Date"), record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


# --- embeddings ------------------------------------------------------------


def plain_links(vectors, cosine=0.9):
    ok = {k: np.array(v, dtype=np.float64) for k, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    n, up = Counter(), {k: k for k, _ in vectors}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= cosine:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {k: (n[k], find(k)) for k, _ in vectors}


def planted_vectors(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 5)):
            out.append((base + rng.normal(size=dim) * 0.05).astype(np.float32).tolist())
    out += [out[0]] * 4 + [[2 * x for x in out[1]], None, [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] + [0.0] * (dim - 1), [], [1.0, 2.0], [1.0, 2.1]]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [2048, 4])
def test_links_match_brute_force(spark, block):
    vectors = planted_vectors()
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as size")
    got = {r["id"]: (r["n_links"], r["component"]) for r in E.near_duplicates(df, bucket=8, recall=0.9999, block=block).collect()}
    assert got == plain_links(vectors)


def test_recall_with_production_parameters(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    vectors = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(d).collect()]
    rng = np.random.default_rng(3)
    near = []
    for k, v in vectors[:200]:  # copies at the limit itself
        u = np.array(v) / np.linalg.norm(v)
        w = rng.normal(size=len(u))
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        near.append((10_000 + k, (0.905 * u + math.sqrt(1 - 0.905**2) * w).tolist()))
    every = vectors + near
    want = sum(n for n, _ in plain_links(every).values())
    df = spark.createDataFrame(every, "vec_id long, embedding array<double>")
    got = E.near_duplicates(df, bucket=16).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * want <= got <= want


def test_keys_do_not_depend_on_the_batch():
    k, tables, width = E.plan(10**6, 0.9)
    hashes = E.Hashes(16, k, tables, width)
    x = np.random.default_rng(2).normal(size=(500, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x[1] = 0
    whole = hashes.keys(x, tables)
    for rows in ([0], [7, 3], range(100, 333)):
        assert np.array_equal(hashes.keys(x[list(rows)], tables), whole[list(rows)])
        assert np.array_equal(hashes.keys(x[list(rows)], 5), whole[list(rows), :5])
    hashes.shifts[:] = 0
    assert np.array_equal(hashes.keys(x[1:2], tables), np.zeros((1, tables)))


def test_no_vectors(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
