import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import pytest
from pitrec.llm.registry import ORACLES, QUERIES
from pyspark.sql import functions as F

from .helpers import DOCS, frame, prose
from .test_simhash import groups, plain_fingerprint


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_the_columns_and_clean_rows(spark, tmp_path):
    rng = random.Random(1)
    base = [prose(rng, 80) for _ in range(120)]
    rows = [(k, t + (" badword vileness badword" if k % 4 == 0 else ""), "en", f"src{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(500 + k, rows[4 * k + 1][1], "en", "src1", 0) for k in range(5)]
    rows += [(600, None, None, None, None), (601, "", "en", "src0", 0)]
    labels = [(k, 1, 1 if k % 4 == 0 else 0) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if k == 0:
            clean = {r[0] for r in rows[:120] if r[0] % 4}
            assert clean <= set(ids) and sum(1 for x in ids if x < 120 and x % 4 == 0) <= 1
        if k == 1:
            assert not set(range(500, 505)) & set(ids) and len(ids) == len(set(ids))
        if k == 2:
            assert docs.where(F.col("text").isNull()).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def plain_near_copies(rows):
    """The smallest (id is null, id) of each group stays; of rows equal in all columns one."""
    rows = list(dict.fromkeys(rows))
    place = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    ordered = [rows[k] for k in place]
    label = groups(range(len(ordered)), [plain_fingerprint(r[1]) for r in ordered])
    first = {g: k for k, g in reversed(list(label.items()))}
    kept = {}
    for k, g in label.items():
        same = [q for q in label if label[q] == g and ordered[q][0] == ordered[first[g]][0]]
        kept[g] = {ordered[q][1] for q in same}
    return kept


def plain_cut(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        parts, k = [], 0
        while k < len(r):
            e = k
            while e < len(r) and gone[e] == gone[k]:
                e += 1
            if not gone[k]:
                parts.append(r[k:e].decode("utf-8", "ignore"))
            k = e
        out.append("".join(parts))
    return out


def plain_mix(rows, weights):
    n, total = Counter(r[3] or "" for r in rows), len(rows)
    named = sum(w for s, w in weights.items() if s in n)
    others = sum(k for s, k in n.items() if s not in weights)
    out, nth = Counter(), Counter()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for r in rows:
        s = r[3] or ""
        share = weights[s] if s in weights else (1 - named) * n[s] / others
        rate = share * total / n[s]
        key = md5(f"{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")
        u = (int(md5(f"mix:{key}:{nth[key]}")[:13], 16) + 0.5) / 2**52
        nth[key] += 1
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c < u:
            k += 1
            p *= rate / k
            c += p
        out[r] += k
    return +out


def test_every_stage_equals_its_brute_force_version(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from pitrec.llm import toxicity

    rng = random.Random(11)
    passage = prose(rng, 70)
    texts = [prose(rng, rng.randint(30, 90)) + (" " + passage if k % 6 == 0 else "") + (" badword vileness" if k % 4 == 0 else "") for k in range(90)]
    rows = [(k, t, ["en", "de", None][k % 3], f"src{k % 5}", len(t)) for k, t in enumerate(texts)]
    rows += [(300 + k, rows[4 * k + 1][1], "en", "src3", 0) for k in range(6)] + [(400 + k, rows[4 * k + 2][1] + " more", "en", "src4", 0) for k in range(4)]
    rows += [(None, rows[5][1], "en", "src1", 0), (None, prose(rng, 40), "en", None, 0), (7, prose(rng, 40), "en", "src1", 0), (600, None, None, None, None), (601, "", "en", "src0", 0), (3, *rows[3][1:])]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got[name] = [tuple(r) for r in docs.collect()]
    model = toxicity.train(frame(spark, rows, DOCS), spark.createDataFrame([x for x in labels], "doc_id long, quality int, toxic int").where(~toxicity.held_out(F.col("doc_id"))))
    tok = toxicity.Tokenizer()
    low = lambda r: model.scores(tok, [r[1] or ""])[0] < model.thresholds.get(r[2] or "", 0.5)
    first = [r for r in rows if low(r)]
    assert Counter(got["toxicity"]) == Counter(first) and {k for k in range(90) if k % 4} <= {r[0] for r in first}
    kept = plain_near_copies(first)
    texts_now = [r[1] for r in got["simhash near-dedup"]]
    assert len(texts_now) == len(kept) and all(any(t in own for own in kept.values()) for t in texts_now)
    second = got["simhash near-dedup"]
    cut = plain_cut([r[1] for r in second])
    assert Counter(got["suffix-array dedup"]) == Counter((*r[:1], t, *r[2:4], len(t) if len((r[1] or "").encode()) != len(t.encode()) else r[4]) for r, t in zip(second, cut))
    assert Counter(got["mixing sources"]) == plain_mix(got["suffix-array dedup"], corpus_pipeline.mixing.WEIGHTS)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = []
    for r in got["mixing sources"]:
        ids = sp.encode(r[1] or "")
        back = sp.decode(ids)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (r[1] or "")))
    assert Counter(got["sentencepiece"]) == Counter(want)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(want)


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, [], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
