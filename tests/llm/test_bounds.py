"""What reaches the driver or waits in a worker stays bounded, whatever ids repeat and however long texts are."""

import random

import numpy as np
from pyspark.sql import functions as F

from pitrec.llm import language_id as L
from pitrec.llm import toxicity as T
from pitrec.llm.warc import ArchiveWriter

from .helpers import frame, prose


def test_languages_of_many_rows_with_one_id(spark, monkeypatch):
    """20,000 rows of one id, or of none: no more rows reach the driver than are asked for, and both languages are learned."""
    texts = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.concat(F.when(F.col("id") % 3 == 0, "straße über ").otherwise("the thing with "), F.col("id").cast("string")).alias("text"))
    same = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("fr").alias("lang"), F.lit("déjà vu encore").alias("text"))
    seen = []
    monkeypatch.setattr(L, "fit", lambda bits, labels, landmarks, own=L.fit: (seen.append((len(bits), sorted(set(labels)))), own(bits, labels, landmarks))[1])
    model = L.train(texts.unionByName(same, allowMissingColumns=True).repartition(8), per_class=250)
    assert seen == [(501, ["de", "en", "fr"])]
    got = {r["id"]: r["lang_pred"] for r in L.predict(frame(spark, [(1, "über die straße"), (2, "with the thing"), (3, "déjà vu")], "doc_id long, text string"), model).collect()}
    assert got == {1: "de", 2: "en", 3: "fr"}


def test_toxicity_sample_has_one_text_an_id(spark, monkeypatch):
    """20,000 rows of one labelled id, and texts beyond the limit of words, add one row and none to the sample."""
    rng = random.Random(2)
    rows = [(k, ("vile rotten " if k % 2 else "kind gentle ") + prose(rng, 8), "en") for k in range(200)]
    rows += [(500, f"vile rotten {k}", "en") for k in range(20_000)] + [(501, "kind " * 9000, "en")]
    labels = [(k, k % 2) for k in range(200)] + [(500, 1), (501, 0)]
    got = []
    monkeypatch.setattr(T, "fit_coded", lambda coded, y, own=T.fit_coded: (got.append([c[2] for c in coded]), own(coded, y, least_steps=60))[1])
    docs = frame(spark, rows, "doc_id long, text string, lang string").repartition(8)
    model = T.train(docs, frame(spark, labels, "doc_id long, toxic int"))
    assert len(got[0]) <= 202 and max(got[0]) < 100
    asked = frame(spark, [(1, "vile rotten", "en"), (2, "kind gentle", "en")], "doc_id long, text string, lang string")
    scores = {r["doc_id"]: r["score"] for r in T.classify(asked, model).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_ids_travel_as_they_are_learned():
    tok = T.Tokenizer()
    for text in ("", "one", "The 3 words, ürgh", "a b " * 500):
        word, stem, n = T.coded_text(tok, text)
        again = T.padded(word[:n].astype(np.uint32).tobytes(), stem[:n].astype(np.uint16).tobytes())
        assert np.array_equal(again[0], word) and np.array_equal(again[1], stem) and again[2] == n


def test_few_bytes_wait_for_the_dictionary():
    rng = random.Random(1)
    writer, most = ArchiveWriter(sample_bytes=1 << 20), 0
    for _ in range(40):
        writer.add(rng.randbytes(300_000))
        most = max(most, sum(map(len, writer.waiting)))
    assert most <= (1 << 20) + 300_000 and writer.frames is not None
