"""Language identification with string kernels.

The kernel of two texts is the number of character 1-, 2- and 3-grams present
in both (a blended spectrum of presence kernels over hashed n-grams), divided
by the root of the product of each text's own number. Landmarks (Nystroem)
stand for the training rows: one-versus-rest kernel ridge regression is solved
in their span, and texts are scored by two matrix products a batch.

Training takes a bounded sample: `per_class` rows and `landmarks` landmarks a
language, chosen by hash, fewer where more than 64 languages share `MOST_ROWS`
and `MOST_MARKS`, and no other languages than the `MOST_CLASSES` with the most
rows. Of a row only the presence of its n-grams comes to the driver, 8 KB whatever
its length. Null texts and texts without letters give `und` with score 0; so does
everything if there was nothing to learn from. Between equal values the language
first in the alphabet is taken. Very long texts count whole. Rows repeat as given,
null ids too; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget_kept, share, slices, table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
LETTER = re.compile(r"[^\W\d_]")
MOST_CLASSES, MOST_ROWS, MOST_MARKS = 512, 16_000, 1_536  # bounds of what is learned from
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def presence(texts: list[str]) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams each text has."""
    n = len(texts)
    seen = np.zeros((n + 1, BUCKETS), dtype=np.uint8)
    flat = seen.reshape(-1)
    pad = "   "  # after each text, so that no n-gram spans two
    points = [np.frombuffer((t.lower() + pad).encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    if not points:
        return seen[:0]
    sizes = np.array([len(p) for p in points])
    cp = np.concatenate([*points, np.zeros(len(ORDERS), dtype=np.uint32)])
    row = np.repeat(np.arange(n, dtype=np.int64), sizes) * BUCKETS
    ends = np.cumsum(sizes)
    for k in range(len(pad)):
        row[ends - 1 - k] = n * BUCKETS
    mixed = np.zeros(len(row), dtype=np.uint32)
    for order in ORDERS:
        mixed = (mixed ^ cp[order - 1 : order - 1 + len(row)]) * FACTORS[order - 1]
        mixed ^= mixed >> np.uint32(15)
        flat[row + ((mixed * FACTORS[0]) >> np.uint32(16))] = 1
    return seen[:n]


@dataclass
class KernelModel:
    classes: list[str]
    columns: np.ndarray  # buckets that any landmark has
    landmarks: np.ndarray  # columns x landmarks, 0 or 1
    norms: np.ndarray
    weights: np.ndarray  # landmarks x classes

    def kernel(self, seen: np.ndarray) -> np.ndarray:
        own = np.maximum(seen.sum(axis=1, dtype=np.int64), 1)
        shared = seen[:, self.columns].astype(np.float32) @ self.landmarks
        return shared / np.sqrt(own[:, None] * self.norms[None, :]).astype(np.float32)

    def scores(self, texts: list[str], rows: int = 64, points: int = 1 << 19) -> np.ndarray:
        """One-versus-rest values; at most about `rows` texts and `points` characters at a time."""
        out, part, held = [], [], 0
        for k, t in enumerate(texts):
            part.append(t)
            held += len(t)
            if len(part) >= rows or held >= points or k == len(texts) - 1:
                out.append(self.kernel(presence(part)) @ self.weights)
                part, held = [], 0
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)


def ridge(to_marks: np.ndarray, among: np.ndarray, labels: list[str], classes: list[str], penalty: float) -> np.ndarray:
    """Weights of the landmarks, a column a class, that minimise the weighted squares against +1 (own class) and -1.

    Classes count alike. The penalty is that of kernel ridge regression in the landmarks' span, w' among w a row,
    with a thousandth of it on the weights themselves for landmarks that are alike.
    """
    n = len(labels)
    target = np.where(np.array(labels)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    weight = 1.0 / np.maximum((target > 0).sum(axis=0), 1)[np.argmax(target, axis=1)]
    weight *= n / weight.sum()
    left = (to_marks * weight[:, None]).T @ to_marks + penalty * n * (among + 1e-3 * np.eye(len(among)))
    return np.linalg.solve(left, (to_marks * weight[:, None]).T @ target)


def fit(seen: np.ndarray, labels: list[str], landmarks: int = 24, penalty: float = 1e-3) -> KernelModel | None:
    """Rows of presence in a fixed order; the first `landmarks` of each class are landmarks."""
    if not labels:
        return None
    classes = sorted(set(labels))
    taken: dict[str, int] = {}
    picks = [k for k, c in enumerate(labels) if taken.setdefault(c, 0) < landmarks and not taken.update({c: taken[c] + 1})]
    marks = seen[picks]
    columns = np.flatnonzero(marks.any(axis=0))
    model = KernelModel(classes, columns, np.ascontiguousarray(marks[:, columns].T, dtype=np.float32), np.maximum(marks.sum(axis=1, dtype=np.int64), 1), np.zeros((len(picks), len(classes)), np.float32))
    to_marks = np.concatenate([model.kernel(seen[at : at + 256]) for at in range(0, len(seen), 256)]).astype(np.float64)
    model.weights = ridge(to_marks, to_marks[picks], labels, classes, penalty).astype(np.float32)
    return model


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_class: int = 250, landmarks: int = 24) -> KernelModel | None:
    """Learns from at most `per_class` distinct texts a language, those of the lowest hash; 8 KB of each reach the driver.

    The hash is the text's, so rows that share an id, or have none, are drawn one by one, and copies of a text once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.col("text").rlike("\\p{L}")).withColumn("lot", F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 40)))
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "lot").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_CLASSES).collect()}
    if not sizes:
        return None
    per_class, landmarks = max(1, min(per_class, MOST_ROWS // len(sizes))), max(1, min(landmarks, MOST_MARKS // len(sizes)))
    shares = spark.createDataFrame([(c, min(1.0, (1.25 * per_class + 25) / n)) for c, n in sizes.items()], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.col("lot") < F.col("share") * float(1 << 40))  # a row a language
    single = drawn.groupBy("lang", "lot").agg(F.min("text").alias("text"))  # about 1.25 * per_class + 25 a language
    kept = single.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("lot"))).where(F.col("place") <= per_class)

    def pack(batches):
        for batch in batches:
            for few in slices(batch, 0):
                bits = [np.packbits(presence([t])).tobytes() for t in few.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(1), few.column(2), pa.array(bits, pa.binary())], names=["lang", "lot", "bits"])

    found = kept.select("text", "lang", "lot").mapInArrow(pack, "lang string, lot bigint, bits binary").collect()
    found = sorted(found, key=lambda r: (r["lot"], r["lang"]))
    if not found:
        return None
    seen = np.stack([np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)) for r in found])
    return fit(seen, [r["lang"] for r in found], landmarks)


def predict(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = share(docs.sparkSession, model)  # bounded by the landmarks, not by the input

    def run(batches):
        forget_kept()
        known = shared()
        for batch in (few for batch in batches for few in slices(batch, 1)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            use = [k for k, t in enumerate(texts) if known is not None and LETTER.search(t)]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if use:
                values = known.scores([texts[k] for k in use]).astype(np.float64) * 4
                odds = np.exp(values - values.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                for k, best, p in zip(use, odds.argmax(axis=1), odds.max(axis=1)):
                    lang[k], score[k] = known.classes[best], float(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, lang_pred string, score double")


def held_out(key):
    """True for the fold that nothing is learned from; a null id is not in it."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
