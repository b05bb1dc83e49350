"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of three hashed ones, of the word and of its
first four and six bytes. Filters of widths 1, 2 and 3 run over the whole text, their
maxima feed a logistic unit. The embeddings of all words of the training texts
are trained with the rest; they start small, but for one coordinate that holds the
log odds of their labels, shrunk as far as these may be chance. Steps are smaller
for rare words, and what a step touches decays. Words never seen stay zero.
Thresholds are calibrated by language on all labelled rows that are kept from
training; the language is no input of a score.

Training takes a bounded sample, `per_class` rows of each label, spread over the
languages as evenly as their rows allow (the 64 largest languages, and the others
together) and chosen by hash. The rows for the thresholds are scored where they lie
and counted by language, label and narrow bins of the score; a language with fewer
than `min_positives` toxic rows among all of them keeps 0.5. Null languages are one,
under the empty name. Of labels that contradict each other the toxic one holds; labels
other than 0 and 1, and those without an id, are ignored. Null and empty texts are
scored as a text without words. Without labels of both kinds every score is 0. Very
long texts count whole. Rows repeat as given, null ids too; extra columns are kept;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, forget_kept, share, slices, table

WORDS, STEMS, DIM, WIDTHS, FILTERS, PAD = 1 << 17, 1 << 15, 12, (1, 2, 3), 8, 3
STEM = (4, 6)
CHANCE = 5.0  # standard errors between the labels' rates at which half of the log odds is believed
RARE, DECAY = 8.0, 2e-4  # rows with a word at which its steps are half as long; part of an embedding that a step takes
STRATA = 64  # languages told apart when the training sample is drawn
BINS, CLIP = 64, 30.0  # bins a unit of the logit, which is clipped
PRIME = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 19  # bytes at a time
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[ord("a") : ord("z") + 1] = True
_IS_LETTER[128:] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Tokenizer:
    """Texts to hashed word and stem ids, vectorised over many texts; PAD zeros follow each text."""

    def __init__(self):
        self.n = 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        buf = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
        if len(buf) + 1 > self.n:
            self.n = max(2 * CHUNK, len(buf) + 1)
            self.up, self.down = _powers(self.n, PRIME), _powers(self.n, pow(PRIME, -1, 1 << 64))
        letter = _IS_LETTER[buf]
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], out=total[1:])
        back = self.down[begin] * np.uint64(0xD6E8FEB86659FD93)

        def ids(to: np.ndarray, n: int) -> np.ndarray:
            h = (total[to] - total[begin]) * back
            h ^= h >> np.uint64(32)
            return (1 + (h * np.uint64(PRIME) >> np.uint64(33)) % np.uint64(n - 1)).astype(np.int64)

        word = ids(end, WORDS)
        stem = np.stack([ids(np.minimum(begin + n, end), STEMS) for n in STEM], axis=1)
        limits = np.cumsum([0, *(len(r) + 1 for r in raw)])
        first = np.searchsorted(begin, limits)
        count = np.diff(first)
        held = np.maximum(count, 1)  # a text without words is one pad
        start = np.cumsum([0, *(held + PAD)])[:-1]
        all_words = np.zeros(int((held + PAD).sum()), dtype=np.int64)
        all_stems = np.zeros((len(all_words), len(STEM)), dtype=np.int64)
        at = np.arange(len(begin)) + np.repeat(start - first[:-1], count)
        all_words[at], all_stems[at] = word, stem
        return all_words, all_stems, start, start + held


@dataclass
class TextCnn:
    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: np.ndarray  # width x FILTERS
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        x = self.words[word]
        for k in range(len(STEM)):
            x += self.stems[stem[:, k]]
        return x

    def responses(self, x: np.ndarray, k: int) -> np.ndarray:
        f, n = self.filters[k], len(x) - PAD + 1
        r = x[:n] @ f[0]
        for j in range(1, len(f)):
            r += x[j : n + j] @ f[j]
        return r + self.bias[k]

    def logits(self, tokenizer: Tokenizer, texts: list[str]) -> np.ndarray:
        out, part, held = [], [], 0
        for k, t in enumerate(texts):
            part.append(t)
            held += len(t)
            if held >= CHUNK or len(part) >= 512 or k == len(texts) - 1:
                word, stem, start, end = tokenizer(part)
                x = self.embed(word, stem)
                cuts = np.ravel(np.column_stack([start, end]))
                top = [np.maximum(np.maximum.reduceat(self.responses(x, w), cuts, axis=0)[::2], 0) for w in range(len(WIDTHS))]
                out.append(np.concatenate(top, axis=1) @ self.out[:-1] + self.out[-1])
                part, held = [], 0
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, tokenizer: Tokenizer, texts: list[str]) -> np.ndarray:
        z = self.logits(tokenizer, texts).astype(np.float64) - self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(model: TextCnn, coded: list[tuple], y: np.ndarray) -> tuple:
    """(loss, those of filters, bias and output weights, word ids, stem ids, gradient of each of these words' embedding sums).

    coded: (word ids, stem ids, words) of each text, padded.
    """
    xs, peaks, places = [], [], []
    every = np.arange(FILTERS)
    for word, stem, end in coded:
        x = model.embed(word, stem)
        values = [model.responses(x, k)[:end] for k in range(len(WIDTHS))]
        place = np.array([v.argmax(axis=0) for v in values])
        xs.append(x)
        peaks.append([v[p, every] for v, p in zip(values, place)])
        places.append(place)
    top = np.maximum(np.array(peaks).reshape(len(coded), -1), 0)
    z = np.clip(top @ model.out[:-1] + model.out[-1], -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y))
    err = (p - y) / len(coded)
    back = (err[:, None] * model.out[None, :-1] * (top > 0)).reshape(len(coded), len(WIDTHS), FILTERS)
    filters = [np.zeros_like(f) for f in model.filters]
    words, stems, delta = [], [], []
    for k, width in enumerate(WIDTHS):
        for j in range(width):
            for (word, stem, _), x, place, g in zip(coded, xs, places, back):
                at = place[k] + j
                filters[k][j] += x[at].T * g[k]
                words.append(word[at])
                stems.append(stem[at])
                delta.append(g[k][:, None] * model.filters[k][j].T)
    return loss, [*filters, back.sum(axis=0), np.append(err @ top, err.sum()).astype(model.out.dtype)], np.concatenate(words), np.concatenate(stems), np.concatenate(delta)


def started(coded: list[tuple], labels: list[int], size: int, part: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings, step lengths) of the hashed words or stems, before training; zero for those not seen."""
    seen, total = np.zeros((2, size)), np.array([labels.count(0), labels.count(1)], dtype=np.float64)
    for c, label in zip(coded, labels):
        seen[label][np.unique(c[part])] += 1
    seen[:, 0] = 0
    rows = seen.sum(axis=0)
    rate = (seen + 0.5) / (total[:, None] + 1)
    pooled = rows / total.sum()
    z = (seen[1] / total[1] - seen[0] / total[0]) / np.sqrt(pooled * (1 - pooled) * (1 / total).sum() + 1e-9)
    e = rng.normal(0, 0.02, (size, DIM)).astype(np.float32)
    e[:, 0] = np.clip(np.log(rate[1] / rate[0]), -3, 3) / 3 * z**2 / (z**2 + CHANCE**2)
    e[rows == 0] = 0
    return e, (rows / (rows + RARE)).astype(np.float32)[:, None]


def coded_text(tokenizer: Tokenizer, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(word ids, stem ids, words) of a text, padded."""
    word, stem, _, end = tokenizer([text])
    return word, stem, int(end[0])


def padded(words: bytes, stems: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the ids as they travel."""
    word, stem = np.frombuffer(words, np.uint32).astype(np.int64), np.frombuffer(stems, np.uint16).astype(np.int64).reshape(-1, len(STEM))
    return np.r_[word, np.zeros(PAD, np.int64)], np.r_[stem, np.zeros((PAD, len(STEM)), np.int64)], len(word)


def fit(texts: list[str], labels: list[int], **settings) -> TextCnn:
    tok = Tokenizer()
    return fit_coded([coded_text(tok, t) for t in texts], labels, **settings)


def fit_coded(coded: list[tuple], labels: list[int], epochs: int = 8, batch: int = 32, seed: int = 7, least_steps: int = 500) -> TextCnn:
    epochs = max(epochs, -(-least_steps * batch // len(coded)))
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    (words, word_steps), (stems, stem_steps) = started(coded, labels, WORDS, 0, rng), started(coded, labels, STEMS, 1, rng)
    model = TextCnn(words, stems, [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros((len(WIDTHS), FILTERS), np.float32), np.r_[np.full(len(WIDTHS) * FILTERS, 0.3), -0.5].astype(np.float32))
    for f in model.filters:
        f[0, 0, :2] = 1.0  # some filters begin by reading the log odds
    dense = [*model.filters, model.bias, model.out]
    m1, m2 = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    sums = [np.full((WORDS, 1), 1e-3, np.float32), np.full((STEMS, 1), 1e-3, np.float32)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            step += 1
            _, grads, word_ids, stem_ids, delta = gradients(model, [coded[r] for r in rows], y[rows])
            for e, at_ids, total, length in ((model.words, word_ids, sums[0], word_steps), (model.stems, stem_ids, sums[1], stem_steps)):
                ids, where = np.unique(at_ids, return_inverse=True)
                where = where.reshape(len(delta), -1)
                g = np.zeros((len(ids), DIM), np.float32)
                for c in range(where.shape[1]):
                    np.add.at(g, where[:, c], delta)
                g[ids == 0] = 0  # the pad stays zero
                total[ids] += (g * g).mean(axis=1, keepdims=True)
                e[ids] = (1 - DECAY) * e[ids] - 0.05 * length[ids] * g / np.sqrt(total[ids])
            for q, (param, g) in enumerate(zip(dense, grads)):
                m1[q] = 0.9 * m1[q] + 0.1 * g
                m2[q] = 0.999 * m2[q] + 0.001 * g * g
                param -= 0.01 * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)
    return model


def encoded(texts: DataFrame, most_words: int) -> DataFrame:
    """(key, y, lot, stratum, code): word and stem numbers of one text a key, that of the lowest hash among those that are short enough."""

    def run(batches):
        forget_kept()
        tok = Tokenizer()
        for batch in (few for batch in batches for few in slices(batch, 4)):
            keep, words, stems = [], [], []
            for k, text in enumerate(batch.column(4).to_pylist()):
                word, stem, n = coded_text(tok, text or "")
                if n <= most_words:
                    keep.append(k)
                    words.append(word[:n].astype(np.uint32).tobytes())
                    stems.append(stem[:n].astype(np.uint16).tobytes())
            own = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(words, pa.binary()), pa.array(stems, pa.binary())], names=["key", "y", "lot", "stratum", "words", "stems"])

    src = texts.select("key", "y", "lot", "stratum", "text")
    codes = src.mapInArrow(run, f"key {dict(src.dtypes)['key']}, y int, lot bigint, stratum string, words binary, stems binary")
    return codes.groupBy("key", "y", "lot", "stratum").agg(F.min(F.struct(F.xxhash64("words", "stems").alias("h"), "words", "stems")).alias("code"))


def binned(texts: DataFrame, labels: DataFrame, model: TextCnn, n_labels: int) -> DataFrame:
    """(lang, bin, n, hits, low, high): counts of all rows of `texts` with a label, by language and bin of the logit; a row a bin that is not empty."""
    shared = share(texts.sparkSession, model)

    def run(batches):
        forget_kept()
        known, tok = shared(), Tokenizer()
        for batch in (few for batch in batches for few in slices(batch, 1)):
            logit = np.clip(known.logits(tok, [t or "" for t in batch.column(1).to_pylist()]).astype(np.float64), -CLIP, CLIP)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(logit, pa.float64())], names=["key", "lang", "logit"])

    scored = texts.select("key", "text", "lang").mapInArrow(run, f"key {dict(texts.dtypes)['key']}, lang string, logit double")
    found = scored.join(bounded_broadcast(labels.select("key", "y"), n_labels), "key")
    return found.groupBy("lang", F.floor(F.col("logit") * BINS).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.sum("y").cast("long").alias("hits"), F.min("logit").alias("low"), F.max("logit").alias("high")
    )


def best_bins(cells: DataFrame) -> DataFrame:
    """(lang, rows, positives, low, next): the bin, all above it included, at which a language's F1 is highest; `next` is the highest logit below it."""
    own = Window.partitionBy("lang")
    down = own.orderBy(F.desc("bin"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cells.select(
        "lang", "bin", "low", F.sum("n").over(own).alias("rows"), F.sum("hits").over(own).alias("positives"), F.lead("high").over(down).alias("next"),
        F.sum("n").over(upto).alias("taken"), F.sum("hits").over(upto).alias("right"),
    )
    f1 = 2 * F.col("right") / (F.col("taken") + F.col("positives"))
    top = F.max_by(F.struct("rows", "positives", "low", "next"), F.struct(f1.alias("f1"), "bin"))
    return out.groupBy("lang").agg(top.alias("t")).select("lang", "t.*")


def level(sizes: list[int], total: int) -> int:
    """The quota at which parts of these sizes give `total` rows together, each no more than the quota; at least 1."""
    sizes, left = sorted(sizes), total
    for k, n in enumerate(sizes):
        if n * (len(sizes) - k) >= left:
            return max(1, left // (len(sizes) - k))
        left -= n
    return max(1, *sizes)


def train(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", per_class: int = 2500, min_positives: int = 20, most_words: int = 4096) -> TextCnn | None:
    """Learns from the labelled rows given; one part in five is kept for the thresholds.

    What reaches the driver are word numbers, 8 bytes each, of one text a sampled id. Texts of more than `most_words` words are not learned from.
    """
    rows = labels.select(F.col(key_col).alias("key"), F.col(label_col).cast("int").alias("y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("key", F.lit("toxicity")), F.lit(1 << 30))).withColumn("part", F.expr("lot % 5 = 0"))
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    named = rows.join(texts.select("key", "lang"), "key").distinct()
    sizes = named.groupBy("part", "lang", "y").agg(F.count("*").alias("n"))
    total = {(r["part"], r["y"]): r["n"] for r in sizes.groupBy("part", "y").agg(F.sum("n").alias("n")).collect()}
    if not total.get((False, 0)) or not total.get((False, 1)):
        return None
    kept = sum(n for (part, _), n in total.items() if part)
    large = [r["lang"] for r in sizes.where("not part").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(STRATA).collect()]
    stratum = F.when(F.col("lang").isin(large), F.concat(F.lit("="), "lang")).otherwise("")
    strata = {(r["stratum"], r["y"]): r["n"] for r in sizes.where("not part").groupBy(stratum.alias("stratum"), "y").agg(F.sum("n").alias("n")).collect()}
    quota = {c: level([n for (_, y), n in strata.items() if y == c], per_class) for c in (0, 1)}
    shares = docs.sparkSession.createDataFrame([(x, c, min(1.0, (1.1 * quota[c] + 50) / n)) for (x, c), n in strata.items()], "stratum string, y int, share double")
    drawn = named.where("not part").withColumn("stratum", stratum).join(F.broadcast(shares), ["stratum", "y"])  # a row a stratum and label
    drawn = drawn.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    chosen = drawn.groupBy("key", "y", "lot").agg(F.min("stratum").alias("stratum"))  # bounded by the parameters
    found = sorted(encoded(texts.join(F.broadcast(chosen), "key"), most_words).collect(), key=lambda r: (r["lot"], r["key"]))
    learn, taken = [], {}
    for c in (0, 1):
        for r in found:
            if r["y"] == c and taken.setdefault((r["stratum"], c), 0) < quota[c]:
                taken[r["stratum"], c] += 1
                learn.append(r)
    if len({r["y"] for r in learn}) < 2:
        return None
    model = fit_coded([padded(r["code"]["words"], r["code"]["stems"]) for r in learn], [r["y"] for r in learn])
    held = texts.where("key is not null")
    if dict(texts.dtypes)["key"] == dict(rows.dtypes)["key"]:  # then equal keys have equal hashes
        held = held.where("pmod(xxhash64(key, 'toxicity'), 1073741824) % 5 = 0")
    cells = cut(binned(held, rows.where("part"), model, kept))
    if not cells.limit(1).count():  # no labelled row was kept from training
        cells = cut(binned(texts.join(F.broadcast(chosen.select("key")), "key", "left_semi"), chosen, model, len(found)))  # then on the sample itself
    every = cells.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
    for r in best_bins(every.withColumn("lang", F.lit(""))).collect():
        if 0 < r["positives"] < r["rows"]:
            model.shift = (r["low"] + r["next"]) / 2 if r["next"] is not None else r["low"] - 1e-6
    for r in best_bins(cells).where((F.col("positives") >= max(1, min_positives)) & (F.col("positives") < F.col("rows"))).collect():
        low, below = (None if x is None else 1 / (1 + np.exp(model.shift - x)) for x in (r["low"], r["next"]))
        model.thresholds[r["lang"]] = float((low + below) / 2 if below is not None else low - 1e-6)
    return model


def classify(docs: DataFrame, model: TextCnn | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows with (score, predicted, threshold, rejected), which replace columns of these names.

    `rejected` compares the score with the threshold of the row's language (0.5 if it has none).
    """
    added = ["score", "predicted", "threshold", "rejected"]
    own = [c for c in docs.columns if c not in added]
    as_it_is = text_col in own and dict(docs.dtypes)[text_col] == "string"  # then the text travels once
    at_text = own.index(text_col) if as_it_is else len(own)
    src = docs.select(*own, *([] if as_it_is else [F.col(text_col).cast("string").alias("__text")]), F.col(lang_col).cast("string").alias("__lang"))
    shared = share(docs.sparkSession, model)  # a few MB whatever the input

    def run(batches):
        forget_kept()
        known, tok = shared(), Tokenizer()
        for batch in (few for batch in batches for few in slices(batch, at_text)):
            texts = [t or "" for t in batch.column(at_text).to_pylist()]
            score = known.scores(tok, texts) if known is not None and texts else np.zeros(len(texts))
            cut = np.array([known.thresholds.get(x or "", 0.5) if known is not None else 0.5 for x in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.float64)
            columns = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(cut, pa.float64()), pa.array(score >= cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *columns], names=[*own, *added])

    fields = [f"`{c}` {t}" for c, t in docs.select(*own).dtypes]
    return src.mapInArrow(run, ", ".join([*fields, "score double", "predicted int", "threshold double", "rejected boolean"]))


def held_out(key):
    """True for the fold that no label is learned from; a null id is not in it."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    found = classify(docs.select("doc_id", "text", "lang"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "rejected")
