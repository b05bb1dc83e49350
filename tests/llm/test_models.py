import math
import random

import numpy as np

from pitrec.llm import language_id as L
from pitrec.llm import toxicity as T

from .helpers import ODD, documents, frame, prose


def corpus(n=240):
    rng = random.Random(1)
    langs = {"aa": ["tha", "ing", "er", "wh"], "bb": ["sch", "ung", "ö", "ei"], "cc": ["eau", "é", "que", "oi"]}
    rows = []
    for k in range(n):
        lang = list(langs)[k % 3]
        text = " ".join("".join(rng.choice(langs[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
        rows.append((k, text, lang, "s", len(text)))
    return rows


def test_language_held_out(spark):
    rows = corpus()
    model = L.train(frame(spark, rows[:150]), per_class=30, landmarks=8)
    got = {r["id"]: r for r in L.predict(frame(spark, rows[150:]), model).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows[150:]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_cases(spark):
    model = L.train(frame(spark, corpus()[:90]), per_class=20, landmarks=4)
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in L.predict(documents(spark, ODD).selectExpr("*", "1 as score"), model).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.classes
    empty = frame(spark, [])
    assert L.train(empty) is None and L.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in L.predict(documents(spark, ["abc"]), None).collect()} == {"und"}


def test_kernel_is_the_presence_kernel():
    """Batched products give the same values as counting shared n-grams one pair at a time."""
    texts = ["the cat sat", "the dog sat on the cat", "zzz"]
    seen = L.presence(texts)
    marks = seen[:2]
    columns = np.flatnonzero(marks.any(axis=0))
    model = L.KernelModel(["a"], columns, marks[:, columns].T.astype(np.float32), marks.sum(axis=1).astype(np.int64), np.eye(2, dtype=np.float32))
    k = model.kernel(seen)
    for a in range(3):
        for b in range(2):
            want = (seen[a] & seen[b]).sum() / np.sqrt(float(seen[a].sum()) * seen[b].sum())
            assert abs(k[a, b] - want) < 1e-5
    assert (L.presence(["the cat sat"])[0] == seen[0]).all()


def test_ridge_equals_a_dense_least_squares_fit():
    """Stacked rows of the weighted squares and of the penalty's square root, solved as one least-squares problem."""
    rng = np.random.default_rng(4)
    k, m = rng.random((60, 7)), 7
    root = rng.random((m, m))
    among, labels = root @ root.T, [["a", "b", "c"][x] for x in rng.choice(3, 60, p=[0.6, 0.3, 0.1])]
    got = L.ridge(k, among, labels, ["a", "b", "c"], 0.01)
    size = {c: labels.count(c) for c in "abc"}
    w = np.array([1 / size[c] for c in labels])
    w *= 60 / w.sum()
    penalty = np.linalg.cholesky(0.01 * 60 * (among + 1e-3 * np.eye(m))).T
    for j, c in enumerate("abc"):
        y = np.array([1.0 if x == c else -1.0 for x in labels])
        want = np.linalg.lstsq(np.vstack([k * np.sqrt(w)[:, None], penalty]), np.r_[y * np.sqrt(w), np.zeros(m)], rcond=None)[0]
        assert np.allclose(got[:, j], want, atol=1e-8)


def test_language_of_null_and_repeated_ids_and_many_languages(spark, monkeypatch):
    rows = [(None if r[0] % 2 else 7, *r[1:]) for r in corpus(60)]
    model = L.train(frame(spark, rows), per_class=50, landmarks=4)
    assert set(model.classes) == {"aa", "bb", "cc"}
    assert L.predict(frame(spark, rows), model).count() == 60
    monkeypatch.setattr(L, "MOST_CLASSES", 2)
    monkeypatch.setattr(L, "MOST_MARKS", 6)
    many = frame(spark, corpus(90) + [(1000 + k, "rare words", f"x{k}", "s", 0) for k in range(20)])
    model = L.train(many)
    assert model.classes == ["aa", "bb"] and model.landmarks.shape[1] == 6
    same = L.KernelModel(["aa", "bb"], model.columns, model.landmarks, model.norms, np.zeros_like(model.weights))
    assert {(r["lang_pred"], r["score"]) for r in L.predict(documents(spark, ["abc", "x" * 200_000]), same).collect()} == {("aa", 0.5)}


def toxic_rows(n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        words = prose(rng, rng.randint(20, 120)).split(" ")
        toxic = k % 5 == 0
        if toxic:
            for w in rng.sample(["badword", "vileness", "grubber", "NASTYish"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1 if toxic else 0))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    held = {k for k, _ in labels if k % 7 == 0}
    given = spark.createDataFrame([x for x in labels if x[0] not in held], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = T.train(docs, given)
    got = {r["doc_id"]: r for r in T.classify(docs, model).collect()}
    truth = dict(labels)
    right = [(got[k]["predicted"] == truth[k]) for k in held]
    assert np.mean(right) > 0.97
    assert "en" in model.thresholds and got[0]["threshold"] == model.thresholds["en"] and got[0]["lang"] == "en"


def test_toxicity_odd_cases(spark):
    rows, labels = toxic_rows(150)
    model = T.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = documents(spark, ODD).selectExpr("*", "'x' as predicted")
    got = T.classify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.train(frame(spark, rows), none) is None
    assert {(r["score"], r["predicted"]) for r in T.classify(odd, None).collect()} == {(0.0, 0)}
    assert T.classify(frame(spark, []), model).count() == 0


def test_scores_do_not_depend_on_the_batch():
    rows, labels = toxic_rows(100)
    model = T.fit([r[1] for r in rows], [y for _, y in labels], least_steps=50)
    tok = T.Tokenizer()
    together = model.scores(tok, [rows[0][1], "", rows[1][1]])
    assert np.allclose(together, [model.scores(tok, [t])[0] for t in (rows[0][1], "", rows[1][1])], atol=1e-6)


def small_cnn(dtype=np.float64):
    rng = np.random.default_rng(3)
    draw = lambda *shape: rng.normal(0, 0.5, shape).astype(dtype)
    model = T.TextCnn(draw(T.WORDS, T.DIM), draw(T.STEMS, T.DIM), [draw(w, T.DIM, T.FILTERS) for w in T.WIDTHS], draw(len(T.WIDTHS), T.FILTERS), draw(len(T.WIDTHS) * T.FILTERS + 1))
    model.words[0] = model.stems[0] = 0
    return model


def test_forward_pass_equals_plain_loops():
    model, tok = small_cnn(), T.Tokenizer()
    texts = ["one two three four", "a", "", "Some WORDS, again some words!"]
    for t, got in zip(texts, model.logits(tok, texts)):
        word, stem, _, end = tok([t])
        z = model.out[-1]
        for k, width in enumerate(T.WIDTHS):
            for f in range(T.FILTERS):
                best = -math.inf
                for at in range(end[0]):
                    total = model.bias[k, f]
                    for j in range(width):
                        x = model.words[word[at + j]] + sum(model.stems[s] for s in stem[at + j])
                        total += sum(x[d] * model.filters[k][j, d, f] for d in range(T.DIM))
                    best = max(best, total)
                z += max(best, 0) * model.out[k * T.FILTERS + f]
        assert abs(z - got) < 1e-9


def test_gradients_equal_finite_differences():
    model, tok = small_cnn(), T.Tokenizer()
    coded = [(w, s, int(e[0])) for w, s, _, e in (tok([t]) for t in ("one two three two", "four five", ""))]
    y = np.array([1.0, 0.0, 1.0])
    _, grads, words, stems, delta = T.gradients(model, coded, y)

    def slope(array, index, h=1e-6):
        was = array[index]
        array[index] = was + h
        up = T.gradients(model, coded, y)[0]
        array[index] = was - h
        down = T.gradients(model, coded, y)[0]
        array[index] = was
        return (up - down) / (2 * h)

    rng = np.random.default_rng(1)
    for array, g in zip([*model.filters, model.bias, model.out], grads):
        for _ in range(6):
            index = tuple(rng.integers(n) for n in array.shape)
            assert abs(slope(array, index) - g[index]) < 1e-6
    for array, ids in ((model.words, words), (model.stems, stems)):
        for i in np.unique(ids)[:4]:
            hits = ids == i
            total = (delta * (hits if hits.ndim == 1 else hits.sum(axis=1))[:, None]).sum(axis=0)
            for d in (0, 5):
                assert abs(slope(array, (i, d)) - total[d]) < 1e-6


def test_twenty_labels_are_enough_to_learn_from(spark):
    rng = random.Random(5)
    rows = [(k, " ".join([*prose(rng, 12).split(), "vile" if k < 25 else "fine", *prose(rng, 12).split()]), "en", "s", 0) for k in range(50)]
    labels = spark.createDataFrame([(k, int(k < 25)) for k in [*range(12), *range(25, 38)]], "doc_id long, toxic int")
    model = T.train(frame(spark, rows), labels)
    assert (np.abs(model.words).sum(axis=1) > 0).sum() > 100
    got = {r["doc_id"]: r["score"] for r in T.classify(frame(spark, rows), model).collect()}
    new_toxic, new_clean = [got[k] for k in range(12, 25)], [got[k] for k in range(38, 50)]
    assert np.mean([a > b for a in new_toxic for b in new_clean]) > 0.95


def test_contradicting_labels_and_null_ids(spark):
    rows, labels = toxic_rows(200)
    given = spark.createDataFrame([*labels, *((k, 1 - y) for k, y in labels if y), (None, 1), (3, 7), (4, None)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, (None, "badword", "en", "s", 0), (None, "x", None, "s", 0)])
    a, b = T.train(docs, given), T.train(docs.repartition(5), given.repartition(3))
    assert np.array_equal(a.words, b.words) and a.thresholds == b.thresholds and a.shift == b.shift
    assert np.array_equal(a.words, T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).words)
    assert T.classify(docs, a).where("doc_id is null").count() == 2


def test_rare_languages_are_in_the_training_sample(spark):
    assert T.level([5, 100, 1000], 300) == 195
    assert T.level([10, 20], 100) == 20 and T.level([50, 50], 60) == 30
    rows = [(k, f"w{k % 50} common text {'schlimm' if k % 100 == 0 else 'gut'}", "xx" if k % 100 < 2 else "en", "s", 0) for k in range(4000)]
    rows = [(k, t + (" awful" if lang == "en" and k % 3 == 0 else ""), lang, s, n) for k, t, lang, s, n in rows]
    labels = [(k, int("schlimm" in t or "awful" in t)) for k, t, *_ in rows]
    model = T.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), per_class=60)
    got = T.classify(frame(spark, rows), model).where("lang = 'xx'").collect()
    assert np.mean([r["rejected"] == ("schlimm" in r["text"]) for r in got]) > 0.95
