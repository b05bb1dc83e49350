from pitrec.llm import toxicity as T


def test_thresholds_come_from_all_labelled_rows(spark):
    """12,000 rows are kept from training, among them some 30 toxic ones of a rare language."""
    rows = spark.range(60_000).selectExpr(
        "id as doc_id", "if(id % 200 = 0, 'rare', if(id % 2 = 0, null, 'en')) as lang", "cast(if(id % 400 = 0 or id % 200 <> 0 and id % 10 < 2, 1, 0) as int) as toxic"
    )
    word = "element_at(array('alpha', 'beta', 'gamma', 'delta', 'omega'), cast(pmod(xxhash64(id, {}), 5) + 1 as int))"
    texts = spark.range(60_000).selectExpr("id as doc_id", f"concat_ws(' ', {word.format(1)}, {word.format(2)}, {word.format(3)}) as text")
    both = rows.join(texts, "doc_id").selectExpr("doc_id", "lang", "toxic", "if(toxic = 1, concat(text, ' badword'), text) as text")
    model = T.train(both.drop("toxic"), rows.select("doc_id", "toxic"), per_class=200)
    assert set(model.thresholds) == {"", "en", "rare"}
    got = T.classify(both.limit(2000), model).collect()
    assert {(r["lang"], r["threshold"]) for r in got} <= {(x or None, t) for x, t in model.thresholds.items()}
    assert all(r["rejected"] == (r["toxic"] == 1) for r in got)


def test_best_bins(spark):
    cells = spark.createDataFrame([("a", 5, 2, 2, 5.1, 5.4), ("a", 3, 2, 1, 3.2, 3.3), ("a", 1, 9, 0, 1.0, 1.9), ("b", 2, 1, 1, 2.0, 2.0)], "lang string, bin int, n long, hits long, low double, high double")
    got = {r["lang"]: tuple(r)[1:] for r in T.best_bins(cells).collect()}
    assert got == {"a": (13, 3, 3.2, 1.9), "b": (1, 1, 2.0, None)}
