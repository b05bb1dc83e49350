"""Training and scoring: samplers, factor models and text models, on Spark ML."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounding import r6
from .retrieval import dense_top_k, random_top_k, seen, unit


def sample_pairs(rows: DataFrame, pool: DataFrame, negatives: int = 2, epoch: int = 0) -> DataFrame:
    """(user_id, item_id, label, kind): positives, hard negatives, and for each positive some unseen pool items, the first of the user's permutation in this epoch.

    A user gets fewer only where the pool has no more unseen items.
    """
    base = rows.select("user_id", "item_id", "label", F.when(F.col("label") == 1, "positive").otherwise("hard_negative").alias("kind")).distinct()
    users = rows.where("label = 1").groupBy("user_id").agg((F.count("*") * negatives).alias("want"))
    soft = random_top_k(users, pool, seen(rows), None, epoch).select("user_id", "item_id", F.lit(0).alias("label"), F.lit("soft_negative").alias("kind"))
    return base.unionByName(soft)


def log_q(rows: DataFrame) -> DataFrame:
    """(item_id, log_q): the log of an item's share of the positives."""
    counts = rows.where("label = 1").groupBy("item_id").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("item_id", r6(F.log(F.col("c") / F.col("t"))).alias("log_q"))  # one row


def factors(rows: DataFrame, rank: int = 16, iterations: int = 5, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(users, items) with unit-free factor vectors by implicit alternating least squares on the positives."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="label", seed=seed).fit(rows.where("label = 1").select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.col("label").cast("float")))
    cast = lambda df, name: df.select(F.col("id").cast("long").alias(name), F.col("features").cast("array<double>").alias("embedding"))
    return cast(model.userFactors, "user_id"), cast(model.itemFactors, "item_id")


def factor_top_k(users: DataFrame, items: DataFrame, pool: DataFrame, seen_pairs: DataFrame, k: int) -> DataFrame:
    """Cosine lists from saved factors; any k from one set of factors."""
    return dense_top_k(users.withColumnRenamed("embedding", "profile"), items, pool, seen_pairs, k)


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def text_counts(text: Column) -> dict[str, Column]:
    """Words, characters, exclamation and question marks, share of upper-case letters."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    return {
        "n_words": F.size(words), "n_chars": F.length(text),
        "n_exclamation": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "n_question": F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))),
        "upper_ratio": r6(F.length(F.regexp_replace(text, "[^\\p{Lu}]", "")) / F.greatest(F.length(text), F.lit(1))),
    }


def document_frequencies(docs: DataFrame, least: int = 5) -> DataFrame:
    """(term, df, idf) of one- and two-word terms that enough documents have."""
    tokens = docs.select("doc_id", F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) > 1).alias("t"))
    pairs = F.expr("if(size(t) < 2, cast(array() as array<string>), transform(sequence(0, size(t) - 2), i -> concat(t[i], ' ', t[i + 1])))")
    terms = tokens.select(F.explode(F.array_distinct(F.concat("t", pairs))).alias("term"))
    n = docs.count()
    return terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least).withColumn("idf", r6(F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))


def stratified_split(rows: DataFrame, label: str, share: float = 0.2, seed: str = "split") -> DataFrame:
    """Adds `part`: the same share of each class is held, by hash order within buckets of the class."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    hashed = rows.withColumn("h", h).withColumn("b", F.substring("h", 1, 2))
    sizes = hashed.groupBy(label, "b").agg(F.count("*").alias("c"))  # at most 256 rows a class
    own = Window.partitionBy(label)
    before = sizes.withColumns({"before": F.coalesce(F.sum("c").over(own.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("c").over(own)})
    placed = hashed.join(F.broadcast(before.drop("c")), [label, "b"]).withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy(label, "b").orderBy("h", "doc_id")))
    return placed.withColumn("part", F.when(F.col("pos") <= F.round(F.col("total") * share), "held").otherwise("train")).drop("h", "b", "before", "total", "pos")


def tfidf(docs: DataFrame, vocabulary: int = 10_000, least: float = 5.0):
    """A fitted pipeline to `features`: one- and two-word terms, sublinear counts, idf, unit length."""
    from pyspark.ml import Pipeline

    words = RegexTokenizer(inputCol="text", outputCol="w1", pattern="[^\\p{L}\\p{N}]+")
    pairs = NGram(n=2, inputCol="w1", outputCol="w2")
    c1, c2 = CountVectorizer(inputCol="w1", outputCol="c1", vocabSize=vocabulary, minDF=least), CountVectorizer(inputCol="w2", outputCol="c2", vocabSize=vocabulary, minDF=least)
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[words, pairs, c1, c2, VectorAssembler(inputCols=["c1", "c2"], outputCol="c"), IDF(inputCol="c", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features")]).fit(docs)


def text_regression(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """(doc_id, rating, pred): ridge regression on tf-idf."""
    from pyspark.ml.regression import LinearRegression

    f = tfidf(train)
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=0.1, elasticNetParam=0.0, maxIter=20, solver="l-bfgs").fit(f.transform(train).withColumn(label, F.col(label).cast("double")))
    return model.transform(f.transform(test)).select("doc_id", F.col(label).alias("rating"), F.col("prediction").alias("pred"))


def text_classifier(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """(doc_id, rating, pred): multinomial logistic regression with classes weighted alike."""
    from pyspark.ml.classification import LogisticRegression

    f = tfidf(train)
    sizes = train.groupBy(label).agg(F.count("*").alias("class_size"))
    n, k = train.count(), sizes.count()
    weighted = f.transform(train).join(F.broadcast(sizes), label).withColumns({"w": F.lit(float(n)) / (F.col("class_size") * float(k)), label: F.col(label).cast("double")})  # a row a class
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="w", regParam=1e-3, maxIter=20).fit(weighted)
    return model.transform(f.transform(test).withColumn(label, F.col(label).cast("double"))).select("doc_id", F.col(label).alias("rating"), F.col("prediction").alias("pred"))


def text_network(train: DataFrame, test: DataFrame, label: str, hidden: int = 16, vocabulary: int = 2000, iterations: int = 60, seed: int = 3) -> DataFrame:
    """(doc_id, rating, pred): a perceptron with one hidden layer on tf-idf, for classes 0, 1, ...

    Its gradients are sums over partitions, combined in a tree. The weights, 2 * vocabulary * hidden numbers at most, are
    what reaches the driver. Small classes are repeated until each weighs about as much as the largest.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    f = tfidf(train, vocabulary)
    sizes = train.groupBy(label).agg(F.count("*").alias("class_size"))
    facts = sizes.agg(F.max("class_size").alias("largest"), F.max(label).alias("top")).first()
    if facts["top"] is None:
        raise ValueError("no rows to learn from")
    times = F.least(F.round(F.lit(facts["largest"]) / F.col("class_size")).cast("int"), F.lit(100))
    level = train.join(F.broadcast(sizes), label).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("copy", "class_size")  # a row a class
    coded = f.transform(level).withColumn(label, F.col(label).cast("double"))
    width = len(f.transform(train).select("features").first()["features"])
    model = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[width, hidden, int(facts["top"]) + 1], maxIter=iterations, seed=seed).fit(coded)
    return model.transform(f.transform(test).withColumn(label, F.col(label).cast("double"))).select("doc_id", F.col(label).alias("rating"), F.col("prediction").alias("pred"))


def hashed_text_vectors(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(item_id, embedding): word counts in hashed buckets at unit length, for items without a given embedding; zeros for texts without words."""
    words = texts.select("item_id", F.explode_outer(F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")).alias("w"))
    bucket = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % dim
    counts = words.groupBy("item_id").agg(*[F.sum(F.when(bucket == k, 1.0).otherwise(0.0)).alias(f"b{k}") for k in range(dim)])
    cells = F.array(*[F.col(f"b{k}") for k in range(dim)])
    return counts.select("item_id", cells.alias("v")).select("item_id", F.coalesce(unit(F.col("v")), F.col("v")).alias("embedding"))
