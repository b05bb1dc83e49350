"""Calibration of logits: distribution, ECE, prior correction, Platt scaling, cohort thresholds."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitrec.functions.expressions import cohort, review_bucket, sigmoid

from .metrics import global_auc, grouped_metrics
from .order import grouped_quantiles, quantiles
from .rounding import r6

QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def prior_correction(logit: Column, weight: float) -> Column:
    """The probability with the training weight of positives taken back."""
    return sigmoid(logit - math.log(weight))


def with_views(dumps: DataFrame) -> DataFrame:
    """Adds cohort (of the user) and bucket (of the item) to (user_id, item_id, label, logit, n_history_events, item_n_reviews)."""
    return dumps.withColumns({"cohort": cohort(F.col("n_history_events")), "bucket": review_bucket(F.col("item_n_reviews"))})


def distribution(rows: DataFrame, p: str = "p") -> DataFrame:
    """One row: moments and quantiles of p, mean logits by label, bias ratio, Brier score."""
    y = F.col("label")
    at = quantiles(rows, p, list(QS))
    return rows.agg(
        F.count("*").alias("n"), r6(F.avg(p)).alias("mean_p"), r6(F.stddev_pop(p)).alias("std_p"),
        *[r6(F.lit(x).cast("double")).alias(f"q{round(q * 100):02d}") for q, x in zip(QS, at)],
        r6(F.avg(F.when(y == 1, F.col("logit")))).alias("pos_logit"), r6(F.avg(F.when(y == 0, F.col("logit")))).alias("neg_logit"),
        r6(F.avg(p) / F.avg(y)).alias("bias_ratio"), r6(F.avg((F.col(p) - y) * (F.col(p) - y))).alias("brier"),
    )


def _ece(binned: DataFrame) -> Column:
    return r6(F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n"))


def ece_equal(rows: DataFrame, bins: int = 15, p: str = "p", by: list[str] = ()) -> DataFrame:
    """Expected calibration error over equal-width bins; 1 is in the last."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    binned = rows.groupBy(*by, b.alias("b")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum("label").alias("sy"))
    return (binned.groupBy(*by) if by else binned.groupBy()).agg(F.sum("n").alias("n"), _ece(binned).alias("ece"))


def ece_quantile(rows: DataFrame, bins: int = 15, p: str = "p") -> DataFrame:
    """ECE over bins between distinct quantiles, closed on the left, so that ties share a bin; equal-width bins if fewer than three edges differ."""
    edges = sorted({round(x, 12) for x in quantiles(rows, p, [k / bins for k in range(bins + 1)]) if x is not None})
    joined = rows.withColumn("edges", F.lit(edges).cast("array<double>"))  # bins + 1 numbers
    rounded = F.round(F.col(p), 12)
    wide = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    narrow = F.greatest(F.least(F.size(F.filter("edges", lambda e: e <= rounded)), F.size("edges") - 1), F.lit(1))
    binned = joined.groupBy(F.when(F.size("edges") < 3, wide).otherwise(narrow).alias("b")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum("label").alias("sy"))
    return binned.agg(F.sum("n").alias("n"), F.count("*").alias("n_bins"), _ece(binned).alias("ece"))


def platt(rows: DataFrame, weight: float, steps: int = 40) -> tuple[float, float, list[float]]:
    """(a, b, losses): unweighted logistic fit of label on the logit by Newton steps from (1, -ln weight); each step is one aggregate."""
    a, b, losses, damping = 1.0, -math.log(weight), [], 1e-6
    for _ in range(steps):
        z = F.col("logit") * a + b
        p = sigmoid(z)
        w = p * (1 - p)
        err = p - F.col("label")
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("label") + F.log1p(F.exp(-F.abs(z)))
        x = F.col("logit")
        r = rows.agg(F.avg(loss), F.avg(err * x), F.avg(err), F.avg(w * x * x), F.avg(w * x), F.avg(w)).first()
        losses.append(r[0])
        haa, hab, hbb = r[3] + damping, r[4], r[5] + damping
        det = haa * hbb - hab * hab
        da, db = (hbb * r[1] - hab * r[2]) / det, (haa * r[2] - hab * r[1]) / det
        size = max(abs(da), abs(db))
        scale = min(1.0, 2.0 / size) if size else 1.0
        a, b = a - scale * da, b - scale * db
        if size < 1e-9:
            break
    return a, b, losses


def choose_calibrator(scores: DataFrame) -> DataFrame:
    """(chosen): Platt if its slope is positive and its ECE not above the prior correction's. scores: (a, platt_ece, prior_ece)."""
    return scores.withColumn("chosen", F.when((F.col("a") > 0) & (F.col("platt_ece") <= F.col("prior_ece")), "platt").otherwise("prior"))


def apply_thresholds(rows: DataFrame, thresholds: dict[int, float], p: str = "p") -> DataFrame:
    """Probabilities below their cohort's threshold become 0."""
    t = F.lit(0.0)
    for c, x in sorted(thresholds.items()):
        t = F.when(F.col("cohort") == c, x).otherwise(t)
    return rows.withColumn(p, F.when(F.col(p) < t, 0.0).otherwise(F.col(p)))


def threshold_sweep(rows: DataFrame, k: int = 10, qs=(0.1, 0.25, 0.5, 0.75, 0.9), p: str = "p") -> DataFrame:
    """(cohort, q, threshold, hits, ece, keeps): each rung's hits in the first k and ECE, and whether it loses no hit and has a lower ECE than none.

    All rungs of all cohorts are evaluated in one plan: rows are exploded by rung.
    """
    found = grouped_quantiles(rows, p, list(qs), "cohort")
    rungs = [(c, q, float(t)) for c, ts in found.items() for q, t in zip((0.0, *qs), (0.0, *ts))]
    grid = rows.sparkSession.createDataFrame(rungs, "cohort int, q double, t double").select("cohort", "q", r6(F.col("t")).alias("threshold"))
    at = rows.join(F.broadcast(grid), "cohort").withColumn("v", F.when(F.col(p) < F.col("threshold"), 0.0).otherwise(F.col(p)))  # six rows a cohort
    from pyspark.sql import Window

    own = Window.partitionBy("cohort", "q", "user_id").orderBy(F.desc("v"), "label", "item_id")
    hits = at.withColumn("place", F.row_number().over(own)).groupBy("cohort", "q", "threshold").agg(F.sum(F.when(F.col("place") <= k, F.col("label")).otherwise(0)).alias("hits"))
    ece = ece_equal(at, p="v", by=["cohort", "q"]).select("cohort", "q", "ece")
    out = hits.join(ece, ["cohort", "q"])
    base = out.where("q = 0").select("cohort", F.col("hits").alias("hits0"), F.col("ece").alias("ece0"))
    return out.join(base, "cohort").select("cohort", "q", "threshold", "hits", "ece", ((F.col("q") > 0) & (F.col("hits") >= F.col("hits0")) & (F.col("ece") < F.col("ece0"))).alias("keeps"))


def denominators(truth: DataFrame) -> DataFrame:
    """(cohort, n_users, n_pairs) of the ground truth."""
    users = truth.groupBy("user_id").agg(F.countDistinct("item_id").alias("n"), F.max("n_history_events").alias("k"))
    return users.groupBy(cohort(F.col("k")).alias("cohort")).agg(F.count("*").alias("n_users"), F.sum("n").alias("n_pairs"))


def check_in_sync(dump: DataFrame, truth: DataFrame) -> None:
    """Raises if a positive of the dump is not a target."""
    n = dump.where("label = 1").join(truth, ["user_id", "item_id"], "left_anti").count()
    if n:
        raise ValueError(f"{n} positives are not in the ground truth")


def view_blocks(rows: DataFrame, p: str = "p", bins: int = 15) -> DataFrame:
    """(view, value, n, mean_p, positive_rate, ece, brier) for all rows, each cohort and each bucket, as grouping sets over the bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    cells = rows.withColumns({"b": b, "c": F.col("cohort").cast("string")}).groupBy("c", "bucket", "b").agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum("label").alias("sy"), F.sum((F.col(p) - F.col("label")) * (F.col(p) - F.col("label"))).alias("sq"))
    by_bin = cells.groupingSets([[F.col("b")], [F.col("b"), F.col("c")], [F.col("b"), F.col("bucket")]], "b", "c", "bucket").agg(F.grouping("c").alias("gc"), F.grouping("bucket").alias("gb"), F.sum("n").alias("n"), F.sum("sp").alias("sp"), F.sum("sy").alias("sy"), F.sum("sq").alias("sq"))
    view = F.when(F.col("gc") == 0, "cohort").when(F.col("gb") == 0, "bucket").otherwise("all")
    value = F.when(F.col("gc") == 0, F.col("c")).when(F.col("gb") == 0, F.col("bucket")).otherwise("")
    out = by_bin.groupBy(view.alias("view"), value.alias("value")).agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"), F.sum("sy").alias("sy"), F.sum("sq").alias("sq"), F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"))
    return out.select("view", "value", "n", r6(F.col("sp") / F.col("n")).alias("mean_p"), r6(F.col("sy") / F.col("n")).alias("positive_rate"), r6(F.col("gap") / F.col("n")).alias("ece"), r6(F.col("sq") / F.col("n")).alias("brier"))


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One frame of all categories' rows."""
    return reduce(DataFrame.unionByName, [df.withColumn("category", F.lit(c)) for c, df in parts.items()])


def markdown(rows: DataFrame) -> str:
    """A table of a small report."""
    data = rows.collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(str(x) for x in r) + " |" for r in data)])


def fit_stage(selection: DataFrame, weight: float) -> dict:
    """What the selection dump alone decides: Platt parameters, the calibrator and the thresholds, bound by a fingerprint."""
    import hashlib
    import json

    a, b, losses = platt(selection, weight)
    viewed = with_views(selection)
    prior = viewed.withColumn("p", prior_correction(F.col("logit"), weight))
    scaled = viewed.withColumn("p", sigmoid(F.col("logit") * a + b))
    e_prior, e_platt = ece_equal(prior).first()["ece"], ece_equal(scaled).first()["ece"]
    use = "platt" if a > 0 and e_platt <= e_prior else "prior"
    kept = threshold_sweep(scaled if use == "platt" else prior).where("keeps").groupBy("cohort").agg(F.max("threshold").alias("t")).collect()  # a row a cohort
    out = {"a": a, "b": b, "weight": weight, "calibrator": use, "first_loss": losses[0], "last_loss": losses[-1], "thresholds": {str(r["cohort"]): r["t"] for r in kept}}
    out["fingerprint"] = hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()
    return out


def locked_stage(dump: DataFrame, sizes: DataFrame, fitted: dict, ks: list[int]) -> DataFrame:
    """The locked evaluation with frozen parameters; raises if they were changed."""
    import hashlib
    import json

    if hashlib.sha256(json.dumps({k: v for k, v in fitted.items() if k != "fingerprint"}, sort_keys=True).encode()).hexdigest() != fitted["fingerprint"]:
        raise ValueError("the fitted parameters were changed")
    p = sigmoid(F.col("logit") * fitted["a"] + fitted["b"]) if fitted["calibrator"] == "platt" else prior_correction(F.col("logit"), fitted["weight"])
    done = apply_thresholds(with_views(dump).withColumn("p", p), {int(c): t for c, t in fitted["thresholds"].items()})
    m = grouped_metrics(done.select("user_id", F.col("p").alias("score"), "label"), sizes, ks)
    return m.crossJoin(ece_equal(done).select("ece")).crossJoin(global_auc(done.select(F.col("p").alias("score"), "label")).select("auc"))  # one row each
