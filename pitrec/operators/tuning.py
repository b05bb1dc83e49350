"""Weights of the rule source: a whole grid of them in one pass.

A weight vector scores an item of a user by its facets' affinities and its prior.
`rules.ranked` makes each user's list under every vector where the user lies, and
gives only the places of their targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounding import r6
from .rules import ranked

Grid = list[dict[str, float]]

#: The grid of the main run, and that of variants with one facet.
FACET_WEIGHTS, PRIOR_WEIGHTS = (0.5, 1.0, 2.0), (0.0, 0.5, 1.0)


def weight_grid(facets: list[str]) -> Grid:
    """Each facet's weights by each prior's weight, the first facet slowest: 27 vectors for two facets, 9 for one."""
    out: Grid = [{}]
    for f in facets:
        out = [o | {f: w} for o in out for w in FACET_WEIGHTS]
    return [o | {"prior": w} for o in out for w in PRIOR_WEIGHTS]


def facets_of(grid: Grid) -> list[str]:
    return sorted({f for w in grid for f in w if f != "prior" and w[f] > 0})


def superset(users: DataFrame, rows: DataFrame, items: DataFrame, pool: DataFrame, seen_pairs: DataFrame, grid: Grid, k: int) -> DataFrame:
    """(user_id, item_id): unseen pool items that hold each user's first k under every weight vector (none negative)."""
    return ranked(users, rows, items, pool, seen_pairs, grid, k).select("user_id", "item_id").distinct()


def evaluate(hits: DataFrame, truth: DataFrame, grid: Grid, ks: list[int], best_by: int, groups: list[str] | None = None) -> DataFrame:
    """(grid_index, group, recall_{k}, precision_{k}, best): means over the users of `truth` for each weight vector.

    hits: (user_id, grid_index, rank), the places of targets. `best` marks the first vector of the largest recall at `best_by`, in each group of vectors.
    """
    spark = truth.sparkSession
    facets = facets_of(grid)
    groups = groups or ["all"] * len(grid)
    table = spark.createDataFrame([(i, groups[i], *(float(w.get(f, 0.0)) for f in facets), float(w.get("prior", 0.0))) for i, w in enumerate(grid)], ", ".join(["grid_index int", "group string", *(f"w_{f} double" for f in facets), "w_prior double"]))
    sizes = truth.groupBy("user_id").agg(F.count("*").alias("n"))
    per_user = hits.groupBy("user_id", "grid_index").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks]).join(sizes, "user_id")
    sums = per_user.groupBy("grid_index").agg(*[F.sum(F.col(f"h{k}") / F.col("n")).alias(f"r{k}") for k in ks], *[F.sum(F.col(f"h{k}") / F.lit(float(k))).alias(f"p{k}") for k in ks])
    n_users = sizes.agg(F.count("*").alias("n_users"))
    out = table.join(sums, "grid_index", "left").crossJoin(F.broadcast(n_users))  # one row
    mean = lambda c: r6(F.coalesce(F.col(c), F.lit(0.0)) / F.col("n_users"))
    out = out.select("grid_index", "group", *[c for c in table.columns if c.startswith("w_")], "n_users", *[x for k in ks for x in (mean(f"r{k}").alias(f"recall_{k}"), mean(f"p{k}").alias(f"precision_{k}"))])
    first = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(f"recall_{best_by}"), "grid_index"))  # a row a grid point
    return out.withColumn("best", first == 1)


def tune(users: DataFrame, rows: DataFrame, items: DataFrame, pool: DataFrame, seen_pairs: DataFrame, truth: DataFrame, grid: Grid, ks: list[int], best_by: int, groups: list[str] | None = None) -> DataFrame:
    return evaluate(ranked(users, rows, items, pool, seen_pairs, grid, max(ks), truth), truth, grid, ks, best_by, groups)
