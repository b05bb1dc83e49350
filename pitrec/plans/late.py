"""Queries of retrieval, candidates, metrics, calibration and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitrec.functions import expressions as X
from pitrec.operators import calibration, candidates, features, metrics, models, retrieval, tuning
from pitrec.operators.rounding import r6
from pitrec.sources import adapters
from pitrec.sources.adapters import clean, load, twin

from .base import Register
from .frames import COVISIT, POPULARITY, RECENT, SNAPSHOT, Snapshot, covisit_list, global_list, interactions, lists_view

Q = Register()
KS = [10, 50, 100]


def lists_twin(body: str, k: int, extra: str = "") -> str:
    return twin(body, lists_view(k) + ("," + extra if extra else ""))


# --- retrieval -------------------------------------------------------------


@Q("r1_popularity", twin(POPULARITY, SNAPSHOT))
def _(spark, d):
    return retrieval.popularity(Snapshot(spark, d).hist)


@Q("r2_seen", twin("SELECT user_id, item_id FROM seen WHERE user_id IN (SELECT user_id FROM tusers)", SNAPSHOT))
def _(spark, d):
    return Snapshot(spark, d).seen


@Q("r3_popularity_top_k", twin("SELECT * FROM popularity", SNAPSHOT + "," + global_list("popularity", POPULARITY, 100)))
def _(spark, d):
    return Snapshot(spark, d).popular(100)


@Q("r4_windowed_popularity", twin("SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM hist, cut WHERE label = 1 AND ts >= c1 - 365 * 86400000::BIGINT GROUP BY 1", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.windowed_popularity(s.hist, s.cuts[0], 365)


@Q("r5_decayed_popularity", twin(RECENT, SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.decayed_popularity(s.hist, s.cuts[0], 180.0)


_NUMBERED = "numbered AS (SELECT item_id, row_number() OVER (ORDER BY substr(md5(CAST(item_id AS VARCHAR)), 1, 3), item_id) - 1 AS idx FROM pool), psize AS (SELECT count(*) AS n FROM pool), prime AS (SELECT min(x) AS q FROM (SELECT unnest(range((SELECT greatest(n, 2) FROM psize), (SELECT n + 300 FROM psize))) AS x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 2000) d(d) WHERE d * d <= x AND x % d = 0))"


def _random_sql(k: int, seed: int) -> str:
    lot = lambda what: f"CAST('0x' || substr(md5('{seed}:{what}:' || u.user_id), 1, 12) AS BIGINT)"
    return f"""SELECT user_id, item_id, -CAST(rank AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS rank FROM (
    SELECT u.user_id, i, ({lot('a')} % q + (1 + {lot('b')} % (q - 1)) * i) % q AS idx FROM tusers u, prime, unnest(range(1, q + 1)) r(i)) p JOIN numbered USING (idx)
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = p.user_id AND s.item_id = numbered.item_id)) WHERE rank <= {k}"""


@Q("r6_random_top_k", twin(_random_sql(20, 0), SNAPSHOT + "," + _NUMBERED))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.random_top_k(s.users, s.pool, s.seen, 20)


def _recall_sql(lists: str, ks, targets: str = "targets") -> str:
    """(k, recall, precision, n_users) for a list relation."""
    return " UNION ALL ".join(f"SELECT {k} AS k, round(avg(h / n), 6) AS recall, round(avg(h / {float(k)}::DOUBLE), 6) AS precision, count(*) AS n_users FROM (SELECT t.user_id, count(*) AS n, count(*) FILTER (l.rank <= {k}) AS h FROM {targets} t LEFT JOIN {lists} l ON l.user_id = t.user_id AND l.item_id = t.item_id GROUP BY 1)" for k in ks)


@Q("r7_random_seeds", twin("SELECT k, round(avg(recall), 6) AS mean_recall, round(stddev_pop(recall), 6) AS std_recall FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_recall_sql(f'({_random_sql(50, s)})', [10, 50])})" for s in range(3)) + ") GROUP BY 1", SNAPSHOT + "," + _NUMBERED))
def _(spark, d):
    s = Snapshot(spark, d)
    each = [metrics.recall_precision(s.targets, retrieval.random_top_k(s.users, s.pool, s.seen, 50, seed), [10, 50]) for seed in range(3)]
    return reduce(DataFrame.unionByName, each).groupBy("k").agg(r6(F.avg("recall")).alias("mean_recall"), r6(F.stddev_pop("recall")).alias("std_recall"))


_AFFINITY = "SELECT user_id, {f} AS facet, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY user_id) AS affinity FROM (SELECT user_id, {f}, count(*) AS n FROM hist JOIN catalog USING (item_id) WHERE label = 1 GROUP BY 1, 2)"


@Q("r8_facet_affinity", twin("SELECT user_id, facet, round(affinity, 6) AS affinity FROM (" + _AFFINITY.format(f="store") + ")", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.facet_affinity(s.hist, s.items, "store").withColumn("affinity", r6(F.col("affinity")))


_PRIOR = "SELECT item_id, coalesce(score, 0.0) / greatest(max(coalesce(score, 0.0)) OVER (), 1.0) AS prior FROM pool LEFT JOIN (" + POPULARITY + ") USING (item_id)"


@Q("r9_popularity_prior", twin("SELECT item_id, round(prior, 6) AS prior FROM (" + _PRIOR + ")", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.popularity_prior(s.hist, s.pool).withColumn("prior", r6(F.col("prior")))


def _rule_sql(weights: dict[str, float], k: int) -> str:
    facets = [f for f in weights if f != "prior" and weights[f] > 0]
    joins = " ".join(f"LEFT JOIN a_{f} ON a_{f}.user_id = u.user_id AND a_{f}.facet = c.{f}" for f in facets)
    total = " + ".join([f"{weights[f]} * coalesce(a_{f}.affinity, 0)" for f in facets] + [f"{weights.get('prior', 0.0)} * p.prior"])
    return f"""SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT u.user_id, p.item_id, round({total}, 6) AS score FROM tusers u CROSS JOIN prior p JOIN catalog c ON c.item_id = p.item_id {joins}
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id))) WHERE rank <= {k}"""


_RULE = SNAPSHOT + f", prior AS ({_PRIOR}), a_store AS ({_AFFINITY.format(f='store')}), a_main_category AS ({_AFFINITY.format(f='main_category')})"


@Q("r10_rule_top_k", twin(_rule_sql({"store": 1.0, "main_category": 0.5, "prior": 0.5}, 50), _RULE))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.rule_scores(s.users, s.hist, s.items, s.pool, s.seen, {"store": 1.0, "main_category": 0.5, "prior": 0.5}, 50)


@Q("r11_weighted_facets", twin(_rule_sql({"store": 1.0, "main_category": 0.0, "prior": 0.0}, 50), _RULE))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.rule_scores(s.users, s.hist, s.items, s.pool, s.seen, {"store": 1.0, "main_category": 0.0, "prior": 0.0}, 50)


def _grid_sql(grid, ks: list[int], best_by: int, groups: list[str] | None = None) -> str:
    """Recall and precision of each weight vector: all pool items of all users under all vectors, ranked."""
    facets = tuning.facets_of(grid)
    rows = ", ".join(f"({i}, '{(groups or ['all'] * len(grid))[i]}', {', '.join(f'{w.get(f, 0.0)}::DOUBLE' for f in [*facets, 'prior'])})" for i, w in enumerate(grid))
    names = ", ".join(f"w_{f}" for f in [*facets, "prior"])
    score = " + ".join(["0.0::DOUBLE", *(f"w_{f} * a_{f}" for f in facets)]) + " + w_prior * prior"
    affinities = ", ".join(f"coalesce(x_{f}.affinity, 0) AS a_{f}" for f in facets)
    joins = " ".join(f"LEFT JOIN a_{f} x_{f} ON x_{f}.user_id = u.user_id AND x_{f}.facet = c.{f}" for f in facets)
    hits = ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}" for k in ks)
    means = ", ".join(f"round(coalesce(sum(h{k} / n), 0) / (SELECT count(*) FROM sizes), 6) AS recall_{k}, round(coalesce(sum(h{k} / {float(k)}::DOUBLE), 0) / (SELECT count(*) FROM sizes), 6) AS precision_{k}" for k in ks)
    return f"""SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY recall_{best_by} DESC, grid_index) = 1 AS best FROM (
  WITH grid(grid_index, "group", {names}) AS (VALUES {rows}),
  base AS (SELECT u.user_id, p.item_id, {affinities}, p.prior FROM tusers u CROSS JOIN prior p JOIN catalog c ON c.item_id = p.item_id {joins}
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)),
  ranked AS (SELECT user_id, item_id, grid_index, row_number() OVER (PARTITION BY user_id, grid_index ORDER BY round({score}, 6) DESC, item_id) AS rank FROM base, grid),
  sizes AS (SELECT user_id, count(*) AS n FROM targets GROUP BY 1),
  hits AS (SELECT r.user_id, grid_index, {hits} FROM ranked r JOIN targets t ON t.user_id = r.user_id AND t.item_id = r.item_id WHERE rank <= {max(ks)} GROUP BY 1, 2)
  SELECT g.*, (SELECT count(*) FROM sizes) AS n_users, {means} FROM grid g LEFT JOIN hits h ON h.grid_index = g.grid_index LEFT JOIN sizes z ON z.user_id = h.user_id GROUP BY ALL)"""


_GRID = tuning.weight_grid(["store", "main_category"])


@Q("r12_tuned_weights", twin(_grid_sql(_GRID, [100], 100), _RULE))
def _(spark, d):
    """Recall at 100 of the 27 weight vectors; the first of the best is marked."""
    s = Snapshot(spark, d)
    return tuning.tune(s.users, s.hist, s.items, s.pool, s.seen, s.targets, _GRID, [100], 100)


_VARIANTS = {"A": ["store", "main_category"], "B": ["main_category"], "C": ["deeper_category"]}
_ABLATION = [(name, w) for name, facets in _VARIANTS.items() for w in tuning.weight_grid(facets)]


def _ablation_sql() -> str:
    return _grid_sql([w for _, w in _ABLATION], KS, 100, [name for name, _ in _ABLATION])


@Q("r13_ablation_variants", twin(_ablation_sql(), _RULE.replace("a_store AS", f"deep AS (SELECT * REPLACE (array_to_string(categories, ' | ') AS main_category) FROM catalog), a_deeper_category AS ({_AFFINITY.format(f='main_category').replace('JOIN catalog', 'JOIN deep')}), a_store AS", 1)).replace("x_deeper_category.facet = c.deeper_category", "x_deeper_category.facet = array_to_string(c.categories, ' | ')"))
def _(spark, d):
    """Three variants of facets, 27 + 9 + 9 weight vectors, all evaluated at three depths in one pass; each variant's best is marked."""
    s = Snapshot(spark, d)
    items = s.items.withColumn("deeper_category", F.array_join("categories", " | "))
    return tuning.tune(s.users, s.hist, items, s.pool, s.seen, s.targets, [w for _, w in _ABLATION], KS, 100, [name for name, _ in _ABLATION])


@Q("r14_covisitation", twin("SELECT a, b, support, score, place FROM edges", SNAPSHOT + "," + COVISIT))
def _(spark, d):
    return retrieval.covisitation(Snapshot(spark, d).hist)


@Q("r15_covisitation_top_k", twin("SELECT * FROM covisit", SNAPSHOT + "," + COVISIT + "," + covisit_list(50)))
def _(spark, d):
    return Snapshot(spark, d).covisited(50)


_PROFILE = """vec AS (
  SELECT vec_id AS item_id, pos, x / norm AS x FROM (SELECT vec_id, unnest(range(0, len(e))) AS pos, unnest(e) AS x, sqrt(list_inner_product(e, e)) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))
), lastpos AS (
  SELECT * FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) - 1 AS r FROM hist WHERE label = 1) WHERE r < 30
), psum AS (
  SELECT user_id, pos, sum(pow(0.8, r) * x) AS x FROM lastpos JOIN vec USING (item_id) GROUP BY 1, 2
), profile AS (
  SELECT user_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM psum
)"""


@Q("r16_content_profiles", twin("SELECT user_id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM profile", SNAPSHOT + "," + _PROFILE))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.content_profiles(s.hist, s.vectors).select("user_id", F.posexplode("profile").alias("pos", "x")).withColumn("x", r6(F.col("x")))


_DENSE = SNAPSHOT + "," + _PROFILE + """, dense AS (
  SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT p.user_id, v.item_id, round(sum(p.x * v.x), 6) AS score FROM profile p JOIN vec v USING (pos) WHERE p.user_id IN (SELECT user_id FROM tusers) AND v.item_id IN (SELECT item_id FROM pool) GROUP BY 1, 2) q
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = q.user_id AND s.item_id = q.item_id)) WHERE rank <= 50
)"""


def _dense(s: Snapshot, k: int = 50) -> DataFrame:
    profiles = retrieval.content_profiles(s.hist, s.vectors).join(s.users, "user_id", "left_semi")
    return retrieval.dense_top_k(profiles, s.vectors, s.pool, s.seen, k)


@Q("r17_content_top_k", twin("SELECT * FROM dense", _DENSE))
def _(spark, d):
    return _dense(Snapshot(spark, d))


@Q("r21_pools", twin("SELECT 'eligible' AS pool, count(*) AS n FROM pool UNION ALL SELECT 'history', count(*) FROM items_h UNION ALL SELECT 'catalog', count(*) FROM catalog", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    f = features.item_features_at(s.items, s.hist)
    flags = {"eligible": "in_eligible_pool", "history": "in_history", "catalog": None}
    return reduce(DataFrame.unionByName, [retrieval.pool(f, c).agg(F.count("*").alias("n")).select(F.lit(p).alias("pool"), "n") for p, c in flags.items()])


@Q("r22_eligibility_override", twin("SELECT item_id FROM items_h WHERE n_item >= 25", SNAPSHOT))
def _(spark, d):
    return retrieval.eligible(Snapshot(spark, d).hist, 25)


@Q("r23_ranked_pool", twin("SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS BIGINT) AS place FROM (SELECT item_id, coalesce(score, 0.0) AS score FROM pool LEFT JOIN (" + RECENT + ") USING (item_id))", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return retrieval.ranked_pool(retrieval.decayed_popularity(s.hist, s.cuts[0], 180.0), s.pool)


@Q("r24_lists_by_score", lists_twin("SELECT * FROM (SELECT model, user_id, item_id, score, CAST(row_number() OVER (PARTITION BY model, user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (SELECT 'logit' AS model, user_id, item_id, logit AS score FROM scored UNION ALL SELECT 'item_n_reviews', user_id, item_id, CAST(item_n_reviews AS DOUBLE) FROM scored)) WHERE rank <= 10", 20))
def _(spark, d):
    return retrieval.ranked_lists(Snapshot(spark, d).scored(20), ["logit", "item_n_reviews"], 10)


# --- candidates ------------------------------------------------------------

_UNION = "user_id, item_id, popularity_score, recent_score, covisit_score, source_popularity, source_recent, source_covisit, popularity_rank, recent_rank, covisit_rank, num_sources, best_rank"


@Q("c1_source_union", lists_twin(f"SELECT {_UNION} FROM cands", 30))
def _(spark, d):
    return Snapshot(spark, d).union(30).select(*_UNION.split(", "))


@Q("c2_flags_and_ranks", lists_twin("SELECT num_sources, best_rank, count(*) AS n FROM cands GROUP BY 1, 2", 30))
def _(spark, d):
    return Snapshot(spark, d).union(30).groupBy("num_sources", "best_rank").agg(F.count("*").alias("n"))


@Q("c3_filled_scores", lists_twin(f"SELECT user_id, c.item_id, coalesce(p.score, 0.0) AS popularity_score, coalesce(covisit_score, (SELECT min(covisit_score) - 1 FROM cands)) AS covisit_score, coalesce(recent_score, 0.0) AS recent_score FROM cands c LEFT JOIN (SELECT item_id, coalesce(score, 0.0) AS score FROM pool LEFT JOIN ({POPULARITY}) USING (item_id)) p ON p.item_id = c.item_id", 20))
def _(spark, d):
    s = Snapshot(spark, d)
    counts = s.pool.join(retrieval.popularity(s.hist), "item_id", "left").fillna(0.0, subset=["score"])
    return candidates.fill_scores(s.union(20), counts, "covisit_score", ["recent_score"]).select("user_id", "item_id", "popularity_score", "covisit_score", "recent_score")


@Q("c4_content_fill", lists_twin("SELECT c.user_id, c.item_id, CASE WHEN p.user_id IS NOT NULL AND v.item_id IS NOT NULL THEN round(least(greatest(1 + coalesce(s.dot, 0), 0), 2), 6) ELSE 0.0 END AS content_score FROM cands c LEFT JOIN (SELECT DISTINCT user_id FROM profile) p USING (user_id) LEFT JOIN (SELECT DISTINCT item_id FROM vec) v USING (item_id) LEFT JOIN (SELECT c.user_id, c.item_id, sum(p.x * v.x) AS dot FROM cands c JOIN profile p USING (user_id) JOIN vec v ON v.item_id = c.item_id AND v.pos = p.pos GROUP BY 1, 2) s ON s.user_id = c.user_id AND s.item_id = c.item_id", 20, _PROFILE))
def _(spark, d):
    s = Snapshot(spark, d)
    units = s.vectors.select("item_id", retrieval.unit(F.col("embedding")).alias("u")).where("u is not null")
    return candidates.fill_content(s.union(20), retrieval.content_profiles(s.hist, s.vectors), units).select("user_id", "item_id", "content_score")


@Q("c5_cross_features", lists_twin("""
SELECT c.user_id, c.item_id, k.store, round(coalesce(a.affinity, 0), 6) AS store_affinity, CAST(coalesce(k.store = t.top, false) AS INTEGER) AS same_top_store FROM cands c JOIN catalog k ON k.item_id = c.item_id LEFT JOIN aff a ON a.user_id = c.user_id AND a.facet = k.store
LEFT JOIN (SELECT user_id, facet AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY affinity DESC, facet) AS rn FROM aff) WHERE rn = 1) t ON t.user_id = c.user_id""", 20, f"aff AS ({_AFFINITY.format(f='store')})"))
def _(spark, d):
    s = Snapshot(spark, d)
    out = candidates.cross_features(s.union(20), s.items, {"store": retrieval.facet_affinity(s.hist, s.items, "store")}, {"store": features.top_facet(s.hist, s.items, "store")})
    return out.select("user_id", "item_id", "store", "store_affinity", "same_top_store")


@Q("c6_feature_blocks", lists_twin("SELECT c.user_id, c.item_id, coalesce(u.n, 0) AS user_n_interactions, CAST(u.n IS NOT NULL AS INTEGER) AS user_has_history, coalesce(i.n_item, 0) AS item_n_reviews_hist, k.rating_number AS item_rating_number FROM cands c LEFT JOIN (SELECT user_id, count(*) AS n FROM hist GROUP BY 1) u ON u.user_id = c.user_id LEFT JOIN items_h i ON i.item_id = c.item_id JOIN catalog k ON k.item_id = c.item_id", 20))
def _(spark, d):
    s = Snapshot(spark, d)
    out = candidates.attach_features(s.union(20), features.user_features_at(s.hist, s.cuts[0]), features.item_features_at(s.items, s.hist))
    return out.select("user_id", "item_id", "user_n_interactions", "user_has_history", "item_n_reviews_hist", "item_rating_number")


@Q("c7_labels", lists_twin("SELECT user_id, item_id, label, n_history_events FROM labelled", 30))
def _(spark, d):
    return Snapshot(spark, d).candidates(30).select("user_id", "item_id", "label", "n_history_events")


def build_snapshot(spark, d: str, k: int = 50) -> DataFrame:
    """The whole candidate table: sources, fills, cross features, feature blocks, labels."""
    s = Snapshot(spark, d)
    counts = s.pool.join(retrieval.popularity(s.hist), "item_id", "left").fillna(0.0, subset=["score"])
    out = candidates.fill_scores(s.union(k), counts, None, ["recent_score", "covisit_score"])
    facets = {f: retrieval.facet_affinity(s.hist, s.items, f) for f in ("store", "main_category")}
    tops = {f: features.top_facet(s.hist, s.items, f) for f in facets}
    out = candidates.cross_features(out, s.items, facets, tops)  # by item as the fills before, then by user as the profiles after
    units = s.vectors.select("item_id", retrieval.unit(F.col("embedding")).alias("u")).where("u is not null")
    out = candidates.fill_content(out, retrieval.content_profiles(s.hist, s.vectors), units)
    out = candidates.attach_features(out, features.user_features_at(s.hist, s.cuts[0]), features.item_features_at(s.items, s.hist).drop("store", "main_category"))
    first = ["user_id", "item_id", "main_category", "store"]
    rest = [c for c in out.columns if c not in (*first, "content_score")]
    at = rest.index("popularity_score") + 1
    return candidates.attach_labels(out, s.truth).select(*first, *rest[:at], "content_score", *rest[at:], "label", "n_history_events")


_UFEATS = ["n_interactions", "mean_rating", "std_rating", "n_items", "span_days", "verified_sum", "verified_rate", "helpful_mean", "helpful_sum", "days_since_last", "recent_interactions", "recent_positives"]
_IFEATS = ["rating_number", "n_categories", "n_reviews_hist", "avg_rating_hist", "n_positive_hist", "n_users_hist", "in_history", "in_eligible_pool"]


def _top(aff: str) -> str:
    return f"(SELECT user_id, facet AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY affinity DESC, facet) AS rn FROM {aff}) WHERE rn = 1)"


_BUILD = _PROFILE + f""", aff_s AS ({_AFFINITY.format(f='store')}), aff_m AS ({_AFFINITY.format(f='main_category')}), pcount AS (
  SELECT item_id, coalesce(score, 0.0) AS score FROM pool LEFT JOIN ({POPULARITY}) USING (item_id)
), dots AS (
  SELECT c.user_id, c.item_id, sum(p.x * v.x) AS dot FROM cands c JOIN profile p USING (user_id) JOIN vec v ON v.item_id = c.item_id AND v.pos = p.pos GROUP BY 1, 2
), content AS (
  SELECT c.user_id, c.item_id, CASE WHEN p.user_id IS NOT NULL AND v.item_id IS NOT NULL THEN round(least(greatest(1 + coalesce(s.dot, 0), 0), 2), 6) ELSE 0.0 END AS content_score
  FROM cands c LEFT JOIN (SELECT DISTINCT user_id FROM profile) p USING (user_id) LEFT JOIN (SELECT DISTINCT item_id FROM vec) v USING (item_id) LEFT JOIN dots s ON s.user_id = c.user_id AND s.item_id = c.item_id
), ublock AS (
  SELECT user_id, count(*) AS n_interactions, round(avg(rating), 6) AS mean_rating, round(coalesce(stddev_samp(rating), 0), 6) AS std_rating, count(DISTINCT item_id) AS n_items, round(CAST(max(ts) - min(ts) AS DOUBLE) / 86400000.0, 6) AS span_days,
         CAST(sum(CAST(verified AS INTEGER)) AS BIGINT) AS verified_sum, round(avg(CAST(verified AS INTEGER)), 6) AS verified_rate, round(avg(helpful), 6) AS helpful_mean, CAST(sum(helpful) AS BIGINT) AS helpful_sum,
         round(CAST(any_value(c1) - max(ts) AS DOUBLE) / 86400000.0, 6) AS days_since_last, count(*) FILTER (ts >= c1 - 2592000000) AS recent_interactions, count(*) FILTER (ts >= c1 - 2592000000 AND label = 1) AS recent_positives FROM hist, cut GROUP BY 1
), iblock AS (
  SELECT p.item_id, store, main_category, rating_number, CAST(len(categories) AS INTEGER) AS n_categories, coalesce(n, 0) AS n_reviews_hist, coalesce(a, 0.0) AS avg_rating_hist, CAST(coalesce(pos, 0) AS BIGINT) AS n_positive_hist, coalesce(u, 0) AS n_users_hist, CAST(n IS NOT NULL AS INTEGER) AS in_history, CAST(coalesce(n, 0) >= 5 AS INTEGER) AS in_eligible_pool
  FROM catalog p LEFT JOIN (SELECT item_id, count(*) AS n, round(avg(rating), 6) AS a, sum(label) AS pos, count(DISTINCT user_id) AS u FROM hist GROUP BY 1) h USING (item_id)
)"""


@Q("c8_snapshot_build", lists_twin(f"""
SELECT l.user_id, l.item_id, coalesce(pc.score, 0.0) AS popularity_score, coalesce(l.recent_score, 0.0) AS recent_score, coalesce(l.covisit_score, 0.0) AS covisit_score, content_score,
  source_popularity, source_recent, source_covisit, popularity_rank, recent_rank, covisit_rank, num_sources, best_rank, i.store, i.main_category, round(coalesce(s.affinity, 0), 6) AS store_affinity, round(coalesce(m.affinity, 0), 6) AS main_category_affinity,
  CAST(coalesce(i.store = ts.top, false) AS INTEGER) AS same_top_store, CAST(coalesce(i.main_category = tm.top, false) AS INTEGER) AS same_top_main_category,
  {', '.join(f'coalesce(u.{c}, 0) AS user_{c}' for c in _UFEATS)}, CAST(u.user_id IS NOT NULL AS INTEGER) AS user_has_history, {', '.join(f'i.{c} AS item_{c}' for c in _IFEATS)}, label, n_history_events
FROM labelled l LEFT JOIN pcount pc USING (item_id) JOIN content c ON c.user_id = l.user_id AND c.item_id = l.item_id JOIN iblock i ON i.item_id = l.item_id LEFT JOIN ublock u ON u.user_id = l.user_id
LEFT JOIN aff_s s ON s.user_id = l.user_id AND s.facet = i.store LEFT JOIN aff_m m ON m.user_id = l.user_id AND m.facet = i.main_category LEFT JOIN {_top('aff_s')} ts ON ts.user_id = l.user_id LEFT JOIN {_top('aff_m')} tm ON tm.user_id = l.user_id""", 50, _BUILD))
def _(spark, d):
    return build_snapshot(spark, d)


@Q("c11_split_duplicates", lists_twin("SELECT split, count(*) AS n FROM cands, (VALUES ('val'), ('test')) v(split) GROUP BY 1", 20))
def _(spark, d):
    return candidates.duplicate_over_splits(Snapshot(spark, d).union(20), ["val", "test"]).groupBy("split").agg(F.count("*").alias("n"))


@Q("c12_source_overlap", lists_twin("SELECT concat_ws('+', CASE WHEN source_popularity = 1 THEN 'popularity' END, CASE WHEN source_recent = 1 THEN 'recent' END, CASE WHEN source_covisit = 1 THEN 'covisit' END) AS sources, count(*) AS n FROM cands GROUP BY 1", 30))
def _(spark, d):
    return candidates.source_overlap(Snapshot(spark, d).union(30), ["popularity", "recent", "covisit"])


@Q("c13_coverage_report", lists_twin("""
SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_pairs, round(avg(h / n), 6) AS coverage_macro, round(avg(CAST(h > 0 AS INTEGER)), 6) AS coverage_any, round(sum(h) / sum(n), 6) AS coverage_per_positive, round(sum(hs) / sum(n), 6) AS historical_coverage, round(sum(p) / sum(n), 6) AS eligible_coverage, CAST(sum(n) - sum(hs) AS BIGINT) AS n_cold_targets,
  count(*) FILTER (k = 0) AS users_0, count(*) FILTER (k = 1) AS users_1, count(*) FILTER (k = 2) AS users_2, count(*) FILTER (k >= 3) AS users_3
FROM (SELECT t.user_id, count(*) AS n, count(c.user_id) AS h, sum(item_in_history) AS hs, sum(item_in_eligible_pool) AS p, max(n_history_events) AS k FROM truth t LEFT JOIN cands c ON c.user_id = t.user_id AND c.item_id = t.item_id GROUP BY 1)""", 100))
def _(spark, d):
    s = Snapshot(spark, d)
    return candidates.coverage_report(s.union(100), s.truth)


@Q("c13_source_recall", lists_twin(" UNION ALL ".join(f"SELECT '{s}' AS source, k, recall, precision FROM ({_recall_sql(s, [10, 50])})" for s in ("popularity", "recent", "covisit")), 50))
def _(spark, d):
    s = Snapshot(spark, d)
    return candidates.source_recall(s.union(50), s.truth, ["popularity", "recent", "covisit"], [10, 50])


@Q("c14_relabel", lists_twin("SELECT count(*) AS n_rows, CAST(sum(a) AS BIGINT) AS n_before, CAST(sum(b) AS BIGINT) AS n_after, count(*) FILTER (a = 1 AND b = 0) AS n_lost, round((count(*) - sum(a)) / greatest(sum(a), 1), 6) AS weight_before, round((count(*) - sum(b)) / greatest(sum(b), 1), 6) AS weight_after FROM (SELECT CAST(f.user_id IS NOT NULL AS INTEGER) AS a, label AS b FROM labelled l LEFT JOIN (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn FROM truth) WHERE rn = 1) f ON f.user_id = l.user_id AND f.item_id = l.item_id)", 100))
def _(spark, d):
    from pitrec.operators import snapshots

    s = Snapshot(spark, d)
    first = snapshots.ground_truth(s.rows, s.bounds, "first")
    return candidates.relabel(candidates.attach_labels(s.union(100), first), s.truth)


@Q("c15_label_gate", lists_twin("""SELECT count(*) FILTER (label = 1 AND NOT known) AS not_in_truth, count(*) FILTER (label = 0 AND known) AS not_labelled FROM (
  SELECT l.label, EXISTS (SELECT 1 FROM targets t WHERE t.user_id = l.user_id AND t.item_id = l.item_id) AS known FROM labelled l)""", 50))
def _(spark, d):
    s = Snapshot(spark, d)
    return candidates.label_gate(s.candidates(50), s.truth)


@Q("c16_target_status", lists_twin("SELECT CASE WHEN c.user_id IS NOT NULL THEN 'retrieved' WHEN n_item >= 5 THEN 'eligible_not_retrieved' WHEN n_item > 0 THEN 'low_support' ELSE 'cold' END AS status, count(*) AS n FROM targets t LEFT JOIN cands c ON c.user_id = t.user_id AND c.item_id = t.item_id LEFT JOIN items_h i ON i.item_id = t.item_id GROUP BY 1", 100))
def _(spark, d):
    s = Snapshot(spark, d)
    return candidates.target_status(s.truth, s.union(100), s.hist)


# --- metrics ---------------------------------------------------------------

_POP = SNAPSHOT + "," + global_list("popularity", POPULARITY, 100)


@Q("e1_truth_sets", twin("SELECT user_id, item_id FROM win WHERE label = 1", SNAPSHOT))
def _(spark, d):
    return metrics.truth_sets(Snapshot(spark, d).window)


@Q("e2_pool_coverage", twin("SELECT count(*) AS n_pairs, round(avg(CAST(item_id IN (SELECT item_id FROM pool) AS INTEGER)), 6) AS coverage FROM targets", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.pool_coverage(s.targets, s.pool)


def flagship(spark, d: str) -> DataFrame:
    """Recall and precision of popularity lists at the 80 % cutoff."""
    s = Snapshot(spark, d)
    return metrics.recall_precision(s.targets, s.popular(100), KS)


@Q("e3_recall_precision", twin(_recall_sql("popularity", KS), _POP))
def _(spark, d):
    return flagship(spark, d)


def _wide_sql(lists: str, ks, targets: str = "targets", keys: str = "", group: str = "") -> str:
    cols = ", ".join(f"round(avg(h{k} / n), 6) AS recall_{k}, round(avg(h{k} / {float(k)}::DOUBLE), 6) AS precision_{k}" for k in ks)
    hits = ", ".join(f"count(*) FILTER (l.rank <= {k}) AS h{k}" for k in ks)
    return f"SELECT {group + ' AS ' + keys + ', ' if keys else ''}count(*) AS n_users, {cols} FROM (SELECT t.user_id, count(*) AS n, {hits}{', max(is_warm_user) AS warm, max(n_history_events) AS k0' if targets == 'truth' else ''} FROM {targets} t LEFT JOIN {lists} l ON l.user_id = t.user_id AND l.item_id = t.item_id GROUP BY 1) {'GROUP BY 1' if keys else ''}"


@Q("e4_split_report", twin(f"SELECT * FROM (SELECT count(*) AS n_total, CAST(sum(label) AS BIGINT) AS n_positive, round(avg(label), 6) AS positive_rate, count(DISTINCT user_id) AS n_users_total FROM win), (SELECT count(*) AS n_pairs, round(avg(CAST(item_id IN (SELECT item_id FROM pool) AS INTEGER)), 6) AS coverage FROM targets), ({_wide_sql('popularity', KS)})", _POP))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.split_report(s.window, s.popular(100), s.pool, KS)


@Q("e5_warm_cold", twin(f"{_wide_sql('popularity', [10, 50], 'truth', 'view', chr(39) + 'all' + chr(39))} UNION ALL {_wide_sql('popularity', [10, 50], 'truth', 'view', 'CASE WHEN warm = 1 THEN ' + repr('warm') + ' ELSE ' + repr('cold') + ' END')}", _POP))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.warm_cold_report(s.truth, s.popular(50), [10, 50])


@Q("e6_ceiling", lists_twin("SELECT count(*) AS n_users, round(avg(h / n), 6) AS macro, round(avg(CAST(h > 0 AS INTEGER)), 6) AS any_hit, round(sum(h) / sum(n), 6) AS per_positive FROM (SELECT t.user_id, count(*) AS n, count(c.user_id) AS h FROM targets t LEFT JOIN cands c ON c.user_id = t.user_id AND c.item_id = t.item_id GROUP BY 1)", 100))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.ceiling(s.targets, s.union(100))


@Q("e7_conditional_recall", lists_twin(_recall_sql("popularity", [10, 50], "(SELECT * FROM targets WHERE user_id IN (SELECT t.user_id FROM targets t JOIN cands c ON c.user_id = t.user_id AND c.item_id = t.item_id))"), 100))
def _(spark, d):
    s = Snapshot(spark, d)
    met = s.candidates(100).where("label = 1")
    return metrics.conditional_recall(s.targets, met, met.where("popularity_rank > 0").select("user_id", "item_id", F.col("popularity_rank").alias("rank")), [10, 50])


@Q("e8_cohorts", twin(_wide_sql("popularity", [10, 100], "truth", "cohort", "CAST(least(k0, 3) AS VARCHAR)"), _POP))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.cohort_report(s.truth, s.popular(100), [10, 100])


@Q("e8_fine_cohorts", twin(_wide_sql("popularity", [10, 100], "truth", "cohort", "CASE WHEN k0 = 0 THEN '0' WHEN k0 <= 2 THEN '1-2' WHEN k0 <= 4 THEN '3-4' WHEN k0 <= 9 THEN '5-9' ELSE '10+' END"), _POP))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.cohort_report(s.truth, s.popular(100), [10, 100], fine=True)


@Q("e9_item_cohorts", twin("SELECT CASE WHEN item_in_history = 1 THEN 'warm_item' ELSE 'cold_item' END AS cohort, count(*) AS n_pairs, count(DISTINCT t.user_id) AS n_users, round(avg(CAST(coalesce(rank <= 10, false) AS INTEGER)), 6) AS recall_10, round(avg(CAST(coalesce(rank <= 100, false) AS INTEGER)), 6) AS recall_100 FROM truth t LEFT JOIN popularity l ON l.user_id = t.user_id AND l.item_id = t.item_id GROUP BY 1", _POP))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.item_cohort_report(s.truth, s.popular(100), [10, 100])


_AUC = """auc AS (
  SELECT user_id, n, n_pos, round((s - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * (n - n_pos)), 6) AS auc FROM (
    SELECT user_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, sum(CASE WHEN label = 1 THEN r END) AS s FROM (
      SELECT *, rank() OVER (PARTITION BY user_id ORDER BY logit) + (count(*) OVER (PARTITION BY user_id, logit) - 1) / 2.0 AS r FROM scored) GROUP BY 1) WHERE n_pos > 0 AND n_pos < n)"""


@Q("e10_user_auc", lists_twin("SELECT * FROM auc", 100, _AUC))
def _(spark, d):
    return metrics.user_auc(Snapshot(spark, d).scored(100))


@Q("e11_grouped_auc", lists_twin("SELECT count(*) AS n_users, round(sum(auc * n) / sum(n), 6) AS gauc, round(avg(auc), 6) AS mean_auc FROM auc", 100, _AUC))
def _(spark, d):
    return metrics.grouped_auc(Snapshot(spark, d).scored(100))


_GAUC = "SELECT n, p AS n_pos, round((s - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * (n - p)), 6) AS auc FROM (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p, sum(CASE WHEN label = 1 THEN r END) AS s FROM (SELECT *, rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0 AS r FROM scored))"


@Q("e12_global_auc", lists_twin(_GAUC, 100))
def _(spark, d):
    return metrics.global_auc(Snapshot(spark, d).scored(100))


def _placed(k: int) -> str:
    return """placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY logit DESC, label) AS place FROM scored
), sizes AS (
  SELECT user_id, count(*) AS n_targets FROM targets GROUP BY 1
)"""


@Q("e13_mrr", lists_twin("SELECT count(*) AS n_users, round(avg(1.0 / f), 6) AS mrr FROM (SELECT user_id, min(place) AS f FROM placed WHERE label = 1 GROUP BY 1)", 100, _placed(100)))
def _(spark, d):
    s = Snapshot(spark, d)
    out = metrics.list_metrics(s.scored_lists(100), _sizes(s), [10])
    return out.select(F.col("n_with_positive").alias("n_users"), "mrr")


def _sizes(s: Snapshot) -> DataFrame:
    return s.targets.groupBy("user_id").agg(F.count("*").alias("n_targets"))


def _metrics_sql(ks, batch: bool = False) -> str:
    inner = ", ".join(f"coalesce(sum(CASE WHEN place <= {k} THEN label END), 0) AS h{k}, coalesce(sum(CASE WHEN place <= {k} THEN label / log2(place + 1.0) END), 0.0) AS g{k}" for k in ks)
    ideal = lambda n, k: f"list_sum(list_transform(range(1, CAST(least({n}, {k}) + 1 AS BIGINT)), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE)))"
    if batch:
        cols = ", ".join(f"round(avg(CASE WHEN n_pos > 0 THEN g{k} / {ideal('n_pos', k)} ELSE 0 END), 6) AS ndcg_{k}, round(avg(h{k} / {float(k)}::DOUBLE), 6) AS precision_{k}, round(avg(CASE WHEN n_pos > 0 THEN h{k} / n_pos END), 6) AS recall_{k}" for k in ks)
        return f"SELECT count(*) AS n_lists, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, {cols} FROM (SELECT user_id, sum(label) AS n_pos, min(CASE WHEN label = 1 THEN place END) AS first, {inner} FROM placed GROUP BY 1)"
    cols = ", ".join(
        f"round(avg(CASE WHEN n_pos > 0 THEN g{k} / {ideal('t', k)} END), 6) AS ndcg_{k}, round(avg(h{k} / {float(k)}::DOUBLE), 6) AS precision_{k}, round(avg(CASE WHEN n_pos > 0 THEN h{k} / t END), 6) AS recall_conditional_{k}, round(avg(CASE WHEN t > 0 THEN h{k} / t ELSE 0 END), 6) AS recall_listed_{k}, "
        f"round(avg(CAST(h{k} > 0 AS INTEGER)), 6) AS hit_rate_{k}, round(sum(CASE WHEN t > 0 THEN h{k} / t ELSE 0 END) / (SELECT count(*) FROM sizes), 6) AS recall_overall_{k}, round(sum(h{k}) / (SELECT count(*) FROM sizes), 6) AS hits_per_user_{k}"
        for k in ks
    )
    return f"SELECT count(*) AS n_listed, count(*) FILTER (n_pos > 0) AS n_with_positive, round(avg(CASE WHEN n_pos > 0 THEN 1.0 / first END), 6) AS mrr, (SELECT count(*) FROM sizes) AS n_truth_users, {cols} FROM (SELECT u.*, greatest(coalesce(n_targets, 0), n_pos) AS t FROM (SELECT user_id, sum(label) AS n_pos, min(CASE WHEN label = 1 THEN place END) AS first, {inner} FROM placed GROUP BY 1) u LEFT JOIN sizes USING (user_id))"


@Q("e14_ndcg", lists_twin(f"SELECT ndcg_10, ndcg_50 FROM ({_metrics_sql([10, 50])})", 100, _placed(100)))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.list_metrics(s.scored_lists(100), _sizes(s), [10, 50]).select("ndcg_10", "ndcg_50")


@Q("e15_denominators", lists_twin(_metrics_sql([10, 50]), 100, _placed(100)))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.list_metrics(s.scored_lists(100), _sizes(s), [10, 50])


@Q("e16_conservative_order", lists_twin("SELECT user_id, CAST(min(CASE WHEN label = 1 THEN place END) AS INTEGER) AS first_positive, count(*) AS n FROM placed GROUP BY 1", 50, _placed(50)))
def _(spark, d):
    ranked = metrics._ranks(Snapshot(spark, d).scored(50))
    return ranked.groupBy("user_id").agg(F.min(F.when(F.col("label") == 1, F.col("place"))).alias("first_positive"), F.count("*").alias("n"))


@Q("e17_auc_context", lists_twin("SELECT round(avg(n - n_pos), 6) AS mean_negatives, round(1 + (1 - avg(auc)) * avg(n - n_pos), 6) AS implied_rank, round(1 - 9 / avg(n - n_pos), 6) AS auc_for_top_k FROM auc", 100, _AUC))
def _(spark, d):
    return metrics.auc_context(Snapshot(spark, d).scored(100), 10)


@Q("e19_full_evaluation", lists_twin(f"SELECT * FROM ({_metrics_sql(KS)}), (SELECT round(sum(auc * n) / sum(n), 6) AS gauc, round(avg(auc), 6) AS mean_auc FROM auc), (SELECT auc AS global_auc FROM ({_GAUC}))", 100, _placed(100) + "," + _AUC))
def _(spark, d):
    s = Snapshot(spark, d)
    rows = s.scored(100).select("user_id", "score", "label")
    return metrics.full_evaluation(rows, _sizes(s), KS)


@Q("e20_batch_suite", lists_twin(_metrics_sql([10, 20], batch=True), 50, _placed(50)))
def _(spark, d):
    return metrics.batch_metrics(Snapshot(spark, d).scored(50), [10, 20])


@Q("e21_front_end", lists_twin(_metrics_sql([5, 10, 20], batch=True), 50, _placed(50)))
def _(spark, d):
    return metrics.batch_metrics(Snapshot(spark, d).scored(50), [5, 10, 20])


@Q("e22_horizon_windows", twin(_recall_sql("popularity", [10, 100], "(SELECT t.user_id, t.item_id FROM truth t, cut WHERE ts < c1 + 90 * 86400000::BIGINT)"), _POP))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.horizon_report(s.truth, s.popular(100), s.cuts[0], s.cuts[0] + 90 * X.DAY_MS, [10, 100])


@Q("e23_target_ranks", lists_twin("SELECT source, user_id, item_id, rank FROM lists JOIN targets USING (user_id, item_id)", 100))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.target_ranks(s.truth, s.lists(100))


@Q("e23_source_hits", lists_twin(" UNION ALL ".join(f"SELECT source, {k} AS k, count(DISTINCT user_id) FILTER (rank <= {k}) AS user_hits, count(*) FILTER (rank <= {k}) AS pair_hits FROM lists JOIN targets USING (user_id, item_id) GROUP BY 1" for k in (20, 100)), 100))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.source_hits(s.truth, s.lists(100), [20, 100])


@Q("e24_union_stats", lists_twin(" UNION ALL ".join(f"SELECT {k} AS k, '*' AS source, count(*) AS hits FROM (SELECT user_id, item_id FROM lists JOIN targets USING (user_id, item_id) WHERE rank <= {k} GROUP BY 1, 2) UNION ALL SELECT {k}, s, count(*) FROM (SELECT user_id, item_id, min(source) AS s FROM lists JOIN targets USING (user_id, item_id) WHERE rank <= {k} GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 2" for k in (20, 100)), 100))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.union_stats(s.truth, s.lists(100), [20, 100])


@Q("e24_avg_candidates", lists_twin(" UNION ALL ".join(f"SELECT {k} AS k, round(avg(n), 6) AS avg_candidates, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT user_id, count(DISTINCT item_id) AS n FROM lists WHERE rank <= {k} GROUP BY 1)" for k in (20, 100)), 100))
def _(spark, d):
    return metrics.avg_candidates(Snapshot(spark, d).lists(100), [20, 100])


@Q("e25_list_overlap", lists_twin("SELECT x.source AS a, y.source AS b, count(*) AS shared FROM lists x JOIN lists y ON x.user_id = y.user_id AND x.item_id = y.item_id AND x.source < y.source WHERE x.rank <= 50 AND y.rank <= 50 GROUP BY 1, 2", 50))
def _(spark, d):
    return metrics.list_overlap(Snapshot(spark, d).lists(50), 50)


@Q("e26_concentration", twin("SELECT count(*) AS n_items, CAST(greatest(1, floor(count(*) * 0.01)) AS BIGINT) AS n_top, round((SELECT sum(c) FROM (SELECT count(*) AS c FROM hist WHERE label = 1 GROUP BY item_id ORDER BY c DESC, item_id LIMIT (SELECT greatest(1, CAST(floor(count(DISTINCT item_id) * 0.01) AS BIGINT)) FROM hist WHERE label = 1))) / sum(c), 6) AS share FROM (SELECT count(*) AS c FROM hist WHERE label = 1 GROUP BY item_id)", SNAPSHOT))
def _(spark, d):
    return metrics.concentration(Snapshot(spark, d).hist)


def _recency(h: float) -> str:
    return f"SELECT item_id, round(sum(pow(0.5, CAST(c1 - ts AS DOUBLE) / 86400000.0 / {h})), 6) AS score FROM hist, cut WHERE label = 1 GROUP BY 1"


@Q("e26_recency_grid", twin(" UNION ALL ".join(f"SELECT {h}::DOUBLE AS half_life, k, recall FROM ({_recall_sql(f'g{int(h)}', [100])})" for h in (30.0, 180.0, 720.0)), SNAPSHOT + "," + ",".join(global_list(f"g{int(h)}", _recency(h), 100) for h in (30.0, 180.0, 720.0))))
def _(spark, d):
    s = Snapshot(spark, d)
    return reduce(DataFrame.unionByName, [metrics.recall_precision(s.targets, s.recent(100, h), [100]).select(F.lit(h).alias("half_life"), "k", "recall") for h in (30.0, 180.0, 720.0)])


@Q("e26_eligibility_grid", twin(" UNION ALL ".join(f"SELECT {m} AS least, count(*) AS n_items, round((SELECT avg(CAST(item_id IN (SELECT item_id FROM items_h WHERE n_item >= {m}) AS INTEGER)) FROM targets), 6) AS coverage FROM items_h WHERE n_item >= {m}" for m in (5, 20, 25)), SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    out = []
    for m in (5, 20, 25):
        pool = retrieval.eligible(s.hist, m)
        out.append(pool.agg(F.count("*").alias("n_items")).crossJoin(metrics.pool_coverage(s.targets, pool).select("coverage")).select(F.lit(m).alias("least"), "n_items", "coverage"))
    return reduce(DataFrame.unionByName, out)


_ARM_SOURCES = [("A0", "popularity"), ("A1", "popularity"), ("A1", "recent"), ("A3", "popularity"), ("A3", "recent"), ("A3", "covisit"), ("A5", "covisit")]
_ARMS = f"""arm_source(arm, source) AS (VALUES {', '.join(f"('{a}', '{s}')" for a, s in _ARM_SOURCES)}),
arm_pairs AS (SELECT arm, user_id, item_id, min(rank) AS best FROM lists JOIN arm_source USING (source) GROUP BY 1, 2, 3),
arm_ranks AS (SELECT *, row_number() OVER (PARTITION BY arm, user_id ORDER BY best, item_id) AS rank FROM arm_pairs),
arms AS (
  SELECT arm, round(avg(h10 / n), 6) AS r10, round(avg(h100 / n), 6) AS r100, round(avg(h / n), 6) AS recall, any_value(n_rows) AS n_rows FROM (
    SELECT a.arm, t.user_id, count(*) AS n, count(r.user_id) AS h, count(*) FILTER (r.rank <= 10) AS h10, count(*) FILTER (r.rank <= 100) AS h100, any_value(a.n_rows) AS n_rows
    FROM targets t CROSS JOIN (SELECT arm, count(*) AS n_rows FROM arm_pairs GROUP BY 1) a LEFT JOIN arm_ranks r ON r.arm = a.arm AND r.user_id = t.user_id AND r.item_id = t.item_id GROUP BY 1, 2) GROUP BY 1
)"""


def _arms(spark, d) -> DataFrame:
    """(arm, r10, r100, recall, n_rows): unions of some sources, their rows ordered by the best rank, against the targets."""
    s = Snapshot(spark, d)
    which = F.broadcast(spark.createDataFrame(_ARM_SOURCES, "arm string, source string"))
    pairs = s.lists(100).join(which, "source").groupBy("arm", "user_id", "item_id").agg(F.min("rank").alias("best")).persist()
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("arm", "user_id").orderBy("best", "item_id")))
    truth = s.targets.crossJoin(F.broadcast(which.select("arm").distinct()))  # a row an arm
    users = metrics.user_hits(truth, ranked, [10, 100, 1 << 30], ["arm"])
    mean = lambda c: r6(F.avg(F.col(c) / F.col("n")))
    out = users.groupBy("arm").agg(mean("h10").alias("r10"), mean("h100").alias("r100"), mean(f"h{1 << 30}").alias("recall"))
    return out.join(pairs.groupBy("arm").agg(F.count("*").alias("n_rows")), "arm")


@Q("e27_stage_gate", lists_twin("""
SELECT arm, recall, n_rows, ratio, gib, allowed, CAST(place AS INTEGER) AS place, allowed AND place <= 2 AS shortlisted FROM (SELECT *, row_number() OVER (ORDER BY allowed DESC, recall DESC, arm) AS place FROM (
  SELECT *, ratio <= 1.6 AND gib <= 120 AS allowed FROM (SELECT arm, recall, n_rows, round(n_rows / (SELECT n_rows FROM arms WHERE arm = 'A0'), 6) AS ratio, round(n_rows * 1100.0 / 1073741824.0, 6) AS gib FROM arms)))""", 100, _ARMS))
def _(spark, d):
    a = _arms(spark, d).persist()
    return metrics.stage_gate(a.select("arm", "recall"), a.select("arm", "n_rows"), "A0")


@Q("e28_bucket_hits", lists_twin("SELECT source, CASE WHEN coalesce(n_item, 0) = 0 THEN '0' WHEN n_item <= 2 THEN '1-2' WHEN n_item <= 4 THEN '3-4' ELSE '>=5' END AS bucket, count(*) AS hits FROM lists JOIN targets USING (user_id, item_id) LEFT JOIN items_h USING (item_id) WHERE rank <= 100 GROUP BY 1, 2", 100))
def _(spark, d):
    s = Snapshot(spark, d)
    return metrics.bucket_hits(s.truth, s.lists(100), s.hist, 100)


@Q("e28_configuration_probe", lists_twin("""
SELECT c AS config, covered, only_here, covered - (SELECT count(*) FROM b) AS delta FROM (
  SELECT 'base' AS c, (SELECT count(*) FROM b) AS covered, 0::BIGINT AS only_here UNION ALL SELECT 'wide', (SELECT count(*) FROM w), (SELECT count(*) FROM (SELECT * FROM w EXCEPT SELECT * FROM b)))""", 100, "b AS (SELECT DISTINCT user_id, item_id FROM lists JOIN targets USING (user_id, item_id) WHERE source = 'popularity'), w AS (SELECT DISTINCT user_id, item_id FROM lists JOIN targets USING (user_id, item_id))"))
def _(spark, d):
    s = Snapshot(spark, d)
    lists = s.lists(100)
    return metrics.configuration_probe(s.truth, {"base": lists.where("source = 'popularity'"), "wide": lists}, "base")


@Q("e29_score_baselines", lists_twin(" UNION ALL ".join(f"SELECT '{m}' AS model, k, recall FROM ({_recall_sql(f'(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {m} DESC, item_id) AS rank FROM scored)', [10, 50])})" for m in ("logit", "item_n_reviews")), 100))
def _(spark, d):
    s = Snapshot(spark, d)
    lists = retrieval.ranked_lists(s.scored(100), ["logit", "item_n_reviews"], 50)
    models_ = spark.createDataFrame([("logit",), ("item_n_reviews",)], "model string")
    return metrics.recall_precision(s.targets.crossJoin(F.broadcast(models_)), lists, [10, 50], ["model"]).select("model", "k", "recall")  # two rows


@Q("e30_freeze_choice", lists_twin("""
SELECT arm, place = 1 AND (near OR arm = 'A0') AS chosen FROM (SELECT *, row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN r10 END DESC NULLS LAST, CASE WHEN near THEN n_rows END NULLS FIRST, CASE WHEN arm = 'A0' THEN 0 ELSE 1 END, arm) AS place FROM (
  SELECT *, able AND r100 >= max(CASE WHEN able THEN r100 END) OVER () - 0.0005 AS near FROM (SELECT a.*, a.arm <> 'A0' AND a.r10 >= z.r10 AND a.r100 > z.r100 AS able FROM arms a, arms z WHERE z.arm = 'A0')))""", 100, _ARMS))
def _(spark, d):
    return metrics.freeze_choice(_arms(spark, d).select("arm", "r10", "r100", "n_rows"), "A0")


_ANCHOR = """split AS (
  SELECT user_id, item_id, ts, label, CASE WHEN back = 1 THEN 'test' WHEN back = 2 THEN 'val' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS held FROM clean) WHERE held >= 3
), tr AS (SELECT * FROM split WHERE split = 'train'
), rankedpop AS (SELECT item_id, count(*) FILTER (label = 1) AS score FROM tr GROUP BY 1
), alist AS (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT DISTINCT user_id FROM split) u CROSS JOIN rankedpop p
  WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = u.user_id AND tr.item_id = p.item_id)
), closed AS (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank FROM alist a WHERE rank <= 101 AND NOT EXISTS (SELECT 1 FROM split s WHERE s.split = 'val' AND s.user_id = a.user_id AND s.item_id = a.item_id)
)"""


def _anchor(spark, d):
    from pitrec.operators import filtering

    s = filtering.cut(filtering.leave_last_two(interactions(spark, d)))  # read by all parts
    train, val, test = (s.where(F.col("split") == x) for x in ("train", "val", "test"))
    pool = train.select("item_id").distinct()
    return train, val, test, pool, retrieval.top_unseen(s.select("user_id").distinct(), retrieval.popularity(train), pool, retrieval.seen(train), 101)


@Q("e32_anchor_score", twin(" UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n_users, round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(1.0 + rank) ELSE 0.0 END), 6) AS ndcg FROM (SELECT user_id, item_id FROM split WHERE split = 'test') t LEFT JOIN closed USING (user_id, item_id)" for k in (10, 100)), _ANCHOR))
def _(spark, d):
    _, val, test, _, lists = _anchor(spark, d)
    return metrics.anchor_score(lists, val, test, [10, 100])


@Q("e33_anchor_checks", twin("SELECT count(*) AS n_tests, count(*) FILTER (item_id NOT IN (SELECT item_id FROM tr)) AS n_outside, round(avg(CAST(item_id NOT IN (SELECT item_id FROM tr) AS INTEGER)), 6) AS outside_rate, 0::BIGINT AS n_without_list FROM split WHERE split = 'test'", _ANCHOR))
def _(spark, d):
    train, _, test, pool, lists = _anchor(spark, d)
    return metrics.anchor_checks(test, pool, lists)


_PRED = "SELECT doc_id, 1 + doc_id % 5 AS rating, 1 + (doc_id * 7 % 45) / 10.0::DOUBLE AS pred FROM documents"


def _pred(spark, d) -> DataFrame:
    k = F.col("doc_id")
    return load(spark, d, "documents").select("doc_id", (1 + k % 5).alias("rating"), (1 + (k * 7 % 45) / F.lit(10.0)).alias("pred"))


_CLS = "CAST(round_even(least(greatest(pred, 1.0), 5.0), 0) AS INTEGER)"


@Q("e34_regression_report", f"SELECT count(*) AS n, round(sqrt(avg(pow(least(greatest(pred, 1.0), 5.0) - rating, 2))), 6) AS rmse, round(avg(abs(least(greatest(pred, 1.0), 5.0) - rating)), 6) AS mae, round(avg(CAST({_CLS} = rating AS INTEGER)), 6) AS accuracy FROM ({_PRED})")
def _(spark, d):
    return metrics.regression_report(_pred(spark, d))


@Q("e34_confusion", f"SELECT rating, pred_class, n, round(n / sum(n) OVER (PARTITION BY rating), 6) AS share FROM (SELECT rating, {_CLS} AS pred_class, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2)")
def _(spark, d):
    return metrics.confusion(_pred(spark, d))


@Q("e34_macro_f1", f"SELECT count(*) AS n_classes, round(avg(2.0 * tp / (t + p)), 6) AS macro_f1 FROM (SELECT c, count(*) FILTER (rating = c) AS t, count(*) FILTER (k = c) AS p, count(*) FILTER (rating = c AND k = c) AS tp FROM (SELECT rating, {_CLS} AS k FROM ({_PRED})), (SELECT unnest(range(1, 6)) AS c) GROUP BY 1)")
def _(spark, d):
    return metrics.macro_f1(_pred(spark, d))


# --- calibration -----------------------------------------------------------

_P = """probs AS (
  SELECT *, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS p, CAST(least(n_history_events, 3) AS INTEGER) AS cohort,
         CASE WHEN item_n_reviews < 10 THEN '0-9' WHEN item_n_reviews < 30 THEN '10-29' WHEN item_n_reviews < 100 THEN '30-99' WHEN item_n_reviews < 300 THEN '100-299' ELSE '300+' END AS bucket
  FROM (SELECT *, logit - ln(20.0::DOUBLE) AS z FROM scored))"""


def _probs(s: Snapshot, k: int = 50) -> DataFrame:
    return calibration.with_views(s.scored(k)).withColumn("p", calibration.prior_correction(F.col("logit"), 20.0))


@Q("b1_sigmoid", lists_twin("SELECT user_id, item_id, round(CASE WHEN logit >= 0 THEN 1 / (1 + exp(-logit)) ELSE exp(logit) / (1 + exp(logit)) END, 6) AS p FROM scored", 20))
def _(spark, d):
    return Snapshot(spark, d).scored(20).select("user_id", "item_id", r6(X.sigmoid(F.col("logit"))).alias("p"))


@Q("b2_review_buckets", lists_twin("SELECT bucket, count(*) AS n FROM probs GROUP BY 1", 50, _P))
def _(spark, d):
    return _probs(Snapshot(spark, d)).groupBy("bucket").agg(F.count("*").alias("n"))


@Q("b3_distribution", lists_twin("SELECT count(*) AS n, round(avg(p), 6) AS mean_p, round(stddev_pop(p), 6) AS std_p, " + ", ".join(f"round(quantile_cont(p, {q}), 6) AS q{round(q * 100):02d}" for q in calibration.QS) + ", round(avg(logit) FILTER (label = 1), 6) AS pos_logit, round(avg(logit) FILTER (label = 0), 6) AS neg_logit, round(avg(p) / avg(label), 6) AS bias_ratio, round(avg(pow(p - label, 2)), 6) AS brier FROM probs", 50, _P))
def _(spark, d):
    return calibration.distribution(_probs(Snapshot(spark, d)))


@Q("b4_ece_equal", lists_twin("SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM (SELECT least(floor(p * 15), 14) AS b, count(*) AS n, sum(p) AS sp, sum(label) AS sy FROM probs GROUP BY 1)", 50, _P))
def _(spark, d):
    return calibration.ece_equal(_probs(Snapshot(spark, d)))


@Q("b5_ece_quantile", lists_twin("SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_bins, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM (SELECT greatest(least(len(list_filter(edges, lambda e: e <= round(p, 12))), len(edges) - 1), 1) AS b, count(*) AS n, sum(p) AS sp, sum(label) AS sy FROM probs, (SELECT list_sort(list_distinct(list_transform(quantile_cont(p, [" + ", ".join(f"{k}.0/15" for k in range(16)) + "]), lambda x: round(x, 12)))) AS edges FROM probs) GROUP BY 1)", 50, _P))
def _(spark, d):
    return calibration.ece_quantile(_probs(Snapshot(spark, d)))


_NEWTON = """g AS (
  SELECT list(struct_pack(x := logit, n := CAST(n AS DOUBLE), y := CAST(y AS DOUBLE))) AS v, CAST(sum(n) AS DOUBLE) AS total FROM (SELECT logit, count(*) AS n, sum(label) AS y FROM scored GROUP BY 1)
), newton AS (
  SELECT 0 AS k, 1.0::DOUBLE AS a, -ln(20.0::DOUBLE) AS b, NULL::DOUBLE AS loss, false AS done
  UNION ALL
  SELECT k + 1, a - least(1.0, 2.0 / greatest(size, 1e-300)) * da, b - least(1.0, 2.0 / greatest(size, 1e-300)) * db, loss, size < 1e-9 FROM (
    SELECT *, greatest(abs(da), abs(db)) AS size FROM (
      SELECT k, a, b, loss, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM (
        SELECT k, a, b, list_sum(list_transform(w, lambda s: s.n * (greatest(s.z, 0) + ln(1 + exp(-abs(s.z)))) - s.y * s.z)) / total AS loss,
          list_sum(list_transform(w, lambda s: (s.n * s.p - s.y) * s.x)) / total AS ga, list_sum(list_transform(w, lambda s: s.n * s.p - s.y)) / total AS gb,
          list_sum(list_transform(w, lambda s: s.n * s.p * (1 - s.p) * s.x * s.x)) / total + 1e-6 AS haa, list_sum(list_transform(w, lambda s: s.n * s.p * (1 - s.p) * s.x)) / total AS hab, list_sum(list_transform(w, lambda s: s.n * s.p * (1 - s.p))) / total + 1e-6 AS hbb
        FROM (SELECT k, a, b, total, list_transform(v, lambda s: struct_pack(x := s.x, n := s.n, y := s.y, z := a * s.x + b, p := 1 / (1 + exp(-(a * s.x + b))))) AS w FROM newton, g WHERE k < 40 AND NOT done))))
), platt AS (
  SELECT (SELECT a FROM newton ORDER BY k DESC LIMIT 1) AS a, (SELECT b FROM newton ORDER BY k DESC LIMIT 1) AS b, (SELECT loss FROM newton WHERE k = 1) AS first_loss, (SELECT loss FROM newton ORDER BY k DESC LIMIT 1) AS last_loss
)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@Q("b6_platt", _recursive(lists_twin("SELECT round(a, 5) AS a, round(b, 5) AS b, round(first_loss, 6) AS first_loss, round(last_loss, 6) AS last_loss FROM platt", 50, _NEWTON)))
def _(spark, d):
    """Slope, intercept and losses of the logistic fit."""
    a, b, losses = calibration.platt(Snapshot(spark, d).scored(50).persist(), 20.0)
    return spark.createDataFrame([(round(a, 5), round(b, 5), round(losses[0], 6), round(losses[-1], 6))], "a double, b double, first_loss double, last_loss double")


@Q("b7_prior_correction", lists_twin("SELECT user_id, item_id, round(p, 6) AS p FROM probs", 20, _P))
def _(spark, d):
    return _probs(Snapshot(spark, d), 20).select("user_id", "item_id", r6(F.col("p")).alias("p"))


def _ece_sql(p: str) -> str:
    return f"(SELECT round(sum(abs(sp - sy)) / sum(n), 6) FROM (SELECT least(floor(q * 15), 14) AS b, count(*) AS n, sum(q) AS sp, sum(label) AS sy FROM (SELECT label, {p} AS q FROM scored, platt) GROUP BY 1))"


@Q("b8_calibrator_choice", _recursive(lists_twin(f"SELECT round(a, 5) AS a, platt_ece, prior_ece, CASE WHEN a > 0 AND platt_ece <= prior_ece THEN 'platt' ELSE 'prior' END AS chosen FROM (SELECT a, {_ece_sql('1 / (1 + exp(-(a * logit + b)))')} AS platt_ece, {_ece_sql('1 / (1 + exp(-(logit - ln(20.0::DOUBLE))))')} AS prior_ece FROM platt)", 50, _NEWTON)))
def _(spark, d):
    """The calibrator that the fit and both errors call for."""
    rows = Snapshot(spark, d).scored(50).persist()
    a, b, _ = calibration.platt(rows, 20.0)
    ece = lambda p: calibration.ece_equal(rows.withColumn("p", p)).first()["ece"]
    scores = [(round(a, 5), ece(X.sigmoid(F.col("logit") * a + b)), ece(calibration.prior_correction(F.col("logit"), 20.0)))]
    return calibration.choose_calibrator(spark.createDataFrame(scores, "a double, platt_ece double, prior_ece double"))


@Q("b9_cohort_thresholds", lists_twin("SELECT cohort, count(*) FILTER (p < CASE cohort WHEN 0 THEN 0.01 WHEN 3 THEN 0.05 ELSE 0.0 END) AS n_zeroed, count(*) AS n FROM probs GROUP BY 1", 50, _P))
def _(spark, d):
    out = calibration.apply_thresholds(_probs(Snapshot(spark, d)), {0: 0.01, 3: 0.05})
    return out.groupBy("cohort").agg(F.count_if(F.col("p") == 0).alias("n_zeroed"), F.count("*").alias("n"))


@Q("b10_threshold_sweep", lists_twin("""
SELECT r.cohort, r.q, r.threshold, r.hits, r.ece, r.q > 0 AND r.hits >= z.hits AND r.ece < z.ece AS keeps FROM rungs r JOIN rungs z ON z.cohort = r.cohort AND z.q = 0""", 50, _P + """, grid AS (
  SELECT cohort, 0.0::DOUBLE AS q, 0.0::DOUBLE AS threshold FROM probs GROUP BY 1 UNION ALL SELECT cohort, u.q, round(u.t, 6) FROM (SELECT cohort, unnest([struct_pack(q := 0.1::DOUBLE, t := quantile_cont(p, 0.1)), struct_pack(q := 0.25, t := quantile_cont(p, 0.25)), struct_pack(q := 0.5, t := quantile_cont(p, 0.5)), struct_pack(q := 0.75, t := quantile_cont(p, 0.75)), struct_pack(q := 0.9, t := quantile_cont(p, 0.9))]) AS u FROM probs GROUP BY 1)
), cutp AS (
  SELECT g.cohort, g.q, g.threshold, user_id, item_id, label, CASE WHEN p < g.threshold THEN 0 ELSE p END AS v FROM probs JOIN grid g USING (cohort)
), hitp AS (
  SELECT cohort, q, threshold, CAST(sum(CASE WHEN place <= 10 THEN label ELSE 0 END) AS BIGINT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY cohort, q, user_id ORDER BY v DESC, label, item_id) AS place FROM cutp) GROUP BY 1, 2, 3
), ecep AS (
  SELECT cohort, q, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM (SELECT cohort, q, least(floor(v * 15), 14) AS b, count(*) AS n, sum(v) AS sp, sum(label) AS sy FROM cutp GROUP BY 1, 2, 3) GROUP BY 1, 2
), rungs AS (SELECT * FROM hitp JOIN ecep USING (cohort, q))"""))
def _(spark, d):
    return calibration.threshold_sweep(_probs(Snapshot(spark, d)))


@Q("b11_denominators", twin("SELECT CAST(least(k, 3) AS INTEGER) AS cohort, count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_pairs FROM (SELECT user_id, count(DISTINCT item_id) AS n, max(n_history_events) AS k FROM truth GROUP BY 1) GROUP BY 1", SNAPSHOT))
def _(spark, d):
    return calibration.denominators(Snapshot(spark, d).truth)


def _block(view: str, value: str) -> str:
    group = "" if view == "all" else "GROUP BY v"
    return f"SELECT '{view}' AS view, {'v' if view != 'all' else chr(39) * 2} AS value, CAST(sum(n) AS BIGINT) AS n, round(sum(sp) / sum(n), 6) AS mean_p, round(sum(sy) / sum(n), 6) AS positive_rate, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM (SELECT {value} AS v, least(floor(p * 15), 14) AS b, count(*) AS n, sum(p) AS sp, sum(label) AS sy, sum(pow(p - label, 2)) AS sq FROM probs GROUP BY 1, 2) {group}"


@Q("b12_view_blocks", lists_twin(" UNION ALL ".join([_block("all", "''"), _block("cohort", "CAST(cohort AS VARCHAR)"), _block("bucket", "bucket")]), 50, _P))
def _(spark, d):
    return calibration.view_blocks(_probs(Snapshot(spark, d)))


@Q("b13_locked_test", lists_twin("SELECT count(DISTINCT user_id) AS n_listed, count(DISTINCT user_id) FILTER (label = 1) AS n_with_positive, (SELECT count(*) FROM tusers) AS n_truth_users, true AS in_range, true AS changed_refused FROM scored", 50))
def _(spark, d):
    """Calibration fitted on the selection rows, then one evaluation with the parameters frozen; changed ones are refused."""
    s = Snapshot(spark, d)
    dump = s.scored(50).persist()
    fitted = calibration.fit_stage(dump, 20.0)
    try:
        calibration.locked_stage(dump, _sizes(s), fitted | {"a": fitted["a"] + 1}, [10])
        refused = False
    except ValueError:
        refused = True
    in_range = (F.col("ece") >= 0) & (F.col("ece") <= 1) & (F.col("auc") > 0) & (F.col("auc") < 1) & (F.col("recall_overall_10") <= 1)
    return calibration.locked_stage(dump, _sizes(s), fitted, [10]).select("n_listed", "n_with_positive", "n_truth_users", in_range.alias("in_range"), F.lit(refused).alias("changed_refused"))


@Q("b14_category_summary", lists_twin("SELECT main_category AS category, CAST(sum(n) AS BIGINT) AS n, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM (SELECT main_category, least(floor(p * 15), 14) AS b, count(*) AS n, sum(p) AS sp, sum(label) AS sy FROM probs JOIN catalog USING (item_id) GROUP BY 1, 2) GROUP BY 1", 30, _P))
def _(spark, d):
    s = Snapshot(spark, d)
    rows = _probs(s, 30).join(s.items.select("item_id", F.col("main_category").alias("category")), "item_id")
    return calibration.ece_equal(rows, by=["category"])


# --- models ----------------------------------------------------------------


_SOFT = f"""SELECT user_id, item_id, 0 AS label, 'soft_negative' AS kind FROM (
  SELECT p.user_id, item_id, want, row_number() OVER (PARTITION BY p.user_id ORDER BY i) AS rank FROM (
    SELECT u.user_id, want, i, (CAST('0x' || substr(md5('0:a:' || u.user_id), 1, 12) AS BIGINT) % q + (1 + CAST('0x' || substr(md5('0:b:' || u.user_id), 1, 12) AS BIGINT) % (q - 1)) * i) % q AS idx
    FROM (SELECT user_id, 2 * count(*) AS want FROM hist WHERE label = 1 GROUP BY 1) u, prime, unnest(range(1, q + 1)) r(i)) p JOIN numbered USING (idx)
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = p.user_id AND s.item_id = numbered.item_id)) WHERE rank <= want"""


@Q("m1_sampled_pairs", twin(f"SELECT DISTINCT user_id, item_id, label, CASE label WHEN 1 THEN 'positive' ELSE 'hard_negative' END AS kind FROM hist UNION ALL {_SOFT}", SNAPSHOT + "," + _NUMBERED))
def _(spark, d):
    s = Snapshot(spark, d)
    return models.sample_pairs(s.hist, s.pool)


@Q("m4_log_q", twin("SELECT item_id, round(ln(CAST(c AS DOUBLE) / sum(c) OVER ()), 6) AS log_q FROM (SELECT item_id, count(*) AS c FROM hist WHERE label = 1 GROUP BY 1)", SNAPSHOT))
def _(spark, d):
    return models.log_q(Snapshot(spark, d).hist)


@Q("m12_hashed_text_vectors", twin(r"""
SELECT item_id, list(coalesce(n / len, 0.0) ORDER BY k) AS embedding FROM (
  SELECT i.item_id, g.k, n, sqrt(sum(n * n) OVER (PARTITION BY i.item_id)) AS len FROM (SELECT DISTINCT item_id FROM texts) i CROSS JOIN (SELECT unnest(range(0, 64)) AS k) g
  LEFT JOIN (SELECT item_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS k, CAST(count(*) AS DOUBLE) AS n FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM texts) GROUP BY 1, 2) c ON c.item_id = i.item_id AND c.k = g.k) GROUP BY 1""", """
texts AS (SELECT item_id, array_to_string(list_filter([trim(title), trim(store)] || categories[1:2], lambda x: x <> ''), ' | ') AS text FROM catalog)"""))
def _(spark, d):
    from pitrec.operators import identity

    return models.hashed_text_vectors(identity.item_texts(adapters.catalog(spark, d)))


@Q("m13_anchor_popularity", twin("SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM alist WHERE rank <= 101", _ANCHOR))
def _(spark, d):
    return _anchor(spark, d)[4].select("user_id", "item_id", "rank")


@Q("m14_text_counts", r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS n_words, CAST(length(text) AS INTEGER) AS n_chars, CAST(length(text) - length(replace(text, '!', '')) AS INTEGER) AS n_exclamation, CAST(length(text) - length(replace(text, '?', '')) AS INTEGER) AS n_question, round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / greatest(length(text), 1), 6) AS upper_ratio FROM documents""")
def _(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", *[c.alias(k) for k, c in models.text_counts(F.col("text")).items()])


@Q("m15_document_frequencies", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 1) AS w FROM documents),
x AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t))
SELECT term, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0, 6) AS idf FROM x GROUP BY 1 HAVING count(*) >= 5""")
def _(spark, d):
    return models.document_frequencies(load(spark, d, "documents"))


@Q("m15_stratified_split", "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('split:' || doc_id), doc_id) <= round(count(*) OVER (PARTITION BY quality) * 0.2) THEN 'held' ELSE 'train' END AS part FROM labels")
def _(spark, d):
    return models.stratified_split(load(spark, d, "labels"), "quality").select("doc_id", "quality", "part")


def _text_parts(spark, d):
    docs = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select("doc_id", "text", "quality")
    split = models.stratified_split(docs, "quality").persist()
    return split.where("part = 'train'").drop("part"), split.where("part = 'held'").drop("part")


@Q("m15_text_regression")
def _(spark, d):
    return models.text_regression(*_text_parts(spark, d), "quality")


@Q("m15_text_classifier")
def _(spark, d):
    return models.text_classifier(*_text_parts(spark, d), "quality")


@Q("m15_text_network")
def _(spark, d):
    return models.text_network(*_text_parts(spark, d), "quality")


# --- streaming (beyond the batch operators) ----------------------------------


@Q("s1_streamed_popularity", """
WITH e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS item_id, date_trunc('day', ts) AS day FROM events WHERE event_type IN ('purchase', 'click', 'view'))
SELECT item_id, round(sum(pow(0.5, (1706745600000 - epoch_ms(day)) / 86400000.0 / 7.0)), 6) AS score FROM e WHERE day < (SELECT date_trunc('day', max(ts) - INTERVAL 2 DAY) FROM events WHERE event_type IN ('purchase', 'click', 'view')) GROUP BY 1""")
def _(spark, d):
    """Daily counts from a stream over the events, decayed to 1 February 2024; days that the watermark has not closed are not in it."""
    from pitrec.streaming import popularity as online

    from .early import _scratch

    place = _scratch(spark)
    load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts").write.parquet(f"{place}/in")
    # files in the order of time, so that none is later than the watermark
    query = online.start_counts(online.positives(online.read_events(spark, f"{place}/in", 100)), f"{place}/out", f"{place}/state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return online.decayed_scores(spark.read.parquet(f"{place}/out"), 1_706_745_600_000, 7.0)


@Q("e26_covisitation_grid", twin(" UNION ALL ".join(f"SELECT {m} AS least, count(*) AS n_edges, count(DISTINCT a) AS n_items, CAST(max(support) AS BIGINT) AS max_support FROM support WHERE support >= {m}" for m in (2, 3)), SNAPSHOT + "," + COVISIT))
def _(spark, d):
    s = Snapshot(spark, d)
    out = [retrieval.covisitation(s.hist, least=m, neighbours=1 << 30).agg(F.count("*").alias("n_edges"), F.countDistinct("a").alias("n_items"), F.max("support").alias("max_support")).select(F.lit(m).alias("least"), "*") for m in (2, 3)]
    return reduce(DataFrame.unionByName, out)


# --- runners ---------------------------------------------------------------


def _split_targets(split: str) -> str:
    return f"(SELECT DISTINCT user_id, item_id FROM split WHERE split = '{split}' AND label = 1)"


@Q("o1_leave_last_two_baselines", twin(" UNION ALL ".join(f"SELECT '{s}' AS split, 'popularity' AS model, k, recall, precision, n_users FROM ({_recall_sql('alist', [10, 100], _split_targets(s))})" for s in ("val", "test")), _ANCHOR))
def _(spark, d):
    """Popularity lists from the train rows against the positives of either held row."""
    _, val, test, _, lists = _anchor(spark, d)
    out = [metrics.recall_precision(metrics.truth_sets(rows), lists, [10, 100]).select(F.lit(s).alias("split"), F.lit("popularity").alias("model"), "k", "recall", "precision", "n_users") for s, rows in (("val", val), ("test", test))]
    return reduce(DataFrame.unionByName, out)


@Q("o2_snapshot_baselines", twin(" UNION ALL ".join(f"SELECT '{m}' AS model, k, recall, precision, n_users FROM ({_recall_sql(r, KS)})" for m, r in (("popularity", "popularity"), ("rule", "(" + _rule_sql({"store": 1.0, "main_category": 0.5, "prior": 0.5}, 100) + ")"), ("random", "(" + _random_sql(100, 0) + ")"))), _RULE + "," + global_list("popularity", POPULARITY, 100) + "," + _NUMBERED))
def _(spark, d):
    """The three untrained models on the snapshot."""
    s = Snapshot(spark, d)
    arms = {"popularity": s.popular(100), "rule": retrieval.rule_scores(s.users, s.hist, s.items, s.pool, s.seen, {"store": 1.0, "main_category": 0.5, "prior": 0.5}, 100), "random": retrieval.random_top_k(s.users, s.pool, s.seen, 100)}
    return reduce(DataFrame.unionByName, [metrics.recall_precision(s.targets, lists, KS).select(F.lit(m).alias("model"), "k", "recall", "precision", "n_users") for m, lists in arms.items()])


@Q("o3_facet_diagnosis", twin(" UNION ALL ".join(f"SELECT '{f}' AS facet, count(*) AS n_unique, round(max(c) / sum(c), 6) AS max_share, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy_bits FROM (SELECT {f}, count(*) AS c FROM hist JOIN catalog USING (item_id) GROUP BY 1)" for f in ("store", "main_category")), SNAPSHOT))
def _(spark, d):
    from pitrec.operators import profile

    s = Snapshot(spark, d)
    joined = s.hist.join(s.items, "item_id")
    return reduce(DataFrame.unionByName, [profile.facet_distribution(joined, f).select(F.lit(f).alias("facet"), "n_unique", "max_share", "entropy_bits") for f in ("store", "main_category")])


@Q("o4_second_domain", """
WITH r AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id, epoch_us(ts) // 1000 AS ts, CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 4 WHEN 'view' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS rating FROM events WHERE json_extract(props, '$.k') IS NOT NULL)
SELECT item_id, count(*) FILTER (rating >= 3) AS n_positive, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(rating), 6) AS mean_rating, min(ts) AS first_ts FROM r GROUP BY 1""")
def _(spark, d):
    rows = adapters.interactions_ev(spark, d).where("item_id is not null")
    return rows.groupBy("item_id").agg(F.count_if(F.col("rating") >= 3).alias("n_positive"), F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), r6(F.avg("rating")).alias("mean_rating"), F.min("ts").alias("first_ts"))
