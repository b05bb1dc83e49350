"""Frames that many queries share, and the same frames as SQL views."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrec.operators import filtering, lists, retrieval, snapshots
from pitrec.sources import adapters, kept

SOURCES = ["popularity", "recent", "covisit"]


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean interactions, written once a session for all queries that read them."""
    return kept.stored(spark, "clean", {}, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders")], lambda: adapters.clean(spark, sf_dir))


@dataclass
class Snapshot:
    """The clean interactions cut at 80 % and 90 % of their times.

    The rows and the union of the sources are tables of the session, built by the first query that asks for them.
    """

    spark: SparkSession
    sf_dir: str
    _unions: dict = field(default_factory=dict)

    @cached_property
    def rows(self) -> DataFrame:
        return interactions(self.spark, self.sf_dir)

    @cached_property
    def cuts(self) -> list[int]:
        return snapshots.resolve_cutoffs(self.rows)

    @cached_property
    def bounds(self) -> DataFrame:
        return snapshots.bounds_frame(self.spark, [("val", self.cuts[0], self.cuts[1])])

    @cached_property
    def hist(self) -> DataFrame:
        return self.rows.where(F.col("ts") < self.cuts[0])

    @cached_property
    def window(self) -> DataFrame:
        return self.rows.where((F.col("ts") >= self.cuts[0]) & (F.col("ts") < self.cuts[1]))

    @cached_property
    def truth(self) -> DataFrame:
        return snapshots.ground_truth(self.rows, self.bounds, "all").drop("snapshot")

    @cached_property
    def targets(self) -> DataFrame:
        return self.truth.select("user_id", "item_id").distinct()

    @cached_property
    def users(self) -> DataFrame:
        return self.window.where("label = 1").select("user_id").distinct()

    @cached_property
    def pool(self) -> DataFrame:
        return retrieval.eligible(self.hist, 5)

    @cached_property
    def seen(self) -> DataFrame:
        return retrieval.seen(self.hist, self.users)

    @cached_property
    def items(self) -> DataFrame:
        return adapters.catalog(self.spark, self.sf_dir)

    @cached_property
    def vectors(self) -> DataFrame:
        return adapters.item_embeddings(self.spark, self.sf_dir)

    def popular(self, k: int) -> DataFrame:
        return retrieval.top_unseen(self.users, retrieval.popularity(self.hist), self.pool, self.seen, k)

    def recent(self, k: int, half_life: float = 180.0) -> DataFrame:
        return retrieval.top_unseen(self.users, retrieval.decayed_popularity(self.hist, self.cuts[0], half_life), self.pool, self.seen, k)

    def covisited(self, k: int) -> DataFrame:
        return retrieval.covisitation_top_k(self.users, self.hist, retrieval.covisitation(self.hist), self.pool, self.seen, k)

    def sources(self, k: int) -> dict[str, DataFrame]:
        return {"popularity": self.popular(k), "recent": self.recent(k), "covisit": self.covisited(k)}

    def user_lists(self, k: int) -> DataFrame:
        """One row a user with the candidates of all sources and their labels; features and metrics of many queries read it."""
        if k not in self._unions:
            inputs = [f"{self.sf_dir}/{t}.parquet" for t in ("lineitem", "orders")]
            self._unions[k] = kept.stored(self.spark, "lists", {"k": k}, inputs, lambda: self._made(k))
        return self._unions[k]

    def _made(self, k: int) -> DataFrame:
        sized = filtering.cut(self.hist.groupBy("item_id").agg(F.count("*").alias("n")).where("n >= 5"))
        orders = {"popularity": retrieval.popularity(self.hist), "recent": retrieval.decayed_popularity(self.hist, self.cuts[0], 180.0)}
        met = retrieval.covisitation_top_k(self.users, self.hist, retrieval.covisitation(self.hist), sized, self.seen, k, carry=["n"])
        return lists.user_lists(self.users, orders, {"covisit": met}, sized, self.seen, self.truth, k)

    def union(self, k: int) -> DataFrame:
        """One row a candidate of any source."""
        return self.candidates(k).drop("label", "n_history_events")

    def candidates(self, k: int) -> DataFrame:
        """The union with its labels and the users' history lengths."""
        return lists.candidates(self.user_lists(k), SOURCES).drop("item_n_reviews")

    def lists(self, k: int) -> DataFrame:
        """The sources' lists in one long frame with `source`."""
        return reduce(DataFrame.unionByName, [df.select("user_id", "item_id", "score", "rank", F.lit(s).alias("source")) for s, df in self.sources(k).items()])

    def scored(self, k: int) -> DataFrame:
        """(user_id, item_id, label, score, logit, ...): the candidates' rows with a score of their sources, for metrics and calibration."""
        logit = F.round(F.coalesce("popularity_score", F.lit(0.0)) / 10 + 4 * F.coalesce("covisit_score", F.lit(0.0)) + F.col("num_sources") - 3, 6)
        return lists.candidates(self.user_lists(k), SOURCES).select("user_id", "item_id", "label", logit.alias("logit"), logit.alias("score"), "n_history_events", "item_n_reviews")

    def scored_lists(self, k: int) -> DataFrame:
        """(user_id, list of score and label): `scored`, one row a user."""
        present = lambda x: reduce(lambda a, b: a + b, [(x[f"{s}_rank"] > 0).cast("int") for s in SOURCES])
        score = lambda x: F.round(F.coalesce(x["popularity_score"], F.lit(0.0)) / 10 + 4 * F.coalesce(x["covisit_score"], F.lit(0.0)) + present(x) - 3, 6)
        return self.user_lists(k).select("user_id", F.transform("list", lambda x: F.struct(score(x).alias("score"), x["label"].alias("label"))).alias("list"))


# The views of a Snapshot.
CUT = """
cut AS (
  SELECT CAST(trunc(quantile_cont(ts, 0.8)) AS BIGINT) AS c1, CAST(trunc(quantile_cont(ts, 0.9)) AS BIGINT) AS c2, max(ts) + 1 AS c3 FROM clean
)"""
AFTER_CUT = """,
hist AS (
  SELECT clean.* FROM clean, cut WHERE ts < c1
), win AS (
  SELECT clean.* FROM clean, cut WHERE ts >= c1 AND ts < c2
), users_h AS (
  SELECT user_id, count(*) AS n_history_events FROM hist GROUP BY 1
), items_h AS (
  SELECT item_id, count(*) AS n_item FROM hist GROUP BY 1
), truth AS (
  SELECT w.user_id, w.item_id, w.ts, w.rating, w.label, coalesce(u.n_history_events, 0) AS n_history_events,
         CAST(coalesce(i.n_item, 0) > 0 AS INTEGER) AS item_in_history, CAST(coalesce(i.n_item, 0) >= 5 AS INTEGER) AS item_in_eligible_pool,
         CAST(coalesce(u.n_history_events, 0) >= 3 AS INTEGER) AS is_warm_user
  FROM win w LEFT JOIN users_h u USING (user_id) LEFT JOIN items_h i USING (item_id) WHERE w.label = 1
), targets AS (
  SELECT DISTINCT user_id, item_id FROM truth
), tusers AS (
  SELECT DISTINCT user_id FROM truth
), pool AS (
  SELECT item_id FROM items_h WHERE n_item >= 5
), seen AS (
  SELECT DISTINCT user_id, item_id FROM hist
)
"""
SNAPSHOT = CUT + AFTER_CUT


def global_list(name: str, scores: str, k: int) -> str:
    """A view (user_id, item_id, score, rank): the first k unseen pool items by the scores (item_id, score)."""
    return f"""
{name}_pool AS (
  SELECT item_id, coalesce(s.score, 0.0) AS score FROM pool LEFT JOIN ({scores}) s USING (item_id)
), {name} AS (
  SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT u.user_id, p.item_id, p.score, row_number() OVER (PARTITION BY u.user_id ORDER BY p.score DESC, p.item_id) AS rank
    FROM tusers u CROSS JOIN {name}_pool p WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)) WHERE rank <= {k}
)"""


POPULARITY = "SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM hist WHERE label = 1 GROUP BY 1"
RECENT = "SELECT item_id, round(sum(pow(0.5, CAST(c1 - ts AS DOUBLE) / 86400000.0 / 180.0)), 6) AS score FROM hist, cut WHERE label = 1 GROUP BY 1"

COVISIT = """
baskets AS (
  SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS rn FROM hist WHERE label = 1) WHERE rn <= 30
), freq AS (
  SELECT item_id, count(*) AS f FROM baskets GROUP BY 1
), support AS (
  SELECT x.item_id AS a, y.item_id AS b, count(*) AS support FROM baskets x JOIN baskets y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY 1, 2 HAVING count(*) >= 2
), edges AS (
  SELECT * FROM (SELECT a, b, support, score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS place FROM (
    SELECT a, b, support, round(support / sqrt(CAST(fa.f AS DOUBLE) * fb.f), 6) AS score FROM support JOIN freq fa ON fa.item_id = a JOIN freq fb ON fb.item_id = b)) WHERE place <= 100
)"""


def covisit_list(k: int) -> str:
    return f"""
seeds AS (
  SELECT * FROM (SELECT user_id, item_id AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) - 1 AS r FROM hist WHERE label = 1 AND user_id IN (SELECT user_id FROM tusers)) WHERE r < 5
), covisit AS (
  SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
      SELECT s.user_id, e.b AS item_id, round(sum(pow(0.8, r) * e.score), 6) AS score FROM seeds s JOIN edges e USING (a) WHERE e.place <= 50 GROUP BY 1, 2) c
    WHERE item_id IN (SELECT item_id FROM pool) AND NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = c.user_id AND z.item_id = c.item_id)) WHERE rank <= {k}
)"""


def lists_view(k: int) -> str:
    return ",".join([SNAPSHOT.strip(), global_list("popularity", POPULARITY, k), global_list("recent", RECENT, k), COVISIT, covisit_list(k)]) + """,
lists AS (
  SELECT *, 'popularity' AS source FROM popularity UNION ALL SELECT *, 'recent' FROM recent UNION ALL SELECT *, 'covisit' FROM covisit
), cands AS (
  SELECT l.user_id, l.item_id, max(CASE WHEN source = 'popularity' THEN score END) AS popularity_score, max(CASE WHEN source = 'recent' THEN score END) AS recent_score,
         max(CASE WHEN source = 'covisit' THEN score END) AS covisit_score,
         CAST(count(CASE WHEN source = 'popularity' THEN 1 END) AS INTEGER) AS source_popularity, CAST(count(CASE WHEN source = 'recent' THEN 1 END) AS INTEGER) AS source_recent, CAST(count(CASE WHEN source = 'covisit' THEN 1 END) AS INTEGER) AS source_covisit,
         coalesce(max(CASE WHEN source = 'popularity' THEN rank END), 0) AS popularity_rank, coalesce(max(CASE WHEN source = 'recent' THEN rank END), 0) AS recent_rank,
         coalesce(max(CASE WHEN source = 'covisit' THEN rank END), 0) AS covisit_rank, CAST(count(*) AS INTEGER) AS num_sources, min(rank) AS best_rank
  FROM lists l GROUP BY 1, 2
), labelled AS (
  SELECT c.*, CAST(t.user_id IS NOT NULL AS INTEGER) AS label, coalesce(n.n_history_events, 0) AS n_history_events
  FROM cands c LEFT JOIN targets t ON t.user_id = c.user_id AND t.item_id = c.item_id
  LEFT JOIN (SELECT user_id, max(n_history_events) AS n_history_events FROM truth GROUP BY 1) n ON n.user_id = c.user_id
), scored AS (
  SELECT user_id, l.item_id, label, round(coalesce(popularity_score, 0.0) / 10 + 4 * coalesce(covisit_score, 0.0) + num_sources - 3, 6) AS logit, n_history_events, coalesce(n_item, 0) AS item_n_reviews
  FROM labelled l LEFT JOIN items_h i ON i.item_id = l.item_id
)"""
