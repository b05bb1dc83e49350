"""Queries of profiling, identity, filtering, snapshots and features."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitrec.functions import expressions as X
from pitrec.operators import features, filtering, identity, profile, snapshots
from pitrec.operators.rounding import r6, r6_signed
from pitrec.sources import adapters, io
from pitrec.sources.adapters import clean, load, twin

from .base import Register
from .frames import SNAPSHOT, Snapshot, lists_view

Q = Register()


# --- scans, sources, sinks -------------------------------------------------


@Q("io3_projected_scan", "SELECT p_partkey AS item_id, p_name AS title FROM part")
def _(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


@Q("io4_exact_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('sample:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def _(spark, d):
    return io.sample_exact(load(spark, d, "orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey")


@Q("io5_jsonl_scan", "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(spark, d):
    """Events written as JSON lines with broken lines among them, read back without these and for users with a purchase only."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type")
    place = f"{_scratch(spark)}/jsonl"
    lines = e.select(F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(lines.select(F.expr("substring(value, 1, length(value) - 9)").alias("value"))).write.text(place)
    return io.read_jsonl(spark, place, e.schema, e.where("event_type = 'purchase'"), "user_id")


@Q("io6_shard_concat", "SELECT s_suppkey AS item_id, s_name AS name, s_acctbal AS balance, CAST(NULL AS INTEGER) AS size FROM supplier WHERE s_suppkey IN (SELECT n_nationkey FROM nation) UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part WHERE p_partkey IN (SELECT n_nationkey FROM nation)")
def _(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return io.concat_shards([a, b], load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("item_id")))


@Q("io7_rows_for_items", "SELECT i.item_id, p_name AS title FROM (SELECT DISTINCT l_partkey * 2 AS item_id FROM lineitem WHERE l_quantity < 3) i LEFT JOIN part ON p_partkey = i.item_id")
def _(spark, d):
    ids = load(spark, d, "lineitem").where("l_quantity < 3").select((F.col("l_partkey") * 2).alias("item_id"))
    return io.rows_for(load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")), ids)


@Q("io8_pushed_filter", twin("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users FROM clean WHERE label = 1"))
def _(spark, d):
    return clean(spark, d).where("label = 1").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@Q("io9_relabel_rewrite", twin("SELECT user_id, item_id, CAST(rating >= 4 AS INTEGER) AS label FROM clean"))
def _(spark, d):
    """A table rewritten with another label column, in a new folder."""
    place = f"{_scratch(spark)}/relabel"
    io.write_table(clean(spark, d).select("user_id", "item_id", (F.col("rating") >= 4).cast("int").alias("label")), place)
    return spark.read.parquet(place)


@Q("io12_inter_lines", twin("SELECT concat_ws(chr(9), user_id, item_id, rating, ts) AS line FROM clean"))
def _(spark, d):
    return io.inter_lines(clean(spark, d))


@Q("io16_prefix_sequences", twin("""SELECT user_id, target, items FROM (SELECT user_id, item_id AS target, list(item_id) OVER (PARTITION BY user_id ORDER BY ts, item_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS items FROM clean) WHERE len(items) > 0"""))
def _(spark, d):
    return io.prefix_sequences(clean(spark, d))


@Q("io18_dump_round_trip", twin("SELECT user_id, item_id, ts FROM clean"))
def _(spark, d):
    """A dump written as gzipped CSV and read by its suffix."""
    place = f"{_scratch(spark)}/dump.csv"
    clean(spark, d).select("user_id", "item_id", "ts").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(place)
    return io.read_dump(spark, place, "user_id long, item_id long, ts long")


def _scratch(spark) -> str:
    return io.scratch(spark)


# --- profiling -------------------------------------------------------------


@Q("p1_stream_stats", twin("""
SELECT 'rating' AS section, CAST(greatest(least(rating, 5), 1) AS VARCHAR) AS bin, count(*) AS n FROM raw GROUP BY 1, 2
UNION ALL SELECT 'helpful', CASE WHEN helpful <= 0 THEN '0' WHEN helpful <= 5 THEN '1-5' WHEN helpful <= 20 THEN '6-20' WHEN helpful <= 100 THEN '21-100' ELSE '100+' END, count(*) FROM raw GROUP BY 1, 2
UNION ALL SELECT 'total', 'rows', count(*) FROM raw UNION ALL SELECT 'total', 'items', count(DISTINCT item_id) FROM raw UNION ALL SELECT 'total', 'users', count(DISTINCT user_id) FROM raw"""))
def _(spark, d):
    return profile.stream_stats(adapters.interactions(spark, d))


_PCT = "quantile_cont(n, 0.2) AS p20, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99"


@Q("p2_count_percentiles", twin(f"SELECT {_PCT} FROM (SELECT item_id, count(*) AS n FROM raw GROUP BY 1)"))
def _(spark, d):
    return profile.count_percentiles(adapters.interactions(spark, d), "item_id")


@Q("p3_filtering_table", twin("""
SELECT mi AS min_item, mu AS min_user, (SELECT count(*) FROM ic WHERE c >= mi) AS n_items, (SELECT count(*) FROM uc WHERE c >= mu) AS n_users, CAST((SELECT coalesce(sum(c), 0) FROM ic WHERE c >= mi) AS BIGINT) AS est_reviews
FROM (VALUES (5), (20), (30), (40)) a(mi), (VALUES (5), (20), (40), (60)) b(mu)""", "ic AS (SELECT item_id, count(*) AS c FROM clean GROUP BY 1), uc AS (SELECT user_id, count(*) AS c FROM clean GROUP BY 1)"))
def _(spark, d):
    return profile.filtering_table(clean(spark, d), (5, 20, 30, 40), (5, 20, 40, 60))


def _kcore_views(rounds: int, min_item: int, min_user: int, first: str) -> str:
    order = [("item_id", min_item), ("user_id", min_user)]
    order = order if first == "item" else order[::-1]
    views, last = [], "clean"
    for k in range(1, rounds + 1):
        for part, (key, least) in zip("ab", order):
            views.append(f"r{k}{part} AS MATERIALIZED (SELECT * FROM {last} WHERE {key} IN (SELECT {key} FROM {last} GROUP BY 1 HAVING count(*) >= {least}))")
            last = f"r{k}{part}"
    return ", ".join(views)


@Q("p4_filter_by_counts", twin("SELECT user_id, item_id, ts, rating FROM r12b", _kcore_views(12, 24, 20, "item")))
def _(spark, d):
    return filtering.iterative_kcore(clean(spark, d), 20, 24, "item")[0].select("user_id", "item_id", "ts", "rating")


@Q("p5_bought_together", twin("""
SELECT count(*) AS n_users, count(h.user_id) AS n_hit, count(a.user_id) AS n_able, round(count(h.user_id) / count(*), 6) AS rate, round(count(h.user_id) / nullif(count(a.user_id), 0), 6) AS conditional_rate
FROM (SELECT DISTINCT user_id FROM own) u LEFT JOIN (SELECT DISTINCT o.user_id FROM own o JOIN pairs p USING (item_id) JOIN own z ON z.user_id = o.user_id AND z.item_id = p.other) h USING (user_id)
LEFT JOIN (SELECT DISTINCT user_id FROM own WHERE item_id IN (SELECT item_id FROM pairs)) a USING (user_id)""", """
own AS (SELECT DISTINCT user_id, item_id FROM clean), pairs AS (SELECT DISTINCT p_partkey AS item_id, unnest([p_partkey + 1, p_partkey * 3]) AS other FROM part)"""))
def _(spark, d):
    lists = load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.array(F.col("p_partkey") + 1, F.col("p_partkey") * 3).alias("others"))
    return profile.bought_together_rate(clean(spark, d), lists)


@Q("p6_category_overlap", twin("""
SELECT 'users' AS kind, c AS a, '' AS b, count(*) AS n FROM own GROUP BY c
UNION ALL SELECT 'n_categories', CAST(k AS VARCHAR), '', count(*) FROM (SELECT user_id, count(*) AS k FROM own GROUP BY 1) GROUP BY k
UNION ALL SELECT 'union', '', '', count(DISTINCT user_id) FROM own
UNION ALL SELECT 'pair', x.c, y.c, count(*) FROM own x JOIN own y ON x.user_id = y.user_id AND x.c < y.c GROUP BY x.c, y.c""", "own AS (SELECT DISTINCT user_id, main_category AS c FROM clean JOIN catalog USING (item_id))"))
def _(spark, d):
    return profile.category_overlap(clean(spark, d), adapters.catalog(spark, d))


def _nulled(spark, d) -> DataFrame:
    """The catalog with some nulls and empty lists, by id."""
    k = F.col("item_id")
    return adapters.catalog(spark, d).select(
        "item_id", F.when(k % 7 == 0, None).otherwise(F.col("title")).alias("title"), F.when(k % 5 == 0, None).when(k % 11 == 0, "").otherwise(F.col("store")).alias("store"), "main_category",
        F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 13 == 0, None).otherwise(F.col("categories")).alias("categories"), F.when(k % 9 == 0, 0).otherwise(F.col("rating_number")).alias("rating_number"))


_NULLED = """nulled AS (
  SELECT item_id, CASE WHEN item_id % 7 = 0 THEN NULL ELSE title END AS title, CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 11 = 0 THEN '' ELSE store END AS store, main_category,
         CASE WHEN item_id % 6 = 0 THEN [] WHEN item_id % 13 = 0 THEN NULL ELSE categories END AS categories, CASE WHEN item_id % 9 = 0 THEN 0 ELSE rating_number END AS rating_number FROM catalog)"""


def _summary_sql(source: str, scope: str = "") -> str:
    tail = f", '{scope}' AS scope" if scope else ""
    nz = ", round(avg(CAST(rating_number <> 0 AS INTEGER)), 6) AS nonzero_rate" if scope else ""
    none = ", CAST(NULL AS DOUBLE) AS nonzero_rate" if scope else ""
    return f"""SELECT 'title' AS column_name, round(avg(CAST(title IS NULL AS INTEGER)), 6) AS null_rate, CAST(NULL AS BIGINT) AS empty, CAST(NULL AS BIGINT) AS non_empty, CAST(NULL AS DOUBLE) AS mean_length, CAST(NULL AS BIGINT) AS max_length{none}{tail} FROM {source}
UNION ALL SELECT 'categories', round(avg(CAST(categories IS NULL AS INTEGER)), 6), count(*) FILTER (len(categories) = 0), count(*) FILTER (len(categories) > 0), round(avg(len(categories)), 6), max(len(categories)){none}{tail} FROM {source}
UNION ALL SELECT 'rating_number', round(avg(CAST(rating_number IS NULL AS INTEGER)), 6), NULL, NULL, NULL, NULL{nz}{tail} FROM {source}"""


@Q("p7_column_summary", twin(_summary_sql("nulled"), _NULLED))
def _(spark, d):
    return profile.column_summary(_nulled(spark, d), ["title", "categories", "rating_number"])


@Q("p8_schema_report", twin(_summary_sql("nulled", "all") + " UNION ALL " + _summary_sql("(SELECT * FROM nulled WHERE item_id IN (SELECT item_id FROM clean))", "canonical"), _NULLED))
def _(spark, d):
    return profile.schema_report(_nulled(spark, d), ["title", "categories", "rating_number"], clean(spark, d), ["rating_number"])


@Q("p10_entropy", twin("SELECT round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy_bits FROM (SELECT store, count(*) AS c FROM clean JOIN catalog USING (item_id) GROUP BY 1)"))
def _(spark, d):
    return profile.entropy(clean(spark, d).join(adapters.catalog(spark, d), "item_id"), "store")


@Q("p11_facet_distribution", twin("SELECT count(*) AS n_unique, round(max(c) / sum(c), 6) AS max_share, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy_bits, count(*) FILTER (c = 1) AS n_singletons, count(*) FILTER (c < 5) AS n_below_5 FROM (SELECT store, count(*) AS c FROM catalog GROUP BY 1)"))
def _(spark, d):
    return profile.facet_distribution(adapters.catalog(spark, d), "store")


@Q("p11_facet_top", twin("SELECT CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank, value, n FROM (SELECT store AS value, count(*) AS n FROM catalog GROUP BY 1) ORDER BY rank LIMIT 20"))
def _(spark, d):
    return profile.facet_top(adapters.catalog(spark, d), "store")


@Q("p12_facet_match", twin("""
SELECT CAST(sum(n) AS BIGINT) AS n_pairs, count(*) AS n_users, round(sum(h) / sum(n), 6) AS micro, round(avg(h / n), 6) AS macro_mean, round(median(h / n), 6) AS macro_median FROM (
  SELECT p.user_id, count(*) AS n, count(s.user_id) AS h FROM (SELECT user_id, store FROM win JOIN catalog USING (item_id) WHERE label = 1) p
  LEFT JOIN (SELECT DISTINCT user_id, store FROM hist JOIN catalog USING (item_id) WHERE label = 1) s ON s.user_id = p.user_id AND s.store = p.store GROUP BY 1)""", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return profile.facet_match(s.hist, s.window, s.items, "store")


@Q("p13_rating_by_helpful", twin("SELECT rating, round(avg(helpful), 6) AS mean_helpful, round(median(helpful), 6) AS median_helpful, count(*) AS n FROM raw GROUP BY 1"))
def _(spark, d):
    return profile.rating_by_helpful(adapters.interactions(spark, d))


@Q("p14_positive_rate_histogram", twin("SELECT CAST(least(10 * s // n, 9) AS BIGINT) AS bin, count(*) AS n_users FROM (SELECT user_id, sum(label) AS s, count(*) AS n FROM clean GROUP BY 1) GROUP BY 1"))
def _(spark, d):
    return profile.positive_rate_histogram(clean(spark, d))


_SPLIT = """split AS (
  SELECT user_id, item_id, ts, rating, label, CASE WHEN back = 1 THEN 'test' WHEN back = 2 THEN 'val' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS held FROM clean) WHERE held >= 3)"""


@Q("p15_split_consistency", twin("SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, round(avg(label), 6) AS label_rate, round(avg(rating), 6) AS mean_rating FROM split GROUP BY 1", _SPLIT))
def _(spark, d):
    s = filtering.leave_last_two(clean(spark, d))
    return profile.split_consistency({k: s.where(F.col("split") == k) for k in ("train", "val", "test")})


@Q("p16_dedup_summary", twin("SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_pairs, CAST(sum(c) - count(*) AS BIGINT) AS n_dropped, count(*) FILTER (c > 1) AS n_repeated_pairs FROM (SELECT user_id, item_id, count(*) AS c FROM raw GROUP BY 1, 2)"))
def _(spark, d):
    return profile.dedup_summary(adapters.interactions(spark, d))


@Q("p16_missing_values", twin("SELECT 'title' AS column_name, count(*) FILTER (title IS NULL) AS n_missing FROM nulled UNION ALL SELECT 'store', count(*) FILTER (store IS NULL) FROM nulled UNION ALL SELECT 'categories', count(*) FILTER (categories IS NULL) FROM nulled", _NULLED))
def _(spark, d):
    return profile.missing_values(_nulled(spark, d), ["title", "store", "categories"])


# --- cleaning and identity -------------------------------------------------

_TITLED = r"""titled AS (
  SELECT item_id, rating_number, CASE WHEN item_id % 17 = 0 THEN NULL WHEN item_id % 3 = 0 THEN '  ' || upper(title) || chr(160) || ' x ' ELSE title || ' X' END AS title, CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 11 = 0 THEN '  ' ELSE store END AS store FROM catalog
), keyed AS (
  SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '[\s\p{Z}]+', ' ', 'g')) AS nt, CASE WHEN trim(coalesce(store, '')) = '' THEN '' ELSE store END AS sk FROM titled
), cmap AS (
  SELECT item_id AS raw_item_id, CASE WHEN nt <> '' AND sk <> '' THEN first_value(item_id) OVER (PARTITION BY nt, sk ORDER BY rating_number DESC NULLS LAST, item_id) ELSE item_id END AS canonical_item_id FROM keyed
)"""


def _titled(spark, d) -> DataFrame:
    """The catalog with untidy titles and missing stores."""
    k = F.col("item_id")
    title = F.when(k % 17 == 0, None).when(k % 3 == 0, F.concat(F.lit("  "), F.upper("title"), F.lit("  x "))).otherwise(F.concat("title", F.lit(" X")))
    store = F.when(k % 5 == 0, None).when(k % 11 == 0, "  ").otherwise(F.col("store"))
    return adapters.catalog(spark, d).select("item_id", "rating_number", title.alias("title"), store.alias("store"))


@Q("n1_normalize_title", twin("SELECT item_id, nt FROM keyed", _TITLED))
def _(spark, d):
    return _titled(spark, d).select("item_id", X.normalize_title(F.col("title")).alias("nt"))


@Q("n2_store_merge_key", twin("SELECT item_id, sk FROM keyed", _TITLED))
def _(spark, d):
    return _titled(spark, d).select("item_id", X.store_merge_key(F.col("store")).alias("sk"))


@Q("n3_metadata_dedup", twin("SELECT item_id, rating_number, title FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rating_number DESC NULLS LAST, title) AS rn FROM (SELECT item_id % 300 AS item_id, rating_number, title FROM catalog)) WHERE rn = 1"))
def _(spark, d):
    return identity.dedup_metadata(adapters.catalog(spark, d).select((F.col("item_id") % 300).alias("item_id"), "rating_number", "title"))


@Q("n4_canonical_map", twin("SELECT * FROM cmap", _TITLED))
def _(spark, d):
    return identity.canonical_map(_titled(spark, d))


_CANON = _TITLED + """, priced AS (SELECT p_partkey AS item_id FROM part WHERE round(p_retailprice, 2) < 1000
), holed AS (
  SELECT user_id, item_id, ts, CASE WHEN item_id % 50 = 1 THEN NULL ELSE rating END AS rating, helpful, l_extendedprice FROM raw
), known AS (SELECT * FROM cmap WHERE raw_item_id IN (SELECT item_id FROM priced)
), moved AS (
  SELECT user_id, canonical_item_id AS item_id, ts, rating, helpful, l_extendedprice FROM holed JOIN known ON raw_item_id = item_id WHERE rating IS NOT NULL
), canon AS (
  SELECT user_id, item_id, ts, rating, helpful, CAST(rating >= 3 AS INTEGER) AS label, CASE WHEN rating >= 3 THEN 'positive' ELSE 'hard_negative' END AS label_type
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, rating, helpful, l_extendedprice) AS rn FROM moved) WHERE rn = 1
)"""


def _canon(spark, d):
    rows = adapters.interactions(spark, d).select("user_id", "item_id", "ts", F.when(F.col("item_id") % 50 == 1, None).otherwise(F.col("rating")).alias("rating"), "helpful", "l_extendedprice")
    priced = adapters.catalog(spark, d).where(X.price(F.col("price")) < 1000).select(F.col("item_id").alias("raw_item_id"))
    mapping = identity.canonical_map(_titled(spark, d)).join(priced, "raw_item_id", "left_semi")  # dearer items are orphans
    return rows, mapping, identity.canonicalize(rows, mapping)


@Q("n5_canonicalize", twin("SELECT user_id, item_id, ts, rating, helpful, label, label_type FROM canon", _CANON))
def _(spark, d):
    return _canon(spark, d)[2].drop("l_extendedprice")


@Q("n6_canonicalize_stats", twin("""
SELECT *, n_raw - n_complete AS n_null_dropped, n_complete - n_known AS n_orphans, n_known - n_out AS n_duplicates, round(n_positive / n_out, 6) AS positive_rate, round(n_remapped / n_known, 6) AS remap_rate FROM (
  SELECT (SELECT count(*) FROM holed) AS n_raw, (SELECT count(*) FROM holed WHERE rating IS NOT NULL) AS n_complete, (SELECT count(*) FROM moved) AS n_known,
         (SELECT count(*) FROM holed JOIN known ON raw_item_id = item_id WHERE rating IS NOT NULL AND canonical_item_id <> item_id) AS n_remapped,
         (SELECT count(*) FROM canon) AS n_out, (SELECT CAST(sum(label) AS BIGINT) FROM canon) AS n_positive, (SELECT count(DISTINCT user_id) FROM canon) AS n_users, (SELECT count(DISTINCT item_id) FROM canon) AS n_items,
         (SELECT count(*) FROM known) AS n_raw_items, (SELECT count(DISTINCT canonical_item_id) FROM known) AS n_canonical_items)""", _CANON))
def _(spark, d):
    return identity.canonicalize_stats(*_canon(spark, d))


@Q("n7_binarize", twin("SELECT user_id, item_id, rating, label, CASE WHEN label = 1 THEN 'positive' ELSE 'hard_negative' END AS label_type FROM clean"))
def _(spark, d):
    return identity.binarize(clean(spark, d).drop("label")).select("user_id", "item_id", "rating", "label", "label_type")


@Q("n8_earliest_per_pair", twin("SELECT user_id, item_id, min(ts) AS ts FROM raw GROUP BY 1, 2"))
def _(spark, d):
    return identity.earliest_per_pair(adapters.interactions(spark, d).select("user_id", "item_id", "ts", "rating", "helpful")).select("user_id", "item_id", "ts")


@Q("n9_restrict_to_canonical", twin("SELECT item_id, title FROM catalog WHERE item_id IN (SELECT item_id FROM clean)"))
def _(spark, d):
    return identity.restrict_to_canonical(adapters.catalog(spark, d), clean(spark, d).select("item_id").distinct()).select("item_id", "title")


@Q("n10_map_by_any_key", twin("SELECT item_id AS raw_item_id, CASE WHEN title <> '' THEN first_value(item_id) OVER (PARTITION BY title ORDER BY rating_number DESC NULLS LAST, item_id) ELSE item_id END AS canonical_item_id FROM catalog"))
def _(spark, d):
    return identity.canonical_map(adapters.catalog(spark, d), [F.coalesce("title", F.lit(""))])


def _audit_sql(mapping: str) -> str:
    return f"""SELECT count(*) FILTER (size > 1) AS n_groups, CAST(sum(folded) AS BIGINT) AS n_folded, CAST(sum(size) AS BIGINT) AS n_catalog, round(100 * sum(folded) / sum(size), 6) AS folded_percent, CAST(sum(moved) AS BIGINT) AS n_reviews_moved, round(100 * sum(moved) / sum(c), 6) AS reviews_percent
FROM (SELECT canonical_item_id, count(*) AS size, count(*) FILTER (raw_item_id <> canonical_item_id) AS folded, sum(coalesce(c, 0)) AS c, coalesce(sum(c) FILTER (raw_item_id <> canonical_item_id), 0) AS moved
      FROM {mapping} LEFT JOIN (SELECT item_id, count(*) AS c FROM raw GROUP BY 1) ON item_id = raw_item_id GROUP BY 1)"""


@Q("n11_audit_summary", twin(_audit_sql("cmap"), _TITLED))
def _(spark, d):
    return identity.audit_summary(identity.canonical_map(_titled(spark, d)), adapters.interactions(spark, d))


def _map_sql(*legs: str) -> str:
    key = ", ".join(legs)
    return f"(SELECT item_id AS raw_item_id, CASE WHEN {' AND '.join(f"{x} <> ''" for x in legs)} THEN first_value(item_id) OVER (PARTITION BY {key} ORDER BY rating_number DESC NULLS LAST, item_id) ELSE item_id END AS canonical_item_id FROM keyed)"


@Q("n12_merge_options", twin(" UNION ALL ".join(f"SELECT *, '{o}' AS option FROM ({_audit_sql(m)})" for o, m in (("exact_title", _map_sql("coalesce(title, '')")), ("norm_title", _map_sql("nt")), ("norm_title_store", _map_sql("nt", "sk")), ("none", "(SELECT item_id AS raw_item_id, item_id AS canonical_item_id FROM keyed)"))), _TITLED))
def _(spark, d):
    out = identity.merge_options(_titled(spark, d), adapters.interactions(spark, d))
    return out


@Q("n13_genuineness", twin("SELECT kind, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_items FROM (SELECT n, CASE WHEN stores > 1 THEN 'cross_store' WHEN blank > 0 THEN 'store_incomplete' ELSE 'single_store' END AS kind FROM (SELECT title, count(*) AS n, count(DISTINCT nullif(sk, '')) AS stores, count(*) FILTER (sk = '') AS blank FROM keyed WHERE title <> '' GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1", _TITLED))
def _(spark, d):
    return identity.genuineness(_titled(spark, d))


@Q("n13_store_conflicts", twin(f"SELECT canonical_item_id, count(DISTINCT nullif(sk, '')) AS n_stores FROM {_map_sql('nt')} m JOIN keyed ON item_id = raw_item_id GROUP BY 1 HAVING count(DISTINCT nullif(sk, '')) > 1", _TITLED))
def _(spark, d):
    """What a map by titles alone would unite; that by title and store has none."""
    t = _titled(spark, d)
    if identity.store_conflicts(t, identity.canonical_map(t)).limit(1).count():
        raise AssertionError("a canonical id unites two stores")
    return identity.store_conflicts(t, identity.canonical_map(t, [X.normalize_title(F.col("title"))]))


@Q("n14_group_samples", twin("""
SELECT title, n, 'largest' AS pick FROM top UNION ALL (SELECT title, n, 'drawn' FROM g WHERE title NOT IN (SELECT title FROM top) ORDER BY md5('sample' || title), title LIMIT 10)""", "g AS (SELECT title, count(*) AS n FROM catalog GROUP BY 1 HAVING count(*) > 1), top AS (SELECT * FROM g ORDER BY n DESC, title LIMIT 10)"))
def _(spark, d):
    return identity.group_samples(adapters.catalog(spark, d))


@Q("n15_clean_value", twin("SELECT item_id, CASE WHEN lower(trim(coalesce(v, ''))) IN ('nan', 'none', 'unknown', '') THEN '' ELSE trim(v) END AS cleaned FROM (SELECT item_id, CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN 'None' WHEN 3 THEN '  ' ELSE ' ' || store END AS v FROM catalog)"))
def _(spark, d):
    k = F.col("item_id") % 6
    v = F.when(k == 0, None).when(k == 1, " NaN ").when(k == 2, "None").when(k == 3, "  ").otherwise(F.concat(F.lit(" "), "store"))
    return adapters.catalog(spark, d).select("item_id", X.clean_value(v).alias("cleaned"))


@Q("n16_known_or_unknown", twin("SELECT item_id, CASE WHEN v IS NULL OR v IN ('', 'nan', 'None') THEN 'Unknown' ELSE v END AS value FROM (SELECT item_id, CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE store END AS v FROM catalog)"))
def _(spark, d):
    k = F.col("item_id") % 5
    return adapters.catalog(spark, d).select("item_id", X.known_or(F.when(k == 0, None).when(k == 1, "nan").when(k == 2, "").otherwise(F.col("store"))).alias("value"))


_TEXT = """SELECT item_id, CASE WHEN t = '' THEN 'unknown item' ELSE t END AS text FROM (
  SELECT item_id, array_to_string(list_filter([coalesce(trim(title), ''), coalesce(trim(%s), '')] || coalesce(categories, CAST([] AS VARCHAR[]))[1:2], lambda x: x <> ''), ' | ') AS t FROM nulled)"""


@Q("n17_item_text", twin(_TEXT % "store", _NULLED))
def _(spark, d):
    return identity.item_texts(_nulled(spark, d))


@Q("n18_author_fallback", twin(_TEXT % "CASE WHEN (SELECT avg(CAST(coalesce(store, '') = '' AS INTEGER)) FROM nulled) > 0.2 AND coalesce(store, '') = '' THEN 'by ' || main_category ELSE store END", _NULLED))
def _(spark, d):
    return identity.item_texts(_nulled(spark, d), 0.2, F.concat(F.lit("by "), F.col("main_category")))


@Q("n19_align_embeddings", twin("""
SELECT k.item_id, coalesce(e.embedding, list_transform(range(0, 64), lambda x: 0.0::DOUBLE)) AS embedding, CASE WHEN e.item_id IS NULL THEN 'not_present' WHEN own THEN 'aligned' ELSE 'rebuilt' END AS status
FROM (SELECT DISTINCT item_id FROM clean) k LEFT JOIN (
  SELECT item_id, list(x ORDER BY pos) AS embedding FROM (SELECT c AS item_id, pos, round(avg(x), 6) AS x FROM (SELECT raw - raw % 3 AS c, unnest(range(0, 64)) AS pos, unnest(embedding) AS x FROM (SELECT vec_id AS raw, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)) GROUP BY 1, 2) GROUP BY 1) e USING (item_id)
LEFT JOIN (SELECT vec_id - vec_id % 3 AS item_id, count(*) = 1 AND bool_and(vec_id % 3 = 0) AS own FROM embeddings GROUP BY 1) o USING (item_id)"""))
def _(spark, d):
    vectors = adapters.item_embeddings(spark, d)
    mapping = vectors.select(F.col("item_id").alias("raw_item_id"), (F.col("item_id") - F.col("item_id") % 3).alias("canonical_item_id"))
    out = identity.align_embeddings(vectors, mapping, clean(spark, d).select("item_id"), 64)
    return out.withColumn("embedding", F.transform("embedding", r6_signed))


# --- k-core and splits -----------------------------------------------------




@Q("k1_kcore", twin("SELECT user_id, item_id, ts, rating FROM r12b", _kcore_views(12, 24, 20, "user")))
def _(spark, d):
    return filtering.iterative_kcore(clean(spark, d), 20, 24, "user")[0].select("user_id", "item_id", "ts", "rating")


@Q("k1_kcore_report", twin("""SELECT * FROM (""" + " UNION ALL ".join(f"SELECT {k} AS round, (SELECT count(DISTINCT user_id) FROM r{k}b) AS n_users, (SELECT count(DISTINCT item_id) FROM r{k}b) AS n_items, (SELECT count(*) FROM r{k}b) AS n_rows, (SELECT count(*) FROM {'clean' if k == 1 else f'r{k - 1}b'}) - (SELECT count(*) FROM r{k}b) AS n_removed" for k in range(1, 13)) + """) x WHERE round <= (SELECT min(CASE WHEN n = 0 THEN k ELSE 99 END) FROM (""" + " UNION ALL ".join(f"SELECT {k} AS k, (SELECT count(*) FROM {'clean' if k == 1 else f'r{k - 1}b'}) - (SELECT count(*) FROM r{k}b) AS n" for k in range(1, 13)) + "))", _kcore_views(12, 24, 20, "user")))
def _(spark, d):
    return filtering.report_frame(spark, filtering.iterative_kcore(clean(spark, d), 20, 24, "user")[1])


@Q("k2_frame_counts", twin("SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_rows FROM clean"))
def _(spark, d):
    return filtering.frame_counts(clean(spark, d))


@Q("k3_leave_last_two", twin("SELECT user_id, item_id, ts, split FROM split", _SPLIT))
def _(spark, d):
    return filtering.leave_last_two(clean(spark, d)).select("user_id", "item_id", "ts", "split")


@Q("k3_dropped_users", twin("SELECT count(*) FILTER (c < 3) AS n_users_dropped, CAST(coalesce(sum(c) FILTER (c < 3), 0) AS BIGINT) AS n_rows_dropped FROM (SELECT user_id, count(*) AS c FROM clean GROUP BY 1)"))
def _(spark, d):
    return filtering.dropped_users(clean(spark, d))


@Q("k4_split_manifest", twin("""
SELECT s.*, n_positive_items, n_known_items, round(n_known_items / n_positive_items, 6) AS coverage FROM (SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, round(avg(label), 6) AS label_rate, min(ts) AS min_ts, max(ts) AS max_ts FROM split GROUP BY 1) s
LEFT JOIN (SELECT split, count(*) AS n_positive_items, count(*) FILTER (item_id IN (SELECT item_id FROM split WHERE split = 'train')) AS n_known_items FROM (SELECT DISTINCT split, item_id FROM split WHERE label = 1) GROUP BY 1) c USING (split)""", _SPLIT))
def _(spark, d):
    return filtering.split_manifest(filtering.leave_last_two(clean(spark, d)))


@Q("k5_tie_rates", twin("""
SELECT count(*) AS n_users, CAST(sum(a) AS BIGINT) AS n_any_tie, CAST(sum(e) AS BIGINT) AS n_edge_tie, round(avg(a), 6) AS any_tie_rate, round(avg(e), 6) AS edge_tie_rate FROM (
  SELECT user_id, max(CAST(coalesce(tied, false) AS INTEGER)) AS a, max(CASE WHEN back <= 2 AND coalesce(tied, false) THEN 1 ELSE 0 END) AS e FROM (
    SELECT user_id, row_number() OVER w AS back, ts = lead(ts) OVER w AS tied FROM clean WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, item_id DESC)) GROUP BY 1)"""))
def _(spark, d):
    return filtering.tie_rates(clean(spark, d))


@Q("k6_split_gate", twin("SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b, count(*) AS n_rows FROM split", _SPLIT))
def _(spark, d):
    """The split against one that is derived by counting the later rows of the user."""
    from pyspark.sql import Window

    rows = clean(spark, d)
    own = Window.partitionBy("user_id")
    later = F.count("*").over(own.orderBy("ts", "item_id").rowsBetween(1, Window.unboundedFollowing))
    other = rows.withColumns({"later": later, "held": F.count("*").over(own)}).where("held >= 3").withColumn("split", F.when(F.col("later") == 0, "test").when(F.col("later") == 1, "val").otherwise("train"))
    return filtering.split_gate(filtering.leave_last_two(rows), other)


@Q("k7_user_holdout", twin("SELECT user_id, CASE WHEN row_number() OVER (ORDER BY md5('holdout:' || CAST(user_id AS VARCHAR))) <= greatest(floor(count(*) OVER () * 0.2), 1) THEN 'held' ELSE 'train' END AS part FROM (SELECT DISTINCT user_id FROM clean)"))
def _(spark, d):
    return filtering.user_holdout(clean(spark, d))


# --- snapshots -------------------------------------------------------------


@Q("t1_epoch_millis", "SELECT o_orderkey, epoch_ms(o_orderdate) AS ts, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, d):
    ts = adapters.millis(F.col("o_orderdate"))
    return load(spark, d, "orders").select("o_orderkey", ts.alias("ts"), F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd").alias("day"))


@Q("t2_cutoffs", twin("SELECT c1, c2, c3 FROM cut", SNAPSHOT))
def _(spark, d):
    return spark.createDataFrame([tuple(snapshots.resolve_cutoffs(clean(spark, d)))], "c1 long, c2 long, c3 long")


@Q("t3_four_cutoffs", twin("SELECT CAST(trunc(quantile_cont(ts, 0.7)) AS BIGINT) AS t0, CAST(trunc(quantile_cont(ts, 0.8)) AS BIGINT) AS t1, CAST(trunc(quantile_cont(ts, 0.9)) AS BIGINT) AS t2, max(ts) + 1 AS t3 FROM clean"))
def _(spark, d):
    return spark.createDataFrame([tuple(snapshots.resolve_four_cutoffs(clean(spark, d)))], "t0 long, t1 long, t2 long, t3 long")


@Q("t4_first_positives", twin("SELECT user_id, item_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn FROM win WHERE label = 1) WHERE rn = 1", SNAPSHOT))
def _(spark, d):
    return snapshots.first_positives(Snapshot(spark, d).window).select("user_id", "item_id", "ts")


@Q("t5_all_positives", twin("SELECT user_id, item_id, ts FROM win WHERE label = 1", SNAPSHOT))
def _(spark, d):
    return snapshots.all_positives(Snapshot(spark, d).window).select("user_id", "item_id", "ts")


_TRUTH = "user_id, item_id, ts, n_history_events, item_in_history, item_in_eligible_pool, is_warm_user"


@Q("t6_snapshot_truth", twin(f"SELECT {_TRUTH} FROM truth", SNAPSHOT))
def _(spark, d):
    return Snapshot(spark, d).truth.select(*_TRUTH.split(", "))


_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn FROM truth) WHERE rn = 1)"


@Q("t6_first_truth", twin(f"SELECT {_TRUTH} FROM first", SNAPSHOT + "," + _FIRST))
def _(spark, d):
    s = Snapshot(spark, d)
    return snapshots.ground_truth(s.rows, s.bounds, "first").select(*_TRUTH.split(", "))


@Q("t7_snapshot_stats", twin("""
SELECT 'val' AS snapshot, (SELECT count(*) FROM hist) AS n_history, (SELECT count(DISTINCT user_id) FROM hist) AS n_history_users, (SELECT count(DISTINCT item_id) FROM hist) AS n_history_items,
  count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(warm) AS BIGINT) AS n_warm_users, round(avg(s / n), 6) AS history_rate, round(sum(s) / sum(n), 6) AS history_rate_per_positive, round(avg(p / n), 6) AS eligible_rate, round(sum(p) / sum(n), 6) AS eligible_rate_per_positive
FROM (SELECT user_id, count(*) AS n, sum(item_in_history) AS s, sum(item_in_eligible_pool) AS p, max(is_warm_user) AS warm FROM truth GROUP BY 1)""", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return snapshots.snapshot_stats(s.rows, s.bounds, snapshots.ground_truth(s.rows, s.bounds))


@Q("t8_relabel_all_positive", twin("SELECT count(*) AS n_first, (SELECT count(*) FROM truth) AS n_all FROM first", SNAPSHOT + "," + _FIRST))
def _(spark, d):
    s = Snapshot(spark, d)
    first, every = (snapshots.ground_truth(s.rows, s.bounds, m).agg(F.count("*").alias(n)) for m, n in (("first", "n_first"), ("all", "n_all")))
    return first.crossJoin(every)


_BOUNDS = """bounds AS (
  SELECT 'T0' AS snapshot, CAST(trunc(quantile_cont(ts, 0.7)) AS BIGINT) AS cutoff, CAST(trunc(quantile_cont(ts, 0.8)) AS BIGINT) AS stop FROM clean
  UNION ALL SELECT 'T1', CAST(trunc(quantile_cont(ts, 0.8)) AS BIGINT), CAST(trunc(quantile_cont(ts, 0.9)) AS BIGINT) FROM clean
  UNION ALL SELECT 'T2', CAST(trunc(quantile_cont(ts, 0.9)) AS BIGINT), max(ts) + 1 FROM clean)"""


def _bounds(spark, rows) -> DataFrame:
    t = snapshots.resolve_four_cutoffs(rows)
    return snapshots.bounds_frame(spark, [(f"T{k}", t[k], t[k + 1]) for k in range(3)])


@Q("t9_two_snapshots", twin("SELECT snapshot, count(*) AS n_pairs, count(DISTINCT user_id) AS n_users FROM clean JOIN bounds ON ts >= cutoff AND ts < stop WHERE label = 1 AND snapshot <> 'T0' GROUP BY 1", _BOUNDS))
def _(spark, d):
    rows = clean(spark, d)
    c = snapshots.resolve_cutoffs(rows)
    bounds = snapshots.bounds_frame(spark, [("T1", c[0], c[1]), ("T2", c[1], c[2])])
    return snapshots.ground_truth(rows, bounds).groupBy("snapshot").agg(F.count("*").alias("n_pairs"), F.countDistinct("user_id").alias("n_users"))


@Q("t10_walk_forward", twin("""
SELECT b.snapshot, l.user_id, l.item_id, coalesce(u.n, 0) AS n_history_events, CAST(coalesce(i.n, 0) >= 5 AS INTEGER) AS item_in_eligible_pool FROM bounds b JOIN clean l ON l.ts >= cutoff AND l.ts < stop AND l.label = 1
LEFT JOIN (SELECT snapshot, user_id, count(*) AS n FROM clean JOIN bounds ON ts < cutoff GROUP BY 1, 2) u ON u.snapshot = b.snapshot AND u.user_id = l.user_id
LEFT JOIN (SELECT snapshot, item_id, count(*) AS n FROM clean JOIN bounds ON ts < cutoff GROUP BY 1, 2) i ON i.snapshot = b.snapshot AND i.item_id = l.item_id""", _BOUNDS))
def _(spark, d):
    rows = clean(spark, d)
    return snapshots.ground_truth(rows, _bounds(spark, rows)).select("snapshot", "user_id", "item_id", "n_history_events", "item_in_eligible_pool")


_FIRST_LABELS = "(SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn FROM win WHERE label = 1) WHERE rn = 1)"


@Q("t11_label_checks", twin(f"""SELECT (SELECT count(*) FROM {_FIRST_LABELS} f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.user_id = f.user_id AND t.item_id = f.item_id)) AS first_not_in_all,
  (SELECT count(*) FROM (SELECT user_id, item_id FROM truth GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_pairs,
  (SELECT count(*) FROM (SELECT DISTINCT user_id FROM truth) a FULL JOIN (SELECT DISTINCT user_id FROM {_FIRST_LABELS}) b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL) AS users_differ""", SNAPSHOT))
def _(spark, d):
    rows = clean(spark, d)
    b = _bounds(spark, rows)
    return snapshots.label_checks(snapshots.ground_truth(rows, b, "first"), snapshots.ground_truth(rows, b, "all"))


@Q("t12_leakage_guard", twin("SELECT count(*) AS n FROM hist", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return snapshots.assert_before(s.hist, s.cuts[0]).where("ts >= 0").agg(F.count("*").alias("n"))


# --- features --------------------------------------------------------------

_UF = """count(*) AS n_interactions, round(avg(rating), 6) AS mean_rating, round(coalesce(stddev_samp(rating), 0), 6) AS std_rating, count(DISTINCT item_id) AS n_items, round(CAST(max(ts) - min(ts) AS DOUBLE) / 86400000.0, 6) AS span_days,
CAST(sum(CAST(verified AS INTEGER)) AS BIGINT) AS verified_sum, round(avg(CAST(verified AS INTEGER)), 6) AS verified_rate, round(avg(helpful), 6) AS helpful_mean, CAST(sum(helpful) AS BIGINT) AS helpful_sum"""


@Q("f1_user_features", twin(f"SELECT user_id, {_UF} FROM clean GROUP BY 1"))
def _(spark, d):
    return features.user_features(clean(spark, d))


@Q("f2_user_features_at", twin(f"SELECT user_id, {_UF}, round(CAST(any_value(c1) - max(ts) AS DOUBLE) / 86400000.0, 6) AS days_since_last, count(*) FILTER (ts >= c1 - 2592000000) AS recent_interactions, count(*) FILTER (ts >= c1 - 2592000000 AND label = 1) AS recent_positives FROM hist, cut GROUP BY 1", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return features.user_features_at(s.hist, s.cuts[0])


def _priced(spark, d) -> DataFrame:
    k = F.col("item_id")
    return adapters.catalog(spark, d).withColumn("price", F.when(k % 7 == 0, None).when(k % 7 == 1, F.concat(F.lit("from "), F.substring("price", 2, 20))).when(k % 7 == 2, "junk").otherwise(F.col("price")))


_PRICED = """priced AS (
  SELECT item_id, store, main_category, rating_number, categories, TRY_CAST(regexp_replace(CASE WHEN item_id % 7 = 0 THEN NULL WHEN item_id % 7 = 1 THEN 'from ' || substr(price, 2) WHEN item_id % 7 = 2 THEN 'junk' ELSE price END, '[^0-9.]', '', 'g') AS DOUBLE) AS price FROM catalog)"""


@Q("f3_item_features", twin("""
SELECT p.item_id, store, main_category, rating_number, CAST(p.price IS NULL AS INTEGER) AS price_missing, round(coalesce(p.price, (SELECT median(price) FROM priced)), 6) AS price, CAST(len(categories) AS INTEGER) AS n_categories,
  coalesce(n, 0) AS n_reviews, coalesce(a, 0.0) AS avg_rating, CAST(coalesce(pos, 0) AS BIGINT) AS n_positive, coalesce(v, 0.0) AS verified_rate, CAST(n IS NOT NULL AS INTEGER) AS in_train_catalog, CAST(coalesce(pos, 0) > 0 AS INTEGER) AS in_train_positive_catalog,
  CAST(p.item_id IN (SELECT item_id FROM clean) AS INTEGER) AS in_filtered_universe
FROM priced p LEFT JOIN (SELECT item_id, count(*) AS n, round(avg(rating), 6) AS a, sum(label) AS pos, round(avg(CAST(verified AS INTEGER)), 6) AS v FROM hist GROUP BY 1) h USING (item_id)""", SNAPSHOT + "," + _PRICED))
def _(spark, d):
    s = Snapshot(spark, d)
    return features.item_features(_priced(spark, d), s.hist, s.rows)


@Q("f4_item_features_at", twin("""
SELECT p.item_id, store, main_category, rating_number, CAST(len(categories) AS INTEGER) AS n_categories, coalesce(n, 0) AS n_reviews_hist, coalesce(a, 0.0) AS avg_rating_hist, CAST(coalesce(pos, 0) AS BIGINT) AS n_positive_hist, coalesce(u, 0) AS n_users_hist, CAST(n IS NOT NULL AS INTEGER) AS in_history, CAST(coalesce(n, 0) >= 5 AS INTEGER) AS in_eligible_pool
FROM catalog p LEFT JOIN (SELECT item_id, count(*) AS n, round(avg(rating), 6) AS a, sum(label) AS pos, count(DISTINCT user_id) AS u FROM hist GROUP BY 1) h USING (item_id)""", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return features.item_features_at(s.items, s.hist)


@Q("f5_price", twin("SELECT item_id, price FROM priced", _PRICED))
def _(spark, d):
    return _priced(spark, d).select("item_id", X.price(F.col("price")).alias("price"))


@Q("f6_list_length", twin("SELECT item_id, CAST(coalesce(len(categories), 0) AS INTEGER) AS n FROM nulled", _NULLED))
def _(spark, d):
    return _nulled(spark, d).select("item_id", X.list_length(F.col("categories")).alias("n"))


@Q("f7_category_path", twin("SELECT item_id, path FROM (SELECT item_id, array_to_string(c, ' | ') AS path, row_number() OVER (PARTITION BY item_id ORDER BY len(c) DESC, c) AS rn FROM (SELECT item_id % 500 AS item_id, CASE WHEN item_id % 3 = 0 THEN [main_category] ELSE categories END AS c FROM catalog)) WHERE rn = 1"))
def _(spark, d):
    lists = adapters.catalog(spark, d).select((F.col("item_id") % 500).alias("item_id"), F.when(F.col("item_id") % 3 == 0, F.array("main_category")).otherwise(F.col("categories")).alias("categories"))
    return features.category_path(lists)


@Q("f8_top_facet", twin("SELECT user_id, store AS top FROM (SELECT user_id, store, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, store) AS rn FROM hist JOIN catalog USING (item_id) WHERE label = 1 GROUP BY 1, 2) WHERE rn = 1", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return features.top_facet(s.hist, s.items, "store")


@Q("f9_top_category", twin("SELECT user_id, c AS top FROM (SELECT user_id, main_category AS c, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, main_category) AS rn FROM hist JOIN catalog USING (item_id) WHERE label = 1 GROUP BY 1, 2) WHERE rn = 1", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return features.top_facet(s.hist, s.items, "main_category")


@Q("f10_vocabulary", twin("SELECT title AS value, CAST(row_number() OVER (ORDER BY title) AS INTEGER) AS idx FROM (SELECT DISTINCT title FROM catalog)"))
def _(spark, d):
    return features.vocabulary(adapters.catalog(spark, d), "title")


@Q("f11_scaled", twin("""
SELECT user_id, round((x - m) / CASE WHEN s <= 1e-9 THEN 1 ELSE s END, 6) AS n_interactions FROM (SELECT user_id, ln(1 + greatest(count(*), 0)) AS x FROM clean GROUP BY 1), (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT ln(1 + count(*)) AS x FROM clean GROUP BY user_id))"""))
def _(spark, d):
    return features.scale(clean(spark, d).groupBy("user_id").agg(F.count("*").alias("n_interactions")), ["n_interactions"])


@Q("f12_assembled", twin("SELECT user_id, item_id, 11 AS width, round(num_sources + best_rank + source_popularity + source_recent + source_covisit + popularity_rank + recent_rank + covisit_rank + coalesce(popularity_score, 0) + coalesce(recent_score, 0) + coalesce(covisit_score, 0), 6) AS total FROM cands", lists_view(20)))
def _(spark, d):
    s = Snapshot(spark, d)
    out, columns = features.assemble(s.candidates(20), ["num_sources", "best_rank"])
    from pyspark.ml.functions import vector_to_array

    return out.select("user_id", "item_id", F.lit(len(columns)).alias("width"), r6(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@Q("f13_sequences", twin("""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY back DESC) - 1 AS INTEGER) AS pos, item, category, store, m AS month, gap, rating FROM (
  SELECT user_id, back, CAST(coalesce(idx + 1, 1) AS INTEGER) AS item, main_category AS category, store, CAST(month(epoch_ms(ts)) AS INTEGER) AS m, CAST(CASE WHEN g < 1 THEN 1 WHEN g < 7 THEN 2 WHEN g < 30 THEN 3 WHEN g < 90 THEN 4 WHEN g < 365 THEN 5 ELSE 6 END AS INTEGER) AS gap, rating FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS back, CAST(lead(ts, 1, c1) OVER (PARTITION BY user_id ORDER BY ts, item_id) - ts AS DOUBLE) / 86400000.0 AS g FROM hist, cut) h
  LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) AS idx FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS v FROM pool)) k ON k.v = CAST(h.item_id AS VARCHAR) JOIN catalog c ON c.item_id = h.item_id WHERE back <= 20)""", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    out = features.sequences(s.hist, s.items, features.vocabulary(s.pool, "item_id"), s.cuts[0])
    return out.select("user_id", F.posexplode("events").alias("pos", "e")).select("user_id", "pos", "e.*")


@Q("f14_taste_history", twin("""
SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, round(exp(-CAST(c1 - ts AS DOUBLE) / 86400000.0 / 365.0), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS pos FROM hist WHERE label = 1 AND item_id IN (SELECT item_id FROM pool)), cut WHERE pos <= 50""", SNAPSHOT))
def _(spark, d):
    s = Snapshot(spark, d)
    return features.taste_history(s.hist, s.pool, s.cuts[0], 50, 365.0)


@Q("f15_pos_weight", twin("SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, round((count(*) - sum(label)) / greatest(sum(label), 1), 6) AS pos_weight FROM clean"))
def _(spark, d):
    return features.pos_weight(clean(spark, d))
