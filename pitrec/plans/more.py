"""Queries of sinks, guards, orchestrators and learned models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitrec.operators import calibration, candidates, features, filtering, metrics, models, orchestrate, profile, rankers, retrieval, snapshots, towers
from pitrec.operators.rounding import r6
from pitrec.sources import adapters, io, versions
from pitrec.sources.adapters import clean, load, twin

from .base import Register
from .early import _nulled
from .frames import AFTER_CUT, POPULARITY, SNAPSHOT, Snapshot, global_list, interactions
from .late import _RULE, _recall_sql, _rule_sql, lists_twin

Q = Register()


# --- sources and sinks -----------------------------------------------------


@Q("io1_jsonl_to_parquet", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    """JSON lines converted once; a second call, whose source is gone, leaves the table as it is."""
    place = io.scratch(spark)
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    e.write.json(f"{place}/lines")
    io.jsonl_to_parquet(spark, f"{place}/lines", f"{place}/table", e.schema)
    return io.jsonl_to_parquet(spark, f"{place}/gone", f"{place}/table", e.schema)


@Q("io2_metadata_layouts", "SELECT 'shards' AS layout, p_partkey, p_name FROM part UNION ALL SELECT 'lines', p_partkey, p_name FROM part")
def _(spark, d):
    """Shards where they are, one of those asked for missing; JSON lines where there is none."""
    place = io.scratch(spark)
    part = load(spark, d, "part").select("p_partkey", "p_name")
    part.write.parquet(f"{place}/shard-0")
    part.write.json(f"{place}/lines")
    shards = io.read_metadata(spark, [f"{place}/shard-0", f"{place}/shard-1"], f"{place}/lines")
    lines = io.read_metadata(spark, [f"{place}/shard-1"], f"{place}/lines", part.schema)
    return shards.withColumn("layout", F.lit("shards")).unionByName(lines.withColumn("layout", F.lit("lines")))


@Q("io10_sink_keeps_the_schema", "SELECT 'empty' AS name, 0::BIGINT AS n_rows, 's_suppkey,s_name' AS columns UNION ALL SELECT 'full', count(*), 's_suppkey,s_name' FROM supplier")
def _(spark, d):
    place = io.scratch(spark)
    s = load(spark, d, "supplier").select("s_suppkey", "s_name")
    out = []
    for name, rows in (("empty", s.limit(0)), ("full", s)):
        io.write_table(rows, f"{place}/{name}")
        back = spark.read.parquet(f"{place}/{name}")
        out.append(back.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(",".join(back.columns)).alias("columns")))
    return out[0].unionByName(out[1])


@Q("io11_atomic_replace", "SELECT o_orderkey, 2 * o_totalprice AS o_totalprice FROM orders")
def _(spark, d):
    """A table replaced by one that is made from it."""
    path = f"{io.scratch(spark)}/orders"
    versions.write(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), path)
    versions.write(versions.read(spark, path).withColumn("o_totalprice", 2 * F.col("o_totalprice")), path)
    return versions.read(spark, path)


@Q("io13_typed_csv", "SELECT o_orderkey, o_custkey, o_orderpriority, false AS refused FROM orders UNION ALL SELECT NULL, NULL, NULL, true")
def _(spark, d):
    """A CSV read with its types, and a reader whose columns are not the header's."""
    path = f"{io.scratch(spark)}/csv"
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    o.write.option("header", True).csv(path)
    back = io.read_typed_csv(spark, path, o.schema).withColumn("refused", F.lit(False))
    wrong = io.read_typed_csv(spark, path, "o_orderkey long, someone long, o_orderpriority string")
    refused = _raises(lambda: wrong.foreach(lambda r: None))
    return back.unionByName(spark.createDataFrame([(None, None, None, refused)], back.schema))


@Q("io14_npz_round_trip", "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")
def _(spark, d):
    """Vectors packed into NPZ archives, kept as a table, and unpacked."""
    path = f"{io.scratch(spark)}/npz"
    io.npz_blobs(adapters.item_embeddings(spark, d), rows=200).write.parquet(path)
    return io.npz_rows(spark.read.parquet(path))


@Q("io15_report_merge", "SELECT 'orders' AS name, 'rows' AS measure, count(*) AS value FROM orders UNION ALL SELECT 'events', 'users', count(DISTINCT user_id) FROM events")
def _(spark, d):
    """A second report replaces only the names it has."""
    path = f"{io.scratch(spark)}/report"
    one = lambda table, measure, c: load(spark, d, table).agg(F.lit(table).alias("name"), F.lit(measure).alias("measure"), c.alias("value"))
    io.write_report(one("orders", "rows", F.count("*")).unionByName(one("events", "rows", F.count("*"))), path, "name")
    io.write_report(one("events", "users", F.countDistinct("user_id")), path, "name")
    return spark.read.schema("measure string, value long, name string").parquet(path)


@Q("io17_prediction_dump", lists_twin("SELECT user_id, item_id, label, logit, n_history_events, item_n_reviews FROM scored", 20))
def _(spark, d):
    """The dump with as many rows as candidates, read back; with another number it is refused."""
    path = io.scratch(spark)
    rows = Snapshot(spark, d).scored(20).persist()
    n = rows.count()
    io.write_dump(rows, f"{path}/dump", n)
    if not _raises(lambda: io.write_dump(rows, f"{path}/short", n + 1)):
        raise AssertionError("a dump of another length was written")
    return io.read_dump(spark, f"{path}/dump")


@Q("k8_output_cleanup", "SELECT * FROM (VALUES ('removed', 'splits'), ('removed', 'universe'), ('kept', 'notes')) t(what, name)")
def _(spark, d):
    """Outputs of known names go, whatever else is there stays."""
    place = io.scratch(spark)
    for name in ("splits", "notes", "universe"):
        load(spark, d, "region").write.parquet(f"{place}/{name}")
    gone = io.remove_outputs(spark, place, {"splits", "universe", "never_written"})
    return spark.createDataFrame([("removed", n) for n in gone] + [("kept", n) for n in io.outputs(spark, place)], "what string, name string")


# --- guards ----------------------------------------------------------------


def _raises(f) -> bool:
    try:
        f()
    except Exception:  # noqa: BLE001 - any refusal counts
        return True
    return False


def _refusals(spark, cases: dict) -> DataFrame:
    return spark.createDataFrame([(name, _raises(f)) for name, f in cases.items()], "guard string, refused boolean")


def _refusal_sql(**cases: bool) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS guard, {str(v).lower()} AS refused" for k, v in cases.items())


@Q("p9_preflight", _refusal_sql(some_filled=False, all_empty=True))
def _(spark, d):
    rows = _nulled(spark, d)
    dead = rows.withColumn("categories", F.when(F.col("categories").isNotNull(), F.array().cast("array<string>")))
    return _refusals(spark, {"some_filled": lambda: profile.preflight(rows, ["categories"]), "all_empty": lambda: profile.preflight(dead, ["categories"])})


@Q("c10_frozen_guard", _refusal_sql(same_cutoffs=False, other_cutoffs=True, other_weights=True, never_frozen=True))
def _(spark, d):
    cuts, weights, place = snapshots.resolve_four_cutoffs(clean(spark, d)), {"store": 1.0, "prior": 0.5}, io.scratch(spark)
    orchestrate.freeze(spark, f"{place}/weights", cuts, weights)
    stored = candidates.weight_fingerprint(cuts, weights)
    return _refusals(spark, {
        "same_cutoffs": lambda: orchestrate.frozen(spark, f"{place}/weights", cuts),
        "other_cutoffs": lambda: orchestrate.frozen(spark, f"{place}/weights", [cuts[0] + 1, *cuts[1:]]),
        "other_weights": lambda: candidates.check_fingerprint(stored, cuts, weights | {"prior": 0.6}),
        "never_frozen": lambda: orchestrate.frozen(spark, f"{place}/none", cuts),
    })


@Q("e18_input_guards", _refusal_sql(good=False, score_not_finite=True, other_label=True, more_listed_than_targets=True))
def _(spark, d):
    s = Snapshot(spark, d)
    rows = s.scored(20).select("user_id", "score", "label").persist()
    sizes = s.targets.groupBy("user_id").agg(F.count("*").alias("n_targets"))
    return _refusals(spark, {
        "good": lambda: metrics.check_inputs(rows, sizes),
        "score_not_finite": lambda: metrics.check_inputs(rows.withColumn("score", F.when(F.col("score") == rows.agg(F.max("score")).first()[0], float("nan")).otherwise(F.col("score"))), sizes),
        "other_label": lambda: metrics.check_inputs(rows.withColumn("label", F.col("label") * 2), sizes),
        "more_listed_than_targets": lambda: metrics.check_inputs(rows.withColumn("label", F.lit(1)), sizes),
    })


@Q("e31_provenance", "SELECT 'report' AS name, sha256('{\"orders\":' || count(*) || '}' || chr(10)) AS sha256, count(*) AS n_rows, true AS refused_empty, true AS refused_missing FROM orders")
def _(spark, d):
    """Digests of the files a decision rests on; arms without rows and missing files are refused."""
    place = io.scratch(spark)
    n = load(spark, d, "orders").count()
    spark.createDataFrame([(f'{{"orders":{n}}}',)], "value string").coalesce(1).write.text(f"{place}/report")
    found = metrics.freeze_provenance(spark, {"report": f"{place}/report"}, {"report": n})
    empty = _raises(lambda: metrics.freeze_provenance(spark, {"report": f"{place}/report"}, {"report": 0}))
    missing = _raises(lambda: metrics.freeze_provenance(spark, {"report": f"{place}/none"}, {"report": n}))
    return found.where(F.col("n_rows").isNotNull()).select("name", "sha256", "n_rows", F.lit(empty).alias("refused_empty"), F.lit(missing).alias("refused_missing"))


# --- orchestrator ----------------------------------------------------------

_FROZEN_GRID = [{"store": 1.0, "main_category": 0.0, "prior": 0.5}, {"store": 0.0, "main_category": 0.5, "prior": 1.0}, {"store": 1.0, "main_category": 0.5, "prior": 0.0}]
_AT = {"train": (0.7, 0.8), "select": (0.8, 0.9), "test": (0.9, None)}


def _at_sql(name: str, body: str, views: str = global_list("popularity", POPULARITY, 30)) -> str:
    """A subquery with the views of one snapshot."""
    lo, hi = _AT[name]
    end = f"CAST(trunc(quantile_cont(ts, {hi})) AS BIGINT)" if hi else "max(ts) + 1"
    cut = f"cut AS (SELECT CAST(trunc(quantile_cont(ts, {lo})) AS BIGINT) AS c1, {end} AS c2, max(ts) + 1 AS c3 FROM clean)"
    return f"(WITH {cut}{AFTER_CUT}{_RULE[len(SNAPSHOT):]}, {views} {body})"


_TUNED = _at_sql("train", "SELECT grid FROM (" + " UNION ALL ".join(f"SELECT {n} AS grid, recall FROM ({_recall_sql(f'({_rule_sql(w, 30)})', [30])})" for n, w in enumerate(_FROZEN_GRID)) + ") ORDER BY recall DESC, grid LIMIT 1")


def _built_sql(name: str) -> str:
    rules = " UNION ALL ".join(f"SELECT * FROM ({_rule_sql(w, 30)}) WHERE (SELECT grid FROM tuned) = {n}" for n, w in enumerate(_FROZEN_GRID))
    return _at_sql(name, f"""SELECT '{name}' AS snapshot, l.user_id, l.item_id, max(CASE WHEN src = 'p' THEN rank ELSE 0 END) AS popularity_rank, max(CASE WHEN src = 'r' THEN rank ELSE 0 END) AS rule_rank, max(CASE WHEN src = 'r' THEN score END) AS rule_score,
      CAST(max(CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS label
    FROM (SELECT *, 'p' AS src FROM popularity UNION ALL SELECT *, 'r' FROM ({rules})) l LEFT JOIN targets t ON t.user_id = l.user_id AND t.item_id = l.item_id GROUP BY 2, 3""")


@Q("c9_frozen_snapshots", twin(" UNION ALL ".join(f"SELECT * FROM {_built_sql(n)}" for n in _AT), f"tuned AS {_TUNED}"))
def _(spark, d):
    """Three snapshots' candidates with rule weights tuned on the first alone."""
    rows = interactions(spark, d)
    built = orchestrate.build_all(rows, adapters.catalog(spark, d), io.scratch(spark), _FROZEN_GRID, 30)
    return reduce(DataFrame.unionByName, built.values()).select("snapshot", "user_id", "item_id", "popularity_rank", "rule_rank", "rule_score", "label")


# --- learned retrieval -----------------------------------------------------


def _fitted(spark, d):
    """Towers of the first 80 %, with the epoch chosen on users of the window before it."""
    rows = interactions(spark, d)
    items, t = adapters.catalog(spark, d), snapshots.resolve_four_cutoffs(rows)
    first = orchestrate.Built(rows, t[0], t[1])
    sample = towers.gather(first.hist, items, first.pool, t[0])
    judge = towers.recall_judge(towers.user_inputs(first.hist, first.users, t[0]), first.targets, first.seen, sample)
    _, epochs, _ = towers.train(sample, judge=judge)
    now = orchestrate.Built(rows, t[1], t[2])
    model, _, losses = towers.train(towers.gather(now.hist, items, now.pool, t[1]), epochs=epochs)
    return now, items, t, model, epochs, losses


def _list_contract(lists: DataFrame, now, k: int) -> DataFrame:
    """One row: what must hold of any source's lists."""
    lists = lists.persist()
    sizes = lists.groupBy("user_id").agg(F.count("*").alias("n"), F.max("rank").alias("deepest"), F.countDistinct("item_id").alias("items"))
    known, n_pool = now.seen.join(now.pool, "item_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("s")), now.pool.count()
    want = F.least(F.lit(k), F.lit(n_pool) - F.coalesce("s", F.lit(0)))
    short = now.users.join(sizes, "user_id", "left").join(known, "user_id", "left").where((F.coalesce("n", F.lit(0)) != want) | (F.col("n") != F.col("deepest")) | (F.col("n") != F.col("items")))
    order = lists.alias("a").join(lists.alias("b"), (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.rank") == F.col("a.rank") + 1)).where("b.score > a.score")
    parts = {
        "n_users": lists.agg(F.countDistinct("user_id").alias("n_users")), "n_wrong_length": short.agg(F.count("*").alias("n_wrong_length")), "n_out_of_order": order.agg(F.count("*").alias("n_out_of_order")),
        "n_seen": lists.join(now.seen, ["user_id", "item_id"], "left_semi").agg(F.count("*").alias("n_seen")), "n_outside": lists.join(now.pool, "item_id", "left_anti").agg(F.count("*").alias("n_outside")),
    }
    return reduce(lambda a, b: a.crossJoin(b), parts.values())  # one row each


_CONTRACT = "SELECT count(*) AS n_users, 0::BIGINT AS n_wrong_length, 0::BIGINT AS n_out_of_order, 0::BIGINT AS n_seen, 0::BIGINT AS n_outside{} FROM tusers"


@Q("m2_two_tower_contract", twin(_CONTRACT.format(", true AS losses_fall"), SNAPSHOT))
def _(spark, d):
    """Lists of the towers keep the contract of a source, and the losses fall. (The provided purchases are random: there is no taste to find.)"""
    now, items, t, model, _, losses = _fitted(spark, d)
    lists = towers.tower_lists(model, now.hist, items, now.users, now.pool, now.seen, t[1], 50)
    return _list_contract(lists, now, 50).withColumn("losses_fall", F.lit(losses[-1] <= losses[0]))


@Q("m2_two_tower_lists")
def _(spark, d):
    """(user_id, item_id, score, rank) of the learned source."""
    now, items, t, model, _, _ = _fitted(spark, d)
    return towers.tower_lists(model, now.hist, items, now.users, now.pool, now.seen, t[1], 50)


@Q("m3_logistic_epochs", "SELECT * FROM (VALUES (1), (2), (3)) t(epoch), (SELECT true AS falls)")
def _(spark, d):
    """Towers trained on sampled pairs with the logistic loss: each epoch's mean loss is below the first's."""
    s = Snapshot(spark, d)
    pairs = models.sample_pairs(s.hist, s.pool)
    sample = towers.gather(s.hist, s.items, s.pool, s.cuts[0], pairs=pairs.select("user_id", "item_id", "label"))
    losses = towers.train(sample, epochs=3, objective="logistic")[2]
    return spark.createDataFrame([(k, bool(x <= losses[0])) for k, x in enumerate(losses, 1)], "epoch int, falls boolean")


@Q("m5_decay_groups", "SELECT * FROM (VALUES ('b', false), ('embedding', false), ('scale', false), ('w', true)) t(name_group, decays)")
def _(spark, d):
    """Which weights of the towers decay, measured by one step without a gradient."""
    from pitrec.operators import autograd as A

    model = towers.Towers()
    before = {k: p.data.copy() for k, p in model.p.items()}
    steps = A.AdamW(model.p, 0.1, 0.5)
    for p in model.p.values():
        p.grad = p.data * 0
    steps.step()
    kind = lambda k: "w" if k.startswith("w_") else "b" if k.startswith("b_") else "scale" if k == "scale" else "embedding"
    found: dict[str, set] = {}
    for k, p in model.p.items():
        found.setdefault(kind(k), set()).add(bool((p.data != before[k]).any()))
    return spark.createDataFrame([(g, True in x) for g, x in sorted(found.items())], "name_group string, decays boolean")


@Q("m6_frozen_refits", twin(" UNION ALL ".join(f"SELECT '{n}' AS snapshot, true AS same_config, true AS in_range, (SELECT * FROM {_at_sql(n, 'SELECT count(*) FROM tusers')}) AS n_users" for n in _AT)))
def _(spark, d):
    """Epochs chosen on the first snapshot and frozen with the configuration; the others are refitted with both, and each has its recall."""
    rows = interactions(spark, d)
    items, t = adapters.catalog(spark, d), snapshots.resolve_four_cutoffs(rows)
    epochs, prints, out = None, [], []
    for k, name in enumerate(_AT):
        now = orchestrate.Built(rows, t[k], t[k + 1])
        sample = towers.gather(now.hist, items, now.pool, t[k])
        if epochs is None:  # its towers are those of the epoch kept, which a refit would only repeat
            model, epochs, _ = towers.train(sample, judge=towers.recall_judge(towers.user_inputs(now.hist, now.users, t[k]), now.targets, now.seen, sample))
        else:
            model, _, _ = towers.train(sample, epochs=epochs)
        prints.append(towers.fingerprint(model.config, epochs))
        found = metrics.recall_precision(now.targets, towers.tower_lists(model, now.hist, items, now.users, now.pool, now.seen, t[k], 50), [50]).first()
        out.append((name, len(set(prints)) == 1, 0.0 < found["recall"] <= 1.0, found["n_users"]))
    return spark.createDataFrame(out, "snapshot string, same_config boolean, in_range boolean, n_users long")


@Q("r18_tower_scores", twin(_CONTRACT.format(", true AS cold_users_listed"), SNAPSHOT))
def _(spark, d):
    """Scoring from saved vectors: dot products, seen masked, best k; users without history are listed as well."""
    now, items, t, model, _, _ = _fitted(spark, d)
    u = towers.encode(towers.user_inputs(now.hist, now.users, t[1]), model, "user").withColumnRenamed("embedding", "profile")
    lists = retrieval.dense_top_k(u, towers.encode(towers.item_inputs(items, now.hist), model, "item"), now.pool, now.seen, 20)
    cold = spark.createDataFrame([(-1,), (-2,)], "user_id long")
    asked = towers.encode(towers.user_inputs(now.hist, cold, t[1]), model, "user").withColumnRenamed("embedding", "profile")
    listed = retrieval.dense_top_k(asked, towers.encode(towers.item_inputs(items, now.hist), model, "item"), now.pool, now.seen, 20).select("user_id").distinct().count()
    return _list_contract(lists, now, 20).withColumn("cold_users_listed", F.lit(listed == 2))


@Q("r19_encoded_vectors", twin("SELECT 'user' AS kind, user_id AS id, 16 AS width, 1.0::DOUBLE AS norm FROM tusers UNION ALL SELECT 'item', item_id, 16, 1.0 FROM catalog", SNAPSHOT))
def _(spark, d):
    """Every user asked for and every catalog item has a unit vector."""
    now, items, t, model, _, _ = _fitted(spark, d)
    norm = r6(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), F.size("embedding").alias("width"), norm.alias("norm"))
    return shape(towers.encode(towers.user_inputs(now.hist, now.users, t[1]), model, "user"), "user").unionByName(shape(towers.encode(towers.item_inputs(items, now.hist), model, "item"), "item"))


@Q("r20_frozen_inference", twin("SELECT count(*) AS n_users, 0::BIGINT AS n_differ FROM tusers", SNAPSHOT))
def _(spark, d):
    """Vectors saved and read back give the same lists, and a shorter list is the head of a longer one."""
    now, items, t, model, _, _ = _fitted(spark, d)
    place = io.scratch(spark)
    towers.encode(towers.user_inputs(now.hist, now.users, t[1]), model, "user").write.parquet(f"{place}/users")
    towers.encode(towers.item_inputs(items, now.hist), model, "item").write.parquet(f"{place}/items")
    u, v = spark.read.parquet(f"{place}/users"), spark.read.parquet(f"{place}/items")
    long, short = (models.factor_top_k(u, v, now.pool, now.seen, k).select("user_id", "item_id", "rank") for k in (20, 5))
    differ = long.where("rank <= 5").join(short, ["user_id", "item_id", "rank"], "full").withColumn("x", F.lit(1)).agg((F.count("x") - F.lit(0)).alias("n"))
    return short.agg(F.countDistinct("user_id").alias("n_users")).crossJoin(differ.crossJoin(short.agg(F.count("*").alias("m"))).select((F.col("n") - F.col("m")).alias("n_differ")))  # one row each


@Q("x1_factor_contract", twin(_CONTRACT.format("") + " WHERE user_id IN (SELECT user_id FROM hist WHERE label = 1)", SNAPSHOT))
def _(spark, d):
    """Lists from factors by alternating least squares, a cheaper source than the towers, in the same contract; users without a positive have no factors."""
    rows = interactions(spark, d)
    t = snapshots.resolve_four_cutoffs(rows)
    now = orchestrate.Built(rows, t[1], t[2])
    users, vectors = models.factors(now.hist, rank=8, iterations=3)
    now.users = now.users.join(users.select("user_id"), "user_id", "left_semi")
    return _list_contract(models.factor_top_k(users.join(now.users, "user_id", "left_semi"), vectors, now.pool, now.seen, 20), now, 20)


# --- learned rankers -------------------------------------------------------

_FEATURES = ["num_sources", "best_rank", "popularity_score", "recent_score", "popularity_rank", "recent_rank", "item_n_reviews", "user_n_events"]


def _table(rows: DataFrame, items: DataFrame, cutoff: int, end: int, k: int = 50, events: bool = False):
    """(snapshot, candidate rows with features, facets and labels)."""
    now = orchestrate.Built(rows, cutoff, end)
    lists = {"popularity": retrieval.top_unseen(now.users, retrieval.popularity(now.hist), now.pool, now.seen, k), "recent": retrieval.top_unseen(now.users, retrieval.decayed_popularity(now.hist, cutoff, 180.0), now.pool, now.seen, k)}
    by_item = now.hist.groupBy("item_id").agg(F.count("*").alias("item_n_reviews"))
    by_user = now.hist.groupBy("user_id").agg(F.count("*").alias("user_n_events"))
    out = candidates.union_sources(lists).join(by_item, "item_id", "left").join(by_user, "user_id", "left").join(items.select("item_id", "store", "main_category"), "item_id", "left")
    out = out.join(now.targets.withColumn("label", F.lit(1)), ["user_id", "item_id"], "left").fillna(0, subset=["label", "item_n_reviews", "user_n_events", "popularity_score", "recent_score"])
    out = out.persist()
    if events:  # a sequence is joined where rows are used; it is not kept once a candidate
        coded = rankers.event_codes(features.sequences(now.hist, items, features.vocabulary(now.pool, "item_id"), cutoff))
        out = out.join(candidates.looked_up(coded), "user_id", "left")
    return now, out


def _parts(now, table: DataFrame):
    """Train and held rows by users, and the held users' targets."""
    parts = filtering.user_holdout(now.users)
    train, held = (table.join(parts.where(F.col("part") == p).select("user_id"), "user_id", "left_semi") for p in ("train", "held"))
    return train, held, now.targets.join(parts.where("part = 'held'").select("user_id"), "user_id", "left_semi")


def _ranked(spark, d, kinds: list[str], events: bool = False) -> DataFrame:
    """Rankers of some kinds fitted on 80 % of the users, from one table; recall of all held users, with its losses falling or not."""
    rows, items = interactions(spark, d), adapters.catalog(spark, d)
    t = snapshots.resolve_four_cutoffs(rows)
    now, table = _table(rows, items, t[1], t[2], events=events)
    train, held, truth = _parts(now, table)
    scale = rankers.moments(train, _FEATURES)
    n, pos = train.agg(F.count("*"), F.sum("label")).first()
    data = rankers.gathered(rankers.inputs(train, _FEATURES), scale)  # all rows, once for all kinds
    return reduce(DataFrame.unionByName, [_ranked_by(kind, data, held, truth, scale, (n - pos) / max(1, pos)) for kind in kinds])


def _ranked_by(kind: str, data, held: DataFrame, truth: DataFrame, scale, pos_weight: float) -> DataFrame:
    model, losses = rankers.refit(data, _FEATURES, kind, 0.003, 3, pos_weight, scale)
    lists = retrieval.top_k(rankers.score(rankers.inputs(held, _FEATURES), model, scale), 50)
    out = metrics.recall_precision(truth, lists, [10, 50])
    return out.select(F.lit(kind).alias("kind"), "k", "n_users", ((F.col("recall") > 0) & (F.col("recall") <= 1)).alias("in_range"), F.lit(losses[-1] < losses[0]).alias("losses_fall"))


def _ranked_sql(*kinds: str) -> str:
    held = "(SELECT count(*) FROM (SELECT user_id, row_number() OVER (ORDER BY md5('holdout:' || CAST(user_id AS VARCHAR))) <= greatest(floor(count(*) OVER () * 0.2), 1) AS held FROM tusers) WHERE held)"
    return twin(" UNION ALL ".join(f"SELECT '{kind}' AS kind, {k} AS k, {held} AS n_users, true AS in_range, true AS losses_fall" for kind in kinds for k in (10, 50)), SNAPSHOT)


for _name, _kind in (("m7_mlp_ranker", "mlp"), ("m8_cross_ranker", "cross")):
    Q(_name, _ranked_sql(_kind))(lambda spark, d, kind=_kind: _ranked(spark, d, [kind]))


@Q("m11_sequence_rankers", _ranked_sql("vanilla", "mh_pool", "causal", "hstu"))
def _(spark, d):
    """The four sequence residuals over the cross network."""
    return _ranked(spark, d, ["vanilla", "mh_pool", "causal", "hstu"], events=True)


@Q("m9_ranker_grid", "SELECT * FROM (VALUES ('mlp', 0.003::DOUBLE), ('mlp', 0.01), ('cross', 0.003), ('cross', 0.01)) t(kind, rate), (SELECT true AS epochs_in_range, true AS recall_in_range)")
def _(spark, d):
    """Two kinds by two rates with the epoch that the held users' recall at 100 chooses."""
    rows, items = interactions(spark, d), adapters.catalog(spark, d)
    t = snapshots.resolve_four_cutoffs(rows)
    table = rankers.select(*_parts(*_table(rows, items, t[1], t[2])), _FEATURES, epochs=3)[0]
    return spark.createDataFrame([(kind, rate, 1 <= n <= 3, 0.0 < recall <= 1.0) for kind, rate, n, recall in table], "kind string, rate double, epochs_in_range boolean, recall_in_range boolean")


_RECENT = "SELECT item_id, round(sum(pow(0.5, CAST(c1 - ts AS DOUBLE) / 86400000.0 / 180.0)), 6) AS score FROM hist, cut WHERE label = 1 GROUP BY 1"
_DUMP = """SELECT l.user_id, l.item_id, CAST(max(CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS label, max(coalesce(u.n_history_events, 0)) AS n_history_events, max(coalesce(n_item, 0)) AS item_n_reviews, true AS finite
FROM (SELECT user_id, item_id FROM long_pop UNION SELECT user_id, item_id FROM long_recent) l LEFT JOIN targets t ON t.user_id = l.user_id AND t.item_id = l.item_id LEFT JOIN users_h u ON u.user_id = l.user_id LEFT JOIN items_h i ON i.item_id = l.item_id GROUP BY 1, 2"""


@Q("m10_ranker_dump", twin("SELECT * FROM " + _at_sql("test", _DUMP, global_list("long_pop", POPULARITY, 50) + "," + global_list("long_recent", _RECENT, 50))))
def _(spark, d):
    """Selection on held users of one snapshot, a refit on all of them, one evaluation on the next, and its dump."""
    rows, items = interactions(spark, d), adapters.catalog(spark, d)
    t = snapshots.resolve_four_cutoffs(rows)
    now, table = _table(rows, items, t[1], t[2])
    _, (kind, rate, epochs, _), pos_weight, scale = rankers.select(*_parts(now, table), _FEATURES, epochs=3)
    model, _ = rankers.refit(table, _FEATURES, kind, rate, epochs, pos_weight, scale)
    last, test = _table(rows, items, t[2], t[3])
    scored = rankers.score(rankers.inputs(test, _FEATURES), model, scale).withColumnRenamed("score", "logit")
    dump = test.select("user_id", "item_id", "label", F.col("user_n_events").alias("n_history_events"), "item_n_reviews").join(scored, ["user_id", "item_id"])
    place = io.scratch(spark)
    io.write_dump(dump, f"{place}/dump", test.count())
    back = io.read_dump(spark, f"{place}/dump")
    calibration.check_in_sync(back, last.targets)
    return back.select("user_id", "item_id", "label", "n_history_events", "item_n_reviews", (F.col("logit").isNotNull() & ~F.isnan("logit") & (F.abs("logit") < 1e9)).alias("finite"))
