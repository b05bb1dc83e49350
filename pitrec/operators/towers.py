"""Two-tower retrieval: user and item towers, in-batch softmax or logistic training, frozen refits, distributed encoding.

A user is a hashed id, numbers of the history and the pooled embeddings of the last
positives; an item is a hashed id, hashed store and category, and numbers of the
history. Both towers end in unit vectors. Cold users and items have towers too: ids
not trained on read as zero rows, and an empty history pools to zero.

The towers learn from all pairs, and their uniform tail is the whole pool. Up to
`max_pairs` pairs and `max_items` pool items learn on the driver; more are dealt to
shards of about that size (`averaging`), the pool with them. The early stop judges all
users by their exact lists. Weights are a few MB whatever the input, and all rows are
encoded where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitrec.functions.expressions import DAY_MS

from . import autograd as A
from . import averaging, metrics
from .filtering import cut
from .models import config_hash, log_q
from .retrieval import dense_top_k

CONFIG = {"ids": 1 << 13, "stores": 256, "categories": 64, "id_dim": 16, "hidden": 32, "dim": 16, "last": 20, "batch": 512, "tail": 256, "lr": 0.01, "decay": 1e-4, "max_epochs": 6, "patience": 2, "max_pairs": 200_000, "max_items": 20_000, "max_users": 1_000, "seed": 7}
USER, ITEM = "bucket int, numbers array<double>, taste array<int>", "bucket int, store int, category int, numbers array<double>"


def _bucket(what: str, column, n: int):
    return (1 + F.pmod(F.xxhash64(F.lit(what), column.cast("string")), F.lit(n))).cast("int")


def user_inputs(hist: DataFrame, users: DataFrame, as_of: int, config: dict = CONFIG) -> DataFrame:
    """(user_id, bucket, numbers, taste) of every user asked for; without history the numbers are 0 and the taste is empty."""
    stats = hist.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.max("ts").alias("last"))
    own = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item_id")
    recent = hist.where("label = 1").withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= config["last"])
    taste = recent.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", _bucket("item", F.col("item_id"), config["ids"]).alias("b")))), lambda x: x["b"]).alias("taste"))  # at most `last` a user
    zero = F.lit(0.0)
    days = (F.lit(as_of) - F.col("last")) / float(DAY_MS)
    numbers = F.array(F.coalesce(F.log1p("n") / 5, zero), F.coalesce(F.col("mean") / 5, zero), F.coalesce(F.log1p(days) / 7, zero))
    out = users.select("user_id").distinct().join(stats, "user_id", "left").join(taste, "user_id", "left")
    return out.select("user_id", _bucket("user", F.col("user_id"), config["ids"]).alias("bucket"), numbers.alias("numbers"), F.coalesce("taste", F.array().cast("array<int>")).alias("taste"))


def item_inputs(items: DataFrame, hist: DataFrame, config: dict = CONFIG) -> DataFrame:
    """(item_id, bucket, store, category, numbers) of every catalog item."""
    stats = hist.groupBy("item_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.sum("label").alias("pos"))
    zero = F.lit(0.0)
    numbers = F.array(F.coalesce(F.log1p("n") / 5, zero), F.coalesce(F.col("mean") / 5, zero), F.coalesce(F.log1p("pos") / 5, zero))
    facet = lambda c, n: F.coalesce(_bucket(c, F.col(c), n), F.lit(0))
    return items.join(stats, "item_id", "left").select("item_id", _bucket("item", F.col("item_id"), config["ids"]).alias("bucket"), facet("store", config["stores"]).alias("store"), facet("main_category", config["categories"]).alias("category"), numbers.alias("numbers"))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of an Arrow column of lists."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.value_lengths()), np.asarray(whole.flatten())


def _users(rows: pa.Table | pa.RecordBatch, last: int) -> dict[str, np.ndarray]:
    taste = np.zeros((rows.num_rows, last), dtype=np.int64)
    n, values = _lists(rows.column("taste"))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    taste[row[at < last], at[at < last]] = values[at < last]
    return {"bucket": np.asarray(rows.column("bucket")).astype(np.int64), "numbers": _lists(rows.column("numbers"))[1].reshape(-1, 3), "taste": taste}


def _items(rows: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: np.asarray(rows.column(c)).astype(np.int64) for c in ("bucket", "store", "category")} | {"numbers": _lists(rows.column("numbers"))[1].reshape(-1, 3)}


def _places(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each value in the sorted ids, whether it is there)."""
    at = np.minimum(np.searchsorted(ids, of), max(0, len(ids) - 1))
    return at, (ids[at] == of) if len(ids) else np.zeros(len(of), bool)


def _keys(spark, name: str, ids: np.ndarray) -> DataFrame:
    """Ids that the driver holds, as a column to join; there are as many as one pass on the driver has at most."""
    return F.broadcast(spark.createDataFrame(pa.table({name: pa.array(ids, pa.int64())})))


def _take(part: dict[str, np.ndarray], rows) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in part.items()}


class Towers:
    """Weights and both towers. Names that begin with w_ decay."""

    def __init__(self, config: dict = CONFIG):
        rng, d, h = np.random.default_rng(config["seed"]), config["id_dim"], config["hidden"]
        self.config = config
        self.p = {
            "user_id": A.embedding(rng, config["ids"] + 1, d), "item_id": A.embedding(rng, config["ids"] + 1, d),
            "store": A.embedding(rng, config["stores"] + 1, d // 2), "category": A.embedding(rng, config["categories"] + 1, d // 2),
            "w_user_1": A.dense(rng, 2 * d + 3, h), "b_user_1": A.Var(np.zeros(h)), "w_user_2": A.dense(rng, h, config["dim"]), "b_user_2": A.Var(np.zeros(config["dim"])),
            "w_item_1": A.dense(rng, 2 * d + 3, h), "b_item_1": A.Var(np.zeros(h)), "w_item_2": A.dense(rng, h, config["dim"]), "b_item_2": A.Var(np.zeros(config["dim"])),
            "scale": A.Var(np.log(10.0)),
        }

    def pooled(self, taste: np.ndarray, but: np.ndarray | None = None) -> A.Var:
        """Mean embedding of a history without the item that is scored; exactly zero if nothing is left."""
        use = taste > 0
        if but is not None:
            use &= taste != but[:, None]
        n = np.maximum(use.sum(axis=1, keepdims=True), 1)
        return A.total(A.rows(self.p["item_id"], taste) * (use / n)[:, :, None], axis=1)

    def _head(self, x: A.Var, side: str) -> A.Var:
        p = self.p
        return A.unit(A.relu(x @ p[f"w_{side}_1"] + p[f"b_{side}_1"]) @ p[f"w_{side}_2"] + p[f"b_{side}_2"])

    def user(self, u: dict, but: np.ndarray | None = None) -> A.Var:
        return self._head(A.concat([A.rows(self.p["user_id"], u["bucket"]), self.pooled(u["taste"], but), A.var(u["numbers"])]), "user")

    def item(self, i: dict) -> A.Var:
        p = self.p
        return self._head(A.concat([A.rows(p["item_id"], i["bucket"]), A.rows(p["store"], i["store"]), A.rows(p["category"], i["category"]), A.var(i["numbers"])]), "item")


def softmax_loss(u: A.Var, v: A.Var, user_key: np.ndarray, item_key: np.ndarray, q: np.ndarray, scale: A.Var, tail: A.Var | None = None, tail_key: np.ndarray | None = None, q_tail: float = 0.0) -> A.Var:
    """Cross-entropy of each row's own item among the batch's items and a uniform tail, each less the log of its chance to be drawn.

    Not among a row's candidates: other columns with its own item, other columns of its own user, and its own item in the tail.
    """
    n = len(item_key)
    wrong = ((item_key[None, :] == item_key[:, None]) | (user_key[None, :] == user_key[:, None])) & ~np.eye(n, dtype=bool)
    logits = A.masked((u @ A.swap(v)) * scale - q[None, :], wrong)
    if tail is not None:
        logits = A.concat([logits, A.masked((u @ A.swap(tail)) * scale - q_tail, tail_key[None, :] == item_key[:, None])])
    return A.cross_entropy(logits, np.arange(n))


@dataclass
class Sample:
    """What one pass learns from: pairs with both sides' inputs, and items for the tail. `n_pool` is the pool's size, of which the tail may be a shard's part."""

    users: dict
    items: dict
    user_key: np.ndarray
    item_key: np.ndarray
    label: np.ndarray
    q: np.ndarray
    tail: dict
    tail_key: np.ndarray
    n_pool: int = 0


@dataclass
class Shards:
    """All pairs and the whole pool, dealt: a shard's tail items, then its users, with their inputs and `cells`, the inputs of the pairs' items."""

    dealt: DataFrame
    n: int
    n_pool: int
    pool: DataFrame
    """The inputs of the pool's items."""


BLOCK = 4096  # pairs of a user that stay together


def gather(hist: DataFrame, items: DataFrame, pool: DataFrame, as_of: int, config: dict = CONFIG, pairs: DataFrame | None = None) -> Sample | Shards:
    """All pairs, on the driver up to `max_pairs` of them and `max_items` pool items, else dealt; `pairs` (user_id, item_id, label) replaces the positives for logistic training.

    Keys come first; the inputs are those of the pairs' users and items alone, and come once each, as Arrow columns.
    """
    given = pairs if pairs is not None else hist.where("label = 1").select("user_id", "item_id", F.lit(1).alias("label")).distinct()
    given = cut(given.select("user_id", "item_id", "label").where("user_id is not null and item_id is not null"))
    tails = cut(pool.join(items.select("item_id"), "item_id").select("item_id"))
    n_pairs, n_pool = given.count(), tails.count()
    if n_pairs > config["max_pairs"] or n_pool > config["max_items"]:
        return _dealt(hist, items, given, tails, n_pool, max(-(-n_pairs // config["max_pairs"]), -(-n_pool // config["max_items"])), as_of, config)
    drawn = given.toArrow()  # bounded by max_pairs
    tail = np.sort(np.asarray(tails.toArrow().column("item_id")))  # bounded by max_items
    user, item = (np.asarray(drawn.column(c)) for c in ("user_id", "item_id"))
    asked, wanted = (_keys(hist.sparkSession, name, np.unique(ids)) for name, ids in (("user_id", user), ("item_id", np.concatenate([item, tail]))))
    u = user_inputs(hist.join(asked, "user_id", "left_semi"), asked, as_of, config).toArrow().sort_by("user_id")
    near = item_inputs(items.join(wanted, "item_id", "left_semi"), hist.join(wanted, "item_id", "left_semi"), config)
    i = near.join(log_q(hist), "item_id", "left").toArrow().sort_by("item_id")
    order = np.lexsort((item, user))
    order = order[_places(np.asarray(i.column("item_id")), item[order])[1]]  # items of the catalog
    user, item = user[order], item[order]
    at_user, at_item, at_tail = (_places(np.asarray(t.column(c)), ids)[0] for t, c, ids in ((u, "user_id", user), (i, "item_id", item), (i, "item_id", tail)))
    users, known = _users(u, config["last"]), _items(i)
    q = np.nan_to_num(i.column("log_q").to_numpy())  # items without a positive have none
    return Sample(_take(users, at_user), _take(known, at_item), user, item, np.asarray(drawn.column("label"))[order].astype(np.float64), q[at_item], _take(known, at_tail), tail, n_pool)


def _dealt(hist: DataFrame, items: DataFrame, given: DataFrame, tails: DataFrame, n_pool: int, shards: int, as_of: int, config: dict) -> Shards:
    """Pairs by user, a user of more than BLOCK pairs by blocks of items, and the pool by item."""
    inputs = cut(item_inputs(items, hist, config).join(log_q(hist), "item_id", "left").withColumn("log_q", F.coalesce("log_q", F.lit(0.0))))
    part = lambda *key: F.pmod(F.xxhash64(*key, F.lit("shard")), F.lit(shards)).cast("int")
    cell = lambda label: F.struct("item_id", "bucket", "store", "category", "numbers", "log_q", label.cast("int").alias("label"))
    sizes = given.groupBy("user_id").agg(F.count("*").alias("h")).where(F.col("h") > BLOCK).select("user_id", F.ceil(F.col("h") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("item_id", F.lit("block")), F.coalesce("blocks", F.lit(1))).cast("int")
    held = given.join(inputs, "item_id").select("user_id", "item_id", cell(F.col("label")).alias("cell")).join(sizes, "user_id", "left")
    held = held.groupBy("user_id", block.alias("block")).agg(F.collect_list("cell").alias("cells"))  # about BLOCK at most
    asked = user_inputs(hist, given, as_of, config).withColumnsRenamed({"bucket": "u_bucket", "numbers": "u_numbers"})
    learn = held.join(asked, "user_id").select(part("user_id", "block").alias("shard"), F.lit(1).alias("kind"), "user_id", "block", "u_bucket", "u_numbers", "taste", "cells")
    pool = cut(inputs.join(tails, "item_id", "left_semi"))
    empty = [F.lit(0).alias("block"), F.lit(0).alias("u_bucket"), F.array().cast("array<double>").alias("u_numbers"), F.array().cast("array<int>").alias("taste")]
    last = pool.select(part("item_id").alias("shard"), F.lit(0).alias("kind"), F.col("item_id").alias("user_id"), *empty, F.array(cell(F.lit(0))).alias("cells"))
    return Shards(averaging.deal(last.unionByName(learn), shards, "kind", "user_id", "block"), shards, n_pool, pool.drop("log_q"))


def _sample(rows: pa.Table, n_pool: int, last: int) -> Sample:
    """A shard's rows as one pass takes them: pairs in order of (user, item), the tail in order of items."""
    rows = rows.combine_chunks()
    cells = rows.column("cells").combine_chunks()
    cell = cells.flatten()
    cell = pa.Table.from_arrays(cell.flatten(), names=[f.name for f in cell.type])
    at = np.repeat(np.arange(rows.num_rows), np.asarray(cells.value_lengths()))
    item, pair = cell["item_id"].to_numpy(), rows["kind"].to_numpy()[at] == 1
    user = rows["user_id"].to_numpy()[at]
    order = np.lexsort((item, user))
    order, tail = order[pair[order]], np.flatnonzero(~pair)
    known = _items(cell)
    asked = rows.filter(pa.array(rows["kind"].to_numpy() == 1)).rename_columns({"u_bucket": "bucket", "u_numbers": "numbers"})
    place = (np.cumsum(rows["kind"].to_numpy() == 1) - 1)[at[order]]
    return Sample(_take(_users(asked, last), place), _take(known, order), user[order], item[order], cell["label"].to_numpy()[order].astype(np.float64), cell["log_q"].to_numpy()[order], _take(known, tail), item[tail], n_pool)


def _pass(model: Towers, steps: A.AdamW, sample: Sample, rng: np.random.Generator, objective: str) -> float:
    """One epoch over the sample in random order; the summed loss."""
    config, order, held = model.config, rng.permutation(len(sample.label)), []
    for k in range(0, len(order), config["batch"]):
        rows = order[k : k + config["batch"]]
        users, items = _take(sample.users, rows), _take(sample.items, rows)
        u, v = model.user(users, items["bucket"]), model.item(items)
        scale = A.exp(model.p["scale"])
        if objective == "softmax":
            t = rng.choice(len(sample.tail_key), min(config["tail"], len(sample.tail_key)), replace=False)
            tail = model.item(_take(sample.tail, t)) if len(t) else None
            loss = softmax_loss(u, v, sample.user_key[rows], sample.item_key[rows], sample.q[rows], scale, tail, sample.tail_key[t], -float(np.log(max(1, sample.n_pool))))
        else:
            loss = A.weighted_bce(A.total(u * v, axis=1) * scale, sample.label[rows], np.ones(len(rows)))
        loss.backward()
        steps.step()
        model.p["scale"].data = np.clip(model.p["scale"].data, 0.0, np.log(100.0))
        held.append(float(loss.data) * len(rows))
    return sum(held)


def _epochs(data: Sample | Shards, model: Towers, objective: str):
    """A function of the epoch's number that trains the model once over all pairs and gives the mean loss."""
    config, steps = model.config, A.AdamW(model.p, model.config["lr"], model.config["decay"])
    if isinstance(data, Sample):
        rng = np.random.default_rng(config["seed"])
        return lambda epoch: _pass(model, steps, data, rng, objective) / max(1, len(data.label))
    n_pool = data.n_pool

    def run(epoch: int) -> float:
        def learn(state, rows, shard):
            own = Towers(config)
            moved, sample = A.AdamW(own.p, config["lr"], config["decay"]).load(state), _sample(rows, n_pool, config["last"])
            loss = _pass(own, moved, sample, np.random.default_rng([config["seed"], epoch, shard]), objective)
            return moved.state(), len(sample.label), loss

        state, loss = averaging.epoch(data.dealt, data.n, steps.state(), learn)
        steps.load(state)
        return loss

    return run


def train(sample: Sample | Shards, config: dict = CONFIG, epochs: int | None = None, objective: str = "softmax", judge=None) -> tuple[Towers, int, list[float]]:
    """(towers, epochs, mean loss an epoch). With `judge` the epoch it likes best is kept and training ends once `patience` epochs are no better; else all epochs are run."""
    model = Towers(config)
    once = _epochs(sample, model, objective)
    losses, best, since = [], (-1.0, 0, None), 0
    for epoch in range(1, (epochs or config["max_epochs"]) + 1):
        losses.append(once(epoch))
        if judge is not None:
            value = judge(model)
            if value > best[0]:
                best, since = (value, epoch, {name: p.data.copy() for name, p in model.p.items()}), 0
            else:
                since += 1
                if since >= config["patience"]:
                    break
    if judge is None:
        return model, len(losses), losses
    for name, data in best[2].items():
        model.p[name].data = data
    return model, best[1], losses


def recall_judge(users: DataFrame, truth: DataFrame, seen_pairs: DataFrame, sample: Sample | Shards, config: dict = CONFIG, k: int = 50):
    """A function of the towers: mean recall at k of all users over the whole pool, seen items left out.

    Up to `max_users` users and a pool on the driver are judged there, more by their lists.
    """
    asked = cut(users.where("user_id is not null"))
    if isinstance(sample, Shards) or asked.count() > config["max_users"]:
        return _listed_recall(asked, truth, seen_pairs, sample, k)
    held = asked.toArrow().sort_by("user_id")  # bounded by max_users
    ids, inputs = np.asarray(held.column("user_id")), _users(held, config["last"])
    asked, tail = (_keys(users.sparkSession, name, x) for name, x in (("user_id", ids), ("item_id", sample.tail_key)))

    def placed(df: DataFrame):
        """(row of the user, item) of the pairs of the users chosen."""
        t = df.select("user_id", "item_id").distinct().toArrow()
        return np.searchsorted(ids, np.asarray(t.column("user_id"))), np.asarray(t.column("item_id"))

    row, item = placed(truth.join(asked, "user_id", "left_semi"))
    sizes, (at, inside) = np.bincount(row, minlength=len(ids)), _places(sample.tail_key, item)
    wanted = [at[inside & (row == r)] for r in range(len(ids))]
    known_row, known_item = placed(seen_pairs.join(asked, "user_id", "left_semi").join(tail, "item_id", "left_semi"))
    known_at = _places(sample.tail_key, known_item)[0]

    def judge(model: Towers) -> float:
        scores = model.user(inputs).data @ model.item(sample.tail).data.T
        scores[known_row, known_at] = -np.inf
        values = [np.isin(wanted[r], first_places(scores[r], k)).sum() / sizes[r] for r in np.flatnonzero(sizes)]
        return float(np.mean(values)) if values else 0.0

    return judge


def _listed_recall(users: DataFrame, truth: DataFrame, seen_pairs: DataFrame, sample: Sample | Shards, k: int):
    """The same recall from exact lists, made where users and items meet."""
    targets, seen_pairs = cut(truth.select("user_id", "item_id").distinct().join(users.select("user_id"), "user_id", "left_semi")), cut(seen_pairs)
    pool = sample.pool if isinstance(sample, Shards) else _frame(users.sparkSession, sample)

    def judge(model: Towers) -> float:
        vectors = [cut(encode(df, model, side)) for df, side in ((users, "user"), (pool, "item"))]
        lists = dense_top_k(vectors[0].withColumnRenamed("embedding", "profile"), vectors[1], pool, seen_pairs, k)
        sums = metrics.user_hits(targets, lists, [k]).agg(F.avg(F.col(f"h{k}") / F.col("n")).alias("recall")).first()
        return sums["recall"] or 0.0

    return judge


def _frame(spark, sample: Sample) -> DataFrame:
    """The inputs of the pool's items that the driver holds."""
    numbers = sample.tail["numbers"]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * 3), pa.array(numbers.ravel()))
    return spark.createDataFrame(pa.table({"item_id": pa.array(sample.tail_key, pa.int64())} | {c: pa.array(sample.tail[c], pa.int32()) for c in ("bucket", "store", "category")} | {"numbers": lists}))


def first_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by place."""
    if k >= len(scores):
        return np.argsort(-scores, kind="stable")
    able = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return able[np.argsort(-scores[able], kind="stable")[:k]]


def encode(inputs: DataFrame, model: Towers, side: str) -> DataFrame:
    """(user_id or item_id, embedding) of all rows of `user_inputs` or `item_inputs`."""
    key = f"{side}_id"
    weights, config = {k: p.data.astype(np.float64) for k, p in model.p.items()}, model.config
    shared = inputs.sparkSession.sparkContext.broadcast((weights, config))  # a few MB whatever the input

    def run(batches):
        weights, config = shared.value
        towers = Towers(config)
        for name, data in weights.items():
            towers.p[name] = A.Var(data)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                held = batch.slice(k, 1024)
                x = towers.user(_users(held, config["last"])).data if side == "user" else towers.item(_items(held)).data
                ends = np.arange(held.num_rows + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([held.column(key).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names=[key, "embedding"])

    return inputs.mapInArrow(run, f"{key} bigint, embedding array<double>")


def tower_lists(model: Towers, hist: DataFrame, items: DataFrame, users: DataFrame, pool: DataFrame, seen_pairs: DataFrame, as_of: int, k: int) -> DataFrame:
    """(user_id, item_id, score, rank): the pool's best unseen items of every user asked for, also those without history. Vectors are made once: counts and lists read them from a checkpoint."""
    u = cut(encode(user_inputs(hist, users, as_of, model.config), model, "user")).withColumnRenamed("embedding", "profile")
    return dense_top_k(u, cut(encode(item_inputs(items, hist, model.config), model, "item")), pool, seen_pairs, k)


def fingerprint(config: dict, epochs: int) -> str:
    """Binds a refit to the configuration and the epochs that were frozen."""
    return config_hash(config | {"epochs": epochs})
