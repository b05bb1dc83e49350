"""Neural rankers over candidate rows: multilayer perceptron, cross network with a deep tower, and a residual over event sequences.

They learn from all rows: up to `max_rows` on the driver, more in shards of about that
size where they lie (`averaging`). Selection runs a grid with an early stop by recall on
all held users; the refit runs the chosen epochs and looks at no label but its own. Rows
are scored where they lie. A sequence is encoded once for a run of rows that share it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import autograd as A
from . import averaging, metrics
from .filtering import cut
from .retrieval import top_k
from .towers import _bucket, _lists

STORES, CATEGORIES, IDS, LENGTH = 256, 64, 1 << 13, 20
BLOCK = 4096  # rows of a user that stay together
EVENT = ("item", "category", "store", "gap", "rating")
SIZES = {"item": IDS + 1, "category": CATEGORIES + 1, "store": STORES + 1, "gap": 8, "rating": 7}


@dataclass
class Rows:
    """Candidate rows as arrays; `events` is rows x LENGTH x 5, 0 is padding at the end."""

    user: np.ndarray
    item: np.ndarray
    numbers: np.ndarray
    store: np.ndarray
    category: np.ndarray
    bucket: np.ndarray
    events: np.ndarray | None
    label: np.ndarray
    weight: np.ndarray

    def take(self, rows) -> Rows:
        return Rows(*(None if v is None else v[rows] for v in vars(self).values()))


def moments(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each feature (1 if it hardly varies); one aggregate."""
    r = rows.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in features], *[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in features]).first()
    mean, dev = np.array([x or 0.0 for x in r[: len(features)]]), np.array([x or 0.0 for x in r[len(features) :]])
    return mean, np.where(dev <= 1e-9, 1.0, dev)


def event_codes(sequences: DataFrame) -> DataFrame:
    """(user_id, events): the last events of `features.sequences` as flat lists of five codes each."""
    code = lambda e: F.array((e["item"] % IDS + 1).cast("int"), _bucket("main_category", e["category"], CATEGORIES), _bucket("store", e["store"], STORES), e["gap"].cast("int"), F.least(F.greatest(e["rating"], F.lit(0)), F.lit(6)).cast("int"))
    return sequences.select("user_id", F.flatten(F.transform("events", code)).alias("events"))


def inputs(rows: DataFrame, features: list[str]) -> DataFrame:
    """The columns that the rankers read. rows: user_id, item_id, the features, store and main_category, maybe label and events."""
    out = [F.col("user_id").cast("long"), F.col("item_id").cast("long"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("numbers")]
    out += [F.coalesce(_bucket("store", F.col("store"), STORES), F.lit(0)).alias("store"), F.coalesce(_bucket("main_category", F.col("main_category"), CATEGORIES), F.lit(0)).alias("category"), _bucket("item", F.col("item_id"), IDS).alias("bucket")]
    out += [F.coalesce(F.col("events"), F.array().cast("array<int>")).alias("events") if "events" in rows.columns else F.array().cast("array<int>").alias("events")]
    return rows.select(*out, (F.col("label") if "label" in rows.columns else F.lit(0)).cast("int").alias("label"))


def _events(column) -> np.ndarray:
    """rows x LENGTH x 5 codes of a column of flat lists, the last LENGTH events of each."""
    n, values = _lists(column)
    width = LENGTH * len(EVENT)
    if not len(values):
        return np.broadcast_to(np.int32(0), (len(n), LENGTH, len(EVENT)))
    out, row = np.zeros((len(n), width), dtype=np.int32), np.repeat(np.arange(len(n)), n)
    at = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n) - np.repeat(np.maximum(n - width, 0), n)
    out[row[at >= 0], at[at >= 0]] = values[at >= 0]
    return out.reshape(-1, LENGTH, len(EVENT))


def _arrays(batch: pa.Table | pa.RecordBatch, scale: tuple, weight: np.ndarray | None = None) -> Rows:
    n = batch.num_rows
    get = lambda c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy())
    numbers = _lists(batch.column("numbers"))[1].reshape(n, len(scale[0]))
    return Rows(get("user_id"), get("item_id"), (numbers - scale[0]) / scale[1], get("store"), get("category"), get("bucket"), _events(batch.column("events")), get("label").astype(np.float64), np.ones(n) if weight is None else weight)


def collected(rows: DataFrame, scale: tuple, max_rows: int = 200_000) -> Rows:
    """At most about `max_rows` rows on the driver: positives up to a half, negatives for the rest, both by hash and weighted back. No query learns from a part; `gathered` takes all."""
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    keep_pos = min(1.0, max_rows / 2 / max(1, pos))
    keep_neg = min(1.0, (max_rows - pos * keep_pos) / max(1, n - pos))
    lot = F.pmod(F.xxhash64("user_id", "item_id", F.lit("rank")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(lot < F.when(F.col("label") == 1, keep_pos).otherwise(keep_neg))
    table = drawn.toArrow().sort_by([("user_id", "ascending"), ("item_id", "ascending")])
    label = table.column("label").to_numpy()
    return _arrays(table.combine_chunks(), scale, np.where(label == 1, 1 / keep_pos, 1 / max(keep_neg, 1e-12)))


def held_recall(rows: DataFrame, truth: DataFrame, scale: tuple, k: int, max_users: int = 500):
    """A function of the model: mean recall at k of all held users that have targets, on the driver up to `max_users` of them, else by their lists."""
    rows, truth = cut(rows), cut(truth.select("user_id", "item_id").distinct())
    if max(rows.select("user_id").distinct().count(), truth.select("user_id").distinct().count()) > max_users:
        return lambda model: metrics.user_hits(truth, top_k(score(rows, model, scale), k), [k]).agg(F.avg(F.col(f"h{k}") / F.col("n"))).first()[0] or 0.0
    judged = _arrays(rows.toArrow().sort_by([("user_id", "ascending"), ("item_id", "ascending")]).combine_chunks(), scale)  # rows of max_users at most
    sizes = {r["user_id"]: r["n"] for r in truth.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    return lambda model: recall_of(model, judged, sizes, k)


@dataclass
class Dealt:
    """All rows, dealt to `n` shards: a row a user (of many rows a block of them) with its events once and its `cells`."""

    dealt: DataFrame
    n: int
    scale: tuple
    width: int

    def epoch(self, model: Ranker, steps: A.AdamW, pos_weight: float, seed: int, batch: int, epoch: int) -> float:
        """One pass of each shard from the model's weights, then their mean; the mean loss."""
        kind, width, scale, lr, decay = model.kind, self.width, self.scale, steps.lr, steps.decay

        def learn(state, rows, shard):
            own, data = Ranker(kind, width, seed), _shard(rows, scale, kind not in ("mlp", "cross"))
            moved = A.AdamW(own.p, lr, decay).load(state)
            loss = _pass(own, moved, data, np.random.default_rng([seed, epoch, shard]), pos_weight, batch)
            return moved.state(), len(data.label), loss

        state, loss = averaging.epoch(self.dealt, self.n, steps.state(), learn)
        steps.load(state)
        return loss


def _shard(rows: pa.Table, scale: tuple, sequences: bool) -> Rows:
    """A shard's rows, each user's together."""
    cells = rows.column("cells").combine_chunks()
    cell, at = cells.flatten(), np.repeat(np.arange(rows.num_rows), np.asarray(cells.value_lengths()))
    flat = pa.Table.from_arrays([rows.column("user_id").combine_chunks().take(pa.array(at)), *cell.flatten()], names=["user_id", *(f.name for f in cell.type)])
    events, numbers = _events(rows.column("events"))[at] if sequences else None, _lists(flat.column("numbers"))[1].reshape(len(at), len(scale[0]))
    order = np.lexsort((flat["item_id"].to_numpy(), at))
    get = lambda c: flat[c].to_numpy()
    return Rows(get("user_id"), get("item_id"), (numbers - scale[0]) / scale[1], get("store"), get("category"), get("bucket"), events, get("label").astype(np.float64), np.ones(len(at))).take(order)


def gathered(rows: DataFrame, scale: tuple, max_rows: int = 200_000) -> Rows | Dealt:
    """All rows of `inputs`: on the driver up to `max_rows`, else dealt to shards of about that many, a user's rows together."""
    sizes = cut(rows.groupBy("user_id").agg(F.count("*").alias("h")))
    n = sizes.agg(F.coalesce(F.sum("h"), F.lit(0))).first()[0]
    if n <= max_rows:
        return collected(rows, scale, 2 * n)  # all of them
    shards = -(-n // max_rows)
    many = sizes.where(F.col("h") > BLOCK).select("user_id", F.ceil(F.col("h") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("item_id", F.lit("block")), F.coalesce("blocks", F.lit(1))).cast("int")
    cell = F.struct("item_id", "numbers", "store", "category", "bucket", "label")
    users = rows.join(many, "user_id", "left").groupBy("user_id", block.alias("block")).agg(F.first("events").alias("events"), F.collect_list(cell).alias("cells"))  # about BLOCK at most
    shard = F.pmod(F.xxhash64("user_id", "block", F.lit("shard")), F.lit(shards)).cast("int")
    return Dealt(averaging.deal(users.withColumn("shard", shard), shards, "user_id", "block"), shards, scale, len(scale[0]))


class Ranker:
    """kind: mlp, cross, or one of the sequence residuals vanilla, mh_pool, causal and hstu on top of the cross network."""

    def __init__(self, kind: str, n_numbers: int, seed: int = 7, cat_dim: int = 8, deep: tuple = (64, 32), layers: int = 3, dim: int = 16, heads: int = 2):
        rng = np.random.default_rng(seed)
        self.kind, self.layers, self.heads, self.dim, self.n_deep = kind, layers, heads, dim, len(deep)
        x = n_numbers + 2 * cat_dim
        p = {"store": A.embedding(rng, STORES + 1, cat_dim), "category": A.embedding(rng, CATEGORIES + 1, cat_dim)}
        before = x
        for k, n in enumerate(deep):
            p[f"w_deep_{k}"], p[f"b_deep_{k}"], before = A.dense(rng, before, n), A.Var(np.zeros(n)), n
        if kind != "mlp":
            for k in range(layers):
                p[f"w_cross_{k}"], p[f"b_cross_{k}"] = A.Var(rng.normal(0, x**-0.5, (x, 1))), A.Var(np.zeros(x))
            before += x
        p["w_head"], p["b_head"] = A.dense(rng, before, 1), A.Var(np.zeros(1))
        if kind not in ("mlp", "cross"):
            for c in EVENT:
                p[f"event_{c}"] = A.embedding(rng, SIZES[c], dim)
            pooled = dim
            if kind == "mh_pool":
                p["w_query"], pooled = A.dense(rng, dim, heads), dim * heads
            if kind in ("causal", "hstu"):
                for c in ("q", "k", "v", "o") + (("u",) if kind == "hstu" else ()):
                    p[f"w_{c}"] = A.dense(rng, dim, dim)
            if kind == "causal":
                p["w_ffn_1"], p["w_ffn_2"] = A.dense(rng, dim, 2 * dim), A.dense(rng, 2 * dim, dim)
            p["w_over_1"], p["b_over_1"] = A.dense(rng, pooled + 2 * dim, 32), A.Var(np.zeros(32))
            p["w_over_2"] = A.Var(np.zeros((32, 1)))  # the residual starts at zero
        self.p = p

    def cross(self, x0: A.Var) -> A.Var:
        """x' = x0 (x . w) + b + x, a layer; with zero weights it gives x0 back."""
        x = x0
        for k in range(self.layers):
            x = x0 * (x @ self.p[f"w_cross_{k}"]) + self.p[f"b_cross_{k}"] + x
        return x

    def states(self, events: np.ndarray) -> tuple[A.Var, np.ndarray]:
        """Encoded events (rows x LENGTH x dim) and which of them are there."""
        there = events[:, :, 0] > 0
        x = A.rows(self.p["event_item"], events[:, :, 0])
        for k, c in enumerate(EVENT[1:], 1):
            x = x + A.rows(self.p[f"event_{c}"], events[:, :, k])
        return A.centred(x) * there[:, :, None].astype(float), there

    def pooled(self, events: np.ndarray) -> A.Var:
        x, there = self.states(events)
        n = np.maximum(there.sum(axis=1, keepdims=True), 1)
        empty = (~there.any(axis=1))[:, None]
        if self.kind == "vanilla":
            return A.total(x * (there / n)[:, :, None], axis=1)
        if self.kind == "mh_pool":
            gone = np.where(there, 0.0, -1e9)[:, None, :]
            weight = A.softmax(A.swap(x @ self.p["w_query"]) + gone)
            return A.reshape(weight @ x, len(events), -1) * (~empty).astype(float)
        q, k, v = (x @ self.p[f"w_{c}"] for c in ("q", "k", "v"))
        late = np.triu(np.ones((LENGTH, LENGTH), dtype=bool), 1)[None] | ~there[:, None, :]
        scores = (q @ A.swap(k)) * (self.dim**-0.5)
        if self.kind == "causal":
            mixed = A.softmax(scores + np.where(late, -1e9, 0.0)) @ v
            x = x + mixed @ self.p["w_o"]
            x = x + A.relu(A.centred(x) @ self.p["w_ffn_1"]) @ self.p["w_ffn_2"]
        else:
            weight = A.silu(scores) * ((~late) / n[:, :, None])
            x = x + (A.centred(weight @ v) * A.silu(x @ self.p["w_u"])) @ self.p["w_o"]
        return A.at(x, np.maximum(there.sum(axis=1) - 1, 0)) * (~empty).astype(float)

    def logits(self, r: Rows) -> A.Var:
        p = self.p
        x0 = A.concat([A.var(r.numbers), A.rows(p["store"], r.store), A.rows(p["category"], r.category)])
        h = x0
        for k in range(self.n_deep):
            h = A.relu(h @ p[f"w_deep_{k}"] + p[f"b_deep_{k}"])
        if self.kind != "mlp":
            h = A.concat([self.cross(x0), h])
        z = h @ p["w_head"] + p["b_head"]
        if self.kind not in ("mlp", "cross"):
            new = np.r_[True, (r.events[1:] != r.events[:-1]).any((1, 2))][: len(r.label)]
            pooled = A.taken(self.pooled(r.events[new]), np.cumsum(new) - 1)  # once a run of rows that share their events
            own = A.rows(p["event_item"], r.bucket) + A.rows(p["event_category"], r.category) + A.rows(p["event_store"], r.store)
            taste = pooled if pooled.data.shape[1] == self.dim else A.total(A.reshape(pooled, len(r.label), self.heads, self.dim), axis=1)
            z = z + A.relu(A.concat([pooled, own, own * taste]) @ p["w_over_1"] + p["b_over_1"]) @ p["w_over_2"]
        return A.reshape(z, len(r.label))


def recall_of(model: Ranker, rows: Rows, sizes: dict, k: int) -> float:
    """Mean recall at k over the users that have targets, listed or not. sizes: targets by user."""
    score = np.concatenate([model.logits(rows.take(slice(q, q + 8192))).data for q in range(0, len(rows.label), 8192)]) if len(rows.label) else np.zeros(0)
    order = np.lexsort((rows.item, -score, rows.user))
    user = rows.user[order]
    start = np.flatnonzero(np.r_[True, user[1:] != user[:-1]]) if len(user) else np.zeros(0, int)
    place = np.arange(len(user)) - np.repeat(start, np.diff(np.r_[start, len(user)]))
    hits: dict = {}
    for u in user[(place < k) & (rows.label[order] == 1)].tolist():
        hits[u] = hits.get(u, 0) + 1
    return float(np.mean([hits.get(u, 0) / n for u, n in sizes.items()])) if sizes else 0.0


def _pass(model: Ranker, steps: A.AdamW, data: Rows, rng: np.random.Generator, pos_weight: float, batch: int) -> float:
    """One epoch over the rows in random order, for sequences users in random order; the summed loss."""
    order, held = rng.permutation(len(data.label)), 0.0
    if model.kind not in ("mlp", "cross"):
        ends = np.flatnonzero(np.r_[data.user[1:] != data.user[:-1], True][: len(data.user)]) + 1
        starts = np.r_[0, ends[:-1]]
        order = np.concatenate([np.arange(starts[g], ends[g]) for g in rng.permutation(len(ends))]) if len(ends) else order
    for q in range(0, len(order), batch):
        part = data.take(order[q : q + batch])
        loss = A.weighted_bce(model.logits(part), part.label, part.weight * np.where(part.label == 1, pos_weight, 1.0))
        loss.backward()
        steps.step()
        held += float(loss.data) * len(part.label)
    return held


def train(data: Rows | Dealt, kind: str, lr: float, epochs: int, pos_weight: float, seed: int = 7, batch: int = 1024, judge=None, patience: int = 2) -> tuple[Ranker, int, list[float]]:
    """(model, epochs, mean loss an epoch); with `judge` its best epoch is kept, without it exactly `epochs` are run."""
    rng, model = np.random.default_rng(seed), Ranker(kind, data.width if isinstance(data, Dealt) else data.numbers.shape[1], seed)
    steps, losses, best, since = A.AdamW(model.p, lr, 1e-5), [], (-1.0, 0, None), 0
    for epoch in range(1, epochs + 1):
        if isinstance(data, Dealt):
            losses.append(data.epoch(model, steps, pos_weight, seed, batch, epoch))
        else:
            losses.append(_pass(model, steps, data, rng, pos_weight, batch) / max(1, len(data.label)))
        if judge is not None:
            value = judge(model)
            if value > best[0]:
                best, since = (value, epoch, {n: p.data.copy() for n, p in model.p.items()}), 0
            else:
                since += 1
                if since >= patience:
                    break
    if judge is None:
        return model, epochs, losses
    for name, data_ in best[2].items():
        model.p[name].data = data_
    return model, best[1], losses


def score(rows: DataFrame, model: Ranker, scale: tuple) -> DataFrame:
    """(user_id, item_id, score) of all rows of `inputs`."""
    shared = rows.sparkSession.sparkContext.broadcast((model.kind, {n: p.data for n, p in model.p.items()}, scale))  # a few MB whatever the input

    def run(batches):
        kind, weights, scale = shared.value
        held = Ranker(kind, len(scale[0]))
        for name, data in weights.items():
            held.p[name] = A.Var(data)
        for batch in batches:
            for q in range(0, batch.num_rows, 4096):
                few = _arrays(batch.slice(q, 4096), scale)
                few = few.take(np.argsort(few.user, kind="stable"))
                yield pa.RecordBatch.from_arrays([pa.array(few.user), pa.array(few.item), pa.array(held.logits(few).data)], names=["user_id", "item_id", "score"])

    return rows.mapInArrow(run, "user_id bigint, item_id bigint, score double")


def select(train_rows: DataFrame, held_rows: DataFrame, held_truth: DataFrame, features: list[str], kinds=("mlp", "cross"), rates=(0.003, 0.01), k: int = 100, epochs: int = 4, max_rows: int = 200_000, max_users: int = 500) -> tuple[list[tuple], tuple, float, tuple]:
    """(table, best, pos_weight, scale): the grid with (kind, rate, epochs, recall) a point, the first of the best, and what a refit needs."""
    scale = moments(train_rows, features)
    n, pos = train_rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    pos_weight = (n - pos) / max(1, pos)
    data, judge = gathered(inputs(train_rows, features), scale, max_rows), held_recall(inputs(held_rows, features), held_truth, scale, k, max_users)
    table = []
    for kind in kinds:
        for rate in rates:
            model, best, _ = train(data, kind, rate, epochs, pos_weight, judge=judge)
            table.append((kind, rate, best, judge(model)))
    chosen = max(table, key=lambda t: t[3])
    return table, chosen, pos_weight, scale


def refit(rows: DataFrame | Rows | Dealt, features: list[str], kind: str, rate: float, epochs: int, pos_weight: float, scale: tuple, max_rows: int = 200_000) -> tuple[Ranker, list[float]]:
    """A model of the frozen kind, rate and epochs on all rows given, or on what `gathered` made of them."""
    model, _, losses = train(gathered(inputs(rows, features), scale, max_rows) if isinstance(rows, DataFrame) else rows, kind, rate, epochs, pos_weight)
    return model, losses
