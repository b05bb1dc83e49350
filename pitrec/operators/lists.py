"""Lists of several sources, one row a user.

A user's list is bounded by the sources' depths. What decides it is small: the gaps of
global orders (`retrieval.unseen_gaps`), rows of other sources, and targets. These come
together by user, and the list is written out there, with its labels: candidates are
neither shuffled, grouped nor sorted, now or by queries that evaluate a user's list.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval

ROWS = 100_000  # of lists that are made at a time
GIVEN, TARGET = 100, 200  # kinds of rows; below GIVEN gaps of a source


def _tagged(df: DataFrame, kind: int, item=None, x=None, a=None, b=None, n=None) -> DataFrame:
    parts = {"item_id": (item, "long"), "x": (x, "double"), "a": (a, "long"), "b": (b, "long"), "n": (n, "long")}
    return df.select("user_id", F.lit(kind).alias("kind"), *[(F.lit(None) if c is None else F.col(c)).cast(t).alias(name) for name, (c, t) in parts.items()])


def user_lists(users: DataFrame, orders: dict[str, DataFrame], given: dict[str, DataFrame], pool: DataFrame, seen_pairs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user_id, n_history_events, list) of each user with candidates.

    orders: {source: (item_id, score)}, of which a user gets the first k unseen items;
    given: {source: (user_id, item_id, score, rank, n)}; pool: (item_id, n). `list` has, in
    order of items, item_id, {source}_score and {source}_rank (0: absent), label and
    item_n_reviews, the pool's n. truth: (user_id, item_id, n_history_events).
    """
    names, parts, heads = [*orders, *given], [], []
    sizes = pool.select("item_id", "n")
    for s, scores in enumerate(orders.values()):
        gaps, head, deepest = retrieval.unseen_gaps(users, scores, pool, seen_pairs, k)
        most = retrieval.BROADCAST_ROWS
        near = head.where(F.col("place") <= most).join(sizes, "item_id", "left").select("place", "item_id", "score", F.coalesce("n", F.lit(0)).alias("n")).toArrow().sort_by("place")  # at most BROADCAST_ROWS
        heads.append((near["item_id"].is_null().to_numpy(), near["item_id"].fill_null(0).to_numpy(), near["score"].to_numpy(), near["n"].to_numpy()))
        parts.append(_tagged(gaps.withColumn("last", F.least("last", F.lit(most))).where("last > place"), s, a="place", b="last", n="i"))
        if deepest > most:
            far = gaps.where(F.col("last") > most).select("user_id", "i", F.explode(F.sequence(F.greatest(F.col("place") + 1, F.lit(most + 1)), "last")).alias("place"))
            far = far.join(head.where(F.col("place") > most), "place").join(sizes, "item_id", "left").withColumns({"rank": F.col("place") - F.col("i"), "n": F.coalesce("n", F.lit(0))})
            parts.append(_tagged(far, GIVEN + s, "item_id", "score", "rank", n="n"))
    parts += [_tagged(df, GIVEN + s, "item_id", "score", "rank", n="n") for s, df in enumerate(given.values(), len(orders))]
    targets = truth.groupBy("user_id", "item_id").agg(F.max("n_history_events").alias("h"))
    parts.append(_tagged(targets, TARGET, "item_id", a="h"))
    shared = users.sparkSession.sparkContext.broadcast(heads)
    dealt = reduce(DataFrame.unionByName, parts).repartition("user_id").sortWithinPartitions("user_id", "kind")
    fields = ", ".join(f"{s}_score: double, {s}_rank: int" for s in names)
    return dealt.mapInArrow(written(shared, names, k), f"user_id bigint, n_history_events bigint, list array<struct<item_id: bigint, {fields}, label: int, item_n_reviews: bigint>>")


def written(shared, names: list[str], k: int):
    """For batches of tagged rows in order of users: a row a user with its list."""

    def give(rows: pa.Table):
        nobody, user = rows["user_id"].is_null().to_numpy(), rows["user_id"].fill_null(0).to_numpy()
        first = np.r_[True, (user[1:] != user[:-1]) | (nobody[1:] != nobody[:-1])]
        at, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        step = max(1, ROWS // (k * len(names)))
        for lo in range(0, len(starts), step):
            a, b = starts[lo], starts[lo + step] if lo + step < len(starts) else len(user)
            yield one(rows.slice(a, b - a), at[a:b] - lo, user[starts[lo : lo + step]], nobody[starts[lo : lo + step]])

    def one(rows, at, user, nobody):
        heads = shared.value
        kind = rows["kind"].to_numpy()
        cols = {c: rows[c].fill_null(0).to_numpy() for c in ("item_id", "x", "a", "b", "n")}
        no_item = rows["item_id"].is_null().to_numpy()
        long = []  # (user's place, no item, item, source, score, rank, n)
        for s, (none, item, score, n) in enumerate(heads):
            is_gap = kind == s
            size = cols["b"][is_gap] - cols["a"][is_gap]
            ends = np.cumsum(size)
            place = np.arange(size.sum()) + np.repeat(cols["a"][is_gap] - (ends - size), size)  # from 0
            long.append((np.repeat(at[is_gap], size), none[place], item[place], np.full(len(place), s), score[place], place + 1 - np.repeat(cols["n"][is_gap], size), n[place]))
        other = kind >= GIVEN
        source = np.where(kind[other] == TARGET, len(names), kind[other] - GIVEN)
        long.append((at[other], no_item[other], cols["item_id"][other], source, cols["x"][other], cols["a"][other], cols["n"][other]))
        u, none, item, source, score, rank, n = (np.concatenate(x) for x in zip(*long))
        order = np.lexsort((item, none, u))
        u, none, item, source, score, rank, n = (x[order] for x in (u, none, item, source, score, rank, n))
        new = np.ones(len(u), dtype=bool)
        new[1:] = (u[1:] != u[:-1]) | (none[1:] != none[:-1]) | (item[1:] != item[:-1])
        g, start = np.cumsum(new) - 1, np.flatnonzero(new)
        target = source == len(names)
        label, listed, held = np.zeros(len(start), np.int32), np.zeros(len(start), bool), np.zeros(len(start), np.int64)
        label[g[target]] = 1
        listed[g[~target]] = True
        held[g[~target]] = n[~target]
        label[none[start] | nobody[u[start]]] = 0
        history = np.zeros(len(user), np.int64)
        np.maximum.at(history, u[target], rank[target])
        history[nobody] = 0
        arrays, fields = [pa.array(item[start][listed], mask=none[start][listed])], ["item_id"]
        for s, name in enumerate(names):
            own, ranks, scores = source == s, np.zeros(len(start), np.int32), np.zeros(len(start))
            ranks[g[own]], scores[g[own]] = rank[own], score[own]
            arrays += [pa.array(scores[listed], mask=ranks[listed] == 0), pa.array(ranks[listed])]
            fields += [f"{name}_score", f"{name}_rank"]
        cells = pa.StructArray.from_arrays([*arrays, pa.array(label[listed]), pa.array(held[listed])], names=[*fields, "label", "item_n_reviews"])
        size = np.bincount(u[start][listed], minlength=len(user))
        some = size > 0
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[some])].astype(np.int32)), cells)
        return pa.RecordBatch.from_arrays([pa.array(user[some], mask=nobody[some]), pa.array(history[some]), lists], names=["user_id", "n_history_events", "list"])

    def run(batches):
        held = []  # rows of the last user so far
        for batch in batches:
            if not batch.num_rows:
                continue
            user = batch.column(0)
            last = user[-1]
            same = user.is_null().to_numpy(zero_copy_only=False) if not last.is_valid else (user.fill_null(last.as_py() - 1).to_numpy() == last.as_py())
            begin = batch.num_rows - int(same.sum())
            if begin or (held and held[-1].column(0)[-1] != last):
                yield from give(pa.Table.from_batches([*held, batch.slice(0, begin)]).combine_chunks())
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from give(pa.Table.from_batches(held).combine_chunks())

    return run


def candidates(lists: DataFrame, names: list[str]) -> DataFrame:
    """The lists' rows as of `candidates.union_sources`, with label, n_history_events and item_n_reviews."""
    rows = lists.select("user_id", "n_history_events", F.inline("list"))
    present = {s: (F.col(f"{s}_rank") > 0).cast("int") for s in names}
    ranks = [F.when(F.col(f"{s}_rank") > 0, F.col(f"{s}_rank")) for s in names]
    return rows.select(
        "user_id", "item_id", *[f"{s}_score" for s in names], *[c.alias(f"source_{s}") for s, c in present.items()], *[f"{s}_rank" for s in names],
        reduce(lambda a, b: a + b, present.values()).alias("num_sources"), (F.least(*ranks) if len(ranks) > 1 else ranks[0]).alias("best_rank"), "label", "n_history_events", "item_n_reviews",
    )
