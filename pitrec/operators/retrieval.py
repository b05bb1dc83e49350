"""Retrieval sources: ranked candidates for each user.

Lists are long: (user_id, item_id, score, rank). Scores are rounded before
ranking where floating-point sums could differ in the last place, and ties go
by item.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitrec.functions.expressions import DAY_MS, decay

from .filtering import cut
from .order import places
from .rounding import r6

BROADCAST_ROWS = 200_000
LONG = 1 << 16  # places of one permutation that a row holds
GRID, BAND = 24, 65_536  # cells of users and items; users that a task holds


def popularity(rows: DataFrame) -> DataFrame:
    """(item_id, score): positives an item."""
    return rows.where("label = 1").groupBy("item_id").agg(F.count("*").cast("double").alias("score"))


def windowed_popularity(rows: DataFrame, as_of: int, days: int) -> DataFrame:
    return popularity(rows.where((F.col("ts") >= as_of - days * DAY_MS) & (F.col("ts") < as_of)))


def decayed_popularity(rows: DataFrame, as_of: int, half_life_days: float) -> DataFrame:
    old = rows.where("label = 1").where(F.col("ts") < as_of)
    return old.groupBy("item_id").agg(r6(F.sum(decay(F.lit(as_of) - F.col("ts"), half_life_days))).alias("score"))


def seen(rows: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id): all of a user's history, positive or not; only of the users asked for."""
    pairs = rows.select("user_id", "item_id")
    return (pairs.join(users.select("user_id").distinct(), "user_id", "left_semi") if users is not None else pairs).distinct()


def ranked_pool(scores: DataFrame, pool: DataFrame) -> DataFrame:
    """(item_id, score, place): the pool by (score desc, item asc), items without a score at 0."""
    full = pool.select("item_id").distinct().join(scores, "item_id", "left").select("item_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return places(full, F.desc("score"), "item_id")


def unseen_gaps(users: DataFrame, scores: DataFrame, pool: DataFrame, seen_pairs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(gaps, head, its depth): for each user stretches (place, last] of one global order that hold the first k unseen items; i seen ones come before.

    No list reaches beyond place k + |seen|, so seen items matter only in that
    head of the order, which is all that joins them. Between two seen places all
    are unseen: place x after i seen ones has rank x - i. A user has at most k gaps.
    """
    order = cut(ranked_pool(scores, pool))
    n = order.count()
    most = seen_pairs.groupBy("user_id").agg(F.count("*").alias("n_seen")).agg(F.coalesce(F.max("n_seen"), F.lit(0))).first()[0]
    deepest = min(n, most + k)
    head = order.where(F.col("place") <= deepest)
    small = deepest <= BROADCAST_ROWS
    gone = seen_pairs.where("user_id is not null").join(F.broadcast(head.select("item_id", "place")) if small else head.select("item_id", "place"), "item_id")
    marks = users.select("user_id").distinct().withColumn("place", F.lit(0).cast("long")).unionByName(gone.select("user_id", "place"))
    own = Window.partitionBy("user_id").orderBy("place")
    gaps = marks.select("user_id", "place", (F.dense_rank().over(own) - 1).alias("i"), F.lead("place", 1, n + 1).over(own).alias("next"), F.first("place").over(own).alias("first")).where("first = 0")  # asked for
    gaps = gaps.withColumn("last", F.least(F.col("next") - 1, F.col("i") + k)).where("last > place")
    return gaps, head, deepest


def top_unseen(users: DataFrame, scores: DataFrame, pool: DataFrame, seen_pairs: DataFrame, k: int) -> DataFrame:
    """Each user's first k unseen items of one global order.

    The gaps are written out where the user lies. Lists are not shuffled, ranked or
    anti-joined. Exact. Of a head above BROADCAST_ROWS only that many are broadcast;
    the deeper places of users with such histories join the order.
    """
    gaps, head, deepest = unseen_gaps(users, scores, pool, seen_pairs, k)
    wanted = gaps.select("user_id", "i", F.explode(F.sequence(F.col("place") + 1, F.col("last"))).alias("place"))
    if deepest <= BROADCAST_ROWS:
        pairs = wanted.join(F.broadcast(head), "place")
    else:
        near = F.col("place") <= BROADCAST_ROWS
        pairs = wanted.where(near).join(F.broadcast(head.where(near)), "place")
        pairs = pairs.unionByName(wanted.where(~near).join(head.where(~near), "place").select(*pairs.columns))
    return pairs.select("user_id", "item_id", "score", (F.col("place") - F.col("i")).cast("int").alias("rank"))


def top_k(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Rank by (score desc, item asc) in each user; planned as a partial and a final limit by group."""
    own = Window.partitionBy(*(by or []), "user_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def numbered(pool: DataFrame) -> DataFrame:
    """(item_id, idx): the pool's items from 0 in one fixed order, that of a hash."""
    items = pool.select("item_id").distinct()
    lot = F.substring(F.md5(F.col("item_id").cast("string")), 1, 3)
    return places(items.withColumn("lot", lot), "lot", "item_id").select("item_id", (F.col("place") - 1).alias("idx"))


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def placed(pool: DataFrame, seen_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, known): the pool numbered, and (user_id, known), the numbers of each user's seen items; what random lists of any seed read."""
    items = cut(numbered(pool))
    near = F.broadcast(items) if items.count() <= BROADCAST_ROWS else items
    return items, cut(seen_pairs.where("user_id is not null").join(near, "item_id").groupBy("user_id").agg(F.collect_set("idx").alias("known")))


def random_top_k(users: DataFrame, pool: DataFrame, seen_pairs: DataFrame, k: int | None, seed: int = 0, ready: tuple | None = None) -> DataFrame:
    """k unseen items a user, the first of a permutation of the pool that is drawn from (seed, user); without k as many as the user's `want`.

    Place i of a user holds item (a + b i) modulo the next prime of the pool's
    size, with a and b hashed from seed and user: a permutation of which only
    the first k + |seen| places, and those that the prime adds, are written out.
    They are written and thinned where the user lies; what is left meets its items,
    of users that want more than LONG places one by one. `ready`: what `placed` made of pool and seen pairs.
    """
    items, known = ready or placed(pool, seen_pairs)
    n = items.count()
    prime = next_prime(max(n, 2))
    lot = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col("user_id").cast("string"))), 1, 12), 16, 10).cast("long")
    asked = users.select("user_id", F.lit(k).alias("want") if k is not None else F.col("want")).distinct().join(known, "user_id", "left")
    none = F.array().cast("array<bigint>")
    asked = asked.select("user_id", F.col("want").cast("long").alias("want"), F.coalesce("known", none).alias("known"), (lot("a") % prime).alias("a"), (1 + lot("b") % (prime - 1)).alias("s"))
    asked = asked.withColumn("depth", F.least(F.size("known") + F.col("want") + (prime - n), F.lit(prime)).cast("int")).where("depth > 0")
    walk = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: (F.col("a") + F.col("s") * i) % prime)
    fresh = F.slice(F.array_except(F.filter(walk, lambda x: x < n), F.col("known")), F.lit(1), F.col("want").cast("int"))
    drawn = asked.where(F.col("depth") <= LONG).select("user_id", F.posexplode(fresh).alias("at", "idx")).select("user_id", "idx", (F.col("at") + 1).alias("rank"))
    if k is None or k + prime - n + (known.agg(F.max(F.size("known"))).first()[0] or 0) > LONG:
        long = asked.where(F.col("depth") > LONG)
        spots = long.select("user_id", "want", "a", "s", F.explode(F.sequence(F.lit(1), "depth")).alias("i")).select("user_id", "want", "i", ((F.col("a") + F.col("s") * F.col("i")) % prime).alias("idx")).where(F.col("idx") < n)
        spots = spots.join(long.select("user_id", F.explode("known").alias("idx")), ["user_id", "idx"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("i")))
        drawn = drawn.unionByName(spots.where(F.col("rank") <= F.col("want")).select("user_id", "idx", "rank"))
    met = drawn.join(F.broadcast(items) if n <= BROADCAST_ROWS else items.hint("shuffle_hash"), "idx")
    return met.select("user_id", "item_id", (F.lit(0.0) - F.col("rank")).alias("score"), "rank")


def facet_affinity(rows: DataFrame, items: DataFrame, facet: str) -> DataFrame:
    """(user_id, facet, affinity): a user's positives in the facet over those in the user's largest one."""
    joined = rows.where("label = 1").join(items.select("item_id", F.col(facet).alias("facet")), "item_id").where("facet is not null")
    counts = joined.groupBy("user_id", "facet").agg(F.count("*").alias("n"))
    return counts.select("user_id", "facet", (F.col("n") / F.max("n").over(Window.partitionBy("user_id"))).alias("affinity"))


def popularity_prior(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """(item_id, prior): positives over the largest count within the pool; every pool item has one."""
    full = pool.select("item_id").distinct().join(popularity(rows), "item_id", "left").select("item_id", F.coalesce("score", F.lit(0.0)).alias("c"))
    most = full.agg(F.greatest(F.max("c"), F.lit(1.0)).alias("m"))
    return full.crossJoin(F.broadcast(most)).select("item_id", (F.col("c") / F.col("m")).alias("prior"))  # one row


def rule_scores(users: DataFrame, rows: DataFrame, items: DataFrame, pool: DataFrame, seen_pairs: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Sum of facet affinities and popularity prior, weighted; the best k unseen items a user.

    weights: {facet: weight, "prior": weight}, none negative.
    """
    from .rules import ranked

    found = ranked(users, rows, items, pool, seen_pairs, [weights], k)
    return top_k(found.select("user_id", "item_id", r6(F.col("score")).alias("score")), k)


def covisitation(rows: DataFrame, basket: int = 30, least: int = 2, neighbours: int = 100, cosine: bool = True) -> DataFrame:
    """(a, b, support, score, place): items that users' last positives hold together.

    The basket limit bounds the pairs of a user. Frequencies are those of the baskets.
    """
    own = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item_id")
    baskets = rows.where("label = 1").withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= basket).select("user_id", "item_id")
    lists = baskets.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("items")).where(F.size("items") > 1)  # at most `basket` a user
    place = F.posexplode("items")
    later = lists.select("items", place.alias("i", "a")).where(F.col("i") < F.size("items") - 1).select("a", F.slice("items", F.col("i") + 2, F.size("items")).alias("bs"))
    met = later.repartition("a").sortWithinPartitions("a")
    kind = rows.schema["item_id"].dataType.simpleString()
    edges = met.mapInArrow(met_often(least), f"a {kind}, b {kind}, support bigint")  # pairs are counted where they are made
    if cosine:
        freq = baskets.groupBy("item_id").agg(F.count("*").alias("f"))
        edges = edges.join(freq.select(F.col("item_id").alias("a"), F.col("f").alias("fa")), "a").join(freq.select(F.col("item_id").alias("b"), F.col("f").alias("fb")), "b")
        edges = edges.select("a", "b", "support", r6(F.col("support") / F.sqrt(F.col("fa").cast("double") * F.col("fb"))).alias("score"))
    else:
        edges = edges.withColumn("score", F.col("support").cast("double"))
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("place") <= neighbours)


def met_often(least: int, most: int = 1 << 20):
    """For batches of (a, later items) in order of a: (a, b, support) and (b, a, support) of the pairs met at least that often.

    Pairs are made and counted an Arrow batch at a time. Of an item that goes on in
    the next batch only counts are held, merged once others have come to `most` or as many.
    """

    def counted(parts):
        a, b, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return a[starts], b[starts], np.add.reduceat(n, starts)

    def run(batches):
        import pyarrow as pa

        def give(a, b, n):
            often = n >= least
            a, b, n = a[often], b[often], n[often]
            return pa.RecordBatch.from_arrays([pa.array(np.r_[a, b]), pa.array(np.r_[b, a]), pa.array(np.r_[n, n])], names=["a", "b", "support"])

        held, merged, waiting = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            item, lists = batch.column(0).to_numpy(), batch.column(1)
            a, b = np.repeat(item, lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            ended = item[0] != item[-1] or (held and held[-1][0][-1] != item[0])
            held.append((a, b, np.ones(len(a), np.int64)))
            waiting += len(a)
            if ended or waiting >= max(most, merged):
                a, b, n = counted(held)
                last = a == item[-1]
                if not last.all():
                    yield give(a[~last], b[~last], n[~last])
                held, merged, waiting = [(a[last], b[last], n[last])], int(last.sum()), 0
        if held:
            yield give(*counted(held))

    return run


def covisitation_top_k(users: DataFrame, rows: DataFrame, edges: DataFrame, pool: DataFrame, seen_pairs: DataFrame, k: int, seeds: int = 5, seed_decay: float = 0.8, per_seed: int = 50, carry: list[str] = ()) -> DataFrame:
    """Neighbours of a user's latest positives, summed with a decay by recency. The cut by seed comes before seen and pool filters; users without seeds get nothing.

    carry: columns of the pool that come along.
    """
    own = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item_id")
    start = rows.where("label = 1").join(users.select("user_id").distinct(), "user_id", "left_semi").withColumn("r", F.row_number().over(own) - 1).where(F.col("r") < seeds).select("user_id", F.col("item_id").alias("a"), "r")
    hits = start.join(edges.where(F.col("place") <= per_seed), "a").select("user_id", F.col("b").alias("item_id"), (F.pow(F.lit(seed_decay), "r") * F.col("score")).alias("part"))
    scored = hits.groupBy("user_id", "item_id").agg(r6(F.sum("part")).alias("score"))
    kept = scored.join(pool.select("item_id", *carry).distinct(), "item_id", "inner" if carry else "left_semi").join(seen_pairs, ["user_id", "item_id"], "left_anti")
    return top_k(kept, k)


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm))


def content_profiles(rows: DataFrame, vectors: DataFrame, last: int = 30, recency: float = 0.8) -> DataFrame:
    """(user_id, profile): unit vector of the last positives' unit vectors with weights falling by recency; an item without a vector uses up its place."""
    own = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item_id")
    recent = rows.where("label = 1").withColumn("r", F.row_number().over(own) - 1).where(F.col("r") < last).select("user_id", "item_id", "r")
    units = vectors.select("item_id", unit(F.col("embedding")).alias("u")).where("u is not null")
    cells = recent.join(units, "item_id").select("user_id", "r", F.posexplode("u").alias("pos", "x"))
    sums = cells.groupBy("user_id", "pos").agg(F.sum(F.pow(F.lit(recency), "r") * F.col("x")).alias("x"))
    whole = sums.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return whole.select("user_id", unit(F.col("v")).alias("profile")).where("profile is not null")


def dense_top_k(profiles: DataFrame, vectors: DataFrame, pool: DataFrame, seen_pairs: DataFrame, k: int, block: int = 4096, group: int = 512) -> DataFrame:
    """Cosine of profiles with the pool's unit vectors, best k unseen, by blocked matrix products.

    Users are dealt into bands of some BAND at most, and items into stripes, at least GRID
    cells where there are that many; each cell is a partition, its users before its items. A
    task holds a band's users, their seen items and best k so far, and lets the stripe's blocks
    pass; products are `group` by `block`. So a vector travels once a stripe or a band, and a
    cell gives at most k items a user.
    """
    units = pool.select("item_id").distinct().join(vectors.select("item_id", unit(F.col("embedding")).alias("u")), "item_id").where("u is not null")
    known = seen_pairs.where("item_id is not null").join(units.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(F.collect_set("item_id").alias("known"))
    asked = profiles.select("user_id", "profile").join(known, "user_id", "left").select("user_id", "profile", F.coalesce("known", F.array().cast("array<bigint>")).alias("known"))
    n_items, n_users = units.count(), profiles.count()
    bands = max(1, -(-n_users // BAND), min(int(GRID**0.5), -(-n_users // group)))
    stripes = max(1, min(-(-GRID // bands), -(-n_items // block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    band, stripe = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("user_id", bands), ("item_id", stripes)))
    left = asked.select(band.alias("band"), every(stripes).alias("stripe"), F.lit(0).alias("kind"), F.col("user_id").alias("id"), F.col("profile").alias("v"), "known")
    right = units.select(every(bands).alias("band"), stripe.alias("stripe"), F.lit(1).alias("kind"), F.col("item_id").alias("id"), F.col("u").alias("v"), F.array().cast("array<bigint>").alias("known"))
    dealt = left.unionByName(right).repartitionById(bands * stripes, F.col("band") * stripes + F.col("stripe")).sortWithinPartitions("band", "stripe", "kind", "id")

    def score(batches):
        import pyarrow as pa

        cell, users, best, items, held = None, [], [], [], 0

        def flush():
            """Lets the items held pass all groups of users."""
            nonlocal items, held
            if items:
                ids, b = np.concatenate([i for i, _ in items]), np.concatenate([v for _, v in items])
                for n, (asked_ids, a, row, item) in enumerate(users):
                    best[n] = best_of(ids, a @ b.T, row, item, best[n], len(asked_ids), k)
            items, held = [], 0

        def done():
            flush()
            for (asked_ids, *_), (row, item, cosine) in zip(users, best):
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[row]), pa.array(item), pa.array(cosine)], names=["user_id", "item_id", "score"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], 1).astype(np.int64)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if (key[lo, 0], key[lo, 1]) != cell:
                    yield from done()
                    cell, users, best = (key[lo, 0], key[lo, 1]), [], []
                for at in range(lo, hi, min(group, block)):
                    part = batch.slice(at, min(min(group, block), hi - at))
                    ids = part.column(3).to_numpy()
                    v = np.asarray(part.column(4).flatten()).reshape(len(ids), -1)
                    if key[lo, 2] == 0:
                        lists = part.column(5)
                        users.append((ids, v, np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())))
                        best.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
                    else:
                        items.append((ids, v))
                        held += len(ids)
                        if held >= block:
                            flush()
        yield from done()

    found = dealt.mapInArrow(score, "user_id bigint, item_id bigint, score double")
    return top_k(found, k)


def best_of(ids, cosines, row, item, before, n: int, k: int):
    """(row, item, cosine): the best k a row of the block's cosines, to six digits, and those before, without the row's seen items; ties by item. `ids` are in order."""
    lo, hi = np.searchsorted(ids, item), np.searchsorted(ids, item, "right")
    at = np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
    cosines[np.repeat(row, hi - lo), at] = -np.inf
    least = np.full(n, -np.inf)  # the k-th best so far: of blocks after the first, few items reach it
    full = np.bincount(before[0], minlength=n) >= k
    if full.any():
        worst = np.full(n, np.inf)
        np.minimum.at(worst, before[0], before[2])
        least[full] = worst[full]
    if not full.all() and len(ids) > k:
        least[~full] = np.partition(cosines[~full], len(ids) - k, axis=1)[:, len(ids) - k]
    r, c = np.divmod(np.flatnonzero(cosines >= np.maximum(least - 1e-6, -2.0)[:, None]), len(ids))
    rows, items, values = np.concatenate([before[0], r]), np.concatenate([before[1], ids[c]]), np.concatenate([before[2], np.round(cosines[r, c], 6)])
    order = np.lexsort((items, -values, rows))
    rows, items, values = rows[order], items[order], values[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], items[kept], values[kept]


def pool(items: DataFrame, flag: str | None = None) -> DataFrame:
    """(item_id) where the membership flag is 1; all items without a flag."""
    return (items.where(F.col(flag) == 1) if flag else items).select("item_id").distinct()


def eligible(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item_id")


def ranked_lists(scored: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(model, user_id, item_id, score, rank): a list for each score column, in one unpivot."""
    long = scored.select("user_id", "item_id", F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("score")) for c in columns])).alias("x")).select("x.model", "user_id", "item_id", "x.score")
    return top_k(long, k, ["model"])
