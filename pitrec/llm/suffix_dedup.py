"""Suffix-array dedup: every byte covered by a string of `length` bytes that also starts elsewhere goes.

Steps, each over whole texts as UTF-8 bytes:

1. Equal texts collapse by digest; all of a text with copies (and at least
   `length` bytes) is covered.
2. Each window of `length` bytes selects the smallest hash among its k-grams
   (the rightmost of equals), so equal windows select the same place: the
   anchors. Anchors whose k-gram occurs once in the corpus drop out.
3. For the others the suffix from the anchor and the bytes before it are
   written into sorted, front-coded runs, dealt by the k-gram's hash.
4. Runs are combined by a loser tree that carries each head's common prefix
   with the last output and compares bytes only beyond it. In the merged order
   common prefixes forward, and those of the reversed bytes before the anchor,
   tell exactly which of the anchor's windows occur again.
5. The windows' union by text is cut out.

Contexts that one task finds more than once are settled there and travel once.
Contexts of a k-gram that is found in very many places are dealt out further, so
that none of them meets all others: from `ranges_from` places on, each for RANGES
ranges of its windows, by the bytes that all windows of a range share, and shortened
to what the range needs, which makes those inside a common passage alike; from
`exact_from` places on, each window by itself under its digest. The limits
rise with the corpus, which keeps the list of such k-grams below 2 MB.
Null texts count as empty. Repeated rows are copies of each other, and so are rows
of one text whatever their ids; rows without an id lose what their text loses. A
very long text is taken whole, in one task. An empty table gives no rows; extra
columns are kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget_kept, share, slices, table

LENGTH, GRAM = 200, 48
PRIME = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 19  # bytes of text looked at together
RUN_ROWS = 25_000  # contexts sorted together
TASK_MB = 16  # of contexts that a merging task gets
RANGES = 8  # of windows of a frequent k-gram
HOT_GRAMS = 100_000  # at most, told apart
PLACE_BITS = 31  # of a batch; the other bits of a hash select the anchor, the same in every batch


class Anchors:
    """Selects the anchors of texts, vectorised over many of them."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.n = length, gram, 0

    def __call__(self, raws: list[bytes]):
        """For all texts together: text number, anchor, lowest and highest distance to a window's start, hash."""
        size = np.array([len(r) for r in raws], dtype=np.int64)
        buf = np.frombuffer(b"".join(raws), dtype=np.uint8)
        n, w = len(buf), self.length - self.gram + 1
        if n < self.length:
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
        if n + 1 > self.n:
            self.n = max(CHUNK * 2, n + 1)
            base = np.full(self.n, PRIME, dtype=np.uint64)
            base[0] = 1
            self.up = np.cumprod(base, dtype=np.uint64)
            base[1:] = pow(PRIME, -1, 1 << 64)
            self.down = np.cumprod(base, dtype=np.uint64)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[self.gram :] - total[: n - self.gram + 1]) * self.down[: n - self.gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        if n >> PLACE_BITS:
            raise ValueError("a batch of 2 GB or more")
        low = np.uint64((1 << PLACE_BITS) - 1)
        best = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        span = 1
        while span * 2 <= w:
            best = np.minimum(best[: len(best) - span], best[span:])
            span *= 2
        if span < w:
            best = np.minimum(best[: len(best) - (w - span)], best[w - span :])
        place = (low - (best & low)).astype(np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        first, last = starts, ends - self.length  # window starts of a text, inclusive
        inside = np.zeros(n + 1, dtype=np.int8)
        some = np.flatnonzero(last >= first)
        inside[first[some]] += 1
        np.add.at(inside, last[some] + 1, -1)
        valid = np.flatnonzero(np.cumsum(inside[: len(place)], dtype=np.int8))
        if not len(valid):
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
        anchor = place[valid]
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        a, p0, p1 = anchor[new], valid[new], valid[np.r_[new[1:] - 1, len(valid) - 1]]
        text = np.searchsorted(ends, a, side="right")
        return text, a - starts[text], a - p1, a - p0, h[a]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def write_run(rows: list[tuple]) -> bytes:
    """Rows (forward, backward, text, place, low, high), sorted; forward is front-coded, backward as well where it follows an equal forward."""
    n = len(rows)
    lcp, rest, back = np.zeros(n, np.int32), [], []
    last = b""
    for k, row in enumerate(rows):
        lcp[k] = common_prefix(last, row[0])
        rest.append(row[0][lcp[k] :])
        back.append(row[1])
        last = row[0]
    fixed = [lcp, np.array([len(x) for x in rest], np.int32), np.array([len(x) for x in back], np.int32)]
    fixed += [np.array([r[c] for r in rows], np.int32) for c in (3, 4, 5)]
    owner = np.array([r[2] for r in rows], np.int64)
    return b"".join([np.int64(n).tobytes(), owner.tobytes(), *(x.tobytes() for x in fixed), *rest, *back])


def read_run(blob: bytes):
    """(lcp, forward, backward, text, place, low, high) in order."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    owner = np.frombuffer(blob, np.int64, n, 8).tolist()
    lcp, n_rest, n_back, place, low, high = (x.tolist() for x in np.frombuffer(blob, np.int32, 6 * n, 8 + 8 * n).reshape(6, n))
    at = 8 + 32 * n
    behind = at + sum(n_rest)
    last = b""
    for k in range(n):
        last = last[: lcp[k]] + blob[at : at + n_rest[k]]
        at += n_rest[k]
        yield lcp[k], last, blob[behind : behind + n_back[k]], owner[k], place[k], low[k], high[k]
        behind += n_back[k]


def merge_runs(runs: list):
    """All rows of sorted runs in order, each with its common prefix with the row before.

    A loser tree: every head carries its common prefix with the last output,
    which decides most matches; only equal ones compare bytes, beyond it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0 if h is not None else -1 for h in heads]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = heads[a][1], heads[b][1]
        m = common_prefix(x, y, known[a])
        if x[m:] <= y[m:]:
            known[b] = m
            return a, b
        known[a] = m
        return b, a

    tree = [0] * k
    level = list(range(k))
    while len(level) > 1:
        up, half = [], len(level) // 2
        for q in range(half):
            win, lose = play(level[2 * q], level[2 * q + 1])
            tree[half + q] = lose
            up.append(win)
        level = up
    win = level[0]
    while heads[win] is not None:
        row = heads[win]
        yield (known[win], *row[1:])
        heads[win] = row = next(runs[win], None)
        known[win] = row[0] if row is not None else -1
        node = (win + k) // 2
        while node:
            other = tree[node]
            win, tree[node] = play(win, other)
            node //= 2


def repeated_windows(group: list[tuple], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(text, first covered byte, last + 1) of a group of rows with one k-gram, in forward order.

    Row: (lcp, forward, backward, text, place, low, high). Text -1 marks a
    context that occurs more than once and whose places are already settled.
    A high of -1 marks rows that stand for one window each, at distance low.
    """
    if group[0][6] < 0:
        return _equal_windows(group, length)
    where: dict[tuple[bytes, bytes], int] = {}
    contexts, owners, shared, running = [], [], [], 1 << 30
    for lcp, forward, backward, text, place, low, high in group:
        running = min(running, lcp)
        at = where.get((forward, backward))
        if at is None:
            at = where[forward, backward] = len(contexts)
            contexts.append((running, forward, backward, low, high))
            owners.append(set())
            shared.append(False)
            running = 1 << 30
        if text < 0:
            shared[at] = True
        else:
            owners[at].add((text, place))
    out, open_ = [], []
    for at, ((_, _, _, low, high), own) in enumerate(zip(contexts, owners)):
        if len(own) > 1 or shared[at]:
            out += [(t, p - high, p - low + length) for t, p in own]
        elif own:
            open_.append(at)
    if not open_ or len(contexts) < 2:
        return out
    if len(contexts) == 2:
        f = contexts[1][0]
        b = common_prefix(contexts[0][2], contexts[1][2])
        found = {at: (max(length - f, contexts[at][3]), min(b, contexts[at][4])) for at in open_}
    else:
        found = _many(contexts, length)
    for at in open_:
        least, most = found[at]
        if least <= most:
            ((text, place),) = owners[at]
            out.append((text, place - most, place - least + length))
    return out


def _equal_windows(group: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """The same for rows of one window, which repeat where their forward parts are equal; these are neighbours."""
    out, at = [], 0
    while at < len(group):
        end, forward = at + 1, group[at][1]
        while end < len(group) and group[end][1] == forward:
            end += 1
        own = {(row[3], row[4], row[5]) for row in group[at:end] if row[3] >= 0}
        if len(own) > 1 or any(row[3] < 0 for row in group[at:end]):
            out += [(text, place - low, place - low + length) for text, place, low in own]
        at = end
    return out


def _many(contexts: list[tuple], length: int) -> list[tuple[int, int]]:
    """For each context the least and the largest distance whose window occurs in another one.

    Contexts that agree on `length - t` bytes forward are neighbours in forward
    order, those that agree on t bytes backward in backward order; for each t
    the two give class numbers, and a window repeats where a pair of them does.
    """
    m = len(contexts)
    ahead = np.array([-1, *(c[0] for c in contexts[1:])])
    order = sorted(range(m), key=lambda k: contexts[k][2])
    behind = np.array([-1, *(common_prefix(contexts[a][2], contexts[b][2]) for a, b in zip(order[:-1], order[1:]))])
    rank = np.empty(m, dtype=np.int64)
    rank[order] = np.arange(m)
    low, high = (np.array([c[k] for c in contexts]) for k in (3, 4))
    least, most = np.full(m, 1 << 30), np.full(m, -1)
    every = np.arange(low.min(), high.max() + 1)
    step = max(1, (1 << 20) // m)
    for at in range(0, len(every), step):
        t = every[at : at + step, None]
        forward = np.cumsum(ahead[None, :] < length - t, axis=1)
        backward = np.cumsum(behind[None, :] < t, axis=1)[:, rank]
        key = forward * (m + 1) + backward
        by = np.argsort(key, axis=1, kind="stable")
        key = np.take_along_axis(key, by, axis=1)
        same = key[:, 1:] == key[:, :-1]
        twice = np.zeros(key.shape, dtype=bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        hit = np.zeros(key.shape, dtype=bool)
        np.put_along_axis(hit, by, twice, axis=1)
        hit &= (t >= low) & (t <= high)
        least = np.minimum(least, np.where(hit, t, 1 << 30).min(axis=0))
        most = np.maximum(most, np.where(hit, t, -1).max(axis=0))
    return list(zip(least.tolist(), most.tolist()))


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(text, start, end) without those that overlap or touch."""
    out: list[tuple[int, int, int]] = []
    for text, s, e in sorted(spans):
        if out and out[-1][0] == text and s <= out[-1][2]:
            if e > out[-1][2]:
                out[-1] = (text, out[-1][1], e)
        else:
            out.append((text, s, e))
    return out


def _runs(rows: list[tuple], parts: int, length: int):
    """Contexts (part, forward, backward, text, place, low, high) as settled spans and as front-coded runs by part."""
    seen: dict[tuple, list] = {}
    for part, forward, backward, text, place, low, high in rows:
        seen.setdefault((part, forward, backward), []).append((text, place, low, high))
    spans, by_part = [], {}
    for (part, forward, backward), own in seen.items():
        places = {(t, p) for t, p, _, _ in own}
        _, _, low, high = own[0]
        if len(places) > 1:
            spans += [(t, p - (high if high >= 0 else low), p - low + length) for t, p in places]
            by_part.setdefault(part, []).append((forward, backward, -1, 0, low, high))
        else:
            by_part.setdefault(part, []).append((forward, backward, *own[0]))
    return joined(spans), [(part, write_run(sorted(kept))) for part, kept in by_part.items()]


_EXCHANGE = "part int, run binary, tid bigint, s bigint, e bigint"


def _exchange_batch(spans: list, runs: list) -> pa.RecordBatch:
    n, m = len(spans), len(runs)
    columns = [
        pa.array([t % (1 << 31) for t, _, _ in spans] + [p for p, _ in runs], pa.int32()),
        pa.array([None] * n + [r for _, r in runs], pa.binary()),
        *(pa.array([x[c] for x in spans] + [None] * m, pa.int64()) for c in range(3)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "run", "tid", "s", "e"])

def _dealt(raw: bytes, a: int, low: int, high: int, h: int, level: int, parts: int, length: int, gram: int):
    """(part, forward, backward, low, high) of an anchor's contexts: one, one a range of windows, or one a window."""
    if level == 0:
        yield h % parts, raw[a : a + length - low], raw[a - high : a][::-1], low, high
    elif level == 1:
        most = length - gram + 1
        for r in range(RANGES):
            first, last = most * r // RANGES, most * (r + 1) // RANGES - 1
            t0, t1 = max(low, first), min(high, last)
            if t0 <= t1:
                shared = raw[a - first : a + length - last]  # in all windows of the range
                yield zlib.crc32(shared, (h ^ r) & 0xFFFFFFFF) % parts, raw[a : a + length - t0], raw[a - t1 : a][::-1], t0, t1
    else:
        lead = raw[a : a + gram]
        for t in range(low, high + 1):
            digest = hashlib.md5(raw[a - t : a - t + length], usedforsecurity=False).digest()
            yield int.from_bytes(digest[:6], "little") % parts, lead + digest, b"", t, -1


def bit_set(keys: DataFrame, key: str, most_bits: int = 28):
    """A broadcast bit set of hashed keys, of at most 2 ** most_bits bits (32 MB); 16 bits a key while that lasts."""
    bits = min(most_bits, max(16, (16 * max(1, keys.count())).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    words = keys.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    held = np.zeros(1 << (bits - 6), dtype=np.int64)
    held[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return bits, share(keys.sparkSession, held.view(np.uint8))


def sieve(rows: DataFrame, known, key: str, inside: bool = True) -> DataFrame:
    """The rows whose key may be in the bit set, or with inside=False all others. A full bit set lets rows through that a join turns away, never the reverse."""
    bits, shared = known

    @F.pandas_udf("boolean")
    def may_be(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared()
        for p in places:
            p = p.to_numpy()
            yield pd.Series(((held[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1) == inside)

    return rows.where(may_be(F.pmod(F.xxhash64(key), F.lit(1 << bits))))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, ranges_from: int = 4096, exact_from: int = 65_536) -> DataFrame:
    """(dig, whole, ranges): what goes from each distinct text that loses anything.

    dig: the first 16 bytes of the text's SHA-256. whole: all of it, since it has copies. ranges: (s, e) in bytes.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(src.dtypes)["id"]

    def anchors(batches):
        forget_kept()
        select = Anchors(length, gram)
        for batch in batches:
            for few in slices(batch, 1, CHUNK):
                part = [t.encode("utf-8", "surrogatepass") for t in few.column(1).to_pylist()]
                text, place, _, _, h = select(part)
                ends = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        few.column(0),
                        pa.array([hashlib.sha256(r).digest()[:16] for r in part], pa.binary()),
                        pa.array([len(r) for r in part], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))),
                    ],
                    names=["id", "dig", "n", "place", "h"],
                )

    found = src.mapInArrow(anchors, f"id {kind}, dig binary, n bigint, place array<int>, h array<bigint>")
    one = found.groupBy("dig").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("place").alias("place"), F.first("h").alias("h"))
    texts = cut(one.withColumn("tid", F.monotonically_increasing_id()))  # numbers are fixed by the checkpoint
    each = texts.select("tid", F.explode(F.arrays_zip("place", "h")).alias("x")).select("tid", "x.place", "x.h")
    often = cut(each.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))  # cut, so that a hot k-gram's join can be split
    wanted = cut(each.join(often, "h", "left_semi").groupBy("tid").agg(F.sort_array(F.collect_list("place")).alias("place")))
    n_places = often.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    limits = [max(x, n_places // HOT_GRAMS) for x in (ranges_from, max(ranges_from, exact_from))]
    level = F.when(F.col("k") >= limits[1], 2).when(F.col("k") >= limits[0], 1).otherwise(0)
    sizes = F.when(level == 2, 64 * (length - gram)).when(level == 1, 400 * RANGES).otherwise(400)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(often.agg(F.sum(F.col("k") * sizes)).first()[0] or 0) // (TASK_MB << 20)))
    hot = often.select("h", level.cast("byte").alias("level")).where("level > 0").toArrow()  # at most HOT_GRAMS rows, by the limits
    hot_h = hot.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hot_h)
    hot_grams = share(spark, (hot_h[order], hot.column("level").to_numpy()[order]))
    ask = wanted.join(texts.select("tid", "dig", "id"), "tid").select("tid", "dig", F.col("id").alias("rid"), "place")
    sieved = sieve(src.withColumn("dig", F.substring(F.unhex(F.sha2("text", 256)), 1, 16)), bit_set(ask, "dig"), "dig")
    with_text = sieved.join(ask, "dig").where(F.col("id").eqNullSafe(F.col("rid"))).select("tid", "text", "place")

    def contexts(batches):
        forget_kept()
        select, rows, (frequent, level_of) = Anchors(length, gram), [], hot_grams()
        for batch in batches:
            for few in slices(batch, 1, CHUNK):
                tids = few.column(0).to_pylist()
                part = [t.encode("utf-8", "surrogatepass") for t in few.column(1).to_pylist()]
                text, place, low, high, h = select(part)
                lists = few.column(2)
                ask_text = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
                ask_place = lists.flatten().to_numpy()
                use = np.flatnonzero(np.isin(text << 40 | place, ask_text.astype(np.int64) << 40 | ask_place.astype(np.int64)))
                levels = np.zeros(len(use), dtype=np.int8)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, h[use]), len(frequent) - 1)
                    levels = np.where(frequent[at] == h[use], level_of[at], 0)
                for t, a, lo, hi, key, lev in zip(text[use].tolist(), place[use].tolist(), low[use].tolist(), high[use].tolist(), h[use].tolist(), levels.tolist()):
                    for p, forward, backward, t0, t1 in _dealt(part[t], a, lo, hi, key, lev, parts, length, gram):
                        rows.append((p, forward, backward, tids[t], a, t0, t1))
                    if len(rows) >= RUN_ROWS:
                        yield _exchange_batch(*_runs(rows, parts, length))
                        rows = []
        if rows:
            yield _exchange_batch(*_runs(rows, parts, length))

    exchanged = with_text.mapInArrow(contexts, _EXCHANGE).repartition(parts, "part").sortWithinPartitions("part")

    def merged(batches):
        forget_kept()
        held, out, now = [], [], None

        def settle() -> None:
            group: list[tuple] = []
            for row in merge_runs([read_run(b) for b in held]):
                if row[0] < gram and group:
                    if len(group) > 1 or group[0][3] < 0:
                        out.extend(repeated_windows(group, length))
                    group = []
                group.append(row)
            if len(group) > 1:
                out.extend(repeated_windows(group, length))

        def flush() -> pa.RecordBatch:
            fewer = joined(out)
            batch = pa.RecordBatch.from_arrays([pa.array([x[c] for x in fewer], pa.int64()) for c in range(3)], names=["tid", "s", "e"])
            out.clear()
            return batch

        for batch in batches:
            for part, run, tid, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None:
                    out.append((tid, s, e))
                    continue
                if part != now and held:
                    settle()
                    held = []
                now = part
                held.append(run)
                if len(out) >= 100_000:
                    yield flush()
        if held:
            settle()
        if out:
            yield flush()

    ranges = exchanged.mapInArrow(merged, "tid bigint, s bigint, e bigint").groupBy("tid").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    whole = F.expr(f"copies > 1 and n >= {length}")
    out = texts.select("tid", "dig", whole.alias("whole")).join(ranges, "tid", "left").where("whole or ranges is not null")
    return out.select("dig", "whole", F.when(~F.col("whole"), F.col("ranges")).alias("ranges"))


def union(ranges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        s, e = max(0, s), min(n, e)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif s < e:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, as_text: bool = False, keep_text: bool = True, ranges_from: int = 4096, exact_from: int = 65_536) -> DataFrame:
    """The rows with `kept` (what stays), `n_bytes`, `n_removed` and `n_spans`, which replace columns of these names.

    kept is binary, or with `as_text` a string without the characters that a cut divides.
    Without `keep_text` the text column itself is left out, and not shuffled beside its bytes.
    """
    gone = cut(spans(docs, id_col, text_col, length, gram, ranges_from, exact_from)).withColumnsRenamed({"dig": "__dig", "whole": "__whole", "ranges": "__ranges"})
    own = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans") and (keep_text or c != text_col)]
    src = docs.select(*own, F.col(text_col).alias("__text"))
    src = src.withColumn("__raw", F.coalesce(F.col("__text").cast("string"), F.lit("")).cast("binary")).drop("__text").withColumn("__dig", F.substring(F.unhex(F.sha2("__raw", 256)), 1, 16))
    known = bit_set(gone, "__dig")
    touched = sieve(src, known, "__dig").join(gone, "__dig", "left").drop("__dig")
    size, none = F.octet_length("__raw").cast("bigint"), F.lit(0).cast("bigint")
    rest = sieve(src, known, "__dig", inside=False).select(*own, (F.col("__raw").cast("string") if as_text else F.col("__raw")).alias("kept"), size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"))
    fields = [f"`{c}` {t}" for c, t in src.select(*own).dtypes]

    def run(batches):
        for batch in (few for batch in batches for few in slices(batch, len(own))):
            raws, whole, ranges = (c.to_pylist() for c in batch.columns[-3:])
            kept, n, lost, count = [], [], [], []
            for raw, w, some in zip(raws, whole, ranges):
                cuts = [(0, len(raw))] if w else union([(x["s"], x["e"]) for x in some or ()], len(raw))
                at, left = 0, []
                for s, e in cuts:
                    left.append(raw[at:s])
                    at = e
                left.append(raw[at:])
                kept.append("".join(x.decode("utf-8", "ignore") for x in left) if as_text else b"".join(left))
                n.append(len(raw))
                lost.append(len(raw) - sum(map(len, left)))
                count.append(len(cuts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (n, lost, count))], names=[*own, "kept", "n_bytes", "n_removed", "n_spans"])

    return rest.unionByName(touched.mapInArrow(run, ", ".join([*fields, "kept string" if as_text else "kept binary", "n_bytes bigint", "n_removed bigint", "n_spans bigint"])))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
