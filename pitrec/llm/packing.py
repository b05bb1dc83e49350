"""Best-fit packing of token sequences by exact-complement hashing.

1. Tasks tokenise whole texts, append the end id, cut what is longer than the
   capacity (the first piece takes the remainder) and give a row a piece.
2. Lengths are counted: at most `capacity` counts, whatever the corpus' size.
3. `plan` packs these counts. For each length from the longest down it looks up
   what fills its gap exactly: one length, a pair from the table of pair sums, or
   a triple as a length and a pair. A combination is consumed as often as the
   counts allow. What has no exact complement is placed by best fit, in order of
   decreasing length, into bins that are held as counts by gap. Four such plans
   are made, with complements of up to 0, 1, 2 and 3 pieces; that of the fewest
   sequences is taken. A plan is a list of patterns (lengths with multiplicity,
   number of sequences), one row a pattern and length.
4. A piece's rank among those of its length comes from its place in its partition
   and the partition's offset; the ranks of a length are dealt to the patterns
   in turn, which gives its sequence and its place there.

The plan is the only thing that is broadcast; it has at most some thousand rows,
as each step uses up a length or a bin size. No task sees all pieces of a length.

Null and empty texts are one end id. Repeated rows are packed each; null ids stay.
Very long texts are tokenised whole. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kept_in_worker, share, slices, table
from .token_ids import TokenIds

CAPACITY, END = 1024, 2
PART_SHIFT = 33  # fixed value: the bits of a monotonically increasing id that count within a partition


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens: all but the first have `capacity` tokens."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the token ids of whole texts, each followed by `end`, in pieces of at most `capacity`."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        tokens = kept_in_worker(("token ids", path), lambda: TokenIds(path))
        for batch in batches:
            for few in slices(batch, 1, 1 << 20):
                owner, rows, ids = [], [], []
                for k, text in enumerate(few.column(1).to_pylist()):
                    own = np.append(tokens(text or ""), np.uint32(end)).astype("<u4")
                    for number, at in enumerate(starts := cut_points(len(own), capacity)):
                        part = own[at : starts[number + 1] if number + 1 < len(starts) else len(own)]
                        owner.append(k)
                        rows.append((number, at, len(part), zlib.crc32(part.tobytes())))
                        if keep_ids:
                            ids.append(part.astype(np.int32))
                columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(owner, pa.int32())), *columns], names=["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


class Complements:
    """Lengths, pairs and triples of available lengths by their sum."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pair_gone = np.zeros(2 * len(left), dtype=bool)  # sums that no pair makes any more: availability only falls

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int, most: int) -> tuple[int, ...] | None:
        """The pair of this sum with the longest first length of at most `most`."""
        if gap < 2 or self.pair_gone[gap]:
            return None
        a = np.arange(min(gap - 1, len(self.left) - 1), (gap - 1) // 2, -1)
        found = np.flatnonzero((self.left[a] > 0) & (self.left[gap - a] > (a * 2 == gap)))
        if not len(found):
            self.pair_gone[gap] = True
            return None
        found = found[a[found] <= most]
        return (int(a[found[0]]), int(gap - a[found[0]])) if len(found) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.left[: max(gap - 1, 0)])[::-1].tolist():
            if 3 * a < gap:
                return None
            rest = self.pair(gap - a, a)
            if rest:
                return (a, *rest)
        return None


def exact_patterns(left: np.ndarray, capacity: int, depth: int) -> list[tuple[dict[int, int], int]]:
    """Patterns that fill a sequence, with up to `depth` pieces beside the longest; takes what they use from `left`."""
    out, index = [], Complements(left)
    find = [index.single, lambda gap: index.pair(gap, gap), index.triple][:depth]
    for length in range(capacity, 0, -1):
        gap = capacity - length
        while left[length]:
            if gap == 0:
                others: tuple[int, ...] | None = ()
            else:
                left[length] -= 1  # the piece itself is no complement of its own
                others = next((o for f in find if (o := f(gap))), None)
                left[length] += 1
            if others is None:
                break
            need: dict[int, int] = {}
            for x in (length, *others):
                need[x] = need.get(x, 0) + 1
            times = min(int(left[x]) // k for x, k in need.items())
            if not times:
                break
            for x, k in need.items():
                left[x] -= k * times
            out.append((need, times))
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit in order of decreasing length; bins of one gap and one content are held as a count."""
    bins: dict[int, list] = {}  # gap: [content, number of bins]
    done = []
    for length in range(capacity, 0, -1):
        n = int(left[length])
        left[length] = 0
        while n:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                gap, content, number = capacity, {}, n
            else:
                content, number = bins[gap].pop()
            fit = min(gap // length, n)
            take = min(number, n // fit)
            n -= take * fit
            if gap != capacity or content:
                if number > take:
                    bins[gap].append((content, number - take))
                elif not bins[gap]:
                    del bins[gap]
            full, rest = {**content, length: content.get(length, 0) + fit}, gap - fit * length
            if rest:
                bins.setdefault(rest, []).append((full, take))
            else:
                done.append((full, take))
    return done + [x for held in bins.values() for x in held]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pieces by length, number of sequences)] that use up the counts."""
    best = None
    for depth in (3, 2, 1, 0):
        left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            left[length] = n
        found = exact_patterns(left, capacity, depth) + best_fit(left, capacity)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
    return best


class Places:
    """Where the pieces of each length go, by rank."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for need, times in patterns:
            offset = 0
            for length in sorted(need, reverse=True):
                rows.append((length, used.get(length, 0), need[length], sequence, offset))
                used[length] = used.get(length, 0) + need[length] * times
                offset += need[length] * length
            sequence += times
        rows.sort()
        self.length, self.rank, self.each, self.sequence, self.offset = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
        self.n_sequences = sequence

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length):
            own = np.flatnonzero(length == one)
            a, b = np.searchsorted(self.length, [one, one + 1])
            row = a + np.searchsorted(self.rank[a:b], rank[own], side="right") - 1
            beyond = rank[own] - self.rank[row]
            sequence[own] = self.sequence[row] + beyond // self.each[row]
            offset[own] = self.offset[row] + beyond % self.each[row] * one
        return sequence, offset


def ranked(held: DataFrame) -> DataFrame:
    """Adds `rank`, from 0, among the rows of a length; `held` has `__id`, fixed by a checkpoint, which tells partition and place."""
    keyed = held.withColumn("__part", F.shiftright("__id", PART_SHIFT))
    sizes = keyed.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "__part", F.coalesce(before, F.lit(0)).alias("__before"))  # a row a length and partition
    inside = F.row_number().over(Window.partitionBy("length", "__part").orderBy("__id")) - 1
    return keyed.withColumn("rank", inside).join(offsets, ["length", "__part"]).withColumn("rank", F.col("rank") + F.col("__before")).drop("__part", "__before", "__id")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (column `length`, 1 to capacity) with sequence_id and offset."""
    held = cut(found.withColumn("__id", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    get = share(held.sparkSession, Places(plan(counts, capacity)))
    src = ranked(held)
    names = [c for c in src.columns if c != "rank"]

    def run(batches):
        place = get()
        for batch in batches:
            sequence, offset = place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, parts): the token ids of each sequence, and (offset, length, id, start) of what it holds; `packed` has the column ids."""
    part = F.struct("offset", "length", "id", "start", "ids")
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("held"))  # at most `capacity` tokens
    return held.select("sequence_id", F.expr("flatten(transform(held, p -> p.ids))").alias("ids"), F.expr("transform(held, p -> struct(p.offset, p.length, p.id, p.start))").alias("parts"))


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
