"""A sequenced change applier: numbered changes of many clients, late and with gaps, applied in order by a stateful stream.

Changes of a client are numbered by the dense rank of their sequence values. They
arrive in batches; a stateful Structured Streaming query is started anew for each
on one checkpoint. Its groups are hash buckets of clients. A batch has one tick a
bucket, so that each bucket is called also when nothing came for it. The state of a
bucket is one map from (client, n) to a held change, with the client's own record
(next number, city, balance) at n = 0. A call reads the map, puts all clients of the
bucket into one array in order of client and number (numpy.lexsort) and works on runs
of consecutive numbers and on segments by client; no loop goes over rows.

For a client at number `next`:

* At a batch's start, held changes of which the earliest is overdue (its day + `wait`
  is not after the largest day of earlier batches) let `next` jump to the smallest
  held number, until none is overdue. As all numbers up to the largest overdue one
  and the run it stands in are then passed, one comparison a run decides.
* A change with a number below `next`, or that is held already, is rejected. Only the
  first change of a number (by day, id) can be held, which is known ahead: others go
  to any bucket (by the hash of their id) and are rejected there. So a client with a
  third of all rows brings each of its numbers to its bucket once.
* The run of held numbers that begins at `next` is applied.

Preparation is shuffles and combined aggregates only: rows are made distinct, folded
to one row a client and sequence value, ranked in a global range order (offsets by
partition; no window over a client), and joined back. What reaches the driver are the
largest day of each batch and a row a partition.

Defined results: rows without valid_at, or with an unsigned crc32 of the decimal id
that 11 divides, vanish after numbering (a null id has crc32 0 and vanishes). A null
client is a client; null sequence values rank first. Days before the first batch
belong to batch 1. An op other than I, U or D changes nothing. A balance that is not
finite gives no cents. Rows equal in day and id are taken in the order of their other
columns. Extra columns are ignored (but they tell rows apart); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import cut, scratch, table
from .prefix_trie import crc32_sql

BATCHES, FIRST_DAY, DAYS = 8, 19_723, 160
WAIT = 5  # days
BUCKET_ROWS = 20_000  # changes a bucket gets, on average
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FEED = "bucket int, tick boolean, batch int, overdue bigint, client string, n bigint, first boolean, day bigint, row bigint, op string, city string, balance double"
DONE = "row bigint, client string, n bigint, status string, batch int, missed bigint, op string, city string, balance double"
STATE = "day bigint, row bigint, op string, city string, balance double"


def dense_ranks(folded: DataFrame) -> DataFrame:
    """`folded`, distinct by (client, seq), with n: the rank of seq within its client, from 1, nulls first.

    Rows are ranged over partitions by (client, seq); a client that goes over several continues its count there.
    """
    spark = folded.sparkSession
    order = [F.asc("client"), F.asc_nulls_first("seq")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut(folded.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    held = held.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id")
    # a row a partition: its first and last client, where the last begins, and its size
    edge = held.groupBy("__part").agg(F.min_by(F.struct("client"), "__at").alias("a"), F.max_by(F.struct("client"), "__at").alias("z"), F.count("*").alias("size"))
    begin = held.join(F.broadcast(edge.select("__part", "z")), "__part").where(F.col("client") == F.col("z.client")).groupBy("__part").agg(F.min("__at").alias("last_at"))
    rows = sorted(edge.join(begin, "__part").select("__part", "a", "z", "size", "last_at").collect())  # as many as shuffle partitions
    carried, before = [], 0
    for k, (part, a, z, size, last_at) in enumerate(rows):
        goes_on = k > 0 and rows[k - 1][2] == a
        before = before if goes_on else 0
        carried.append((part, before))
        before = size - last_at if last_at else before + size
    offsets = spark.createDataFrame(carried, "__part long, __carried long")
    own = Window.partitionBy("__part", "client")
    joined = held.join(F.broadcast(offsets), "__part").join(F.broadcast(edge.select("__part", "a")), "__part")
    n = F.col("__at") - F.min("__at").over(own) + 1 + F.when(F.col("client") == F.col("a.client"), F.col("__carried")).otherwise(0)
    return joined.withColumn("n", n).drop("__part", "__at", "__carried", "a")


def numbered(changes: DataFrame) -> DataFrame:
    """Distinct changes with day, batch, client (as text, null for none), n, `first` (of its client and number), and `row`, a number that is theirs."""
    kept = [c for c in changes.columns if c in ("change_id", "client_id", "seq", "op", "valid_at", "city", "balance")]
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")))
    day = F.unix_date(F.to_date("valid_at")) + 2 * (h % 4)
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    rest = F.xxhash64(*changes.columns)
    src = changes.distinct().select(*kept, rest.alias("__rest")).withColumns({"client": F.coalesce(F.concat(F.lit("c"), F.col("client_id").cast("string")), F.lit("")), "day": day, "stays": F.col("valid_at").isNotNull() & (h % 11 != 0)})
    src = cut(src.withColumn("row", F.monotonically_increasing_id()))  # the number is fixed here
    key = F.struct("day", "change_id", F.col("op"), F.col("city"), F.col("balance"), "__rest", "row")
    folded = src.groupBy("client", "seq").agg(F.min(F.when(F.col("stays"), key)).alias("least"))
    ranks = dense_ranks(folded.select("client", "seq", F.col("least.row").alias("first_row")))
    stay = src.where("stays").alias("s")
    joined = stay.join(ranks.alias("r"), (F.col("s.client") == F.col("r.client")) & F.col("s.seq").eqNullSafe(F.col("r.seq")))
    return joined.select("s.row", "s.change_id", "s.client_id", "s.client", "r.n", (F.col("s.row") == F.col("r.first_row")).alias("first"), "s.day", batch.alias("batch"), "s.op", "s.city", "s.balance")


class Applier(StatefulProcessor):
    """Holds, rejects and applies the changes of a bucket's clients."""

    def __init__(self, wait: int = WAIT):
        self.wait = wait

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "client string, n bigint", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        tick = new.tick.to_numpy(bool)
        batch, overdue = int(new.batch[tick].iloc[0]), int(new.overdue[tick].iloc[0])
        new = new[~tick]
        state = list(self.held.iterator())
        known = {"client": [k[0] for k, _ in state], "n": [k[1] for k, _ in state], **{c: [v[i] for _, v in state] for i, c in enumerate(("day", "row", "op", "city", "balance"))}}
        done, put, gone = apply_batch(pd.DataFrame(known), new, batch, overdue - self.wait)
        for k in gone:
            self.held.removeKey(k)
        for k, value in put:
            self.held.updateValue(k, value)
        if len(done):
            yield done

    def close(self) -> None:
        pass


def segments(key: np.ndarray) -> np.ndarray:
    """The number of each row's run of equal keys."""
    return np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def scanned(values: np.ndarray, sets: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The last value set at or before each row of its group; the first row of each group sets."""
    return values[np.maximum.accumulate(np.where(sets, np.arange(len(values)), 0))] if len(values) else values


def apply_batch(known: pd.DataFrame, new: pd.DataFrame, batch: int, limit: int) -> tuple[pd.DataFrame, list, list]:
    """(rows done, state to put, keys to remove) for all clients of a bucket.

    known: the state, clients' own records at n = 0 with `next` in `row`. limit: held changes of this day or before are overdue.
    """
    columns = ["client", "n", "day", "row", "op", "city", "balance"]
    is_first = new["first"].to_numpy(bool)
    late, first = new[~is_first], new[is_first]
    code, everyone = pd.factorize(pd.concat([known.client, first.client], ignore_index=True))
    own, first_code = code[: len(known)], code[len(known) :]
    records = known[known.n == 0]
    at = own[(known.n == 0).to_numpy(bool)]
    nxt = np.ones(len(everyone), np.int64)
    nxt[at] = records.row.to_numpy(np.int64)
    city, balance = np.full(len(everyone), None, object), np.full(len(everyone), np.nan)
    city[at], balance[at] = records.city.to_numpy(object), records.balance.to_numpy(float)
    held = known[known.n > 0]

    # jumps: beyond the run of held numbers that the largest overdue one of a client stands in
    held_code = own[(known.n > 0).to_numpy(bool)]
    c, n, day = held_code, held.n.to_numpy(np.int64), held.day.to_numpy(np.int64)
    order = np.lexsort((n, c))
    c, n, day = c[order], n[order], day[order]
    run = segments(n - np.arange(len(n)) + (c << 40)) if len(n) else c
    if len(n):
        ends = np.r_[run[1:] != run[:-1], True]
        overdue = np.bincount(run, weights=day <= limit) > 0
        np.maximum.at(nxt, c[ends][overdue], n[ends][overdue] + 1)
    jumped = nxt.copy()

    # what is new: held from `next` on, else rejected
    below = first.n.to_numpy(np.int64) < jumped[first_code]
    rejected = _stacked(late, first[below])
    both = _stacked(held[columns], first.loc[~below, columns])
    fresh = np.r_[np.zeros(len(held), bool), np.ones(int((~below).sum()), bool)]
    c, n = np.r_[held_code, first_code[~below]], both.n.to_numpy(np.int64)
    order = np.lexsort((n, c))
    both, fresh, c, n = both.iloc[order], fresh[order], c[order], n[order]
    run = segments(n - np.arange(len(n)) + (c << 40)) if len(n) else c
    if len(n):
        starts, ends = np.r_[True, run[1:] != run[:-1]], np.r_[run[1:] != run[:-1], True]
        reached = (n[starts] <= jumped[c[starts]]) & (n[ends] >= jumped[c[starts]])
        np.maximum.at(nxt, c[ends][reached], n[ends][reached] + 1)
    applied = n < nxt[c]
    ac, an, rows = c[applied], n[applied], both[applied]

    # what each applied change leaves: scans over the clients' segments, which begin with their records
    touched = np.unique(ac)
    seg = np.r_[touched, ac]
    order = np.lexsort((np.r_[np.zeros(len(touched), np.int64), an], seg))
    op = np.r_[np.full(len(touched), "I", object), rows.op.to_numpy(object)][order]
    cities = np.r_[city[touched], rows.city.to_numpy(object)][order]
    balances = np.r_[balance[touched], rows.balance.to_numpy(float)][order]
    deletes, whole, some = op == "D", (op == "I") | (op == "D"), op == "U"
    cities[deletes], balances[deletes] = None, np.nan
    cities = scanned(cities, whole | some & np.array([x is not None and x == x for x in cities], bool), seg)
    balances = scanned(balances, whole | some & ~np.isnan(balances), seg)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    own = back[len(touched) :]
    cities, balances = cities[own], balances[own]
    old = np.ones(len(everyone), np.int64)
    old[at] = records.row.to_numpy(np.int64)
    previous = np.r_[0, an[:-1]]
    head = np.r_[True, ac[1:] != ac[:-1]] if len(ac) else np.zeros(0, bool)
    missed = an - np.where(head, old[ac], previous + 1)

    done = pd.DataFrame({"row": rows.row.astype("int64"), "client": rows.client, "n": an, "status": "applied", "batch": np.int32(batch), "missed": missed, "op": rows.op, "city": cities, "balance": balances})
    refused = pd.DataFrame({"row": rejected.row.astype("int64"), "client": rejected.client, "n": rejected.n.astype("int64"), "status": "rejected", "batch": np.int32(batch), "missed": np.int64(0), "op": rejected.op, "city": None, "balance": np.nan})
    put = []
    waits = ~applied & fresh
    for row in both[waits][columns].itertuples(index=False):
        put.append(((_text(row.client), int(row.n)), (int(row.day), int(row.row), _text(row.op), _text(row.city), _float(row.balance))))
    last = np.r_[ac[1:] != ac[:-1], True] if len(ac) else np.zeros(0, bool)
    for k, to, c_, b_ in zip(ac[last].tolist(), nxt[ac[last]].tolist(), cities[last], balances[last]):
        put.append(((_text(everyone[k]), 0), (0, to, "", _text(c_), _float(b_))))
    gone = [(_text(a), int(b)) for a, b in zip(rows.client[~fresh[applied]], an[~fresh[applied]])]
    return _stacked(done, refused), put, gone


def _stacked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([a, b], ignore_index=True) if len(a) and len(b) else (a if len(a) else b).reset_index(drop=True)


def _text(x):
    return None if x is None or x != x else str(x)


def _float(x):
    return None if x is None or np.isnan(x) else float(x)


def apply_changes(changes: DataFrame) -> DataFrame:
    """(change_id, client_id, status, batch, missed, city, cents, current): a row a distinct change that stays."""
    spark = changes.sparkSession
    place = scratch(spark, "changes")
    rows = numbered(changes)
    rows.write.partitionBy("batch").parquet(f"{place}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{place}/rows")
    days = dict(rows.groupBy("batch").agg(F.max("day"), F.count("*").alias("n")).select("batch", F.struct("max(day)", "n")).collect())
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(x["n"] for x in days.values()) // BUCKET_ROWS))
    bucket = F.pmod(F.when(F.col("first"), F.xxhash64("client")).otherwise(F.xxhash64("row")), F.lit(n_buckets)).cast("int")
    session = spark.newSession()  # the state store's setting is the stream's alone
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # a start has one batch; else stores of earlier starts keep their local files
    columns = [c.split() for c in FEED.split(", ")]
    filled = {"tick": F.lit(True), "client": F.lit(""), "n": F.lit(0), "first": F.lit(False), "day": F.lit(0), "row": F.lit(-1), "op": F.lit(""), "city": F.lit(None), "balance": F.lit(None)}
    fed, before = f"{place}/fed", -(1 << 40)
    for batch in range(1, BATCHES + 2):  # the last has ticks only
        limit = before if batch <= BATCHES else 1 << 40
        marks = {"batch": F.lit(batch), "overdue": F.lit(limit)}
        ticks = spark.range(n_buckets).withColumns({"bucket": F.col("id"), **filled, **marks})
        own = rows.where(F.col("batch") == batch).withColumns({"bucket": bucket, "tick": F.lit(False), **marks})
        both = [x.select(*(F.col(c).cast(kind).alias(c) for c, kind in columns)) for x in (ticks, own)]
        both[0].unionByName(both[1]).write.mode("append").parquet(fed)
        stream = session.readStream.schema(FEED).parquet(fed).groupBy("bucket").transformWithStateInPandas(Applier(), DONE, "append", "None")
        query = stream.writeStream.format("parquet").option("path", f"{place}/done").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        before = max(before, days[batch]["max(day)"]) if batch in days else before
    done = spark.read.schema(DONE).parquet(f"{place}/done")
    last = done.where("status = 'applied'").groupBy("client").agg(F.max("n").alias("n")).withColumn("final", F.lit(True)).alias("l")
    done = done.alias("d").join(last, (F.col("d.client") == F.col("l.client")) & (F.col("d.n") == F.col("l.n")) & (F.col("d.status") == "applied"), "left")
    cents = F.when(F.abs("balance") < 9e16, F.floor(F.col("balance") * 100 + 0.5)).cast("bigint")
    current = F.coalesce(F.col("final"), F.lit(False)) & ~F.coalesce(F.col("op") == "D", F.lit(False))
    shown = done.select("d.row", "status", "d.batch", "missed", "d.city", cents.alias("cents"), current.alias("current"))
    return shown.join(rows.select("row", "change_id", "client_id"), "row").select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")


def op13_change_applier(spark, sf_dir: str) -> DataFrame:
    return apply_changes(table(spark, sf_dir, "client_changes"))


def _steps(last: int) -> str:
    """SQL for each client's number after the jumps at a batch's start and after the batch, for batches 1 to `last`."""
    out = ["step0 AS (SELECT DISTINCT client, CAST(0 AS BIGINT) AS jump, CAST(1 AS BIGINT) AS next FROM firsts)"]
    for b in range(1, last + 1):
        limit = f"(SELECT max(day) FROM stays WHERE batch < {b})" if b < last else "CAST(1000000000 AS BIGINT)"
        out.append(f"""runs{b} AS (
  SELECT client, n, day, max(n) OVER (PARTITION BY client, run) AS stop FROM (
    SELECT client, n, day, n - row_number() OVER (PARTITION BY client ORDER BY n) AS run FROM firsts WHERE batch <= {b}))""")
        overdue = f"SELECT s.client, max(r.stop) + 1 AS jump FROM step{b - 1} s JOIN runs{b - 1} r ON r.client = s.client AND r.n >= s.next WHERE r.day + {WAIT} <= {limit} GROUP BY s.client"
        jump = f"SELECT s.client, coalesce(o.jump, s.next) AS jump FROM step{b - 1} s LEFT JOIN ({overdue}) o ON o.client = s.client" if b > 1 else "SELECT client, next AS jump FROM step0"
        out.append(f"step{b} AS (SELECT j.client, j.jump, coalesce(r.stop + 1, j.jump) AS next FROM ({jump}) j LEFT JOIN runs{b} r ON r.client = j.client AND r.n = j.jump)")
    return ",\n".join(out)


OP13_SQL = f"""
WITH marked AS (
  SELECT *, {crc32_sql("coalesce(CAST(change_id AS VARCHAR), '')")} AS h, coalesce('c' || CAST(client_id AS VARCHAR), '') AS client,
    dense_rank() OVER (PARTITION BY client_id ORDER BY seq NULLS FIRST) AS n FROM (SELECT DISTINCT * FROM client_changes)
), dated AS (
  SELECT *, date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + 2 * (h % 4) AS day FROM marked WHERE valid_at IS NOT NULL AND h % 11 <> 0
), stays AS (
  SELECT *, least({BATCHES}, greatest(1, 1 + CAST(floor((day - {FIRST_DAY}) * {BATCHES} / {DAYS}.0) AS BIGINT))) AS batch,
    row_number() OVER (PARTITION BY client, n ORDER BY day, change_id, op NULLS FIRST, city NULLS FIRST, balance NULLS FIRST) = 1 AS is_first FROM dated
), firsts AS (SELECT * FROM stays WHERE is_first),
{_steps(BATCHES + 1)},
steps AS ({" UNION ALL ".join(f"SELECT {b} AS b, * FROM step{b}" for b in range(1, BATCHES + 2))}),
held AS (
  SELECT f.*, min(s.b) AS applied_in FROM firsts f JOIN steps a ON a.client = f.client AND a.b = f.batch AND f.n >= a.jump
  JOIN steps s ON s.client = f.client AND s.b >= f.batch AND s.next > f.n GROUP BY ALL
), scans AS (
  SELECT *, n - coalesce(lag(n) OVER w, 0) - 1 AS missed, n = max(n) OVER (PARTITION BY client) AND coalesce(op, '') <> 'D' AS current,
    count(CASE WHEN op IN ('I', 'D') OR op = 'U' AND city IS NOT NULL THEN 1 END) OVER w AS by_city,
    count(CASE WHEN op IN ('I', 'D') OR op = 'U' AND balance IS NOT NULL THEN 1 END) OVER w AS by_balance
  FROM held WINDOW w AS (PARTITION BY client ORDER BY n)
), filled AS (
  SELECT *, max(CASE WHEN op IN ('I', 'U') THEN city END) OVER (PARTITION BY client, by_city) AS city_after,
    max(CASE WHEN op IN ('I', 'U') THEN balance END) OVER (PARTITION BY client, by_balance) AS balance_after FROM scans
)
SELECT change_id, client_id, 'applied' AS status, CAST(applied_in AS INTEGER) AS batch, CAST(missed AS BIGINT) AS missed, city_after AS city,
  CAST(floor(100 * balance_after + 0.5) AS BIGINT) AS cents, current FROM filled
UNION ALL
SELECT change_id, client_id, 'rejected', CAST(batch AS INTEGER), CAST(0 AS BIGINT), NULL, NULL, false FROM stays s
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.change_id = s.change_id AND h.client = s.client AND h.n = s.n)
"""
