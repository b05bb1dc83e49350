"""Conversation prefix trie by a merge sort that knows common prefixes.

Conversations are sequences of turns (role, text). Their prefixes form a trie:
a node of depth d is a distinct sequence of first d turns, the root has none.

1. Sorted runs: a task sorts the conversations of a few megabytes, collapses
   equal ones into one entry with the list of their ids, cuts the run at the
   splitters and front-codes it: an entry holds its common prefix with the one
   before (LCP, in turns) and the turns beyond.
2. Splitters are places in the global order (sequence, conv_id), taken from a
   sample of SAMPLE conversations a part, of which only digests of turns travel.
   As conv_id is part of the order, copies of one conversation spread over parts.
3. A part's runs meet in a loser tree. Each head carries its LCP with the last
   output; only heads of equal LCP compare turns, and only beyond it.
4. The merged stream goes over a stack that holds the open path. Turns that an
   entry does not share with the one before close their nodes, which then are
   finished: members, children, leaves and savings are passed on upwards.
5. A node whose members lie on both sides of a splitter is a prefix of that
   splitter. These open ends, at most a path a part, are given out as partial
   rows and summed up by splitter and depth. Ids of conversations that end there
   come in ascending blocks and are digested as a stream.

Turns are ordered by a digest and, where it is equal, by role and text, so that
equality inside a part rests on texts. Memory of a merging task follows from
PART_BYTES, and a node's digest of ends needs one block of ids at a time.

Rows without conv_id belong to no conversation. Null roles and texts are empty.
Turns are taken in the order turn (null first), role, text; repeated rows are
turns of their own. A conversation without turns ends at the root. A conversation's
own turns meet in one row, as a document's text does. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, share, table

RUN_BYTES = 4 << 20  # of texts sorted together
PART_BYTES = 16 << 20  # of texts that a merging task gets
SAMPLE = 30  # conversations a part, from which splitters are taken
BLOCK = 4096  # ids in a block

TURN = "struct<digest:binary,role:string,text:string>"


def turns_of(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the turns (role, text) of each conversation in order."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = conversations.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    return held.select("conv_id", F.expr("transform(rows, t -> struct(t.role as role, t.text as text))").alias("turns"))


def with_shared_heads(own: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % group in place of its own; h is the unsigned crc32 of the decimal c, modulo `most`."""
    base = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    joined = own.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    shared = F.expr("slice(coalesce(head, cast(array() as array<struct<role:string,text:string>>)), 1, h)")
    return joined.select("conv_id", F.concat(shared, F.expr("slice(turns, h + 1, greatest(size(turns), 1))")).alias("turns"))


def write_run(entries: list[tuple]) -> dict:
    """Sorted entries (turns, ids) as flat columns: the LCP with the entry before, the number of turns beyond it, these turns, ids."""
    out = {k: [] for k in ("lcp", "size", "digest", "role", "text", "n_ids", "ids")}
    last: tuple = ()
    for turns, ids in entries:
        m = common_turns(last, turns)
        out["lcp"].append(m)
        out["size"].append(len(turns) - m)
        for digest, role, text in turns[m:]:
            out["digest"].append(digest)
            out["role"].append(role)
            out["text"].append(text)
        out["n_ids"].append(len(ids))
        out["ids"] += ids
        last = turns
    return out


RUN = pa.struct([("lcp", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("digest", pa.list_(pa.binary())), ("role", pa.list_(pa.string())), ("text", pa.list_(pa.string())), ("n_ids", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
RUN_DDL = "struct<lcp:array<int>,size:array<int>,digest:array<binary>,role:array<string>,text:array<string>,n_ids:array<int>,ids:array<bigint>>"


def read_run(run: dict) -> Iterator[tuple]:
    """(lcp, turns, ids) in order."""
    turns: tuple = ()
    fresh, at, seen = list(zip(run["digest"], run["role"], run["text"])), 0, 0
    for lcp, size, n_ids in zip(run["lcp"], run["size"], run["n_ids"]):
        turns = turns[:lcp] + tuple(fresh[at : at + size])
        at += size
        yield lcp, turns, run["ids"][seen : seen + n_ids]
        seen += n_ids


def common_turns(a: tuple, b: tuple, known: int = 0) -> int:
    """The number of first turns that are equal, if `known` of them are."""
    n = min(len(a), len(b))
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """All entries of sorted runs in order, each with its LCP with the one before it here.

    A match is decided by the heads' LCPs with the last output where they differ: the longer one is the
    smaller sequence. Equal ones compare turns beyond it, and the loser keeps what it has in common with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [-1 if h is None else 0 for h in heads]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = heads[a][1], heads[b][1]
        m = common_turns(x, y, known[a])
        first = m == len(x) or m < len(y) and x[m] < y[m]
        known[b if first else a] = m
        return (a, b) if first else (b, a)

    losers, level = [0] * k, list(range(k))
    while len(level) > 1:
        half = len(level) // 2
        played = [play(level[2 * q], level[2 * q + 1]) for q in range(half)]
        losers[half : 2 * half] = [lose for _, lose in played]
        level = [win for win, _ in played]
    win = level[0]
    while heads[win] is not None:
        _, turns, ids = heads[win]
        yield known[win], turns, ids
        heads[win] = following = next(runs[win], None)
        known[win] = -1 if following is None else following[0]
        at = (win + k) // 2
        while at:
            win, losers[at] = play(win, losers[at])
            at //= 2


class Splitters:
    """Places in the order of (digests of turns, conv_id) that cut it into parts."""

    def __init__(self, places: list[tuple[tuple[bytes, ...], int]]):
        self.places = places
        #: first[s][d]: the first splitter from which on all up to s share their first d turns; it names that prefix
        self.first: list[list[int]] = []
        for s, (path, _) in enumerate(places):
            m = common_turns(places[s - 1][0], path) if s else -1
            self.first.append([self.first[s - 1][d] if d <= m else s for d in range(len(path) + 1)])

    def part(self, digests: tuple[bytes, ...], conv_id: int) -> int:
        return bisect_right(self.places, (digests, conv_id))

    def spanning(self, part: int, digests: tuple[bytes, ...]) -> list[int]:
        """Names of those prefixes of a sequence that the splitters beside the part begin with, by depth."""
        out: list[int] = []
        for s in (part - 1, part):
            if 0 <= s < len(self.places):
                m = common_turns(self.places[s][0], digests)
                if m + 1 > len(out):
                    out = self.first[s][: m + 1]
        return out


def splitters(sequences: DataFrame, parts: int, n: int) -> Splitters:
    """From a sample of at most about SAMPLE * parts conversations, spread by the hash of their ids; 16 bytes a turn reach the driver."""
    if parts < 2:
        return Splitters([])
    chance = int(min(1.0, SAMPLE * parts / n) * (1 << 30))
    drawn = sequences.where(F.pmod(F.xxhash64("conv_id", F.lit(29)), F.lit(1 << 30)) < chance)
    rows = drawn.select(F.expr("transform(turns, t -> t.digest)").alias("path"), "conv_id", "bytes").collect()
    order = sorted((tuple(map(bytes, r["path"])), r["conv_id"], r["bytes"]) for r in rows)
    total, run, places = sum(x[2] for x in order), 0, []
    for path, conv_id, weight in order:
        run += weight
        if run * parts >= total * (len(places) + 1) and len(places) < parts - 1:
            places.append((path, conv_id))
    return Splitters(sorted(set(places)))


def build_runs(sequences: DataFrame, get) -> DataFrame:
    """(part, run): sorted front-coded runs, cut at the splitters."""

    def flush(held: list, cuts: Splitters) -> pa.RecordBatch:
        held.sort()
        parts: dict[int, list] = {}
        for turns, conv_id in held:
            own = parts.setdefault(cuts.part(tuple(t[0] for t in turns), conv_id), [])
            if own and own[-1][0] == turns:
                own[-1][1].append(conv_id)
            else:
                own.append((turns, [conv_id]))
        runs = [write_run(own) for own in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(runs, RUN)], names=["part", "run"])

    def run(batches):
        cuts, held, size = get(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                for conv_id, turns, n in zip(*(few.column(c).to_pylist() for c in range(3))):
                    held.append((tuple((t["digest"], t["role"], t["text"]) for t in turns), conv_id))
                    size += n
                    if size >= RUN_BYTES:
                        yield flush(held, cuts)
                        held, size = [], 0
        if held:
            yield flush(held, cuts)

    return sequences.select("conv_id", "turns", "bytes").mapInArrow(run, f"part int, run {RUN_DDL}")


class Trie:
    """The nodes of one part, from its merged stream."""

    def __init__(self, part: int, cuts: Splitters):
        self.part, self.cuts, self.nodes, self.open = part, cuts, [], []

    def add(self, entries: Iterator[tuple]) -> None:
        for lcp, turns, ids in entries:
            if not self.open or lcp < len(turns):
                names = self.cuts.spanning(self.part, tuple(t[0] for t in turns))
                while len(self.open) > lcp + 1:
                    self._close()
                for d in range(len(self.open), len(turns) + 1):
                    _, role, text = turns[d - 1] if d else (None, None, "")
                    up = self.open[-1] if d else None
                    self.nodes.append({"depth": d, "up": up, "name": names[d] if d < len(names) else None, "path": names[: d + 1], "role": role, "text": text, "least": None, "n": 0, "children": 0, "leaves": 0, "saved": 0, "ends": []})
                    self.open.append(self.nodes[-1])
            top = self.open[-1]
            top["ends"].append(ids)
            top["n"] += len(ids)
            top["least"] = ids[0] if top["least"] is None else min(top["least"], ids[0])
        while self.open:
            self._close()

    def _close(self) -> None:
        node = self.open.pop()
        ends = list(heapq.merge(*node["ends"]))
        if node["name"] is None:
            node["leaves"] += not node["children"]
            node["saved"] += (node["n"] - 1) * len(node["text"])
            node["ends"] = ends_digest([ends])
        else:
            node["ends"] = ends
        up = node["up"]
        if up is not None:
            up["n"] += node["n"]
            up["least"] = node["least"] if up["least"] is None else min(up["least"], node["least"])
            if node["name"] is None:
                up["children"] += 1
                up["leaves"] += node["leaves"]
                up["saved"] += node["saved"]


def ends_digest(blocks) -> str:
    """SHA-256 of decimal ids joined by commas; they come in lists."""
    digest, some = hashlib.sha256(), False
    for ids in blocks:
        if len(ids):
            digest.update(("," * some + ",".join(map(str, ids))).encode())
            some = True
    return digest.hexdigest()


MERGED = "kind int, part int, block int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, role string, text string, name int, path array<int>, ids array<bigint>"
DONE, OPEN, IDS = 0, 1, 2  # kinds of rows: a finished node, an open end's share, a block of ids that end there


def merge_parts(runs: DataFrame, parts: int, get, keep_text: bool) -> DataFrame:
    """The nodes of each part: finished ones, and shares of those that other parts have as well."""
    names = [x.split()[0] for x in MERGED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 7, *[pa.string()] * 3, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def rows_of(trie: Trie) -> Iterator[tuple]:
        for x in trie.nodes:
            up, shown = x["up"], (x["role"], x["text"] if x["depth"] else None) if keep_text else (None, None)
            own = (x["least"], x["depth"], None if up is None or up["name"] is not None else up["least"], x["n"], x["children"], x["leaves"], x["saved"])
            if x["name"] is None:
                yield (DONE, trie.part, 0, *own, x["ends"], *shown, None if up is None else up["name"], None, None)
                continue
            yield (OPEN, trie.part, len(x["text"]), *own, None, *shown, x["name"], x["path"], None)
            for k in range(0, len(x["ends"]), BLOCK):
                yield (IDS, trie.part, k // BLOCK, None, x["depth"], *[None] * 8, x["name"], None, x["ends"][k : k + BLOCK])

    def run(batches):
        cuts, held = get(), {}
        for batch in batches:
            for part, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(part, []).append(one)
        while held:
            part, own = held.popitem()
            trie = Trie(part, cuts)
            trie.add(merge_runs([read_run(x.as_py()) for x in own]))
            out = []
            for row in rows_of(trie):
                out.append(row)
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return runs.repartitionById(parts, F.col("part")).mapInArrow(run, MERGED)


def digests_of_open(blocks: DataFrame) -> DataFrame:
    """(name, depth, ends_sha256): the blocks of a node in order, as a stream; parts are in the order of ids, for equal sequences."""

    def run(batches):
        key, digest, some = None, None, False
        for batch in batches:
            done = []
            for name, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "ids"))):
                if (name, depth) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest, some = (name, depth), hashlib.sha256(), False
                digest.update(("," * some + ",".join(map(str, ids))).encode())
                some = True
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["name", "depth", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["name", "depth", "ends_sha256"])

    placed = blocks.select("name", "depth", "part", "block", "ids").repartition("name", "depth").sortWithinPartitions("name", "depth", "part", "block")
    return placed.mapInArrow(run, "name int, depth bigint, ends_sha256 string")


def open_totals(shares: DataFrame, blocks: DataFrame) -> DataFrame:
    """The open ends' nodes, each from its shares; a row a splitter and depth at most."""
    held = shares.groupBy("name", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"), F.max("block").alias("chars"), F.max("path").alias("path"), F.max("role").alias("role"), F.max("text").alias("text"),
    )
    up = F.expr("get(path, cast(depth as int) - 1)").alias("name")
    below = held.where("depth > 0").groupBy(up, (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("open_children"))
    held = held.join(below, ["name", "depth"], "left").withColumn("n_children", F.col("inner_children") + F.coalesce("open_children", F.lit(0)))
    leaves = F.col("inner_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("chars")
    over = held.select(F.posexplode("path").alias("depth", "name"), leaves.alias("l"), saved.alias("s")).groupBy("name", F.col("depth").cast("bigint").alias("depth")).agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    parents = held.select(F.col("name").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256().hexdigest())
    return (
        held.withColumn("up", up).join(parents, ["up", "depth"], "left").join(over, ["name", "depth"]).join(digests_of_open(blocks), ["name", "depth"], "left")
        .select("name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "role", "text")
    )


def prefix_trie(sequences: DataFrame, keep_text: bool = False) -> DataFrame:
    """The trie of (conv_id, turns): a row a node, with role and text of its last turn if `keep_text`.

    conv_id: the smallest member; n_convs: members; n_leaves and saved_tokens are over the node's subtree.
    """
    spark = sequences.sparkSession
    digest = "unhex(md5(concat(cast(octet_length(t.role) as string), ':', t.role, t.text)))"
    size = F.expr("aggregate(turns, 16L, (n, t) -> n + 48 + octet_length(t.role) + octet_length(t.text))")
    src = sequences.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.expr(f"transform(turns, t -> struct({digest} as digest, t.role as role, t.text as text))").cast(f"array<{TURN}>").alias("turns"), size.alias("bytes"))
    src = cut(src)
    n, total = src.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(-(-total // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 64)), 1)
    get = share(spark, splitters(src, parts, max(n, 1)))
    merged = cut(merge_parts(build_runs(src, get), parts, get, keep_text))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", *(["role", "text"] if keep_text else [])]
    done, shares = merged.where(F.col("kind") == DONE), merged.where(F.col("kind") == OPEN)
    known = cut(open_totals(shares, merged.where(F.col("kind") == IDS)))
    above = shares.join(known.select("name", "depth", F.col("conv_id").alias("open_parent")), ["name", "depth"]).select("part", "name", (F.col("depth") + 1).alias("depth"), "open_parent")
    above = cut(above)  # a name and depth for each part, so that no parent meets all its children in one task
    done = done.join(bounded_broadcast(above, above.count()), ["part", "depth", "name"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "open_parent"))
    return done.select(*columns).unionByName(known.select(*columns))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(turns_of(table(spark, sf_dir, "conversations"))))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string: bits go through the shift register, lowest first."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda i: CAST((ascii(ch) >> CAST(i AS INTEGER)) & 1 AS BIGINT))))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), CAST(4294967295 AS BIGINT))"


OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS d, role, text FROM (
    SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
  )
), prefixes AS (
  SELECT a.conv_id, a.d, any_value(a.text) FILTER (WHERE b.d = a.d) AS text,
    string_agg(length(b.role) || ':' || b.role || length(b.text) || ':' || b.text, '' ORDER BY b.d) AS path,
    string_agg(length(b.role) || ':' || b.role || length(b.text) || ':' || b.text, '' ORDER BY b.d) FILTER (WHERE b.d < a.d) AS up
  FROM rebuilt a JOIN rebuilt b ON b.conv_id = a.conv_id AND b.d <= a.d GROUP BY a.conv_id, a.d
), reached AS (
  SELECT conv_id, d, sha256(path) AS path, sha256(coalesce(up, '')) AS up, length(text) AS chars FROM prefixes
  UNION ALL SELECT conv_id, 0, sha256(''), NULL, 0 FROM convs
), sizes AS (SELECT conv_id, max(d) AS size FROM reached GROUP BY conv_id),
nodes AS (
  SELECT r.path, min(r.conv_id) AS conv_id, any_value(r.d) AS depth, any_value(r.up) AS up, count(*) AS n_convs, any_value(r.chars) AS chars,
    sha256(coalesce(string_agg(CAST(r.conv_id AS VARCHAR), ',' ORDER BY r.conv_id) FILTER (WHERE s.size = r.d), '')) AS ends_sha256
  FROM reached r JOIN sizes s USING (conv_id) GROUP BY r.path
), kids AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
own AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * n.chars AS saved FROM nodes n LEFT JOIN kids k USING (path)
), lines AS (
  SELECT DISTINCT a.path AS top, o.path, o.saved, CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END AS leaf
  FROM own o JOIN reached r ON r.path = o.path JOIN reached a ON a.conv_id = r.conv_id AND a.d <= r.d
), totals AS (SELECT top AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM lines GROUP BY top)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN totals t USING (path) LEFT JOIN nodes p ON p.path = o.up
"""
