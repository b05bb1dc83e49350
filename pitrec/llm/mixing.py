"""Mixing sources to target weights by Poisson replication.

A weight is the share of the wanted rows that its source is to have. Sources
without one share what the weights leave, in proportion to their own sizes; a source's
mean repetition rate is its share of the wanted size over its own size, whatever
that is. Weights that come to more than 1 are divided by their sum, and so are those
of a table without other sources; the share of a named source without rows is left to
the sources without a weight. Weights are floored at 0; a source with share 0 gives no rows.

A document's count is the Poisson value with that mean at the document's own uniform
number, a hash of a seed, its id, its text's digest and its place among rows that
agree in both, so a run that is repeated gives the same copies, and rows without an
id, or with one id, draw each their own. Counts of rows that agree in id and text do
not depend on how the table is partitioned, though which of them gets which may. The
rows are exploded by their counts and dealt over all partitions by a hash of the same
and the copy: partition and key within it are a global random order, with one shuffle.

Null sources are a source of their own, under the empty name; null ids and texts count
as empty. An empty table gives no rows. Very long texts are hashed whole. All columns
are kept; `copy` and `shuffle_key` are added and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, table

LEVEL = 1024  # copies of a row written out together
DIRECT = 64.0  # rates up to this sum their probabilities from zero copies on
SPREAD = 12.0  # standard deviations about the mean that hold every uniform number


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1): the first 52 bits of a digest, moved by half a step."""
    return (_long(F.md5(F.concat_ws(":", F.lit(seed), key)), 13).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str = "source", size: float = 1.0) -> DataFrame:
    """(source, rate): one row a source."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__mix_source")).agg(F.count("*").cast("double").alias("n"))
    wanted = F.lit(None).cast("double")
    for name, w in sorted((weights or {}).items()):
        wanted = F.when(F.col("__mix_source") == name, F.lit(max(0.0, float(w)))).otherwise(wanted)
    sources = counts.withColumn("w", wanted)
    other = F.col("w").isNull()
    sums = sources.agg(F.sum("n").alias("total"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("named"), F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0.0)).alias("others"))
    scale = F.when((F.col("others") > 0) & (F.col("named") <= 1), 1.0).when(F.col("named") > 0, F.col("named")).otherwise(1.0)
    share = F.when(other, F.greatest(1 - F.col("named"), F.lit(0.0)) * F.col("n") / F.col("others")).otherwise(F.col("w") / scale)
    return sources.crossJoin(F.broadcast(sums)).select("__mix_source", (share * F.col("total") * F.lit(float(size)) / F.col("n")).alias("rate"))  # one row


def least_count(rate: Column) -> Column:
    """The count at which `cumulative` begins: fewer copies are less likely than any uniform number."""
    return F.when(rate > DIRECT, F.greatest(F.lit(0.0), F.floor(rate - SPREAD * F.sqrt(rate)).cast("double"))).otherwise(0.0).cast("int")


def cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most `least_count`, one more, two more, ... copies, as far as any uniform number can ask.

    Where exp(-rate) may vanish, they are summed relative to the first and divided by their total.
    """
    last = F.when(rate > DIRECT, F.ceil(rate + SPREAD * F.sqrt(rate)).cast("int")).otherwise(int(DIRECT + SPREAD * DIRECT**0.5))
    first = F.when(rate > DIRECT, 1.0).otherwise(F.exp(-rate))
    begin = least_count(rate)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt((last - begin).cast("double"))).cast("int"))  # counts of a block: each append copies no more than a block, or the list of blocks

    def block(s: Column, k0: Column) -> Column:
        return F.aggregate(
            F.sequence(k0, F.least(k0 + width - 1, last)),
            F.struct(s["p"].alias("p"), s["t"].alias("t"), F.array().cast("array<double>").alias("c")),
            lambda q, k: F.struct((q["p"] * rate / k).alias("p"), (q["t"] + q["p"] * rate / k).alias("t"), F.concat(q["c"], F.array(q["t"] + q["p"] * rate / k)).alias("c")),
        )

    def appended(s: Column, k0: Column) -> Column:
        # a lambda's variable stands for the block, which is evaluated once
        return F.element_at(F.transform(F.array(block(s, k0)), lambda b: F.struct(b["p"].alias("p"), b["t"].alias("t"), F.concat(s["c"], F.array(b["c"])).alias("c"))), 1)

    every = F.aggregate(
        F.sequence(begin + 1, last, width),
        F.struct(first.alias("p"), first.alias("t"), F.array(F.array(first)).alias("c")),
        appended,
        lambda s: F.transform(F.flatten(s["c"]), lambda c: c / F.when(rate > DIRECT, s["t"]).otherwise(1.0)),
    )
    return F.filter(every, lambda c: c < 1 - 2.0**-53)


def poisson(u: Column, probabilities: Column) -> Column:
    """The smallest count whose cumulative probability reaches u, which is evaluated once."""
    start = F.struct(u.alias("u"), F.lit(0).alias("n"))
    return F.aggregate(probabilities, start, lambda s, c: F.struct(s["u"].alias("u"), (s["n"] + F.when(c < s["u"], 1).otherwise(0)).alias("n")), lambda s: s["n"])


def _long(digest: Column, n: int) -> Column:
    """The first n hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, n), 16, 10).cast("long")


def named_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds `__mix_key`, a digest of id and text, and `__mix_nth`, a row's place from 0 among those that share it.

    Only rows that share a key are numbered: by the counts of the partitions before and the place in their own,
    so that no task holds all rows of one key.
    """
    keyed = docs.withColumn("__mix_key", F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))))
    often = cut(keyed.groupBy("__mix_key").agg(F.count("*").alias("n")).where("n > 1").select("__mix_key"))
    n = often.count()
    if not n:
        return keyed.withColumn("__mix_nth", F.lit(0))
    single = keyed.join(bounded_broadcast(often, n), "__mix_key", "left_anti").withColumn("__mix_nth", F.lit(0))
    again = cut(keyed.join(bounded_broadcast(often, n), "__mix_key", "left_semi").withColumn("__mix_at", F.monotonically_increasing_id()))  # places are fixed by the checkpoint
    part = F.shiftright("__mix_at", 33)
    sizes = again.groupBy("__mix_key", part.alias("__mix_part")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("__mix_key").orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = sizes.select("__mix_key", "__mix_part", before.alias("__mix_before"))
    own = F.row_number().over(Window.partitionBy("__mix_key", "__mix_part").orderBy("__mix_at"))
    placed = again.withColumn("__mix_part", part).withColumn("__mix_own", own).join(offsets, ["__mix_key", "__mix_part"])
    numbered = placed.withColumn("__mix_nth", (F.col("__mix_before") + F.col("__mix_own") - 1).cast("int"))
    return single.unionByName(numbered.select(*single.columns))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The copies of the rows in global random order, with `copy` (from 0) and `shuffle_key`."""
    own = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    table_ = rates(docs, weights, source_col, size)
    src = named_rows(docs.select(*own), id_col, text_col).withColumn("__mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    table_ = cut(table_.select("__mix_source", least_count(F.col("rate")).alias("__mix_from"), cumulative(F.col("rate")).alias("__mix_cdf")))  # once a source
    rated = src.join(bounded_broadcast(table_, table_.count(), 10_000), "__mix_source")
    row = F.concat_ws(":", "__mix_key", F.col("__mix_nth").cast("string"))
    counted = rated.withColumn("__mix_n", F.col("__mix_from") + poisson(uniform(row, seed), F.col("__mix_cdf"))).where("__mix_n > 0")
    level = counted.withColumn("__mix_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("__mix_n") - 1) / LEVEL).cast("int"))))
    copies = level.withColumn("copy", F.explode(F.sequence(F.col("__mix_k") * LEVEL, F.least(F.col("__mix_k") * LEVEL + LEVEL, F.col("__mix_n")) - 1)))
    keyed = copies.withColumn("shuffle_key", _long(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), row, F.col("copy").cast("string"))), 15))
    return keyed.select(*own, "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: Production weights: the hot source is held down, two others are raised; the rest keep their proportions.
WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.08}


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)


# From the definition: shares, then each count's Poisson probability by its own formula, then the count whose interval holds the row's number.
OP1_SQL = """
WITH target(s, w) AS (VALUES ('src0', 0.15::DOUBLE), ('src1', 0.10), ('src2', 0.08)),
d AS (
  SELECT *, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), named AS (
  SELECT *, key || ':' || (row_number() OVER (PARTITION BY key) - 1) AS r FROM d
), size AS (
  SELECT d.s, count(*) AS n, any_value(target.w) AS w FROM d LEFT JOIN target ON target.s = d.s GROUP BY 1
), mean AS (
  SELECT s, (CASE WHEN w IS NULL THEN (1 - (SELECT sum(w) FROM size)) * n / (SELECT sum(n) FROM size WHERE w IS NULL) ELSE w END) * (SELECT sum(n) FROM size) / n AS rate FROM size
), chance AS (
  SELECT s, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM (SELECT s, rate, unnest(range(0, CAST(60 + ceil(rate + 12 * sqrt(rate)) AS BIGINT))) AS k FROM mean)
), upto AS (
  SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c, sum(p) OVER (PARTITION BY s ORDER BY k) - p AS below FROM chance
), u AS (
  SELECT *, (CAST(CAST('0x' || substr(md5('mix:' || r), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 AS u FROM named
), copies AS (
  SELECT u.*, unnest(range(0, k)) AS cp FROM u JOIN upto ON upto.s = u.s AND u.u > below AND u.u <= c
)
SELECT doc_id, text, lang, source, n_chars, CAST(cp AS INTEGER) AS copy, CAST('0x' || substr(md5('mix:order:' || r || ':' || cp), 1, 15) AS BIGINT) AS shuffle_key FROM copies
"""
