"""Quality rules: repetition within a text, and lines that many documents of a host share.

Lines are normalised (white space collapsed, lower case) and hashed; a line
found in more than `share` of a host's documents, and in more than `least_docs`
of them, is removed. A document of which less than `least_kept` of its words, or
fewer than `min_words` words, stay is depleted and rejected. Everything is DataFrame
expressions: the text is read once for the counts by line and once for the
rest. `cleaned` gives the texts without those lines; all other lines, blank ones
too, stay as they are. `quality_rules` gives its counts and verdicts.

A null text has no words. A null host is a host of its own. Each row is a
document, also when ids repeat or are null. Documents with fewer than `min_words` words or
too many repeated words fail the base rules. Very long texts count whole; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

BLANK = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, BLANK, " "))))


def _n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, BLANK), lambda w: w != ""))


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds the counts to rows with a non-null `text`."""
    out = docs.withColumn("words", F.filter(F.split("text", BLANK), lambda w: w != "")).withColumn("lines", _lines(F.col("text")))
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "windows": F.expr(f"if(size(words) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({', '.join(f'get(words, i + {k})' for k in range(WINDOW))})))"),
        }
    )
    # windows themselves are sorted only where two hashes agree
    out = out.withColumn("sorted", F.expr(f"if(size(array_distinct(windows)) < size(windows), array_sort(transform(windows, (h, i) -> struct(concat_ws(' ', slice(words, i + 1, {WINDOW})) as h, i as i))), null)"))
    out = out.withColumn("twice", F.expr("if(sorted is null, null, array_sort(transform(filter(sorted, (x, k) -> x.h <=> get(sorted, k - 1).h or x.h <=> get(sorted, k + 1).h), x -> x.i)))"))
    covered = f"if(twice is null, 0L, aggregate(transform(twice, (p, k) -> least({WINDOW}, coalesce(get(twice, k + 1) - p, {WINDOW}))), 0L, (s, x) -> s + x))"
    return out.withColumn("n_repeat_words", F.expr(covered)).drop("windows", "sorted", "twice", "words")


def _each_line(docs: DataFrame, *columns: str) -> DataFrame:
    """A row for each different line of a document."""
    return docs.select(*columns, F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _line_hash))).alias("line"))


def common_lines(docs: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(host, line): hashes of lines in more than `least_docs` and more than `share` of a host's documents."""
    counts = _each_line(docs, "host").groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    sizes = docs.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("docs"))
    return counts.join(sizes, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > share * F.col("docs")).select("host", "line")


def with_common(each: DataFrame, common: DataFrame, n: int, limit: int = 200_000, salts: int = 32) -> DataFrame:
    """The rows of `each` whose line is common in their host. Beyond the limit of a broadcast both sides are salted, as such lines are many rows each."""
    other = common.withColumnsRenamed({"host": "chost", "line": "cline"})
    same = (F.col("line") == F.col("cline")) & F.col("host").eqNullSafe(F.col("chost"))
    if n <= limit:
        return each.join(F.broadcast(other), same).drop("chost", "cline")
    salted = each.withColumn("salt", F.pmod(F.xxhash64("mark", "id"), F.lit(salts)).cast("int"))
    spread = other.withColumn("csalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, same & (F.col("salt") == F.col("csalt"))).drop("chost", "cline", "salt", "csalt")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = 10, share: float = 0.05, min_words: int = 10, repeat_percent: int = 20, least_kept: float = 0.3, limit: int = 200_000) -> DataFrame:
    """(id, host, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words, base_failed, kept), one row a document; `text` has no common lines."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(host_col).alias("host"))
    src = src.withColumn("mark", F.xxhash64("text"))
    common = cut(common_lines(src, least_docs, share))
    stats = base_rules(src).drop("lines")
    removed = (
        with_common(_each_line(src, "id", "mark", "host"), common, common.count(), limit)
        .groupBy(F.col("id").alias("rid"), F.col("mark").alias("rmark"), F.col("host").alias("rhost"))
        .agg(F.collect_set("line").alias("gone"))
    )
    joined = stats.join(removed, (F.col("mark") == F.col("rmark")) & F.col("id").eqNullSafe(F.col("rid")) & F.col("host").eqNullSafe(F.col("rhost")), "left")
    rest_of = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", _line_hash(x))), "\n")
    out = joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest_of))
    out = out.withColumn("n_common_words", F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.col("n_words") - _n_words(F.col("text"))).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    rest = F.col("n_words") - F.col("n_common_words")
    kept = ~F.col("base_failed") & (rest >= min_words) & (rest >= least_kept * F.col("n_words"))
    return out.select("id", "host", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", kept.alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words, base_failed, kept): what `cleaned` found."""
    return cleaned(docs, id_col, text_col, host_col, **limits).drop("host", "text")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT rid, i, words[i:i+4] AS g FROM w, unnest(range(1, greatest(len(words) - 3, 1))) AS t(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 5) AS r(k) GROUP BY rid
), ln AS (
  SELECT rid, source, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM w, unnest(lines) AS t(x)
), host AS (
  SELECT source, count(*) AS docs FROM documents GROUP BY 1
), common AS (
  SELECT l.source, line FROM (SELECT source, line, count(DISTINCT rid) AS k FROM ln GROUP BY 1, 2) l JOIN host h ON h.source IS NOT DISTINCT FROM l.source WHERE k > 10 AND k > 0.05 * docs
), gone AS (
  SELECT rid, sum(n) AS n_common_words FROM ln JOIN common c ON c.line = ln.line AND c.source IS NOT DISTINCT FROM ln.source GROUP BY rid
), s AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_common_words, 0) AS BIGINT) AS n_common_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - n_common_words >= 10 AND n_words - n_common_words >= 0.3 * n_words AS kept FROM f
"""
