"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. Rows that a stage keeps are passed on whole; ids may be null or repeat.
Null and empty texts pass the first stage, are near copies of each other in the
second, and empty in the third. Very long texts go through each stage whole. Of
near copies that tie, equal ids included, the contents' hash decides which stays.
Columns beside those of documents go in the first stage, also where their names
clash with a stage's own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrec.llm import mixing, pieces, simhash, suffix_dedup, toxicity
from pitrec.llm.common import cut, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.classify(docs.select(*COLUMNS), toxicity.train(docs, labels)).where(~F.col("rejected")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: that of the smallest doc_id, null ids last.

    Rows are told apart by id and contents, so rows that share an id, or have none, go only for a near copy.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(*COLUMNS).alias("contents"))
    docs = docs.select(*COLUMNS, key.alias("key"))
    found = cut(simhash.near_duplicates(docs, "key"))
    if found.groupBy("id").count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["key"])  # rows equal in all columns
    others = found.where("id <> component").select(F.col("id").alias("key")).distinct()
    return docs.join(others, "key", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text covered by repeated strings of 200 bytes is cut out; characters that a cut divides go whole. No row goes; null becomes empty."""
    found = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True, keep_text=False)
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": F.col("kept"), "n_chars": size}).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of the documents, in global random order."""
    return mixing.mix(docs, mixing.WEIGHTS).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trips(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    place = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{place}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{place}/{k}")
    return docs
