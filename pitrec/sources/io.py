"""Readers and writers of the pipeline's files, all through Spark's own sources."""

from __future__ import annotations

import io
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEWS = T.StructType(
    [T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType()), T.StructField("verified_purchase", T.BooleanType()), T.StructField("helpful_vote", T.LongType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def store(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of any store that Spark reaches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver's JVM ends."""
    place = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4()}"
    fs, path = store(spark, place)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return place


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = store(spark, path)
    return fs.exists(hadoop)


def outputs(spark: SparkSession, folder: str) -> list[str]:
    """The names below a folder; none if it is not there."""
    fs, path = store(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def remove_outputs(spark: SparkSession, folder: str, names: set[str]) -> list[str]:
    """Deletes the outputs of these names and nothing else; the names that were there."""
    found = [n for n in outputs(spark, folder) if n in names]
    for name in found:
        fs, path = store(spark, f"{folder.rstrip('/')}/{name}")
        fs.delete(path, True)
    return found


def jsonl_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType = REVIEWS, max_rows: int | None = None, overwrite: bool = False) -> DataFrame:
    """Converts JSON lines once; an existing target is kept unless `overwrite`."""
    if overwrite or not exists(spark, target):
        rows = spark.read.schema(schema).json(source)
        (rows.limit(max_rows) if max_rows else rows).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_metadata(spark: SparkSession, shards: list[str], jsonl: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet shards that are there, else the JSON lines."""
    found = [p for p in shards if exists(spark, p)]
    if found:
        return concat_shards([spark.read.parquet(p) for p in found])
    if not jsonl:
        raise FileNotFoundError("neither shards nor JSON lines")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(jsonl)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, ids: DataFrame | None = None, key: str = "parent_asin") -> DataFrame:
    """JSON lines without malformed ones, and only the wanted ids."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.join(ids.select(key).distinct(), key, "left_semi") if ids is not None else rows


def concat_shards(shards: list[DataFrame], ids: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """Union by name; columns that a shard lacks are null; only the wanted ids."""
    out = shards[0]
    for df in shards[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.join(ids.select(key).distinct(), key, "left_semi") if ids is not None else out


def sample_exact(df: DataFrame, n: int, key: str, seed: str = "sample") -> DataFrame:
    """Exactly n rows (or all), the same for a seed: those of the lowest hash. Planned as a top-n without a full sort; one task holds n rows at the end."""
    lot = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("lot", lot).orderBy("lot", key).limit(n).drop("lot")


def rows_for(df: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    """The rows of the wanted ids, and a row of nulls for each id that has none."""
    wanted = ids.select(key).distinct()
    return wanted.join(df, key, "left")


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by a commit protocol; an empty frame keeps its schema."""
    df.write.mode("overwrite").parquet(path)


def npz_blobs(vectors: DataFrame, key: str = "item_id", vector: str = "embedding", rows: int = 100_000) -> DataFrame:
    """(name, content): NPZ archives with `ids` and `vectors` (32-bit), of about `rows` vectors each."""
    src = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column(1)
                held = io.BytesIO()
                np.savez(held, ids=part.column(0).to_numpy(), vectors=np.asarray(lists.flatten(), dtype=np.float32).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4()}.npz"]), pa.array([held.getvalue()], pa.binary())], names=["name", "content"])

    return src.mapInArrow(pack, "name string, content binary")


def npz_rows(blobs: DataFrame, ids: str = "ids", vectors: str = "vectors") -> DataFrame:
    """(item_id, embedding) of NPZ archives in a column `content`; raises if ids and vectors differ in number."""

    def unpack(batches):
        for batch in batches:
            for content in batch.column(0):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as held:
                    keys, rows = held[ids].astype(np.int64), held[vectors].astype(np.float64)
                if len(keys) != len(rows):
                    raise ValueError(f"{len(keys)} ids, {len(rows)} vectors")
                for at in range(0, len(keys), 4096):
                    few = rows[at : at + 4096]
                    ends = np.arange(len(few) + 1, dtype=np.int32) * few.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 4096]), pa.ListArray.from_arrays(pa.array(ends), pa.array(few.ravel()))], names=["item_id", "embedding"])

    return blobs.select("content").mapInArrow(unpack, "item_id bigint, embedding array<double>")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """NPZ files, each read whole by one task."""
    return npz_rows(spark.read.format("binaryFile").load(path))


def digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of a file, or of the data files of a folder, by name."""
    fs, root = store(spark, path)
    if not fs.exists(root):
        raise FileNotFoundError(path)
    files = [root] if fs.getFileStatus(root).isFile() else sorted((x.getPath() for x in fs.listStatus(root) if not x.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())
    sha = spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils
    out = {}
    for f in files:
        stream = fs.open(f)
        try:
            out[f.getName()] = sha.sha256Hex(stream)
        finally:
            stream.close()
    return out


def write_report(df: DataFrame, path: str, key: str) -> None:
    """Replaces only the partitions of the keys present."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def inter_lines(rows: DataFrame) -> DataFrame:
    """(line): tab-separated user, item, rating, time; raises on a tab or newline in an id."""
    def safe(c: str):
        x = F.col(c).cast("string")
        return F.when(x.rlike("[\t\n\r]"), F.raise_error(F.concat(F.lit("tab or newline in "), F.lit(c)))).otherwise(x)

    return rows.select(F.concat_ws("\t", safe("user_id"), safe("item_id"), F.col("rating").cast("string"), F.col("ts").cast("string")).alias("line"))


def write_inter(rows: DataFrame, path: str) -> None:
    """A tab-separated file set with typed headers, in order of (user, time, item)."""
    for_order = rows.select("user_id", "item_id", "rating", "ts").orderBy("user_id", "ts", "item_id")
    guarded = for_order.select(*[F.when(F.col(c).cast("string").rlike("[\t\n\r]"), F.raise_error(F.lit(f"tab or newline in {c}"))).otherwise(F.col(c).cast("string")).alias(h) for c, h in (("user_id", "user_id:token"), ("item_id", "item_id:token"))], F.col("rating").alias("rating:float"), F.col("ts").alias("timestamp:float"))
    guarded.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV whose header must name the schema's columns, in order."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False).csv(path)


def read_dump(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A ranked dump: Parquet, or CSV, also gzipped, by its suffix."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def write_dump(rows: DataFrame, path: str, expected: int | None = None) -> None:
    """The prediction dump's six columns; raises if the row count is not the expected one."""
    out = rows.select("user_id", "item_id", "label", "logit", "n_history_events", "item_n_reviews")
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rows, {expected} expected")
    out.write.mode("overwrite").parquet(path)


def prefix_sequences(rows: DataFrame, length: int = 20) -> DataFrame:
    """(user_id, target, items): for each event but the first, the items before it, the last `length` of them."""
    own = Window.partitionBy("user_id").orderBy("ts", "item_id")
    out = rows.select("user_id", "ts", F.col("item_id").alias("target"), F.collect_list("item_id").over(own.rowsBetween(-length, -1)).alias("items"))
    return out.where(F.size("items") > 0).drop("ts")

