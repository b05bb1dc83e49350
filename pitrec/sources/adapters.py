"""The provided tables in the roles of the recommendation data model.

Every function takes (spark, sf_dir) and reads only the columns it names.
Event times are epoch milliseconds in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITIVE = 3
SAME_TIME = ["l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a purchase line: user, item, time, rating 1-5, verified, helpful votes."""
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber", *SAME_TIME)
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        millis(F.col("o_orderdate")).alias("ts"),
        (1 + F.col("l_quantity").cast("int") % 5).alias("rating"),
        (F.col("l_returnflag") != "R").alias("verified"),
        F.col("l_linenumber").alias("helpful"),
        *SAME_TIME,
    )


def first_per_pair(rows: DataFrame) -> DataFrame:
    """The earliest row of each (user, item), in a total order, with its label."""
    order = Window.partitionBy("user_id", "item_id").orderBy("ts", "rating", *SAME_TIME)
    kept = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", *SAME_TIME)
    return kept.withColumn("label", (F.col("rating") >= POSITIVE).cast("int"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique (user, item) rows of all interactions."""
    return first_per_pair(interactions(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("store"),
        F.col("p_type").alias("main_category"),
        F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice")).alias("price"),
        F.col("p_size").alias("rating_number"),
        F.array("p_type", "p_brand").alias("categories"),
    )


def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def interactions_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second, small domain: items from the events' JSON, ratings from their type."""
    e = load(spark, sf_dir, "events")
    rating = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "click", 4).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), millis(F.col("ts")).alias("ts"), rating.alias("rating"))


# The same views for the SQL twins.
SQL_VIEWS = """
raw AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, epoch_ms(o_orderdate) AS ts, CAST(1 + CAST(l_quantity AS INTEGER) % 5 AS INTEGER) AS rating,
         l_returnflag <> 'R' AS verified, l_linenumber AS helpful, l_quantity, l_extendedprice, l_discount, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), clean AS (
  SELECT user_id, item_id, ts, rating, verified, helpful, CAST(rating >= 3 AS INTEGER) AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, rating, l_quantity, l_extendedprice, l_discount, l_shipdate) AS rn FROM raw) WHERE rn = 1
), catalog AS (
  SELECT p_partkey AS item_id, p_name AS title, p_brand AS store, p_type AS main_category, '$' || printf('%.2f', p_retailprice) AS price, p_size AS rating_number, [p_type, p_brand] AS categories FROM part
)
"""


def twin(body: str, extra: str = "") -> str:
    """A SQL twin: the views, more views, and the query itself."""
    return "WITH " + SQL_VIEWS.strip() + ("," + extra.strip() if extra.strip() else "") + "\n" + body.strip()
