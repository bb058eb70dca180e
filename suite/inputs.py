"""Cohort-like inputs derived from the supplied tables, and the same in SQL.

The tables have no missing values, so some are blanked by a key rule, the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def blank(condition: Column, name: str) -> Column:
    return F.when(~condition, F.col(name)).alias(name)


def lineitem(spark, sf) -> DataFrame:
    """Line items as visits with gaps in four measures."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        blank(F.col("l_orderkey") % 7 == 0, "l_quantity"),
        blank(F.col("l_partkey") % 11 == 0, "l_extendedprice"),
        blank((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, "l_discount"),
        blank((F.col("l_orderkey") % 7 == 0) | (F.col("l_suppkey") % 5 == 0), "l_tax"),
        "l_returnflag",
        "l_linestatus",
    )


LINEITEM = """li AS (SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_orderkey % 7 = 0 OR l_suppkey % 5 = 0 THEN NULL ELSE l_tax END AS l_tax,
  l_returnflag, l_linestatus FROM lineitem)"""
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def orders(spark, sf) -> DataFrame:
    """Orders with the customer's characteristics and a treatment code."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
        (F.col("o_orderkey") % 4).cast("int").alias("tx.group"),
    )
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


ORDERS = """oc AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
  CAST(o_orderkey % 4 AS INTEGER) AS tx, c_mktsegment, c_acctbal, c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def parts(spark, sf) -> DataFrame:
    """Parts with the mean quantity sold, with gaps in three measures."""
    sold = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("avg_qty")
    )
    p = table(spark, sf, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    key = F.col("p_partkey")
    return p.select(
        "p_partkey",
        F.when(key % 7 != 0, F.col("p_size").cast("double")).alias("p_size"),
        F.when(key % 11 != 3, F.col("p_retailprice")).alias("p_retailprice"),
        F.when(key % 5 != 2, F.col("avg_qty")).alias("avg_qty"),
    )


PARTS = """pa AS (SELECT p_partkey,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
  CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE p_retailprice END AS p_retailprice,
  CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE avg_qty END AS avg_qty
  FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS avg_qty FROM lineitem
  GROUP BY l_partkey) s ON p_partkey = l_partkey)"""


def dictionary(spark, sf) -> DataFrame:
    """A data dictionary made of the parts: name.size (or a bare name) with a description."""
    p = table(spark, sf, "part")
    name = F.when(F.col("p_size") < 8, F.col("p_name")).otherwise(
        F.concat_ws(".", "p_name", F.col("p_size").cast("string"))
    )
    return p.select(
        name.alias("variable"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.col("p_partkey").alias("ord"),
    )


DICTIONARY = """dict AS (SELECT CASE WHEN p_size < 8 THEN p_name
  ELSE p_name || '.' || CAST(p_size AS VARCHAR) END AS variable,
  p_brand || ' ' || p_type AS description, p_partkey AS ord FROM part)"""


def words(spark, sf) -> DataFrame:
    """Distinct plain words of the documents, as variable names."""
    text = F.split(F.lower("text"), "[^a-z]+")
    return (
        table(spark, sf, "documents").select(F.explode(text).alias("variable"))
        .filter(F.length("variable") > 0).distinct()
    )


WORDS = """words AS (SELECT DISTINCT variable FROM (SELECT
  unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS variable FROM documents)
  WHERE length(variable) > 0)"""


def visits(spark, sf) -> DataFrame:
    """Part names as variables measured at visits: name.day, name_M<month>."""
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("int")
    day = F.concat_ws(".", "p_name", (size % 12).cast("string"))
    month = F.concat("p_name", F.lit("_M"), (size % 5).cast("string"))
    return p.select(day.alias("variable")).union(p.select(month.alias("variable"))).distinct()


VISITS = """visits AS (SELECT p_name || '.' || CAST(CAST(p_size AS INTEGER) % 12 AS VARCHAR) AS
  variable FROM part UNION SELECT p_name || '_M' || CAST(CAST(p_size AS INTEGER) % 5 AS VARCHAR)
  FROM part)"""


def vectors(spark, sf) -> DataFrame:
    """Embeddings as feature vectors with three given labelings."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
        F.col("label").alias("given_10"),
        (F.col("label") % 5).alias("given_5"),
        (F.col("vec_id") % 3).cast("int").alias("given_3"),
    )


VECTORS = """ve AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS given_10,
  label % 5 AS given_5, CAST(vec_id % 3 AS INTEGER) AS given_3 FROM embeddings)"""
WIDTH = 64


def dimensions(spark, sf, n: int = 8) -> DataFrame:
    """Embeddings as a wide table: vec_id, given labels, e1 … en."""
    v = vectors(spark, sf)
    return v.select(
        "vec_id", "given_10", "given_5", "given_3",
        *[F.col("x")[i].alias(f"e{i + 1}") for i in range(n)],
    )


DIMENSIONS = (
    "di AS (SELECT vec_id, label AS given_10, label % 5 AS given_5, "
    "CAST(vec_id % 3 AS INTEGER) AS given_3, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(1, 9))
    + " FROM embeddings)"
)
DIMS = [f"e{i}" for i in range(1, 9)]


def customers(spark, sf) -> DataFrame:
    """Customers with their order history, as participants to cluster."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"),
        F.max("o_totalprice").alias("max_price"),
    )
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        "c_custkey", "c_mktsegment", "c_acctbal", "n_orders", "avg_price", "max_price"
    )


CUSTOMER_FEATURES = ["c_acctbal", "n_orders", "avg_price", "max_price"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and −0 made 0), so that two engines agree on every digit."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double"
            else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def rd(expression: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0.0 AS DOUBLE))"


def union(names, template: str) -> str:
    """One SELECT per variable; ``{v}`` is its name, ``{i}`` its position."""
    return " UNION ALL ".join(
        template.replace("{v}", v).replace("{i}", str(i)) for i, v in enumerate(names)
    )
