"""Deterministic point catalogues on an integer lattice, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = 1000


def _cents(c: F.Column) -> F.Column:
    return F.round(c * 100).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c, z = F.col("o_orderkey"), F.col("o_custkey"), _cents(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        i.alias("id"), ((i * 7919 + 13) % BOX).alias("x"), ((c * 104729 + i * 31) % BOX).alias("y"), (z % BOX).alias("z"),
        ((i * 37) % 401 - 200).alias("vx"), ((c * 53) % 401 - 200).alias("vy"), (z % 401 - 200).alias("vz"),
    )


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("c_custkey"), F.col("c_nationkey").cast("bigint")
    return table(spark, sf_dir, "customer").select(
        i.alias("id"), s.alias("save"), ((i * 6151 + 7) % BOX).alias("x"), ((i * 3571 + s * 101) % BOX).alias("y"), (_cents(F.col("c_acctbal") + 1000) % BOX).alias("z"), (20 + (i * 131) % 480).alias("numpart"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    steps = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fil"), (F.row_number().over(w) - 1).cast("bigint").alias("k"), F.sum(5 + (p * 17) % 21).over(run).alias("sx"), F.sum((s * 29) % 21 - 10).over(run).alias("sy"), F.sum((p * 11 + s * 7) % 21 - 10).over(run).alias("sz"),
        F.count("*").over(Window.partitionBy("l_orderkey")).alias("size"),
    )
    at = particles(spark, sf_dir).select(F.col("id").alias("fil"), *("x", "y", "z"))
    moved = {c: F.pmod(F.col(c) + F.col(f"s{c}"), F.lit(BOX)) for c in "xyz"}
    return steps.join(at, "fil").select("fil", "k", *(v.alias(c) for c, v in moved.items()), "size")


PARTICLES_SQL = """particles AS (SELECT o_orderkey AS id, (o_orderkey*7919+13)%1000 AS x, (o_custkey*104729+o_orderkey*31)%1000 AS y,
  CAST(round(o_totalprice*100) AS BIGINT)%1000 AS z, (o_orderkey*37)%401-200 AS vx, (o_custkey*53)%401-200 AS vy, CAST(round(o_totalprice*100) AS BIGINT)%401-200 AS vz FROM orders)"""
HALOS_SQL = """halos AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS save, (c_custkey*6151+7)%1000 AS x, (c_custkey*3571+CAST(c_nationkey AS BIGINT)*101)%1000 AS y,
  CAST(round((c_acctbal+1000)*100) AS BIGINT)%1000 AS z, 20+(c_custkey*131)%480 AS numpart FROM customer)"""
NODES_SQL = PARTICLES_SQL + """, steps AS (SELECT l_orderkey AS fil, row_number() OVER w - 1 AS k, sum(5+(l_partkey*17)%21) OVER w AS sx, sum((l_suppkey*29)%21-10) OVER w AS sy,
  sum((l_partkey*11+l_suppkey*7)%21-10) OVER w AS sz, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate ROWS UNBOUNDED PRECEDING)),
nodes AS (SELECT s.fil, k, CAST(((x+sx)%1000+1000)%1000 AS BIGINT) AS x, CAST(((y+sy)%1000+1000)%1000 AS BIGINT) AS y, CAST(((z+sz)%1000+1000)%1000 AS BIGINT) AS z, size FROM steps s JOIN particles p ON p.id=s.fil)"""
