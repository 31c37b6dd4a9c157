"""Views that give the test tables the shapes the operators expect. Each is mirrored in the queries' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowlane.functions.signature import from_vector
from winnowlane.session import table


def shots(spark: SparkSession, d: str) -> DataFrame:
    """events as records with time, camera, unit and position; every tenth lacks a camera, every ninth a position."""
    e = table(spark, d, "events")
    gone = F.lit(None)
    lat = F.pmod(F.col("user_id") * 37, F.lit(120)) - 60 + F.pmod("event_id", F.lit(7)) * 0.01
    lon = F.pmod(F.col("user_id") * 53, F.lit(300)) - 150 + F.pmod("event_id", F.lit(5)) * 0.01
    here = F.pmod("event_id", F.lit(9)) != 0
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("unit"), F.when(F.pmod("event_id", F.lit(10)) != 0, F.col("event_type")).otherwise(gone).alias("camera"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(here, lat.cast("double")).alias("lat"), F.when(here, lon.cast("double")).alias("lon"),
    )


def customers_in_folders(spark: SparkSession, d: str) -> DataFrame:
    """customer as rows of a tree region / nation / segment; every tenth lies loose in its nation."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.select(F.col("c_custkey").alias("id"), F.concat_ws("/", "r_name", "n_name", F.when(F.pmod("c_custkey", F.lit(10)) != 0, F.col("c_mktsegment"))).alias("dir"), F.col("c_acctbal").alias("score"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as 64-bit signatures; the label is the unit."""
    e = table(spark, d, "embeddings").withColumn("s", from_vector(F.col("embedding")))
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("unit"), "s.hi", "s.lo")


#: part as records of images, in expressions that Spark and DuckDB read alike.
RECORD = """p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Trip/Day:' || CAST(p_partkey % 9 AS STRING) WHEN 2 THEN 'Trip' ELSE 'Home' END AS dir,
  p_name || '_' || CAST(p_partkey AS STRING) || '.jpg' AS name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Trip/Day:' || CAST(p_partkey % 9 AS STRING) || '/' WHEN 2 THEN 'Trip/' ELSE 'Home/' END || p_name || '_' || CAST(p_partkey AS STRING) || '.jpg' AS path,
  CASE p_partkey % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'heic' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' ELSE 'unknown' END AS kind, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 5095 + CAST(p_partkey % 9 AS INT) END AS w, 5000 AS h, CAST(p_partkey % 4 AS INT) AS r,
  CASE WHEN p_partkey % 7 > 0 THEN '2024-' || lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0') || 'T09:' || lpad(CAST(p_partkey % 60 AS STRING), 2, '0') || ':00' END AS taken,
  CASE WHEN p_partkey % 3 = 0 THEN '+09:00' END AS tz, CASE WHEN p_partkey % 5 = 0 THEN 'modified' ELSE 'original' END AS taken_from,
  CASE p_partkey % 5 WHEN 0 THEN 'Canon' WHEN 1 THEN 'NIKON CORPORATION' WHEN 2 THEN 'Apple' WHEN 3 THEN '' END AS make, CASE p_partkey % 5 WHEN 0 THEN 'Canon EOS R6' WHEN 1 THEN 'NIKON Z 6' WHEN 2 THEN 'iPhone 15 Pro' WHEN 3 THEN 'X100' END AS model,
  CASE WHEN p_partkey % 6 > 0 THEN p_brand END AS lens, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 4 AS DOUBLE) END AS fl35, CASE WHEN p_partkey % 8 > 0 THEN CAST(p_size AS DOUBLE) * CAST(0.5 AS DOUBLE) END AS fl,
  CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 16 AS DOUBLE) * CAST(0.5 AS DOUBLE) END AS f, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(0.3 AS DOUBLE) WHEN 2 THEN CAST(0.8 AS DOUBLE) WHEN 3 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / CAST(p_partkey % 500 + 4 AS DOUBLE) END AS exposure,
  CASE WHEN p_partkey % 9 > 0 THEN CAST(p_partkey % 64 * 100 AS DOUBLE) END AS iso, CASE WHEN p_partkey % 5 > 1 THEN CAST(p_partkey % 170 AS DOUBLE) - CAST(85 AS DOUBLE) + CAST(p_partkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS lat,
  CASE WHEN p_partkey % 5 > 1 THEN CAST(p_partkey % 350 AS DOUBLE) - CAST(175 AS DOUBLE) - CAST(p_partkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS lon, CASE WHEN p_partkey % 4 = 0 THEN 'Kyoto' WHEN p_partkey % 4 = 1 THEN '' END AS city,
  CASE WHEN p_partkey % 8 = 1 THEN 'Gion' END AS sublocation, CASE WHEN p_partkey % 6 = 2 THEN 'Osaka' END AS state, CASE p_partkey % 3 WHEN 0 THEN 'Japan' WHEN 1 THEN 'Kyoto' END AS country, CAST(p_partkey AS BIGINT) * 977 AS size, CASE WHEN p_partkey % 13 = 0 THEN 'bad' END AS err"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """part as records of images, with missing values, folders at three depths and sides around the edge of square."""
    return spark.sql(f"SELECT {RECORD} FROM {{part}}", part=table(spark, d, "part"))
