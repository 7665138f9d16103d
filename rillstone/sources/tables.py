"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epoch_ms(col: str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})") / 1000)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ms, event_id, event_type, cents and k: ordered by (ms, event_id) within a user."""
    return read(spark, sf_dir, "events").select(
        "user_id",
        epoch_ms("ts").alias("ms"),
        "event_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )


#: The same rows in DuckDB SQL.
EVENTS_SQL = """e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, event_type,
  CAST(round(value * 100) AS BIGINT) AS cents, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""
KEY = ["user_id"]
ORDER = ["ms", "event_id"]
HOUR = 3_600_000


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memory fragments: ids repeat, some rows are invalid, some have bounds or no embedding."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = F.col("doc_id")
    bounded = n % 5 == 0
    return read(spark, sf_dir, "documents").join(vectors, "doc_id", "left").select(
        n.alias("idx"),
        F.when(n % 89 == 0, "").otherwise(F.concat(F.lit("f"), (n % 700).cast("string"))).alias("id"),
        F.when(n % 97 == 0, F.lit(1.5)).otherwise(F.least(F.col("n_chars"), F.lit(20000)) / F.lit(20000)).alias("confidence"),
        (n * 1000).alias("t_ns"),
        F.when(bounded, n).alias("valid_from"),
        F.when(bounded, F.when(n % 35 == 0, n - 1).otherwise(n + 50)).alias("valid_to"),
        F.array("lang", "source").alias("tags"),
        "embedding",
    )


FRAGMENTS_SQL = """fr AS (SELECT doc_id AS idx, CASE WHEN doc_id % 89 = 0 THEN '' ELSE 'f' || (doc_id % 700) END AS id,
 CASE WHEN doc_id % 97 = 0 THEN 1.5::DOUBLE ELSE least(n_chars, 20000) / 20000::DOUBLE END AS confidence, doc_id * 1000 AS t_ns,
 CASE WHEN doc_id % 5 = 0 THEN doc_id END AS valid_from,
 CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 35 = 0 THEN doc_id - 1 ELSE doc_id + 50 END END AS valid_to,
 [lang, source] AS tags, e.embedding::DOUBLE[] AS embedding FROM documents LEFT JOIN embeddings e ON vec_id = doc_id),
frs AS (SELECT *, NOT (id = '' OR confidence > 1 OR coalesce(valid_from >= valid_to, false)) AS ok FROM fr),
frk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, ok ORDER BY idx) AS rk FROM frs) WHERE ok AND rk = 1)"""
