"""The registry of queries: each reads the driver's tables and may have the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A page's path is its URL without the scheme, query and fragment.
PAGE_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))


def micros(column: str) -> Column:
    """Microseconds of a timestamp without time zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: episode_id, t, event_id, ts_us, x, y."""
    from framewright.operators.sequences import number_frames

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), "event_id", micros("ts").alias("ts_us"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type")
    return number_frames(events, "episode_id", ["ts_us", "event_id"])


FRAMES = """f AS (SELECT user_id AS episode_id, event_id, epoch_us(ts) AS ts_us, value AS x,
    nullif(regexp_extract(props, '"k": *([0-9.-]+)', 1), '')::DOUBLE AS y, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"""
LENGTHS = FRAMES + """, l AS (SELECT episode_id, count(*) AS n FROM f GROUP BY episode_id)"""
SAMPLES = LENGTHS + """, k AS (SELECT unnest(range(0, 32)) AS pos),
s AS (SELECT episode_id, 'past' AS half, pos, (pos * (n // 2 - 1)) // 31 AS t FROM l, k WHERE n >= 2
      UNION ALL SELECT episode_id, 'target', pos, n // 2 + (pos * (n - 1 - n // 2)) // 31 FROM l, k WHERE n >= 2)"""


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day as a log of epochs: epoch, train, val, loss (NaN on every seventh)."""
    events = table(spark, sf_dir, "events")
    days = events.groupBy(F.to_date("ts").alias("d")).agg(r6(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))) / F.count_if(F.col("event_id") % 2 == 0)).alias("train"), r6(F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value"))) / F.count_if(F.col("event_id") % 2 == 1)).alias("val"))
    from pyspark.sql import Window

    days = days.withColumn("epoch", F.row_number().over(Window.orderBy("d")).cast("long"))  # one row for each day
    return days.select("epoch", "train", F.when(F.col("epoch") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("val")).alias("val"))


DAILY = """dd AS (SELECT ts::DATE AS d, round(sum(value) FILTER (event_id % 2 = 0) / count(*) FILTER (event_id % 2 = 0), 6) AS train,
    round(sum(value) FILTER (event_id % 2 = 1) / count(*) FILTER (event_id % 2 = 1), 6) AS val FROM events GROUP BY 1),
e AS (SELECT row_number() OVER (ORDER BY d) AS epoch, train, CASE WHEN row_number() OVER (ORDER BY d) % 7 = 0 THEN 'nan'::DOUBLE ELSE val END AS val FROM dd)"""
