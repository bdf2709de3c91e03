"""Fixture tables as the feature store's tables, in Spark and in SQL; the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import segments as seg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = "view"
KINDS = ("click", "error", "purchase", "signup", "view")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL for the same rows where there is one."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, t, phone, pitch): the events of a user in order are the frames of an utterance."""
    t = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), t.cast("int").alias("t"), F.col("event_type").alias("phone"), F.col("value").alias("pitch"))


def with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.runs(frames(spark, sf_dir), "phone")


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segments(frames(spark, sf_dir), "phone")


FRAMES = """frames AS (SELECT user_id AS utt, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS t,
  event_type AS phone, value AS pitch FROM events)"""
RUNS = FRAMES + """, marks AS (SELECT *, CASE WHEN phone = lag(phone) OVER (PARTITION BY utt ORDER BY t) THEN 0 ELSE 1 END AS fresh FROM frames),
 runs AS (SELECT utt, t, phone, pitch, (sum(fresh) OVER (PARTITION BY utt ORDER BY t) - 1)::INTEGER AS pos FROM marks)"""
SEGS = RUNS + """, segs AS (SELECT utt, pos, min(phone) AS phone, min(t)::INTEGER AS start, count(*)::INTEGER AS dur FROM runs GROUP BY utt, pos)"""
