"""Writers. Spark's committers publish whole files or none, and retries are the tasks' own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def features(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by columns if asked."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def log(df: DataFrame, path: str) -> None:
    """Append JSON lines."""
    df.write.mode("append").json(path)


def cadenced(steps: DataFrame, losses: str, ratios: dict[str, Column], every: int = 50, ratios_every: int = 200) -> DataFrame:
    """The records that a log gets of steps (step, epoch, losses struct): one every `every` steps, with ratios every `ratios_every`, and the mean losses of each epoch at its last step."""
    names = steps.schema[losses].dataType.names
    held = F.when(F.col("step") % ratios_every == 0, F.struct(*(x.alias(n) for n, x in ratios.items())))
    records = steps.where(F.col("step") % every == 0).select(F.lit("step").alias("type"), "step", "epoch", F.col(losses).alias("losses"), held.alias("grad_ratios"))
    means = F.struct(*(F.avg(f"{losses}.{n}").alias(n) for n in names)).alias("losses")
    epochs = steps.groupBy("epoch").agg(F.max("step").alias("step"), means).select(F.lit("epoch").alias("type"), "step", "epoch", "losses")
    return records.unionByName(epochs, allowMissingColumns=True)


def keyed_json(df: DataFrame, key: str, path: str) -> None:
    """JSON lines of one-key maps, which together are the map from key to record."""
    record = F.struct(*(c for c in df.columns if c != key))
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), record)).alias("value")).write.mode("overwrite").text(path)


def split(df: DataFrame, path: str) -> DataFrame:
    """Write by the column split; returns (split, rows) of what was written."""
    features(df, path, ["split"])
    return df.sparkSession.read.schema(df.schema).parquet(path).groupBy("split").agg(F.count("*").alias("rows"))


def alignment_corpus(df: DataFrame, path: str) -> None:
    """Text lines (utt_id, tab, text) in folders by spk and emotion."""
    line = F.concat_ws("\t", "utt_id", "text").alias("value")
    df.select("spk", "emotion", line).write.mode("overwrite").partitionBy("spk", "emotion").text(path)


def best_so_far(log: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """log with is_best: the value is below all before it in its run."""
    before = F.min(value).over(W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return log.withColumn("is_best", before.isNull() | (F.col(value) < before))


def published(df: DataFrame, path: str, key: str, least_bytes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Append the rows whose key is not there yet; returns all rows. least_bytes: a filter for rows too small to publish."""
    spark = df.sparkSession
    new = least_bytes(df) if least_bytes else df
    try:
        there = spark.read.schema(df.schema).parquet(path)
        there.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    if there is not None:
        new = new.join(there.select(key), key, "left_anti")
    new.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
