"""A monitor over a growing metrics log, and results of streams in update mode."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Epochs that the state of a run holds: what comes later for an older one is left out.
EPOCHS = 8
STATUS = "run string, epoch long, value double, recent double, trend double, better boolean, best double, eta_seconds double"


def status_of(epochs: dict[int, list[float]], best: float | None, baseline: float, target: int, last: int = 3) -> tuple:
    """(epoch, value, recent, trend, better, best, eta_seconds) from epoch -> [sum of values, number, seconds]."""
    ids = sorted(epochs)
    value = lambda e: epochs[e][0] / epochs[e][1]
    tail = ids[-last:]
    recent = sum(map(value, tail)) / len(tail)
    trend = value(ids[-1]) - value(ids[-2]) if len(ids) > 1 else None
    seconds = sum(epochs[e][2] for e in tail) / len(tail)
    return ids[-1], value(ids[-1]), recent, trend, recent < baseline, best, (target - ids[-1]) * seconds


def monitored(log: DataFrame, baseline: float, target: int) -> DataFrame:
    """A row for each run that has new records: its status by the last epochs. log: stream of (run, epoch, value, seconds), several records an epoch in any order.

    For update mode. value is the mean of the last epoch's records, recent that of the last three epochs' values, trend the step from the epoch before, best the least record so far, eta
    the epochs up to `target` at the pace of the last three. The state of a run is EPOCHS sums, however long the log grows.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, best = json.loads(state.get[0]) if state.exists else ({}, None)
        epochs = {int(e): x for e, x in held.items()}
        for pdf in parts:
            sums = pdf.groupby("epoch").agg(total=("value", "sum"), n=("value", "count"), seconds=("seconds", "sum"))
            for e, total, n, seconds in sums.itertuples():
                x = epochs.setdefault(int(e), [0.0, 0, 0.0])
                epochs[int(e)] = [x[0] + float(total), x[1] + int(n), x[2] + float(seconds)]
            least = float(pdf["value"].min())
            best = least if best is None else min(best, least)
        epochs = {e: epochs[e] for e in sorted(epochs)[-EPOCHS:]}
        state.update((json.dumps([epochs, best]),))
        yield pd.DataFrame([(key[0], *status_of(epochs, best, baseline, target))], columns=[f.split()[0] for f in STATUS.split(", ")])

    return log.where("epoch is not null and value is not null").groupBy("run").applyInPandasWithState(step, STATUS, "held string", "update", GroupStateTimeout.NoTimeout)


def upserted(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream in update mode over what is there. Each batch is a folder of its own and is overwritten when it is repeated."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: StructType, *key: str) -> DataFrame:
    """Of the rows of upserted() the last one for each key."""
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(path)
    rest = [c for c in schema.names if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*key, "_row.*")
