"""Incremental work: resumable jobs, streams over files, monitors, a state machine for sequences."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def remaining(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The inputs whose key is not done."""
    return inputs.join(done.select(key), key, "left_anti")


def resumed(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 50) -> StreamingQuery:
    """Run step over the files that have come since the last run, in batches, each appended to out once."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return step(files).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()


def windows(events: DataFrame, size: str, slide: str, late: str, by: str) -> DataFrame:
    """Counts and sums of value by event-time window; rows later than `late` are left out of streams."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), by)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def places(ends: DataFrame, late: str = "1 hour", bits: int = 6) -> DataFrame:
    """(utt, t, place) from a stream (utt, ts, t, eop, n) whose rows may come out of order: the place moves on after each end flag, and rows stop once it is past n.

    A sequence's rows are taken in order of t from 0 on. One that comes early waits in the state. If the rows before it have not come when the watermark, `late` behind
    the newest ts, passes its ts, a timer lets it go without them; rows that come after that, and rows of a t that has been, are left out. The state of a sequence is its place and what waits.
    Sequences whose utt differ in the last `bits` bits alone share a state and its timer, 64 at most: a call takes far longer than the rows of one.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {utt: (place, after, {int(t): row for t, row in waiting.items()}) for utt, place, after, waiting in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            for pdf in parts:
                utts = [None] * len(pdf) if pd.isna(key[0]) else pdf["utt"].tolist()
                ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
                for utt, t, eop, n, at in zip(utts, pdf["t"].tolist(), pdf["eop"].tolist(), pdf["n"].tolist(), ms.tolist(), strict=True):
                    _, after, waiting = held.setdefault(utt, (1, 0, {}))
                    if t >= after >= 0:
                        waiting.setdefault(t, [eop, n, at])
        passed, out, timers = state.getCurrentWatermarkMs(), [], []
        for utt, (place, after, waiting) in held.items():
            for t in sorted(waiting):
                eop, n, at = waiting[t]
                if t != after and at > passed:
                    timers.append(at)
                    break
                if place > n:
                    after, waiting = -1, {}  # complete
                    break
                del waiting[t]
                out.append((utt, t, place))
                place, after = place + eop, t + 1
            held[utt] = place, after, waiting
        state.update((json.dumps([(utt, *x) for utt, x in held.items()]),))
        if timers:
            state.setTimeoutTimestamp(max(min(timers), passed) + 1)
        yield pd.DataFrame(out, columns=["utt", "t", "place"])

    timed = ends.withWatermark("ts", late).withColumn("few", F.shiftright("utt", bits)).groupBy("few")
    return timed.applyInPandasWithState(step, "utt long, t int, place int", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def model_seam(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a model that each task loads once: for encoders, classifiers, taggers and predictors kept outside this library."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in parts:
            yield model(pdf)

    return df.mapInPandas(run, schema)
