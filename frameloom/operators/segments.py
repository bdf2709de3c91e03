"""Segments of frame series: runs, offsets, pooling, anchors, warps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_time(key: str = "utt", t: str = "t"):
    return W.partitionBy(key).orderBy(t)


def runs(frames: DataFrame, label: str) -> DataFrame:
    """frames with pos, the number of the run of equal labels that a frame is in."""
    new = F.coalesce((F.col(label) != F.lag(label).over(by_time())).cast("int"), F.lit(1))
    return frames.withColumn("_new", new).withColumn("pos", (F.sum("_new").over(by_time()) - 1).cast("int")).drop("_new")


def segments(frames: DataFrame, label: str) -> DataFrame:
    """(utt, pos, label, start, dur) of the runs."""
    return runs(frames, label).groupBy("utt", "pos").agg(F.first(label).alias(label), F.min("t").cast("int").alias("start"), F.count("*").cast("int").alias("dur"))


def with_bounds(segs: DataFrame, dur: str = "dur") -> DataFrame:
    """Segments with start and end by running sums."""
    end = F.sum(dur).over(W.partitionBy("utt").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return segs.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col(dur)).cast("int"))


def merged(segs: DataFrame, label: str, only: str) -> DataFrame:
    """(utt, pos, label, dur): neighbours of the label `only` are one segment."""
    w = W.partitionBy("utt").orderBy("pos")
    same = (F.col(label) == only) & (F.lag(label).over(w) == only)
    island = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w)
    out = segs.withColumn("island", (island - 1).cast("int")).groupBy("utt", "island").agg(F.first(label).alias(label), F.sum("dur").cast("int").alias("dur"))
    return out.withColumnRenamed("island", "pos")


def frames_of(segs: DataFrame) -> DataFrame:
    """One row (.., t) for each frame of a segment: the length regulator on rows. No duration, no row."""
    s = segs.where("dur > 0")
    return s.withColumn("t", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("dur") - 1)))


def pooled(segs: DataFrame, frames: DataFrame, x: str) -> DataFrame:
    """(utt, pos, mean) of the frames of each segment; 0 for one without frames. frames has pos."""
    m = frames.groupBy("utt", "pos").agg(F.avg(x).alias("mean"))
    return segs.select("utt", "pos").join(m, ["utt", "pos"], "left").select("utt", "pos", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def attention_pooled(frames: DataFrame, score: Column, x: str) -> DataFrame:
    """(utt, pos, mean) weighted by the softmax of the scores within the segment. frames has pos."""
    top = F.max(score).over(W.partitionBy("utt", "pos"))
    e = frames.withColumn("_e", F.exp(score - top))
    return e.groupBy("utt", "pos").agg((F.sum(F.col("_e") * F.col(x)) / F.sum("_e")).alias("mean"))


def anchors(segs: DataFrame, frames: DataFrame, x: str) -> DataFrame:
    """(utt, pos, start_x, mid_x, end_x) at the first, middle and last frame of segments (utt, pos, start, dur); without frames all three at the cursor.

    Places beyond the series are its last frame. The three places of a segment are one lookup, picked together again in one aggregation.
    """
    n = frames.groupBy("utt").agg(F.max("t").alias("_last"))
    d = F.greatest(F.col("dur"), F.lit(1))
    places = F.array(F.col("start"), F.col("start") + F.floor(d / 2).cast("int"), F.col("start") + d - 1)
    asked = segs.join(n, "utt").select("utt", "pos", "_last", F.posexplode(places).alias("_k", "_at")).withColumn("t", F.least("_at", "_last"))
    found = asked.join(frames.select("utt", "t", x), ["utt", "t"])
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col(x)))
    return found.groupBy("utt", "pos").agg(at(0).alias("start_x"), at(1).alias("mid_x"), at(2).alias("end_x"))


def end_flags(frames: DataFrame) -> DataFrame:
    """frames with is_end: the last frame of its segment. frames has pos."""
    nxt = F.lead("pos").over(by_time())
    return frames.withColumn("is_end", F.coalesce(nxt != F.col("pos"), F.lit(True)))


def differences(frames: DataFrame, x: str) -> DataFrame:
    """frames with delta and accel, the first and second differences; null where there are too few frames before."""
    w = by_time()
    return frames.withColumn("delta", F.col(x) - F.lag(x).over(w)).withColumn("accel", F.col(x) - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w))


def jitter(frames: DataFrame, x: str) -> DataFrame:
    """(is_end, mean, most, n): size of the step into the next segment against that inside."""
    w = by_time()
    step = frames.withColumn("step", F.abs(F.lead(x).over(w) - F.col(x))).where("step is not null")
    return end_flags(step).groupBy("is_end").agg(F.avg("step").alias("mean"), F.max("step").alias("most"), F.count("*").alias("n"))
