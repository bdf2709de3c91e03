"""Series of any length in blocks of bounded length.

A series is rows (key, t, x) with t from 0 without gaps. A block holds SIZE of its places and, on both sides, the rows that
a kernel looks at beyond them, which are sent to the neighbours as copies. So a long series is many rows of many tasks, and none is gathered as one array. Where a block's
array ends, either the series ends too or the kernel doesn't look further: clamped indices replicate the edges of the series, and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

#: Places of a block.
SIZE = 4096

Kernel = Callable[..., Column]


def blocks(frames: DataFrame, xs: list[str], before: int, after: int, key: str = "utt", t: str = "t", size: int = SIZE) -> DataFrame:
    """(key, block, first, rows): rows, structs (t, xs...) in order of t, are the places of the block and up to `before` and `after` more; first is the t of the first one."""
    low, high = F.floor((F.col(t) - after) / size), F.floor((F.col(t) + before) / size)  # the blocks that look at t
    sent = frames.select(key, t, *xs, F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("block"))
    own = F.max((F.floor(F.col(t) / size) == F.col("block")).cast("int"))
    packed = sent.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct(t, *xs))).alias("rows"), own.alias("_own"))
    return packed.where("_own = 1").select(key, "block", F.col("rows")[0][t].alias("first"), "rows")


def blockwise(frames: DataFrame, kernels: Mapping[str, tuple[str | tuple[str, ...], Kernel]], before: int, after: int, key: str = "utt", t: str = "t", size: int = SIZE) -> DataFrame:
    """(key, t, and a column for each kernel). kernels: result name -> (column or columns, function of their arrays to an array of equal length).

    A kernel sees the values of a block with what is around them, and may look at `before` places before and `after` places after each, indices clamped.
    """
    of = {name: (xs,) if isinstance(xs, str) else xs for name, (xs, _) in kernels.items()}
    names = list(dict.fromkeys(x for xs in of.values() for x in xs))
    column = lambda x: F.transform("rows", lambda r: r[x])

    def bound(xs: tuple[str, ...], kernel: Kernel, *arrays: Column) -> Column:
        """The kernel on arrays that are made once, not anew for each of their elements."""
        return let(column(xs[0]), lambda a: bound(xs[1:], kernel, *arrays, a)) if xs else kernel(*arrays)

    made = [bound(of[name], k).alias(name) for name, (_, k) in kernels.items()]
    rows = blocks(frames, names, before, after, key, t, size).select(key, "block", F.explode(F.arrays_zip(column(t).alias(t), *made)).alias("_r"))
    own = F.floor(F.col(f"_r.{t}") / size) == F.col("block")
    return rows.where(own).select(key, *(F.col(f"_r.{c}").alias(c) for c in (t, *kernels)))


def sampled(points: DataFrame, frames: DataFrame, xs: list[str], at: str = "at", key: str = "utt", t: str = "t", size: int = SIZE) -> DataFrame:
    """points (key, at, ...) with the columns xs of frames at the place `at`, linear between whole places. A place without a frame gives null.

    The two frames beside a place are looked up in the block that it falls into: one equi-join on (key, block), whatever the lengths.
    """
    packed = blocks(frames, xs, 0, 1, key, t, size)
    asked = points.drop(*xs).withColumn("block", F.floor(F.floor(at) / size))
    joined = asked.join(packed, [key, "block"], "left")
    i = (F.floor(at) - F.col("first")).cast("int")
    last = F.size("rows") - 1
    rest = F.col(at) - F.floor(at)

    def value(x: str) -> Column:
        low, high = F.get("rows", i)[x], F.get("rows", F.least(i + 1, last))[x]
        return F.when(rest == 0, low).otherwise(low + rest * (high - low)).alias(x)

    return joined.select(*(c for c in points.columns if c not in xs), *(value(x) for x in xs))


def lengths(frames: DataFrame, key: str = "utt", t: str = "t") -> DataFrame:
    """(key, n): the length of each series."""
    return frames.groupBy(key).agg((F.max(t) + 1).cast("int").alias("n"))


def stretched(frames: DataFrame, xs: list[str], new: DataFrame, key: str = "utt", t: str = "t", size: int = SIZE) -> DataFrame:
    """(key, t, xs...): each series resampled linearly to the length that new (key, m) asks for, ends kept; one frame gives m copies, m = 1 the first frame.

    New places come in ranges of `size`, so a long series is not one row.
    """
    spans = new.join(lengths(frames, key, t), key).where("m > 0")
    begin = F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(size))).alias("_begin")
    spans = spans.select(key, "n", "m", begin)
    stop = F.least(F.col("_begin") + size, F.col("m")) - 1
    points = spans.select(key, "n", "m", F.explode(F.sequence(F.col("_begin"), stop)).alias(t))
    points = points.withColumn("at", F.col(t) * (F.col("n") - 1) / F.greatest(F.col("m") - 1, F.lit(1)))
    return sampled(points, frames, xs, "at", key, t, size).select(key, t, *xs)


def segment_points(source: DataFrame, target: DataFrame, key: str = "utt", pos: str = "pos") -> DataFrame:
    """(key, pos, t, at): for each frame t of the target segments the place in the source series that it is taken from.

    source (key, pos, dur, n): durations and the length n of the source series, which may be shorter or longer than their sum. target (key, pos, dur). Segments are paired by pos; a
    target without a source segment has one without frames. Within a segment the places are spread evenly over the source's frames, ends kept. A segment without source frames takes the last
    frame before it, and null where there is none.
    """
    from .segments import with_bounds

    s = with_bounds(source.select(key, pos, "dur", "n")).select(key, pos, F.col("start").alias("_s"), F.col("end").alias("_e"), "n")
    g = with_bounds(target.select(key, pos, "dur")).where("dur > 0").select(key, pos, "dur", F.col("start").alias("_t"))
    whole = s.groupBy(key).agg(F.max("n").alias("_n"), F.max("_e").alias("_all"))
    j = g.join(s.drop("n"), [key, pos], "left").join(whole, key, "left")
    a = F.least(F.coalesce("_s", "_all", F.lit(0)), F.coalesce("_n", F.lit(0)))
    frames = F.greatest(F.least(F.coalesce("_e", "_all", F.lit(0)), F.coalesce("_n", F.lit(0))) - a, F.lit(0))
    rows = j.select(key, pos, "dur", "_t", a.alias("_a"), frames.alias("_f"), F.explode(F.sequence(F.lit(0), F.col("dur") - 1)).alias("_i"))
    spread = F.col("_a") + F.col("_i") * (F.col("_f") - 1) / F.greatest(F.col("dur") - 1, F.lit(1))
    at = F.when(F.col("_f") > 1, spread).when(F.col("_f") == 1, F.col("_a").cast("double")).when(F.col("_a") > 0, (F.col("_a") - 1).cast("double"))
    return rows.select(key, pos, (F.col("_t") + F.col("_i")).alias("t"), at.alias("at"))


def warped_onto(frames: DataFrame, xs: list[str], source: DataFrame, target: DataFrame, key: str = "utt", size: int = SIZE) -> DataFrame:
    """(key, pos, t, xs...): frames warped piece by piece from the segments of source (key, pos, dur) onto those of target (key, pos, dur).

    See segment_points(); where there is no frame to take, 0.
    """
    n = lengths(frames, key)
    points = segment_points(source.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))), target, key)
    got = sampled(points, frames, xs, "at", key, "t", size)
    return got.select(key, "pos", "t", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in xs))


def blended(blocks_: DataFrame, ext: str = "ext", key: str = "utt", pos: str = "pos", share: float = 0.5) -> DataFrame:
    """(key, pos, body): blocks (key, pos, ext) without their context frames, edges blended with what the neighbours predict for them.

    ext is a block's frames between a predicted frame of the block before and one of the block after. The first frame of a block is mixed with the last context frame of
    the block before it, then the last frame with the first one of the block after it; a block of one frame is mixed with both in turn. Positions are counted
    without gaps. Frames are numbers or vectors. Each block sends its two context frames to its neighbours: one shuffle by (key, pos), and no series in one place.
    """
    vectors = str(blocks_.schema[ext].dataType).startswith("ArrayType(ArrayType")
    mix = (lambda a, b: F.zip_with(a, b, lambda x, y: (1 - share) * x + share * y)) if vectors else (lambda a, b: (1 - share) * a + share * b)
    frame = blocks_.schema[ext].dataType.elementType
    none, no_block = F.lit(None).cast(frame), F.lit(None).cast(blocks_.schema[ext].dataType)
    own = blocks_.select(key, pos, F.col(ext).alias("_ext"), none.alias("_before"), none.alias("_after"))
    to_next = blocks_.select(key, (F.col(pos) + 1).alias(pos), no_block.alias("_ext"), F.element_at(ext, -1).alias("_before"), none.alias("_after"))
    to_last = blocks_.select(key, (F.col(pos) - 1).alias(pos), no_block.alias("_ext"), none.alias("_before"), F.element_at(ext, 1).alias("_after"))
    met = own.union(to_next).union(to_last).groupBy(key, pos).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("_ext", "_before", "_after"))).where("_ext is not null")
    body = F.slice("_ext", F.lit(2), F.size("_ext") - 2)
    met = met.where(F.size("_ext") > 2).withColumn("_body", body)
    first = F.when(F.col("_before").isNull(), F.col("_body")[0]).otherwise(mix(F.col("_body")[0], F.col("_before")))
    met = met.withColumn("_body", F.concat(F.array(first), F.slice("_body", F.lit(2), F.size("_body") - 1)))
    end = F.element_at("_body", -1)
    last = F.when(F.col("_after").isNull(), end).otherwise(mix(end, F.col("_after")))
    return met.select(key, pos, F.concat(F.slice("_body", F.lit(1), F.size("_body") - 1), F.array(last)).alias("body"))
