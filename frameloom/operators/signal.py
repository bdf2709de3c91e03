"""Smoothing with replicated edges, envelopes, deltas.

Kernels work on arrays, where replicated edges are clamped indices. Of a series the arrays are blocks of bounded length with
what lies around them (blocks.blockwise); what depends on a whole series is an aggregate joined to its frames.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, mean, total, upto
from .blocks import blockwise, lengths, stretched


def series(frames: DataFrame, x: str, key: str = "utt", t: str = "t") -> DataFrame:
    """(key, xs): the values in order of t, for ragged sequences of a bounded length."""
    return frames.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(t, x))), lambda s: s[x]).alias("xs"))


def exploded(packed: DataFrame, xs: Column, name: str, key: str = "utt") -> DataFrame:
    return packed.select(key, F.posexplode(xs).alias("t", name))


def radius(sigma: float) -> int:
    """How far a Gaussian reaches: 4 sigma."""
    return int(4 * sigma + 0.5)


def around(xs: Column, i: Column, low: int, high: int) -> Column:
    """Values at i+low .. i+high, indices clamped to the series."""
    last = F.size(xs) - 1
    return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.get(xs, F.least(F.greatest(i + k, F.lit(0)), last)))


def gaussian(xs: Column, sigma: float) -> Column:
    """Gaussian smoothing to 4 sigma, edges replicated."""
    r = radius(sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    weights = F.array(*[F.lit(x / sum(w)) for x in w])
    return F.transform(xs, lambda _, i: total(F.zip_with(around(xs, i, -r, r), weights, lambda x, y: x * y)))


def median(xs: Column, size: int = 5) -> Column:
    """Median filter of an odd size, edges replicated."""
    half = size // 2
    return F.transform(xs, lambda _, i: F.array_sort(around(xs, i, -half, half))[half])


def rolling_std(xs: Column, size: int, above: float, least: int = 3) -> Column:
    """Population standard deviation of the voiced values among size places around each; 0 with fewer than `least`."""

    def std(v: Column) -> Column:
        # The voiced values and their mean are bound once for a window, not expanded for each of its elements.
        squares = lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
        return F.when(F.size(v) >= least, F.sqrt(let(mean(v), squares) / F.size(v))).otherwise(0.0)

    return F.transform(xs, lambda _, i: let(F.filter(around(xs, i, -(size // 2), size - size // 2 - 1), lambda x: x > above), std))


def beyond(accel: Column, theta: Column | float) -> Column:
    """What an acceleration has beyond a deadzone of theta to either side; 0 inside it."""
    return F.greatest(F.abs(accel) - theta, F.lit(0.0))


def deadzone_loss(accel: Column, theta: float, weight: float = 1.0) -> Column:
    """Weighted square of what is beyond a fixed deadzone."""
    return weight * beyond(accel, theta) * beyond(accel, theta)


def conditional_deadzone(truth: Column, floor: float) -> Column:
    """The deadzone that a true acceleration leaves its prediction: its own size, the floor at least."""
    return F.greatest(F.abs(truth), F.lit(floor))


def envelope(x: Column, mean_x: Column, low: float, high: float) -> Column:
    """A value in relation to its series' mean, clipped; in a series of zeros the lower bound."""
    return F.least(F.greatest(x / (mean_x + 1e-6), F.lit(low)), F.lit(high))


def enveloped(frames: DataFrame, bounds: dict[str, tuple[float, float]], key: str = "utt") -> DataFrame:
    """frames with columns scaled to mean 1 over their series and clipped to bounds: column -> (low, high)."""
    means = frames.groupBy(key).agg(*(F.avg(x).alias(f"_mean_{x}") for x in bounds))
    made = {x: envelope(F.col(x), F.col(f"_mean_{x}"), low, high) for x, (low, high) in bounds.items()}
    return frames.join(means, key).withColumns(made).select(*frames.columns)


def expanded(x: Column, centre: Column, factor: Column | float) -> Column:
    """The deviation from a centre times a factor."""
    return centre + factor * (x - centre)


def expanded_pitch(frames: DataFrame, x: str, factor: float, above: float = 40.0, least: int = 5, low: float = 40.0, high: float = 500.0, key: str = "utt") -> DataFrame:
    """frames with the voiced values of x moved from their series' mean by a factor and clipped; unchanged in series with fewer than `least` of them."""
    voiced = F.when(F.col(x) > above, F.col(x))
    stats = frames.groupBy(key).agg(F.avg(voiced).alias("_mean"), F.count(voiced).alias("_n"))
    moved = F.least(F.greatest(expanded(F.col(x), F.col("_mean"), factor), F.lit(low)), F.lit(high))
    return frames.join(stats, key).withColumn(x, F.when((F.col("_n") >= least) & (F.col(x) > above), moved).otherwise(F.col(x))).select(*frames.columns)


def end_ramp(frames: DataFrame, x: str, over: int, shift: float, key: str = "utt", t: str = "t") -> DataFrame:
    """frames with a linear ramp from 0 to shift on the last `over` frames of x; unchanged in series of at most twice as many."""
    n = lengths(frames, key, t).withColumnRenamed("n", "_n")
    at = F.col(t) - (F.col("_n") - over)
    ramp = F.when((F.col("_n") > 2 * over) & (at >= 0), shift * at / (over - 1)).otherwise(0.0)
    return frames.join(n, key).withColumn(x, F.col(x) + ramp).select(*frames.columns)


def excitement(frames: DataFrame, size: int = 12, above: float = 40.0, sigma: float = 6.0, pitch_bounds=(0.5, 3.0), loud_bounds=(0.6, 2.5)) -> DataFrame:
    """(utt, t, pitch, loud): how much pitch (Hz) swings and how loud it is at each frame in relation to the whole series, as smoothed multipliers around 1."""
    reach = radius(sigma) + size // 2
    swing = lambda xs: let(rolling_std(xs, size, above), lambda v: gaussian(v, sigma))
    smooth = blockwise(frames, {"pitch": ("pitch", swing), "loud": ("loud", lambda xs: gaussian(xs, sigma))}, reach, reach)
    return enveloped(smooth, {"pitch": pitch_bounds, "loud": loud_bounds})


def excited(frames: DataFrame, exemplar: DataFrame, pitch_intensity: float = 1.0, loud_intensity: float = 1.0, sigma: float = 20.0) -> DataFrame:
    """frames (utt, t, pitch, loud; pitch as a logarithm) with the deviations of both from their smoothed mean multiplied by the excitement of an exemplar.

    exemplar (utt, t, pitch in Hz, loud) has the series to follow under the same utt; its multipliers are warped to our length. Intensity 0 changes nothing. Series without an
    exemplar stay as they are.
    """
    new = lengths(frames).withColumnRenamed("n", "m")
    by = stretched(excitement(exemplar), ["pitch", "loud"], new).select("utt", "t", F.col("pitch").alias("_p"), F.col("loud").alias("_l"))
    smooth = lambda xs: gaussian(xs, sigma)
    centre = blockwise(frames, {"_cp": ("pitch", smooth), "_cl": ("loud", smooth)}, radius(sigma), radius(sigma))
    both = frames.join(centre, ["utt", "t"]).join(by, ["utt", "t"], "left")
    new_x = lambda x, c, e, k: F.when(F.col(e).isNull(), F.col(x)).otherwise(expanded(F.col(x), F.col(c), 1 + k * (F.col(e) - 1)))
    return both.withColumns({"pitch": new_x("pitch", "_cp", "_p", pitch_intensity), "loud": new_x("loud", "_cl", "_l", loud_intensity)}).select(*frames.columns)


def with_delta(
    frames: DataFrame, delta: DataFrame, intensity: float = 1.0, gated: bool = True, gate_sigma: float = 2.0, smooth_sigma: float = 1.5,
    scales: dict[str, float] | None = None, voiced_from: float = math.log(31.0),
) -> DataFrame:
    """frames (utt, t, pitch, loud, ...; pitch as a logarithm) plus an exemplar's delta (utt, t, pitch, loud, voiced of 0 or 1, ...) warped to our length.

    The pitch delta is gated where both sides are voiced, that of loudness where ours is; gates are smoothed so that they don't click, and so are the gated deltas.
    scales: further channels of both tables and the factor of their deltas, which are not gated. Series without a delta stay as they are.
    """
    scales = scales or {}
    channels = ["pitch", "loud", *scales]
    new = lengths(frames).withColumnRenamed("n", "m")
    warped = stretched(delta, [*channels, "voiced"], new).withColumnsRenamed({c: f"_{c}" for c in channels})
    ours = (F.col("pitch") > voiced_from).cast("double")
    met = frames.select("utt", "t", ours.alias("_ours")).join(warped, ["utt", "t"])
    met = met.withColumn("_both", F.col("_ours") * (F.col("voiced") > 0.5).cast("double"))
    smooth = (lambda xs: gaussian(xs, smooth_sigma)) if smooth_sigma > 0 else (lambda xs: xs)
    times = lambda xs, gate: F.zip_with(xs, gaussian(gate, gate_sigma), lambda x, g: x * g)  # noqa: E731  read once: bound below
    kernels = {c: (f"_{c}", smooth) for c in channels}
    if gated:
        kernels |= {c: ((f"_{c}", gate), lambda xs, g: let(times(xs, g), smooth)) for c, gate in (("pitch", "_both"), ("loud", "_ours"))}
    reach = radius(gate_sigma) + radius(max(smooth_sigma, 0.0))
    moves = blockwise(met, kernels, reach, reach).withColumnsRenamed({c: f"_{c}" for c in channels})
    factor = {"pitch": intensity, "loud": intensity, **scales}
    added = {c: F.col(c) + factor[c] * F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in channels}
    return frames.join(moves, ["utt", "t"], "left").withColumns(added).select(*frames.columns)


def paired_delta(frames: DataFrame, baseline: DataFrame, xs: list[str], sigma: float = 3.0) -> DataFrame:
    """(utt, t, xs...): frames less the smoothed frames of a baseline of the same grid; sigma 0 takes the baseline as it is."""
    if sigma > 0:
        baseline = blockwise(baseline, {x: (x, lambda v: gaussian(v, sigma)) for x in xs}, radius(sigma), radius(sigma))
    b = baseline.select("utt", "t", *(F.col(x).alias(f"_{x}") for x in xs))
    return frames.join(b, ["utt", "t"]).select("utt", "t", *((F.col(x) - F.col(f"_{x}")).alias(x) for x in xs))


def with_body_delta(frames: DataFrame, delta: DataFrame, ends: DataFrame, x: str, intensity: float = 1.0) -> DataFrame:
    """frames plus a delta (utt, t, x) that begins after the first segment: ends (utt, first, last) are the durations of the segments at both ends.

    Body frames beyond the delta, and the frames of both ends, get 0; a delta longer than the body is cut.
    """
    n = lengths(frames).withColumnRenamed("n", "_n")
    d = delta.join(ends, "utt").join(n, "utt").where(F.col("t") < F.col("_n") - F.col("first") - F.col("last"))
    d = d.select("utt", (F.col("t") + F.col("first")).alias("t"), F.col(x).alias("_d"))
    return frames.join(d, ["utt", "t"], "left").withColumn(x, F.col(x) + intensity * F.coalesce("_d", F.lit(0.0))).select(*frames.columns)


def rendered(start: Column, mid: Column, end: Column, d: Column, kind: Column) -> Column:
    """d values through three anchors. kind "linear": two straight parts that both hold the middle anchor; "plateau": the
    middle anchor between the ends; "line": from start to end. d = 1 gives the middle one (a line the mean of its ends), d = 2 both ends."""
    first = F.floor((d + 1) / 2).cast("int")
    rest = d - first
    straight = lambda a, b, i, n: a + (b - a) * i / F.greatest(n - 1, F.lit(1))

    def at(i: Column) -> Column:
        linear = F.when(d == 3, F.when(i == 0, start).when(i == 1, mid).otherwise(end)).when(i < first, straight(start, mid, i, first)).otherwise(straight(mid, end, i - first, rest))
        plateau = F.when(i == 0, start).when(i == d - 1, end).otherwise(mid)
        return F.when(kind == "line", straight(start, end, i, d)).when(kind == "plateau", plateau).otherwise(linear)

    points = F.when(d == 1, F.array(F.when(kind == "line", 0.5 * (start + end)).otherwise(mid))).when(d == 2, F.array(start, end))
    return F.when(d < 1, F.array().cast("array<double>")).otherwise(F.coalesce(points, F.transform(upto(d), at)))
