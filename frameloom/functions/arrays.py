"""Kernels on arrays: durations, ragged sequences, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value bound to a variable: however often f uses it, it is computed once."""
    return F.transform(F.array(value), f)[0]


def upto(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0 (a bare sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def total(xs: Column, kind: str = "double") -> Column:
    return F.aggregate(xs, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def running(xs: Column) -> Column:
    """Inclusive running sums of an array of whole numbers."""
    return F.transform(xs, lambda _, i: total(F.slice(xs, 1, i + 1), "int"))


def packed(ema: Column, pitch: Column, loudness: Column) -> Column:
    """Channels of a frame in one vector."""
    return F.concat(ema, F.array(pitch), F.array(loudness))


def reconciled(*xs: Column) -> list[Column]:
    """The arrays cut to the least of their lengths."""
    n = F.least(*(F.size(x) for x in xs)) if len(xs) > 1 else F.size(xs[0])
    return [F.slice(x, 1, n) for x in xs]


def same_length(*xs: Column) -> Column:
    """The first array, or an error if the lengths differ."""
    ok = F.lit(True)
    for x in xs[1:]:
        ok = ok & (F.size(xs[0]) == F.size(x))
    return F.when(ok, xs[0]).otherwise(F.raise_error(F.lit("lengths differ")).cast("array<double>"))


def auto_log_pitch(pitch: Column, hz_from: float = 20.0) -> Column:
    """log1p of a series that is still in Hz, known by a value above hz_from."""
    return F.when(F.array_max(pitch) > hz_from, F.transform(pitch, F.log1p)).otherwise(pitch)


def wrapped(xs: Column, bos: Column, eos: Column) -> Column:
    return F.concat(F.array(bos), xs, F.array(eos))


def body(xs: Column) -> Column:
    """Without first and last; empty for fewer than three."""
    return F.when(F.size(xs) > 2, F.slice(xs, F.lit(2), F.size(xs) - 2)).otherwise(F.slice(xs, 1, 0))


def regulated(durs: Column) -> Column:
    """Length regulator: index i dur[i] times. Zero durations give nothing."""
    return F.flatten(F.transform(durs, lambda d, i: F.array_repeat(i, d.cast("int"))))


def to_length(xs: Column, n: Column, pad: Column) -> Column:
    """Cut or padded to n."""
    return F.slice(F.concat(xs, F.array_repeat(pad, F.greatest(n - F.size(xs), F.lit(0)).cast("int"))), F.lit(1), n)


def even_split(frames: Column, n: Column) -> Column:
    """n whole parts of frames; the first frames mod n get one more."""
    return F.transform(upto(n), lambda i: F.floor(frames / n).cast("int") + (i < F.pmod(frames, n)).cast("int"))


def trimmed_to(durs: Column, frames: Column) -> Column:
    """Durations cut where they pass frames; later ones become 0."""
    before = lambda i: total(F.slice(durs, 1, i), "int")
    return F.transform(durs, lambda d, i: F.greatest(F.lit(0), F.least(d, frames - before(i))))


def tail_trimmed(durs: Column, most: Column) -> Column:
    """Durations of a series that is cut to `most`: those whose running sum is within it, the first one in any case; the last takes what is missing. A series within `most` stays."""
    n = F.greatest(F.size(F.filter(durs, lambda d, i: total(F.slice(durs, 1, i + 1), "int") <= most)), F.lit(1))
    kept = F.slice(durs, F.lit(1), n)
    rest = F.greatest(F.lit(0), most - total(kept, "int"))
    return F.when(total(durs, "int") <= most, durs).otherwise(F.transform(kept, lambda d, i: F.when(i == F.size(kept) - 1, d + rest).otherwise(d)))


def residual_fixed(durs: Column, frames: Column) -> Column:
    """Durations that add up to frames: the difference goes to the last item, at a surplus the last positive one, at a
    shortage the last that stays at 1 or more; where there is none nothing changes."""
    diff = frames - total(durs, "int")
    fits = F.transform(durs, lambda d, i: F.when(F.when(diff > 0, d > 0).otherwise(d + diff >= 1), i).otherwise(F.lit(-1)))
    at = F.array_max(fits)
    return F.when(diff == 0, durs).otherwise(F.transform(durs, lambda d, i: F.when(i == at, d + diff).otherwise(d)))


def weighted_durations(weights: Column, frames: Column) -> Column:
    """frames in proportion to weights, each rounded half to even and 1 at least; the residual goes one by one by descending size.

    A surplus is taken off only from items above 1, so the sum can stay above frames when there are more items.
    """
    all_ = total(weights)
    raw = F.transform(weights, lambda w: w * frames / all_)
    base = F.transform(raw, lambda x: F.greatest(F.lit(1), F.bround(x).cast("int")))
    diff = frames - total(base, "int")
    order = F.transform(F.array_sort(F.transform(raw, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), lambda s: s["i"])
    n = F.size(weights)
    rank = lambda i: F.array_position(order, i) - 1
    more = lambda i: F.floor(diff / n).cast("int") + (rank(i) < F.pmod(diff, n)).cast("int")
    less = lambda d, i: F.when((rank(i) < -diff) & (d > 1), d - 1).otherwise(d)
    return F.when(diff >= 0, F.transform(base, lambda d, i: d + more(i))).otherwise(F.transform(base, less))


def interval_durations(starts: Column, ends: Column, frames: Column, rate: int = 50) -> Column:
    """Frames of intervals in seconds, 1 at least, fitted to frames: the last takes the difference as far as it stays at 1; where the sum still
    differs, all are scaled, rounded half to even, and the last takes the difference again."""

    def last_fixed(xs: Column) -> Column:
        diff = frames - total(xs, "int")
        return F.transform(xs, lambda d, i: F.when(i == F.size(xs) - 1, F.greatest(F.lit(1), d + diff)).otherwise(d))

    def scaled(xs: Column) -> Column:
        # The factor is computed before the product, as halves depend on it.
        factor = frames / total(xs, "int")
        return let(F.transform(xs, lambda d: F.greatest(F.lit(1), F.bround(d * factor).cast("int"))), last_fixed)

    raw = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.greatest(F.lit(1), F.bround(s["b"] * rate).cast("int") - F.bround(s["a"] * rate).cast("int")))
    return let(let(raw, last_fixed), lambda xs: F.when(total(xs, "int") == frames, xs).otherwise(scaled(xs)))


def chunk_starts(n: Column, size: int = 200, stride: int = 100) -> Column:
    """Starts of full windows; a short series has one, at 0."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), n - size).cast("int"), F.lit(stride))


def chunk(xs: Column, start: Column, size: int = 200) -> Column:
    return to_length(F.slice(xs, start + 1, F.lit(size)), F.lit(size), F.lit(0.0))


def resampled(xs: Column, n: Column) -> Column:
    """Linear resampling to n points, ends kept; one point gives n copies."""
    last = F.size(xs) - 1

    def at(i: Column) -> Column:
        x = i * last / F.greatest(n - 1, F.lit(1))
        low = F.floor(x).cast("int")
        high = F.least(low + 1, last)
        return F.get(xs, low) + (x - low) * (F.get(xs, high) - F.get(xs, low))

    return F.transform(upto(n), at)


def even_picks(d: Column, n: Column) -> Column:
    """n of d places, evenly spaced, halves to even; the middle one for n = 1."""
    return F.when(n == 1, F.array(F.floor(d / 2).cast("int"))).otherwise(F.transform(upto(n), lambda i: F.bround(i * (d - 1) / F.greatest(n - 1, F.lit(1))).cast("int")))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def combined(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def softmax(xs: Column, temperature: float = 1.0) -> Column:
    """Each of the array, its greatest, the exponentials and their sum is computed once."""
    shares = lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))
    return let(xs, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp((x - top) / temperature)), shares)))


def log_sum_exp(xs: Column) -> Column:
    return let(xs, lambda v: let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))))


def argmax(xs: Column) -> Column:
    """The first index of the largest."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def shifted(xs: Column, first: Column) -> Column:
    """One to the right, as for teacher forcing."""
    return F.when(F.size(xs) > 0, F.concat(F.array(first), F.slice(xs, F.lit(1), F.size(xs) - 1))).otherwise(xs)


def interleaved(a: Column, b: Column) -> Column:
    return F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))


def positions_of_ends(ends: Column) -> Column:
    """Place in the encoder at each frame, 1 plus the end flags before it."""
    return F.transform(ends, lambda _, i: F.lit(1) + total(F.slice(ends, 1, i), "int"))


def half_masks(f: Column) -> tuple[Column, Column]:
    """First and second half of a block of f frames; one frame is in both."""
    mid = F.greatest(F.lit(1), F.floor(f / 2)).cast("int")
    return F.transform(upto(f), lambda i: i < mid), F.transform(upto(f), lambda i: (i >= mid) | (f == 1))
