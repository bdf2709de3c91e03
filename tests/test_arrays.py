"""Array kernels and scalars on literal rows with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from frameloom.functions import arrays as A
from frameloom.functions import scalars as S
from frameloom.operators import signal as G


def one(spark, x):
    return spark.range(1).select(x.alias("x")).first()["x"]


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


def reals(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


CASES = {
    "regulated": (lambda: A.regulated(ints(2, 0, 3)), [0, 0, 2, 2, 2]),
    "regulated_none": (lambda: A.regulated(ints()), []),
    "even_split": (lambda: A.even_split(F.lit(7), F.lit(3)), [3, 2, 2]),
    "even_split_short": (lambda: A.even_split(F.lit(2), F.lit(3)), [1, 1, 0]),
    "upto_0": (lambda: A.upto(F.lit(0)), []),
    "trimmed": (lambda: A.trimmed_to(ints(3, 4, 5), F.lit(8)), [3, 4, 1]),
    "tail_trimmed": (lambda: A.tail_trimmed(ints(3, 4, 5), F.lit(8)), [3, 5]),
    "tail_trimmed_first_too_long": (lambda: A.tail_trimmed(ints(9, 2), F.lit(5)), [9]),
    "tail_not_trimmed": (lambda: A.tail_trimmed(ints(3, 0, 2), F.lit(5)), [3, 0, 2]),
    "residual_surplus": (lambda: A.residual_fixed(ints(3, 2, 0), F.lit(7)), [3, 4, 0]),
    "residual_shortage": (lambda: A.residual_fixed(ints(5, 1), F.lit(4)), [3, 1]),
    "residual_none": (lambda: A.residual_fixed(ints(1, 1), F.lit(1)), [1, 1]),
    "weighted": (lambda: A.weighted_durations(reals(1, 1, 2), F.lit(9)), [2, 2, 5]),
    "weighted_blocked": (lambda: A.weighted_durations(reals(1, 1, 1), F.lit(2)), [1, 1, 1]),
    "intervals": (lambda: A.interval_durations(reals(0, 0.1), reals(0.1, 0.11), F.lit(8)), [5, 3]),
    "intervals_scaled": (lambda: A.interval_durations(reals(0, 0.16, 0.32), reals(0.16, 0.32, 0.48), F.lit(10)), [5, 5, 1]),
    "chunks_long": (lambda: A.chunk_starts(F.lit(450)), [0, 100, 200]),
    "chunks_exact": (lambda: A.chunk_starts(F.lit(200)), [0]),
    "chunks_short": (lambda: A.chunk_starts(F.lit(150)), [0]),
    "resampled": (lambda: A.resampled(reals(0, 10), F.lit(5)), [0, 2.5, 5, 7.5, 10]),
    "resampled_same": (lambda: A.resampled(reals(3, 1, 4), F.lit(3)), [3, 1, 4]),
    "resampled_one": (lambda: A.resampled(reals(3), F.lit(2)), [3, 3]),
    "picks": (lambda: A.even_picks(F.lit(6), F.lit(3)), [0, 2, 5]),
    "shifted": (lambda: A.shifted(ints(1, 2, 3), F.lit(0)), [0, 1, 2]),
    "interleaved": (lambda: A.interleaved(ints(1, 2), ints(8, 9)), [1, 8, 2, 9]),
    "places": (lambda: A.positions_of_ends(ints(0, 1, 0, 0, 1)), [1, 1, 2, 2, 2]),
    "body": (lambda: A.body(ints(1, 2, 3, 4)), [2, 3]),
    "body_short": (lambda: A.body(ints(1, 2)), []),
    "to_length": (lambda: A.to_length(ints(1, 2, 3), F.lit(2), F.lit(0)), [1, 2]),
    "render_1": (lambda: G.rendered(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(1), F.lit("linear")), [10]),
    "render_2": (lambda: G.rendered(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(2), F.lit("linear")), [0, 20]),
    "render_3": (lambda: G.rendered(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(3), F.lit("linear")), [0, 10, 20]),
    "render_4": (lambda: G.rendered(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(4), F.lit("linear")), [0, 10, 10, 20]),
    "render_5": (lambda: G.rendered(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(5), F.lit("linear")), [0, 5, 10, 10, 20]),
    "line_1": (lambda: G.rendered(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(1), F.lit("line")), [10]),
    "line_3": (lambda: G.rendered(F.lit(0.0), F.lit(99.0), F.lit(20.0), F.lit(3), F.lit("line")), [0, 10, 20]),
    "plateau_4": (lambda: G.rendered(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(4), F.lit("plateau")), [0, 10, 10, 20]),
    "median": (lambda: G.median(reals(1, 9, 2, 8, 3)), [1, 2, 3, 3, 3]),
    "clauses": (lambda: S.merged_clauses(F.lit("a b, c d, e f. g"), 4), ["a b, c d", "e f.", "g"]),
    "clauses_joined": (lambda: S.merged_clauses(F.lit("\n a,b,,  c,d\te. \n f "), 2), ["a, b", "c", "d\te.", "f"]),
    "gaps": (lambda: F.transform(S.gaps(F.lit("a, b! c\n")), lambda g: g["gap"]), [0.12, 0.30, 0.30]),
    "gap_parts": (lambda: F.transform(S.gaps(F.lit(" a, b! c\n")), lambda g: g["part"]), ["a,", "b!", "c"]),
    "prosody": (lambda: F.array(*[S.prosody(F.lit(t))[k] for t in ("NUM", "DET", "INTJ") for k in ("scale", "boost")]), [1.3, 0.05, 0.7, -0.03, 1.0, 0.0]),
    "prosody_charming": (lambda: F.array(*[S.prosody(F.lit(t), "charming")[k] for t in ("VERB", "PART", "X") for k in ("scale", "boost")]), [1.4, 0.1, 0.6, -0.05, 1.0, 0.0]),
    "envelope_of_zeros": (lambda: F.array(G.envelope(F.lit(0.0), F.lit(0.0), 0.5, 3.0), G.envelope(F.lit(9.0), F.lit(2.0), 0.5, 3.0)), [0.5, 3.0]),
    "rolling_std": (lambda: G.rolling_std(reals(50, 52, 10, 54), 4, 40.0, 2), [0.75**0.5, (8 / 9) ** 0.5, (8 / 3) ** 0.5, (8 / 9) ** 0.5]),
    "deadzones": (lambda: F.array(G.deadzone_loss(F.lit(-5.0), 3.0, 2.0), G.deadzone_loss(F.lit(2.0), 3.0), G.beyond(F.lit(9.0), G.conditional_deadzone(F.lit(-6.0), 4.0))), [8, 0, 3]),
    "bround": (lambda: F.array(*[S.whole_duration(F.lit(x)) for x in (12.5, 2.5, 3.5, 0.1)]), [12, 2, 4, 1]),
    "emotions": (
        lambda: F.array(*[S.emotion_of(F.lit(v), F.lit(a)) for v, a in ((0.6, 0.7), (0.4, 0.7), (0.5, 0.7), (0.9, 0.3), (0.1, 0.5), (0.1, 0.35), (0.1, 0.65))]),
        ["happy", "angry", "surprise", "sad", "neutral", "neutral", "neutral"],
    ),
    "knobs_none": (lambda: S.knobs(F.lit(None).cast("int"), F.lit(0.3)), [0, 0, 0, 0, 0, 0.5]),
}


@pytest.mark.parametrize("name", CASES)
def test_kernel(spark, name):
    make, want = CASES[name]
    got = one(spark, make())
    assert got == (want if want and isinstance(want[0], str) else pytest.approx(want))


def test_gaussian_keeps_constants_and_replicates_edges(spark):
    assert one(spark, G.gaussian(reals(2, 2, 2), 1.0)) == pytest.approx([2, 2, 2])
    got = one(spark, G.gaussian(reals(0, 0, 0, 0, 9), 0.5))
    assert got[-1] > got[-2] > got[0] >= 0


def test_even_split_adds_up(spark):
    rows = spark.range(1, 40).crossJoin(spark.range(1, 9).toDF("n"))
    assert rows.where(A.total(A.even_split(F.col("id"), F.col("n")), "int") != F.col("id")).count() == 0


def test_softmax_sums_to_one(spark):
    assert sum(one(spark, A.softmax(reals(1, 2, 3)))) == pytest.approx(1)


def test_lengths_differ_raises(spark):
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, A.same_length(reals(1, 2), reals(1)))
