"""The plans that operators are meant to have."""

import pytest
from pyspark.sql import functions as F

from frameloom.functions import arrays as A
from frameloom.operators import blocks as B
from frameloom.operators import quantize as V
from frameloom.operators import relational as R
from frameloom.operators import segments as G
from frameloom.operators import stats as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def frames(spark, tmp_path):
    path = str(tmp_path / "frames")
    spark.range(100).select((F.col("id") % 7).alias("utt"), F.col("id").cast("int").alias("t"), F.lit("a").alias("phone"), (F.col("id") * 1.5).alias("pitch"), F.lit("x" * 50).alias("unused")).write.parquet(path)
    return spark.read.parquet(path)


def test_range_filter_reaches_the_scan_and_columns_are_pruned(frames):
    p = plan(R.in_range(frames, "pitch", 3.0, 30.0).select("utt"))
    assert "PushedFilters: [IsNotNull(pitch), GreaterThanOrEqual(pitch,3.0), LessThanOrEqual(pitch,30.0)]" in p
    assert "unused" not in p.split("ReadSchema")[1]


def test_channel_stats_is_one_pass_with_partial_sums(frames):
    p = plan(T.channel_stats(frames, ["pitch", "t"]))
    assert p.count("FileScan") == 1 and p.count("Exchange") == 1 and "partial_avg" in p


def test_length_regulator_has_no_shuffle(frames):
    p = plan(frames.select(F.explode(A.regulated(F.array("t", F.lit(2))))))
    assert "Exchange" not in p and "Python" not in p


def test_interval_frames_is_no_range_join(spark):
    x = spark.createDataFrame([(0, 0.1, 0.2, 10)], "id int, xmin double, xmax double, n int")
    assert "Join" not in plan(R.interval_frames(x, 50, "n"))


def test_quantisation_does_not_shuffle_the_rows(spark, frames):
    book = spark.createDataFrame([(0, [0.0])], "code int, v array<double>")
    p = plan(V.assign(frames.select("t", F.array("pitch").alias("v")), book))
    assert p.count("MapInArrow") == 1  # the codebook is broadcast to it
    assert "Join" not in p and "Exchange" not in p


def test_windows_over_one_key_share_a_shuffle(frames):
    p = plan(G.end_flags(G.runs(G.differences(frames, "pitch"), "phone")))
    assert p.count("Exchange hashpartitioning") == 1


def test_no_python_in_operators(frames):
    for df in (G.segments(frames, "phone"), G.differences(frames, "pitch"), T.usage(frames.withColumn("code", F.col("t") % 5), "code"), B.stretched(frames, ["pitch"], frames.select("utt").distinct().withColumn("m", F.lit(5)))):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)
