"""Files of arrays, tails of logs, and text dialects."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import scalars as S
from frameloom.operators import quantize as V
from frameloom.sources import files, readers
from frameloom.streaming import flush

SCHEMA = "key string, path string, pitch array<float>, ema array<array<float>>"


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(files.ArrayFiles)
    rows = [(f"s{k % 2}/u{k}", [[float(k), 1.0]] * k, [float(k)] * k) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "key string, ema array<array<float>>, pitch array<float>").repartition(3)
    assert files.write_arrays(df, f"{tmp_path}/a") == 8
    return str(tmp_path / "a")


def read(spark, root, schema, **options):
    return spark.read.format("arrays").schema(schema).options(**options).load(root)


def test_a_row_for_each_file(spark, root):
    got = sorted(map(tuple, read(spark, root, SCHEMA).collect()))
    assert got == [(f"u{k}", f"s{k % 2}/u{k}.npz", [float(k)] * k, [[float(k), 1.0]] * k) for k in range(1, 9)]
    assert read(spark, root, "key string, absent array<float>").where("absent is null").count() == 8


def test_files_are_dealt_by_size_and_nothing_else_is_one(spark, root):
    for name in ("notes.txt", ".hidden.npz", "_tmp.npz"):
        with open(f"{root}/{name}", "w") as f:
            f.write("x")
    one = os.path.getsize(f"{root}/s0/u2.npz")
    assert read(spark, root, SCHEMA, partitionBytes=2 * one).rdd.getNumPartitions() > 3
    assert read(spark, root, SCHEMA).rdd.getNumPartitions() == 1 and read(spark, root, SCHEMA).count() == 8
    os.makedirs(f"{root}/none")
    assert read(spark, f"{root}/none", SCHEMA).count() == 0


def test_small_files_are_written_and_read_in_many_tasks(spark, tmp_path):
    """Files of few bytes take time by their number: one task for all of them grows with it."""
    from pyspark import TaskContext

    path, at = str(tmp_path / "many"), str(tmp_path / "tasks")

    def put(uri, content, _):
        flush.write_checked(uri, content, 0)
        flush.write_checked(f"{at}/{TaskContext.get().partitionId()}", b"x", 0)

    spark.dataSource.register(files.ArrayFiles)
    df = spark.range(0, 5000, 1, 1).select(F.concat_ws("/", (F.col("id") % 3).cast("string"), F.col("id").cast("string")).alias("key"), F.array(F.col("id").cast("float")).alias("x"))
    assert flush.dealt(df, "key").select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert files.write_arrays(df.where("id % 10 <> 0"), path) == 4500
    sink = flush.StagedSink(spark, f"{tmp_path}/root", path, put=put)
    sink.add(df.where("id % 10 = 0").select(F.concat("key", F.lit(".npz")).alias("key"), F.lit(b"PK").alias("content")), 0)
    assert sink.finish() == 0 and len(os.listdir(at)) > 8
    got = read(spark, path, "key string, path string, x array<float>, _error string")
    assert got.rdd.getNumPartitions() == 3 and read(spark, path, SCHEMA, partitionFiles=100).rdd.getNumPartitions() == 50
    assert got.where("_error is null").selectExpr("count(distinct path) as n", "sum(x[0]) as s").first() == (4500, float(sum(k for k in range(5000) if k % 10)))
    assert got.where("_error is not null").count() == 500


def test_arrays_that_are_not_declared_are_not_read(spark, root):
    """A file whose other array is broken still gives the one that is asked for."""
    path = f"{root}/s0/u2.npz"
    with zipfile.ZipFile(path) as z:
        pitch = z.read("pitch.npy")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("pitch.npy", pitch)
        z.writestr("ema.npy", b"broken")
    assert read(spark, root, "key string, pitch array<float>").where("key = 'u2'").first().pitch == [2.0, 2.0]
    got = read(spark, root, f"{SCHEMA}, _error string").where("key = 'u2'").first()
    assert got.ema is None and got._error.startswith("ValueError")


def test_broken_files_end_the_query_or_are_rows(spark, root):
    with open(f"{root}/s1/u1.npz", "wb") as f:
        f.write(b"PK")
    with pytest.raises(Exception, match="Python worker"):
        read(spark, root, SCHEMA).collect()
    got = read(spark, root, "key string, pitch array<float>, _error string")
    assert [r.key for r in got.where("_error is not null").collect()] == ["u1"] and got.where("pitch is not null").count() == 7


def test_reconciled_and_strict_features(spark, tmp_path):
    spark.dataSource.register(files.ArrayFiles)
    row = [("u", [[1.0]] * 4, [50.0] * 3, [0.5] * 5)]
    files.write_arrays(spark.createDataFrame(row, "key string, ema array<array<float>>, pitch array<float>, loudness array<float>"), str(tmp_path))
    df = read(spark, str(tmp_path), "key string, ema array<array<float>>, pitch array<float>, loudness array<float>")
    got = readers.features(df, log_pitch=True).first()
    assert [len(got[c]) for c in ("ema", "pitch", "loudness")] == [3, 3, 3] and got.pitch == pytest.approx([np.log(51)] * 3)
    with pytest.raises(Exception, match="lengths differ"):
        readers.features(df, strict=True).collect()


def test_one_array_a_file(spark, tmp_path):
    spark.dataSource.register(files.ArrayFiles)
    df = spark.createDataFrame([("a", [1, 2, 3]), ("b", [7])], "key string, codes array<int>")
    files.write_arrays(df, str(tmp_path), suffix="npy")
    assert np.load(tmp_path / "a.npy").tolist() == [1, 2, 3]
    assert sorted(map(tuple, read(spark, str(tmp_path), "key string, codes array<int>").collect())) == [("a", [1, 2, 3]), ("b", [7])]


def test_only_the_tail_of_a_log_is_read(spark, tmp_path):
    logs = {
        "long.log": "Epoch 1/9: 5%\n" + "x" * 20_000 + "\nEpoch 2/9: 7%\rEpoch 3/9: 9% é\r\nend\n", "old.log": "Epoch 1/9: 5%\n" + "x" * 20_000,
        "short.log": "Epoch 4/9: 1%",
    }
    for name, text in logs.items():
        (tmp_path / name).write_text(text, newline="")
    got = {os.path.basename(r.path): (r.line, r.read) for r in files.last_lines(readers.listing(spark, str(tmp_path), "*.log"), r"Epoch .*/.*%").collect()}
    assert got == {"long.log": ("Epoch 3/9: 9% é", 16_384), "old.log": (None, 16_384), "short.log": ("Epoch 4/9: 1%", 13)}


def test_dialects(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(S.sentences(F.lit(" a b. c,  d!\n e "))) == ["a b.", "c,  d!", "e"]
    assert one(S.sentences(F.lit(" a b. c,  d!\n e "), S.PHRASE)) == ["a b.", "c,", "d!", "e"]
    tokens = lambda *xs: F.array(*map(F.lit, xs))
    assert one(S.blanks_silent(tokens("HH", " ", "", "\t", "."))) == ["HH", "<sil>", "."]
    assert one(S.silence_first(tokens("HH", " ", ".", "AH0"))) == ["<sil>", "HH", "AH0"]
    parts = F.array(tokens("HH", "."), F.array().cast("array<string>"), tokens("AH0"))
    assert one(S.silences_between(parts)) == ["<sil>", "HH", "<sil>", "AH0", "<sil>"]


def test_levels_masked_whole_have_no_loss(spark):
    rows = [(1, [0.0, 2.0], 1, 1), (1, [0.0, 2.0], 0, 1), (1, [9.0, 0.0], 1, 0), (2, [1.0, 1.0], 0, 0)]
    x = spark.createDataFrame(rows, "level int, z array<double>, target int, mask int")
    got = {r.level: r for r in V.leveled_loss(x, "level", F.col("z"), F.col("target"), F.col("mask"), {1: 0.7}).collect()}
    ce = np.log(1 + np.exp(2)) - 1
    assert got[1].ce == pytest.approx(ce) and got[1].acc == 0.5 and got[1].weight == 0.7
    assert (got[2].ce, got[2].acc, got[2].weight) == (0, 0, 0) and got[1].total == got[2].total == pytest.approx(0.7 * ce)
