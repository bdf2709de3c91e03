"""Streams against the answer over all rows at once: order, late rows, timers, failures."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from frameloom.streaming import flush, monitor
from frameloom.streaming import incremental as I

START = dt.datetime(2024, 1, 1)
#: Streams are fed file by file, in the order of their names' times.
ONE = {"maxFilesPerTrigger": 1}


def feed(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, stream, out, mode="append"):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


ENDS = "utt long, ts timestamp, t int, eop int, n int"


def sequences(seed):
    """Rows of some sequences and the places they should get."""
    r, rows, want = random.Random(seed), [], []
    for utt in range(4):
        n, place = r.randint(2, 6), 1
        for t in range(r.randint(5, 30)):
            eop = int(r.random() < 0.3)
            rows.append((utt, START + dt.timedelta(minutes=t), t, eop, n))
            if place <= n:
                want.append((utt, t, place))
                place += eop
    return rows, sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_places_do_not_depend_on_the_order_of_rows(spark, tmp_path, seed):
    rows, want = sequences(seed)
    random.Random(seed).shuffle(rows)
    feed(spark, f"{tmp_path}/in", [rows[k::4] for k in range(4)], ENDS)
    stream = spark.readStream.schema(ENDS).options(**ONE).parquet(f"{tmp_path}/in")
    got = run(spark, I.places(stream, "1 day"), f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == want


def test_a_timer_lets_rows_go_whose_predecessors_never_come(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    first = [(0, at(0), 0, 1, 9), (0, at(2), 2, 1, 9), (0, at(3), 3, 0, 9), (0, at(3), 3, 1, 9)]  # row 1 is missing, row 3 comes twice
    later = [(1, at(600), 0, 0, 9)]  # moves the watermark far beyond
    late = [(0, at(1), 1, 1, 9), (0, at(601), 4, 1, 9)]  # row 1 is too late
    feed(spark, f"{tmp_path}/in", [first, later, [(1, at(601), 1, 0, 9)], late], ENDS)  # a batch runs under the watermark of those before it
    stream = spark.readStream.schema(ENDS).options(**ONE).parquet(f"{tmp_path}/in")
    got = run(spark, I.places(stream, "10 minutes"), f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1), (0, 2, 2), (0, 3, 3), (0, 4, 3), (1, 0, 1), (1, 1, 1)]


EVENTS = "ts timestamp, kind string, value double"


def test_sliding_windows_of_shuffled_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [(START + dt.timedelta(seconds=r.randint(0, 5000)), r.choice("ab"), float(r.randint(0, 9))) for _ in range(400)]
    feed(spark, f"{tmp_path}/in", [rows[k::3] for k in range(3)], EVENTS)
    stream = spark.readStream.schema(EVENTS).options(**ONE).parquet(f"{tmp_path}/in")
    w = I.windows(stream, "200 seconds", "100 seconds", "2 hours", "kind")
    monitor.upserted(w, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = monitor.latest(spark, f"{tmp_path}/out", w.schema, "start", "kind")
    want = {}
    for ts, kind, value in rows:
        k = int((ts - START).total_seconds()) // 100
        for begin in (k - 1, k):
            n, total = want.get((begin, kind), (0, 0.0))
            want[begin, kind] = (n + 1, total + value)
    assert {(int((x.start - START).total_seconds()) // 100, x.kind): (x.n, x.total) for x in got.collect()} == want


def test_windows_leave_out_rows_behind_the_watermark(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    feed(spark, f"{tmp_path}/in", [[(at(1), "a", 1.0), (at(2), "a", 1.0)], [(at(300), "a", 1.0)], [(at(302), "a", 1.0)], [(at(3), "a", 1.0), (at(301), "a", 1.0)], [(at(900), "b", 1.0)]], EVENTS)
    stream = spark.readStream.schema(EVENTS).options(**ONE).parquet(f"{tmp_path}/in")
    got = run(spark, I.windows(stream, "10 minutes", "10 minutes", "30 minutes", "kind"), f"{tmp_path}/out")
    assert sorted((x.start, x.kind, x.n) for x in got.collect()) == [(at(0), "a", 2), (at(300), "a", 3)]


LOG = "run string, epoch long, value double, seconds double"


def test_status_is_that_of_the_whole_log(spark, tmp_path):
    r = random.Random(4)
    log = [(run, e, round(r.uniform(1, 9) - e / 5, 3), 60.0 + e) for run in ("x", "y") for e in range(12) for _ in range(3)]
    batches = [log[:30] + log[36:50], log[30:36] + log[50:], [("x", None, 1.0, 1.0), ("y", 11, None, 1.0)]]  # an epoch over two batches; records without epoch or value
    stream_in = f"{tmp_path}/in"
    for rows in batches:
        feed(spark, stream_in, [rows], LOG)
        seen = monitor.monitored(spark.readStream.schema(LOG).parquet(stream_in), 4.0, 20)
        monitor.upserted(seen, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {x.run: x for x in monitor.latest(spark, f"{tmp_path}/out", seen.schema, "run").collect()}
    for run_, rows in itertools.groupby(log, lambda x: x[0]):
        rows = list(rows)
        epochs = {e: [sum(v) for v in zip(*((x[2], 1, x[3]) for x in rows if x[1] == e), strict=True)] for e in range(12)}
        want = monitor.status_of(epochs, min(x[2] for x in rows), 4.0, 20)
        assert tuple(got[run_])[1:] == pytest.approx(want)


def test_state_of_a_run_is_bounded(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", [[("x", e, float(e), 1.0) for e in range(50)], [("x", 1, -5.0, 1.0)]], LOG)
    seen = monitor.monitored(spark.readStream.schema(LOG).options(**ONE).parquet(f"{tmp_path}/in"), 4.0, 60)
    monitor.upserted(seen, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = monitor.latest(spark, f"{tmp_path}/out", seen.schema, "run").first()
    assert (got.epoch, got.value, got.recent, got.trend, got.best, got.eta_seconds) == (49, 49.0, 48.0, 1.0, -5.0, 11.0)


def published(path):
    return {p.name: p.read_bytes() for p in path.iterdir() if not p.name.startswith(".")}


def test_failures_stay_queued_until_a_pass_succeeds(spark, tmp_path):
    rows = [[(f"f{k}", bytes([k]) * (600 + k)) for k in range(a, a + 10)] for a in (0, 10, 20)]
    rows[1].append(("small", b"x" * 499))
    feed(spark, f"{tmp_path}/in", rows, "key string, content binary")

    def put(uri, content, number):
        if uri.endswith("3") and number < 3:
            raise OSError("busy")
        flush.write_checked(uri, content)

    sink = flush.StagedSink(spark, f"{tmp_path}/root", f"{tmp_path}/files", 15, put)
    stream = spark.readStream.schema("key string, content binary").options(**ONE).parquet(f"{tmp_path}/in")
    sink.start(stream, f"{tmp_path}/ck").awaitTermination()
    assert sink.passes == 1 and sink.queue().count() == 13  # 21 rows after two batches; two busy ones and the small one stay, ten come after
    assert sink.finish() == 1 and sink.passes == 6
    assert published(tmp_path / "files") == {k: v for part in rows for k, v in part if k != "small"}
    tries = {x.key: x.n for x in sink.manifest().groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert tries["f0"] == 1 and tries["f3"] == 3 and tries["f23"] == 2 and tries["small"] == 6
    assert sink.manifest().where("key = 'small'").select("error").distinct().first()[0] == "499 bytes, 500 wanted"


def test_a_new_sink_finds_the_queue_of_the_old_one(spark, tmp_path):
    batch = spark.createDataFrame([("a", b"a" * 500), ("b", b"b" * 500)], "key string, content binary")

    def busy(uri, content, number):
        raise OSError("busy")

    old = flush.StagedSink(spark, f"{tmp_path}/root", f"{tmp_path}/files", 2, busy)
    old.add(batch, 0)
    old.add(batch, 0)  # a repeated batch is one batch
    assert old.waiting == 2
    new = flush.StagedSink(spark, f"{tmp_path}/root", f"{tmp_path}/files")
    assert new.finish() == 0 and published(tmp_path / "files") == {"a": b"a" * 500, "b": b"b" * 500}
    assert flush.StagedSink(spark, f"{tmp_path}/root", f"{tmp_path}/files").finish() == 0


def test_long_sequences_wait_for_all_parts(spark, tmp_path):
    """A sequence of 3,000 rows, more than a day of minutes, whose parts come in no order; ids far apart, negative and null."""
    import duckdb

    from frameloom import plans

    rows = [(k, START + dt.timedelta(seconds=k), 1, "ab"[k // 200 % 2]) for k in range(3000)]
    rows += [(3000 + k, START + dt.timedelta(seconds=k), user, "abc"[k // 2 % 3]) for user in (2, 70, -5, 2**53 + 1, None) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").withColumn("value", F.lit(1.0))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as db:
        db.sql(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
        want = db.sql(plans.SQL["str_05_state_machine"]).fetchall()
    got = map(tuple, plans.QUERIES["str_05_state_machine"](spark, str(tmp_path)).collect())
    order = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=order) == sorted(want, key=order) and len(want) > 3000


def test_a_part_of_a_stream_is_a_batch_of_many_files(spark, tmp_path):
    from frameloom.plans.io_queries import _fed

    stream, seen = _fed(spark.range(3000), "id"), []
    stream.writeStream.foreachBatch(lambda df, _: seen.append((df.count(), df.select(F.input_file_name()).distinct().count()))).trigger(availableNow=True).start().awaitTermination()
    assert sum(n for n, _ in seen) == 3000 and [files for _, files in seen] == [spark.sparkContext.defaultParallelism] * 3


def test_sequences_share_a_state(spark, tmp_path):
    """A call of the state's function is for up to 64 sequences: 256 of them take 4 states, and each gets its places."""
    feed(spark, f"{tmp_path}/in", [[(u, START, t, 1, 9) for u in range(256) for t in (b, b + 1)] for b in (2, 0)], ENDS)
    stream = spark.readStream.schema(ENDS).options(**ONE).parquet(f"{tmp_path}/in")
    got = run(spark, I.places(stream, "1 day"), f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [(u, t, t + 1) for u in range(256) for t in range(4)]
    assert spark.read.format("statestore").load(f"{tmp_path}/out-ck").count() == 4
