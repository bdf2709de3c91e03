"""Operators on small literal frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import ordering as O
from frameloom.operators import quantize as V
from frameloom.operators import relational as R
from frameloom.operators import segments as G
from frameloom.operators import stats as T
from frameloom.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_first_and_last_win(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id int, v string")
    b = spark.createDataFrame([(1, "b"), (3, None)], "id int, v string")
    assert rows(R.first_wins([a, b], "id"), "id") == [(1, "a"), (2, "a"), (3, None)]
    assert rows(R.first_wins([a, b], "id", last=True), "id") == [(1, "b"), (2, "a"), (3, None)]


def test_interval_frames_round_half_to_even_and_clamp(spark):
    x = spark.createDataFrame([(0, 0.05, 0.09, 10), (1, 0.3, 0.3, 10), (2, 0.01, 0.03, 10)], "id int, xmin double, xmax double, n int")
    assert rows(R.interval_frames(x, 50, "n").select("id", "t"), "id", "t") == [(0, 2), (0, 3), (1, 9), (2, 0), (2, 1)]


def test_merged_silences(spark):
    s = spark.createDataFrame([(0, 0, "sil", 1), (0, 1, "sil", 2), (0, 2, "AH1", 3), (0, 3, "sil", 4)], "utt int, pos int, label string, dur int")
    assert rows(G.merged(s, "label", "sil").select("pos", "label", "dur"), "pos") == [(0, "sil", 3), (1, "AH1", 3), (2, "sil", 4)]


def test_anchors(spark):
    frames = spark.createDataFrame([(0, t, "a" if t < 1 else "b", float(t)) for t in range(6)], "utt int, t int, label string, x double")
    got = G.anchors(G.segments(frames, "label"), G.runs(frames, "label"), "x")
    assert rows(got.select("pos", "start_x", "mid_x", "end_x"), "pos") == [(0, 0, 0, 0), (1, 1, 3, 5)]


def test_anchors_of_empty_segments_are_at_the_cursor(spark):
    frames = spark.createDataFrame([(0, t, float(10 * t)) for t in range(4)], "utt int, t int, x double")
    segs = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 2), (0, 2, 2, 0), (0, 3, 2, 3), (0, 4, 5, 0)], "utt int, pos int, start int, dur int")
    got = G.anchors(segs, frames, "x").select("pos", "start_x", "mid_x", "end_x")
    assert rows(got, "pos") == [(0, 0, 0, 0), (1, 0, 10, 10), (2, 20, 20, 20), (3, 20, 30, 30), (4, 30, 30, 30)]


def test_pooled_gives_zero_without_frames(spark):
    s = spark.createDataFrame([(0, 0), (0, 1)], "utt int, pos int")
    f = spark.createDataFrame([(0, 0, 2.0), (0, 0, 4.0)], "utt int, pos int, x double")
    assert rows(G.pooled(s, f, "x"), "pos") == [(0, 0, 3.0), (0, 1, 0.0)]


def test_usage(spark):
    u = T.usage(spark.createDataFrame([(0,), (0,), (1,), (1,)], "code int"), "code").first()
    assert (u.active, u.coverage, u.n) == (2, 1.0, 4) and u.perplexity == pytest.approx(2.0)


def test_ties_at_the_cutoff(spark):
    x = spark.createDataFrame([(0, 0, 3.0), (0, 1, 2.0), (0, 2, 2.0), (0, 3, 1.0)], "g int, i int, s double")
    assert O.top_k(x, "g", "s", 2, True, "i").count() == 3
    assert rows(O.top_k(x, "g", "s", 2, False, "i").select("i"), "i") == [(0,), (1,)]


def test_nearest_takes_the_least_code_of_ties(spark):
    book = spark.createDataFrame([(1, [1.0]), (0, [-1.0])], "code int, v array<double>")
    q = spark.createDataFrame([(0, [0.0]), (1, [0.9])], "id int, v array<double>")
    assert rows(V.assign(q, book).select("id", "code"), "id") == [(0, 0), (1, 1)]
    plan = V.assign(q, book)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_residual_levels_never_add_error(spark):
    zero = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.5]), (2, [-0.5, 0.25])], "code int, v array<double>")
    q = spark.range(20).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    one, two = (V.residual_assign(q, [zero] * k).select("id", F.col("error").alias(f"e{k}")) for k in (1, 2))
    assert one.join(two, "id").where("e2 > e1 + 1e-12").count() == 0


def test_vocabulary_grows_after_the_largest_id(spark):
    v = spark.createDataFrame([("a", 0), ("b", 5)], "symbol string, id int")
    more = spark.createDataFrame([("c",), ("a",), ("c",)], "symbol string")
    assert rows(R.extended(v, more), "id") == [("a", 0), ("b", 5), ("c", 6)]


def test_mean_of_means_is_not_the_mean(spark):
    x = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 4.0)], "b int, x double")
    assert T.mean_of_means(x, "b", "x").first()[0] == 2.5


def test_publish_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    path = str(tmp_path / "out")
    assert writers.published(df.where("id = 1"), path, "id").count() == 1
    assert writers.published(df, path, "id").count() == 2
    assert writers.published(df, path, "id").count() == 2


def test_textgrid_without_the_tier_is_empty(spark):
    got = spark.createDataFrame([("no tiers",), (None,)], "t string").select(readers.intervals(F.col("t")).alias("x")).collect()
    assert got[0]["x"] == []


def test_waveform_is_mixed_and_resampled(spark):
    import io
    import wave

    import numpy as np

    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[16384, 0]] * 80, "<i2").tobytes())
    df = spark.createDataFrame([("a.wav", bytearray(b.getvalue()))], "path string, content binary")
    samples = readers.waveforms(df).first()["samples"]
    assert len(samples) == 160 and samples[0] == pytest.approx(0.25)


def test_waveforms_of_wider_samples_and_no_waveforms(spark):
    import struct

    def content(tag, bits, body):
        extra = struct.pack("<HHIH14x", 22, bits, 0, 1) if tag == 0xFFFE else b""
        head = struct.pack("<HHIIHH", tag, 1, 16000, 2000 * bits, bits // 8, bits) + extra
        data = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body
        return bytearray(b"RIFF" + struct.pack("<I", 12 + len(head) + len(data)) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + data)

    x = np.array([0.5, -0.25])
    rows = [("f8", content(3, 64, (x * 4).astype("<f8").tobytes())), ("f4", content(3, 32, x.astype("<f4").tobytes())), ("i4", content(1, 32, (x * 2**31).astype("<i4").tobytes()))]
    rows.append(("ext", content(0xFFFE, 16, (x * 2**15).astype("<i2").tobytes())))
    got = dict(map(tuple, readers.waveforms(spark.createDataFrame(rows, "path string, content binary")).collect()))
    assert got == {"f8": [2.0, -1.0], "f4": [0.5, -0.25], "i4": [0.5, -0.25], "ext": [0.5, -0.25]}
    for bad in (bytearray(b"no RIFF"), content(1, 24, b"123")):
        with pytest.raises(Exception, match="WAV"):
            readers.waveforms(spark.createDataFrame([("bad", bad)], "path string, content binary")).collect()


def test_waveforms_take_values_beyond_16_bits_and_round_ties_up(spark, tmp_path):
    from frameloom.plans import QUERIES

    tie = [(100 + k, 2, 0.02 * (2580 + (k < 36))) for k in range(75)]  # 2580.48 / 32768 is 0.07875
    e = [(0, 1, 655.36), (1, 1, 1e8), (2, 1, 0.0)] + [(i, u, v + 0.001) for i, u, v in tie]
    spark.createDataFrame(e, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.utt_id: (r.n, r["mean"]) for r in QUERIES["src_13_waveforms"](spark, str(tmp_path)).collect()}
    assert got == {"1": (6, pytest.approx((32768 + 5e9) / 3 / 32768, abs=1e-3)), "2": (150, 0.0788)}


def test_a_codebook_beyond_4096_is_used_whole(spark):
    book = spark.range(5000).select(F.col("id").cast("int").alias("code"), F.array(F.col("id").cast("double")).alias("v"))
    q = spark.createDataFrame([(k, [float(x)]) for k, x in enumerate((0, 17, 4096, 4900, 4999))], "id int, v array<double>")
    got = V.assign(q, book)
    assert rows(got.select("id", "code", "dist"), "id") == [(0, 0, 0.0), (1, 17, 0.0), (2, 4096, 0.0), (3, 4900, 0.0), (4, 4999, 0.0)]
    back = V.decoded(got.select("id", F.array("code").alias("codes")), [book])
    assert [r[1] for r in rows(back.select("id", F.col("v")[0]), "id")] == [0.0, 17.0, 4096.0, 4900.0, 4999.0]


def test_a_codebook_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_NUMBERS", 3)
    book = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0])], "code int, v array<double>")
    with pytest.raises(ValueError):
        V.codebook_row(book)


def test_fitted_centres_are_the_means(spark):
    data = [(k, [float(k % 3) * 10 + (k % 2) * 0.5, 1.0]) for k in range(60)]
    got = V.fit_codebook(spark.createDataFrame(data, "id int, v array<double>"), 3)
    assert sorted(r.v[0] for r in got.collect()) == pytest.approx([0.25, 10.25, 20.25])


def test_a_codebook_moves_and_dead_codes_revive(spark):
    book = spark.createDataFrame([(0, [0.0], 4.0), (1, [10.0], 4.0), (2, [99.0], 1.0)], "code int, v array<double>, weight double")
    q = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [12.0])], "id int, v array<double>")
    got = {r.code: (r.v[0], r.weight) for r in V.moved_codebook(q, book, decay=0.5).collect()}
    assert got[0] == (pytest.approx(2 / 3), 3.0) and got[1] == (pytest.approx(52 / 5), 2.5)
    assert got[2][0] in (1.0, 3.0, 12.0) and got[2][1] == 2.0


def test_products_of_two_large_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "DIMENSION_ROWS", 2)
    with pytest.raises(ValueError):
        R.grid(spark.range(3), spark.range(3).toDF("b"))
    assert R.grid(spark.range(3), spark.range(2).toDF("b")).count() == 6


def test_quantiles_are_exact(spark):
    import numpy as np

    r = np.random.default_rng(2)
    for x in (r.normal(size=30_001), np.repeat([1.0, 2.0, 5.0], [10, 20_000, 3]), np.array([7.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        got = T.quantiles(df, "x").first()
        assert list(got) == pytest.approx(list(np.quantile(x, [0.1, 0.25, 0.5, 0.75, 0.9])))
    assert list(T.quantiles(df.where("x is null"), "x").first()) == [None] * 5


def test_resampling_keeps_tones():
    import numpy as np

    t = np.arange(64) / 64
    x = np.sin(2 * np.pi * 5 * t) + 0.3
    up = readers.resampled(x, 128)
    assert up == pytest.approx(np.sin(2 * np.pi * 5 * np.arange(128) / 128) + 0.3)
    assert readers.resampled(up, 64) == pytest.approx(x)
    assert readers.resampled(x[:0], 0).tolist() == []


def brute_codes(x, books):
    """Codes of each level by squared distance, ties to the least code, and what is left."""
    codes, rest = [], np.array(x, float)
    for book in books:
        d, code, word = min(((float(((rest - np.array(v)) ** 2).sum()), c, v) for c, v in book), key=lambda t: t[:2])
        codes.append(code)
        rest = rest - np.array(word)
    return codes, rest, d


@pytest.mark.parametrize("block", [1 << 22, 24, 9])
def test_blocked_search_equals_brute_force(spark, monkeypatch, block):
    """Codebooks in many blocks, with equal codewords and rows on them; rows without a vector."""
    monkeypatch.setattr(V, "BLOCK", block)
    r = np.random.default_rng(block)
    books = [[(int(c), v.round(1).tolist()) for c, v in zip(r.permutation(40), r.normal(size=(40, 3)) * 3, strict=True)] for _ in range(2)]
    books[0][7] = (books[0][7][0], books[0][3][1])
    vectors = [v.round(2).tolist() for v in r.normal(size=(60, 3)) * 3] + [v for _, v in books[0]]
    rows_ = [(k, v) for k, v in enumerate(vectors)] + [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0])]
    q = spark.createDataFrame(rows_, "id int, v array<double>").repartition(3)
    frames = [spark.createDataFrame(b, "code int, v array<double>") for b in books]
    one = {x.id: (x.code, x.dist) for x in V.assign(q, frames[0]).collect()}
    two = {x.id: (x.codes, x.error) for x in V.residual_assign(q, frames).collect()}
    for k, v in enumerate(vectors):
        codes, _, d = brute_codes(v, books[:1])
        assert one[k][0] == codes[0] and one[k][1] == pytest.approx(d)
        codes, rest, _ = brute_codes(v, books)
        assert two[k][0] == codes and two[k][1] == pytest.approx(float((rest**2).sum()))
    for k in (900, 901, 902):
        assert one[k] == (None, None) and two[k] == (None, None)
    back = V.decoded(V.residual_assign(q.where("id < 60"), frames).select("id", "codes", F.col("v").alias("w")), frames)
    for x in back.collect():
        assert np.allclose(x.v, np.array(x.w) - brute_codes(x.w, books)[1])


def test_vector_means_send_one_row_a_group_and_task(spark):
    r = np.random.default_rng(1)
    data = [(k % 3, "ab"[k % 2], r.random(5).tolist()) for k in range(60)] + [(7, "a", [1.0] * 5), (0, "a", None)]
    df = spark.createDataFrame(data, "g int, kind string, v array<double>").repartition(4)
    got = {x.g: (x.mean, x.n) for x in T.vector_mean(df, "g", "v").collect()}
    for g in range(3):
        want = np.array([v for h, _, v in data if h == g and v])
        assert np.allclose(got[g][0], want.mean(axis=0)) and got[g][1] == len(want)
    delta = {(x.g, x.kind): (x.delta, x.n) for x in T.vector_delta(df, "g", "kind", "b", "v").collect()}
    assert set(delta) == {(0, "a"), (1, "a"), (2, "a"), (7, "a")} and delta[7, "a"] == ([1.0] * 5, 0)
    a, b = (np.array([v for h, k, v in data if (h, k) == (0, kind) and v]) for kind in "ab")
    assert np.allclose(delta[0, "a"][0], a.mean(axis=0) - b.mean(axis=0)) and delta[0, "a"][1] == 10
    plan = T.vector_mean(df, "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "partial_avg" in plan
