"""Windows, segments, ragged sequences, signals."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import blocks as B
from ..operators import segments as G
from ..operators import signal as S
from .base import FRAMES, RUNS, SEGS, frames, long, query, r6, segs, with_runs

#: Series of each utterance in SQL: xs, a list by t.
SERIES = f"{FRAMES}, series AS (SELECT utt, list(pitch ORDER BY t) AS xs FROM frames GROUP BY utt)"
DURS = f"{SEGS}, durs AS (SELECT utt, list(dur ORDER BY pos) AS d, sum(dur)::INTEGER AS total FROM segs GROUP BY utt)"


def series(spark, d):
    return S.series(frames(spark, d), "pitch")


def durs(spark, d):
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "dur"))), lambda s: s["dur"])
    return segs(spark, d).groupBy("utt").agg(packed.alias("d"), F.sum("dur").cast("int").alias("total"))


def _gauss(name: str, source: str, columns: str, sigma: float) -> str:
    """A CTE (utt, t, columns) of columns smoothed to 4 sigma with replicated edges."""
    w, r = f"exp(-0.5 * k.k * k.k / {sigma * sigma})", int(4 * sigma + 0.5)
    smooth = ", ".join(f"sum({w} * g.{c}) / sum({w}) AS {c}" for c in columns.split())
    return f"""{name} AS (SELECT f.utt, f.t, {smooth} FROM {source} f JOIN (SELECT utt, max(t) AS last FROM {source} GROUP BY 1) n ON n.utt = f.utt,
      (SELECT unnest(range({-r}, {r + 1})) AS k) k, {source} g WHERE g.utt = f.utt AND g.t = greatest(0, least(f.t + k.k, n.last)) GROUP BY 1, 2)"""


def _stretch(name: str, source: str, columns: str, like: str) -> str:
    """A CTE (utt, t, columns) of the series of source resampled to the lengths of those of like."""
    mixed = ", ".join(f"a.{c} + (p.p - floor(p.p)) * (coalesce(b.{c}, a.{c}) - a.{c}) AS {c}" for c in columns.split())
    return f"""{name} AS (SELECT p.utt, p.t, {mixed} FROM (
        SELECT utt, t, t * (n - 1) / greatest(m - 1, 1)::DOUBLE AS p FROM (SELECT l.utt, s.n, l.m, unnest(range(l.m))::INTEGER AS t
          FROM (SELECT utt, count(*) AS m FROM {like} GROUP BY 1) l JOIN (SELECT utt, count(*) AS n FROM {source} GROUP BY 1) s ON s.utt = l.utt)) p
      JOIN {source} a ON a.utt = p.utt AND a.t = floor(p.p) LEFT JOIN {source} b ON b.utt = p.utt AND b.t = floor(p.p) + 1)"""


def smoothed(df, kernel, before, after, name):
    return B.blockwise(df, {name: ("pitch", kernel)}, before, after).select("utt", "t", r6(name).alias(name))


def next_user(df):
    """Frames or segments of each user under the id of the user before."""
    return df.withColumn("utt", F.col("utt") - 1)


def tall(df, xs, name="d", kind="int"):
    return df.select("utt", F.posexplode(xs).alias("i", "x")).select("utt", "i", F.col("x").cast(kind).alias(name))


@query("win_01_offsets", f"WITH {SEGS} SELECT utt, pos, dur, (sum(dur) OVER (PARTITION BY utt ORDER BY pos) - dur)::INTEGER AS start, (sum(dur) OVER (PARTITION BY utt ORDER BY pos))::INTEGER AS stop FROM segs")
def offsets(spark, d):
    s = G.with_bounds(segs(spark, d).select("utt", "pos", "dur"))
    return s.select("utt", "pos", "dur", "start", F.col("end").alias("stop"))


@query("win_02_delta", f"WITH {FRAMES} SELECT utt, t, round(pitch - lag(pitch) OVER (PARTITION BY utt ORDER BY t), 6) AS delta FROM frames")
def delta(spark, d):
    return G.differences(frames(spark, d), "pitch").select("utt", "t", r6("delta").alias("delta"))


@query("win_03_acceleration", f"WITH {FRAMES} SELECT * FROM (SELECT utt, t, round(pitch - 2 * lag(pitch, 1) OVER (PARTITION BY utt ORDER BY t) + lag(pitch, 2) OVER (PARTITION BY utt ORDER BY t), 6) AS accel FROM frames) WHERE t >= 2")
def acceleration(spark, d):
    return G.differences(frames(spark, d), "pitch").where("t >= 2").select("utt", "t", r6("accel").alias("accel"))


_ACC = f"{FRAMES}, acc AS (SELECT utt, t, pitch - 2 * lag(pitch, 1) OVER (PARTITION BY utt ORDER BY t) + lag(pitch, 2) OVER (PARTITION BY utt ORDER BY t) AS a FROM frames)"


@query("win_04_deadzone", f"WITH {_ACC} SELECT utt, round(avg(greatest(abs(a) - 20, 0) * greatest(abs(a) - 20, 0)), 6) AS loss FROM acc WHERE a IS NOT NULL GROUP BY 1")
def deadzone(spark, d):
    return G.differences(frames(spark, d), "pitch").where("accel is not null").groupBy("utt").agg(r6(F.avg(S.deadzone_loss(F.col("accel"), 20.0))).alias("loss"))


@query("win_05_relative_deadzone", f"WITH {_ACC} SELECT utt, round(avg(greatest(abs(a) * 1.5 - greatest(abs(a), 20), 0)), 6) AS loss FROM acc WHERE a IS NOT NULL GROUP BY 1")
def relative_deadzone(spark, d):
    predicted, theta = F.col("accel") * 1.5, S.conditional_deadzone(F.col("accel"), 20.0)
    return G.differences(frames(spark, d), "pitch").where("accel is not null").groupBy("utt").agg(r6(F.avg(S.beyond(predicted, theta))).alias("loss"))


@query(
    "win_06_chunks",
    f"""WITH {SERIES}, c AS (SELECT utt, xs, unnest(range(0, greatest(0, len(xs) - 20) + 1, 10)) AS start FROM series)
        SELECT utt, start::INTEGER AS start, round(list_sum(list_slice(xs, start + 1, start + 20)), 6) AS total FROM c""",
)
def chunks(spark, d):
    c = series(spark, d).select("utt", "xs", F.explode(A.chunk_starts(F.size("xs"), 20, 10)).alias("start"))
    return c.select("utt", "start", r6(A.total(A.chunk(F.col("xs"), F.col("start"), 20))).alias("total"))


def _around(low: int, high: int) -> str:
    """Values around each frame with replicated edges: (utt, t, k, x)."""
    return f"""WITH {FRAMES}, n AS (SELECT utt, max(t) AS last FROM frames GROUP BY utt),
      k AS (SELECT unnest(range({low}, {high} + 1)) AS k),
      o AS (SELECT f.utt, f.t, k.k, greatest(0, least(f.t + k.k, n.last)) AS s FROM frames f JOIN n USING (utt), k),
      w AS (SELECT o.utt, o.t, o.k, g.pitch AS x FROM o JOIN frames g ON g.utt = o.utt AND g.t = o.s)"""


@query("win_07_rolling_std", _around(-6, 5) + " SELECT utt, t, round(CASE WHEN count_if(x > 40) >= 3 THEN stddev_pop(CASE WHEN x > 40 THEN x END) ELSE 0.0 END, 6) AS std FROM w GROUP BY 1, 2")
def rolling_std(spark, d):
    return smoothed(frames(spark, d), lambda xs: S.rolling_std(xs, 12, 40.0), 6, 5, "std")


@query("win_08_gaussian", _around(-8, 8) + " SELECT utt, t, round(sum(exp(-0.5 * (k / 2.0) * (k / 2.0)) * x) / sum(exp(-0.5 * (k / 2.0) * (k / 2.0))), 6) AS x FROM w GROUP BY 1, 2")
def gaussian(spark, d):
    return smoothed(frames(spark, d), lambda xs: S.gaussian(xs, 2.0), 8, 8, "x")


@query("win_09_median", _around(-2, 2) + " SELECT utt, t, round(median(x), 6) AS x FROM w GROUP BY 1, 2")
def median(spark, d):
    return smoothed(frames(spark, d), S.median, 2, 2, "x")


@query("win_10_boundary", f"WITH {RUNS} SELECT utt, t, coalesce(lead(pos) OVER (PARTITION BY utt ORDER BY t) <> pos, true) AS is_end FROM runs")
def boundary(spark, d):
    return G.end_flags(with_runs(spark, d)).select("utt", "t", "is_end")


@query(
    "win_11_jitter",
    f"""WITH {RUNS}, s AS (SELECT *, abs(lead(pitch) OVER (PARTITION BY utt ORDER BY t) - pitch) AS step FROM runs),
        e AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY utt ORDER BY t) <> pos, true) AS is_end FROM s WHERE step IS NOT NULL)
        SELECT is_end, round(avg(step), 6) AS mean, round(max(step), 6) AS most, count(*)::BIGINT AS n FROM e GROUP BY 1""",
)
def jitter(spark, d):
    return G.jitter(with_runs(spark, d), "pitch").select("is_end", r6("mean").alias("mean"), r6("most").alias("most"), "n")


@query(
    "win_12_merge_silence",
    f"""WITH {SEGS}, l AS (SELECT utt, pos, dur, CASE WHEN phone IN ('view', 'error') THEN 'sil' ELSE phone END AS label FROM segs),
        m AS (SELECT *, CASE WHEN label = 'sil' AND lag(label) OVER (PARTITION BY utt ORDER BY pos) = 'sil' THEN 0 ELSE 1 END AS fresh FROM l),
        i AS (SELECT *, (sum(fresh) OVER (PARTITION BY utt ORDER BY pos) - 1)::INTEGER AS island FROM m)
        SELECT utt, island AS pos, min(label) AS label, sum(dur)::INTEGER AS dur FROM i GROUP BY 1, 2""",
)
def merge_silence(spark, d):
    s = segs(spark, d).withColumn("label", F.when(F.col("phone").isin("view", "error"), "sil").otherwise(F.col("phone")))
    return G.merged(s, "label", "sil")


@query("win_13_ordinal", "SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id))::INTEGER AS rn FROM events")
def ordinal(spark, d):
    from .base import table

    return table(spark, d, "events").select("event_id", F.row_number().over(W.partitionBy("event_type").orderBy("event_id")).alias("rn"))


@query("win_14_end_ramp", f"WITH {FRAMES}, n AS (SELECT utt, count(*) AS n FROM frames GROUP BY 1) SELECT utt, t, round(CASE WHEN n > 64 AND t >= n - 32 THEN pitch + 10.0 * (t - (n - 32)) / 31 ELSE pitch END, 6) AS x FROM frames JOIN n USING (utt)")
def end_ramp(spark, d):
    return S.end_ramp(frames(spark, d), "pitch", 32, 10.0).select("utt", "t", r6("pitch").alias("x"))


@query("win_15_expand_smoothed", _around(-4, 4) + ", c AS (SELECT utt, t, sum(exp(-0.5 * k * k) * x) / sum(exp(-0.5 * k * k)) AS c FROM w GROUP BY 1, 2) SELECT c.utt, c.t, round(c.c + 1.4 * (f.pitch - c.c), 6) AS x FROM c JOIN frames f ON f.utt = c.utt AND f.t = c.t")
def expand_smoothed(spark, d):
    return smoothed(frames(spark, d), lambda xs: F.zip_with(xs, S.gaussian(xs, 1.0), lambda x, c: S.expanded(x, c, 1.4)), 4, 4, "x")


@query("win_16_expand_pitch", f"WITH {FRAMES}, m AS (SELECT utt, avg(CASE WHEN pitch > 40 THEN pitch END) AS m, count_if(pitch > 40) AS n FROM frames GROUP BY 1) SELECT utt, t, round(CASE WHEN n >= 5 AND pitch > 40 THEN least(greatest(m + 1.5 * (pitch - m), 40), 500) ELSE pitch END, 6) AS x FROM frames JOIN m USING (utt)")
def expand_pitch(spark, d):
    return S.expanded_pitch(frames(spark, d), "pitch", 1.5).select("utt", "t", r6("pitch").alias("x"))


@query("win_17_envelope", f"WITH {FRAMES} SELECT utt, t, round(least(greatest(pitch / (avg(pitch) OVER (PARTITION BY utt) + 1e-6), 0.5), 3.0), 6) AS x FROM frames")
def envelope(spark, d):
    return S.enveloped(frames(spark, d), {"pitch": (0.5, 3.0)}).select("utt", "t", r6("pitch").alias("x"))


@query("win_18_shift", f"WITH {FRAMES} SELECT utt, t, lag(pitch, 1, -1.0) OVER (PARTITION BY utt ORDER BY t) AS x FROM frames")
def shift(spark, d):
    return S.exploded(series(spark, d), A.shifted(F.col("xs"), F.lit(-1.0)), "x")


@query("win_19_interleave", f"WITH {SEGS} SELECT utt, (2 * pos)::INTEGER AS i, start AS x FROM segs UNION ALL SELECT utt, (2 * pos + 1)::INTEGER, (start + dur - 1)::INTEGER FROM segs")
def interleave(spark, d):
    s = segs(spark, d).groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("pos", "start", (F.col("start") + F.col("dur") - 1).alias("stop")))).alias("s"))
    return s.select("utt", F.posexplode(A.interleaved(F.transform("s", lambda x: x["start"]), F.transform("s", lambda x: x["stop"]))).alias("i", "x"))


@query("win_20_trailing_mean", f"WITH {FRAMES} SELECT utt, t, round(avg(pitch) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m FROM frames")
def trailing_mean(spark, d):
    return frames(spark, d).select("utt", "t", r6(F.avg("pitch").over(G.by_time().rowsBetween(-2, 0))).alias("m"))


@query("win_21_running_best", f"WITH {FRAMES} SELECT utt, t, min(pitch) OVER (PARTITION BY utt ORDER BY t ROWS UNBOUNDED PRECEDING) AS best FROM frames")
def running_best(spark, d):
    return frames(spark, d).select("utt", "t", F.min("pitch").over(G.by_time().rowsBetween(W.unboundedPreceding, 0)).alias("best"))


@query("win_22_band", f"WITH {FRAMES} SELECT utt, t, (count(*) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))::BIGINT AS seen, max(pitch) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS top FROM frames")
def band(spark, d):
    w = G.by_time().rowsBetween(-7, 0)
    return frames(spark, d).select("utt", "t", F.count("*").over(w).alias("seen"), F.max("pitch").over(w).alias("top"))


@query("seq_01_length_regulator", f"WITH {SEGS} SELECT utt, pos, unnest(range(start, start + dur))::INTEGER AS t FROM segs")
def length_regulator(spark, d):
    return durs(spark, d).select("utt", F.posexplode(A.regulated(F.col("d"))).alias("t", "pos")).select("utt", "pos", "t")


@query("seq_02_frame_labels", f"WITH {SEGS} SELECT utt, phone, unnest(range(start, start + dur))::INTEGER AS t FROM segs")
def frame_labels(spark, d):
    return G.frames_of(segs(spark, d)).select("utt", "phone", "t")


@query("seq_03_pool", f"WITH {RUNS} SELECT utt, pos, round(avg(pitch), 6) AS mean FROM runs GROUP BY 1, 2")
def pool(spark, d):
    return G.pooled(segs(spark, d), with_runs(spark, d), "pitch").select("utt", "pos", r6("mean").alias("mean"))


@query("seq_04_attention_pool", f"WITH {RUNS} SELECT utt, pos, round(sum(exp(pitch / 100) * pitch) / sum(exp(pitch / 100)), 6) AS mean FROM runs GROUP BY 1, 2")
def attention_pool(spark, d):
    return G.attention_pooled(with_runs(spark, d), F.col("pitch") / 100, "pitch").select("utt", "pos", r6("mean").alias("mean"))


@query("seq_05_even_split", f"WITH {DURS}, e AS (SELECT utt, total, unnest(range(7))::INTEGER AS i FROM durs) SELECT utt, i, (total // 7 + (i < total % 7)::INTEGER)::INTEGER AS d FROM e")
def even_split(spark, d):
    return tall(durs(spark, d), A.even_split(F.col("total"), F.lit(7)))


@query("seq_06_even_split_short", "WITH n AS (SELECT n_nationkey AS utt, n_regionkey AS total FROM nation), e AS (SELECT utt, total, unnest(range(3))::INTEGER AS i FROM n) SELECT utt, i, (total // 3 + (i < total % 3)::INTEGER)::INTEGER AS d FROM e")
def even_split_short(spark, d):
    from .base import table

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("utt"), F.col("n_regionkey").alias("total"))
    return tall(n, A.even_split(F.col("total"), F.lit(3)))


@query(
    "seq_07_weighted",
    f"""WITH {DURS}, r AS (SELECT utt, total, unnest(range(5))::INTEGER AS i FROM durs), w AS (SELECT *, (i + 1) * total / 15.0::DOUBLE AS raw FROM r),
        b AS (SELECT *, greatest(1, round_even(raw, 0)::INTEGER) AS base, row_number() OVER (PARTITION BY utt ORDER BY raw DESC, i) - 1 AS rk FROM w),
        s AS (SELECT *, total - (sum(base) OVER (PARTITION BY utt))::INTEGER AS diff FROM b)
        SELECT utt, i, (CASE WHEN diff >= 0 THEN base + diff // 5 + (rk < diff % 5)::INTEGER WHEN rk < -diff AND base > 1 THEN base - 1 ELSE base END)::INTEGER AS d FROM s""",
)
def weighted(spark, d):
    w = F.array(*[F.lit(float(k)) for k in range(1, 6)])
    return tall(durs(spark, d), A.weighted_durations(w, F.col("total")))


@query(
    "seq_08_interval_durations",
    f"""WITH {SEGS}, i AS (SELECT utt, pos, start / 50.0 AS a, (start + dur) / 50.0 AS b FROM segs),
        r AS (SELECT utt, pos, greatest(1, round_even(b * 50, 0)::INTEGER - round_even(a * 50, 0)::INTEGER) AS d, CASE WHEN utt % 2 = 0 THEN 90 ELSE 40 END AS want FROM i),
        l AS (SELECT *, max(pos) OVER (PARTITION BY utt) AS last, (sum(d) OVER (PARTITION BY utt))::INTEGER AS total FROM r),
        f AS (SELECT *, CASE WHEN pos = last THEN greatest(1, d + want - total) ELSE d END AS d1 FROM l),
        g AS (SELECT *, (sum(d1) OVER (PARTITION BY utt))::INTEGER AS total1 FROM f),
        h AS (SELECT *, CASE WHEN total1 = want THEN d1 ELSE greatest(1, round_even(d1 * (want / total1::DOUBLE), 0)::INTEGER) END AS d2 FROM g),
        k AS (SELECT *, (sum(d2) OVER (PARTITION BY utt))::INTEGER AS total2 FROM h)
        SELECT utt, pos AS i, (CASE WHEN pos = last THEN greatest(1, d2 + want - total2) ELSE d2 END)::INTEGER AS d FROM k""",
)
def interval_durations(spark, d):
    """90 frames are more than any user has, 40 fewer: the last segment grows, or all are scaled."""
    s = segs(spark, d).groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("start") / 50.0).alias("a"), ((F.col("start") + F.col("dur")) / 50.0).alias("b")))).alias("s"))
    want = F.when(F.col("utt") % 2 == 0, 90).otherwise(40)
    return tall(s, A.interval_durations(F.transform("s", lambda x: x["a"]), F.transform("s", lambda x: x["b"]), want))


@query(
    "seq_09_residual_fix",
    f"""WITH {SEGS}, s AS (SELECT utt, pos, dur, (66 - sum(dur) OVER (PARTITION BY utt))::INTEGER AS diff FROM segs),
        q AS (SELECT *, max(CASE WHEN CASE WHEN diff > 0 THEN dur > 0 ELSE dur + diff >= 1 END THEN pos ELSE -1 END) OVER (PARTITION BY utt) AS spot FROM s)
        SELECT utt, pos AS i, (CASE WHEN pos = spot THEN dur + diff ELSE dur END)::INTEGER AS d FROM q""",
)
def residual_fix(spark, d):
    return tall(durs(spark, d), A.residual_fixed(F.col("d"), F.lit(66)))


@query("seq_10_overflow_trim", f"WITH {SEGS} SELECT utt, pos AS i, greatest(0, least(dur, 40 - start))::INTEGER AS d FROM segs")
def overflow_trim(spark, d):
    return tall(durs(spark, d), A.trimmed_to(F.col("d"), F.lit(40)))


@query(
    "seq_11_tail_trim",
    f"""WITH {SEGS}, n AS (SELECT utt, pos, dur + CASE WHEN pos = 0 AND utt % 3 = 0 THEN 50 ELSE 0 END AS dur FROM segs),
        c AS (SELECT *, sum(dur) OVER (PARTITION BY utt ORDER BY pos) AS cum, sum(dur) OVER (PARTITION BY utt) AS total FROM n),
        k AS (SELECT *, max(pos) OVER (PARTITION BY utt) AS last, sum(dur) OVER (PARTITION BY utt) AS used FROM c WHERE total <= 40 OR cum <= 40 OR pos = 0)
        SELECT utt, pos AS i, (dur + CASE WHEN pos = last AND total > 40 THEN greatest(0, 40 - used) ELSE 0 END)::INTEGER AS d FROM k""",
)
def tail_trim(spark, d):
    """A third of the users have a first segment that is longer than all that may be kept."""
    longer = F.transform("d", lambda x, i: x + F.when((i == 0) & (F.col("utt") % 3 == 0), 50).otherwise(0))
    return tall(durs(spark, d), A.tail_trimmed(longer, F.lit(40)))


#: Segments with empty ones after every third.
_WITH_EMPTY = f"""{SEGS}, cut AS (SELECT utt, 2 * pos AS pos, start, dur FROM segs UNION ALL SELECT utt, 2 * pos + 1, start + dur, 0 FROM segs WHERE pos % 3 = 0)"""


def _with_empty(spark, d):
    s = segs(spark, d)
    empty = s.where("pos % 3 = 0").select("utt", 2 * F.col("pos") + 1, F.col("start") + F.col("dur"), F.lit(0))
    return s.select("utt", (2 * F.col("pos")).alias("pos"), "start", "dur").union(empty)


@query(
    "seq_12_anchors",
    f"""WITH {_WITH_EMPTY}, l AS (SELECT utt, max(t) AS last FROM frames GROUP BY 1),
        c AS (SELECT cut.*, last, CASE WHEN dur = 0 THEN start ELSE start + dur // 2 END AS m, CASE WHEN dur = 0 THEN start ELSE start + dur - 1 END AS e FROM cut JOIN l USING (utt))
        SELECT c.utt, c.pos::INTEGER AS pos, a.pitch AS start_x, m.pitch AS mid_x, e.pitch AS end_x FROM c
        JOIN frames a ON a.utt = c.utt AND a.t = least(c.start, last) JOIN frames m ON m.utt = c.utt AND m.t = least(c.m, last) JOIN frames e ON e.utt = c.utt AND e.t = least(c.e, last)""",
)
def anchors(spark, d):
    return G.anchors(_with_empty(spark, d), frames(spark, d), "pitch")


@query(
    "seq_13_resample",
    f"""WITH {SERIES}, i AS (SELECT utt, xs, len(xs) - 1 AS last, unnest(range(50)) AS i FROM series), x AS (SELECT *, i * last / 49.0::DOUBLE AS p FROM i)
        SELECT utt, i::INTEGER AS i, round(xs[floor(p)::INTEGER + 1] + (p - floor(p)) * (xs[least(floor(p)::INTEGER + 1, last) + 1] - xs[floor(p)::INTEGER + 1]), 6) AS x FROM x""",
)
def resample(spark, d):
    f = frames(spark, d)
    return B.stretched(f, ["pitch"], f.select("utt").distinct().withColumn("m", F.lit(50))).select("utt", F.col("t").alias("i"), r6("pitch").alias("x"))


#: Declared durations of the source, some a frame too long, and the next user's durations as target, some empty.
_GRIDS = f"""{SEGS}, source AS (SELECT utt, pos, dur + CASE WHEN pos % 4 = 1 THEN 1 ELSE 0 END AS dur FROM segs),
  target AS (SELECT utt - 1 AS utt, pos, phone, dur - CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS dur FROM segs WHERE utt - 1 IN (SELECT utt FROM segs))"""
_WARP = f"""{_GRIDS}, src AS (SELECT utt, pos, sum(dur) OVER w - dur AS a, sum(dur) OVER w AS e, sum(dur) OVER (PARTITION BY utt) AS whole FROM source WINDOW w AS (PARTITION BY utt ORDER BY pos)),
  n AS (SELECT utt, count(*) AS n FROM frames GROUP BY 1), ends AS (SELECT DISTINCT utt, whole AS every_dur FROM src),
  tgt AS (SELECT utt, pos, dur, sum(dur) OVER (PARTITION BY utt ORDER BY pos) - dur AS begins FROM target),
  met AS (SELECT tgt.*, n, coalesce(a, every_dur) AS a, greatest(0, least(coalesce(e, every_dur), n) - coalesce(a, every_dur)) AS has FROM tgt LEFT JOIN src USING (utt, pos) JOIN n USING (utt) JOIN ends USING (utt) WHERE dur > 0),
  every AS (SELECT *, unnest(range(dur)) AS i FROM met),
  places AS (SELECT utt, pos, (begins + i)::INTEGER AS t, CASE WHEN has = 0 THEN least(a, n) - 1 WHEN has = 1 THEN a ELSE a + i * (has - 1) / greatest(dur - 1, 1)::DOUBLE END AS p FROM every),
  warp AS (SELECT p.utt, p.pos, p.t, coalesce(x.pitch + (p - floor(p)) * (coalesce(y.pitch, x.pitch) - x.pitch), 0.0) AS pitch
    FROM places p LEFT JOIN frames x ON x.utt = p.utt AND x.t = floor(p) LEFT JOIN frames y ON y.utt = p.utt AND y.t = floor(p) + 1)"""


def _warped(spark, d):
    s = segs(spark, d)
    source = s.select("utt", "pos", (F.col("dur") + (F.col("pos") % 4 == 1).cast("int")).alias("dur"))
    target = next_user(s).join(s.select("utt").distinct(), "utt", "left_semi").withColumn("dur", F.col("dur") - (F.col("pos") % 5 == 0).cast("int"))
    return B.warped_onto(frames(spark, d), ["pitch"], source, target)


@query("seq_14_segment_warp", f"WITH {_WARP} SELECT utt, pos, t, round(pitch, 6) AS x FROM warp")
def segment_warp(spark, d):
    return _warped(spark, d).select("utt", "pos", "t", r6("pitch").alias("x"))


_DELTA = f"{_WARP}, {_gauss('smooth', 'warp', 'pitch', 3.0)}, delta AS (SELECT s.utt, s.t, f.pitch - s.pitch AS pitch FROM smooth s JOIN frames f ON f.utt = s.utt + 1 AND f.t = s.t)"


def _delta(spark, d):
    return S.paired_delta(next_user(frames(spark, d)), _warped(spark, d), ["pitch"])


@query("seq_15_frame_delta", f"WITH {_DELTA} SELECT utt, t, round(pitch, 6) AS delta FROM delta")
def frame_delta(spark, d):
    """The next user's frames less those of this one, warped onto the next one's segments and smoothed."""
    return _delta(spark, d).select("utt", "t", r6("pitch").alias("delta"))


@query("seq_16_downsample", f"WITH {DURS}, e AS (SELECT utt, total, greatest(1, total // 5) AS n FROM durs), i AS (SELECT utt, total, n, unnest(range(n)) AS i FROM e) SELECT utt, i::INTEGER AS i, (CASE WHEN n = 1 THEN total // 2 ELSE round_even(i * (total - 1) / (n - 1)::DOUBLE, 0) END)::INTEGER AS d FROM i")
def downsample(spark, d):
    n = F.greatest(F.lit(1), F.floor(F.col("total") / 5)).cast("int")
    return tall(durs(spark, d), A.even_picks(F.col("total"), n))


def _anchored(spark, d):
    """The anchors of each segment, to be rendered at other durations: 0 to 6 frames."""
    s = segs(spark, d)
    return G.anchors(s, frames(spark, d), "pitch").join(s.select("utt", "pos", "phone", (F.col("pos") % 7).alias("dur")), ["utt", "pos"])


_ANCHORED = f"""{SEGS}, anchored AS (SELECT s.utt, s.pos, s.pos % 7 AS d, s.phone, a.pitch AS x, m.pitch AS y, e.pitch AS z FROM segs s
        JOIN frames a ON a.utt = s.utt AND a.t = s.start JOIN frames m ON m.utt = s.utt AND m.t = s.start + s.dur // 2 JOIN frames e ON e.utt = s.utt AND e.t = s.start + s.dur - 1),
        p AS (SELECT *, (d + 1) // 2 AS f, unnest(range(d))::INTEGER AS i FROM anchored)"""
_LINEAR = """CASE WHEN d = 1 THEN y WHEN d = 2 THEN CASE WHEN i = 0 THEN x ELSE z END WHEN d = 3 THEN CASE i WHEN 0 THEN x WHEN 1 THEN y ELSE z END
        WHEN i < f THEN x + (y - x) * i / greatest(f - 1, 1) ELSE y + (z - y) * (i - f) / greatest(d - f - 1, 1) END"""
_PLATEAU = "CASE WHEN d = 1 THEN y WHEN i = 0 THEN x WHEN i = d - 1 THEN z ELSE y END"


def _render(spark, d, kind):
    xs = S.rendered(F.col("start_x"), F.col("mid_x"), F.col("end_x"), F.col("dur"), kind)
    return _anchored(spark, d).select("utt", "pos", F.posexplode(xs).alias("i", "v")).select("utt", "pos", "i", r6("v").alias("v"))


@query("seq_17_render_line", f"WITH {_ANCHORED} SELECT utt, pos, i, round(CASE WHEN d = 1 THEN 0.5 * (x + z) ELSE x + (z - x) * i / greatest(d - 1, 1) END, 6) AS v FROM p")
def render_line(spark, d):
    return _render(spark, d, F.lit("line"))


@query("seq_18_render_linear", f"WITH {_ANCHORED} SELECT utt, pos, i, round({_LINEAR}, 6) AS v FROM p")
def render_linear(spark, d):
    return _render(spark, d, F.lit("linear"))


@query("seq_19_render_plateau", f"WITH {_ANCHORED} SELECT utt, pos, i, round({_PLATEAU}, 6) AS v FROM p")
def render_plateau(spark, d):
    return _render(spark, d, F.lit("plateau"))


@query("seq_20_render_hybrid", f"WITH {_ANCHORED} SELECT utt, pos, i, round(CASE WHEN phone IN ('view', 'click') THEN {_LINEAR} ELSE {_PLATEAU} END, 6) AS v FROM p")
def render_hybrid(spark, d):
    return _render(spark, d, F.when(F.col("phone").isin("view", "click"), "linear").otherwise("plateau"))


@query("seq_21_blocks", f"WITH {RUNS}, g AS (SELECT utt, pos, list(pitch ORDER BY t) AS xs FROM runs GROUP BY 1, 2) SELECT utt, pos, least(len(xs), 3)::BIGINT AS n, round(list_sum(list_slice(xs, 1, 3)), 6) AS total FROM g")
def blocks(spark, d):
    xs = F.transform(F.array_sort(F.collect_list(F.struct("t", "pitch"))), lambda s: s["pitch"])
    g = with_runs(spark, d).groupBy("utt", "pos").agg(xs.alias("xs"))
    return g.select("utt", "pos", long(F.least(F.size("xs"), F.lit(3))).alias("n"), r6(A.total(A.to_length(F.col("xs"), F.lit(3), F.lit(0.0)))).alias("total"))


@query(
    "seq_22_context_blocks",
    f"WITH {RUNS}, c AS (SELECT *, coalesce(lag(pitch) OVER (PARTITION BY utt ORDER BY t), 0.0) AS p, coalesce(lead(pitch) OVER (PARTITION BY utt ORDER BY t), 0.0) AS q FROM runs) SELECT utt, pos, round(arg_min(p, t), 6) AS bef, round(arg_max(q, t), 6) AS aft FROM c GROUP BY 1, 2",
)
def context_blocks(spark, d):
    w = G.by_time()
    c = with_runs(spark, d).withColumn("p", F.lag("pitch", 1, 0.0).over(w)).withColumn("q", F.lead("pitch", 1, 0.0).over(w))
    return c.groupBy("utt", "pos").agg(r6(F.min_by("p", "t")).alias("bef"), r6(F.max_by("q", "t")).alias("aft"))


@query("seq_23_half_masks", f"WITH {SEGS}, p AS (SELECT utt, pos, dur, greatest(1, dur // 2) AS mid, unnest(range(dur)) AS i FROM segs) SELECT utt, pos, i::INTEGER AS i, i < mid AS first, i >= mid OR dur = 1 AS second FROM p")
def half_masks(spark, d):
    a, b = A.half_masks(F.col("dur"))
    s = segs(spark, d).withColumn("m", F.arrays_zip(a.alias("a"), b.alias("b")))
    return s.select("utt", "pos", F.posexplode("m").alias("i", "m")).select("utt", "pos", "i", F.col("m.a").alias("first"), F.col("m.b").alias("second"))


@query(
    "seq_24_boundary_blend",
    f"""WITH {RUNS}, c AS (SELECT *, 0.9 * coalesce(lag(pitch) OVER w, 0.0) AS p, 1.1 * coalesce(lead(pitch) OVER w, 0.0) AS q FROM runs WINDOW w AS (PARTITION BY utt ORDER BY t)),
        b AS (SELECT utt, pos, arg_min(p, t) AS before, arg_max(q, t) AS after, min(t) AS a, max(t) AS e FROM c GROUP BY 1, 2),
        n AS (SELECT utt, pos, a, e, lag(after) OVER w AS from_last, lead(before) OVER w AS from_next FROM b WINDOW w AS (PARTITION BY utt ORDER BY pos)),
        one AS (SELECT r.utt, r.pos, r.t, n.e, from_next, CASE WHEN r.t = n.a AND from_last IS NOT NULL THEN 0.5 * r.pitch + 0.5 * from_last ELSE r.pitch END AS x FROM runs r JOIN n USING (utt, pos))
        SELECT utt, t, round(CASE WHEN t = e AND from_next IS NOT NULL THEN 0.5 * x + 0.5 * from_next ELSE x END, 6) AS x FROM one""",
)
def boundary_blend(spark, d):
    """Blocks are the runs of a user between predictions of the frames beside them: nine tenths of the one before, eleven tenths of the one after."""
    w = G.by_time()
    c = with_runs(spark, d).withColumn("p", 0.9 * F.lag("pitch", 1, 0.0).over(w)).withColumn("q", 1.1 * F.lead("pitch", 1, 0.0).over(w))
    packed = F.array_sort(F.collect_list(F.struct("t", "pitch", "p", "q"))).alias("s")
    ext = F.concat(F.array(F.col("s")[0]["p"]), F.transform("s", lambda r: r["pitch"]), F.array(F.element_at("s", -1)["q"]))
    b = c.groupBy("utt", "pos").agg(packed, F.min("t").alias("start")).select("utt", "pos", "start", ext.alias("ext"))
    out = B.blended(b.select("utt", "pos", "ext")).join(b.select("utt", "pos", "start"), ["utt", "pos"])
    return out.select("utt", "start", F.posexplode("body").alias("i", "x")).select("utt", (F.col("start") + F.col("i")).alias("t"), r6("x").alias("x"))


@query(
    "seq_25_collate",
    f"""WITH {DURS}, m AS (SELECT *, (ceil(max(len(d)) OVER (PARTITION BY utt % 8) / 16.0) * 16)::BIGINT AS width FROM durs), p AS (SELECT utt, d, width, unnest(range(width)) AS i FROM m)
        SELECT utt, width, i::INTEGER AS i, coalesce(d[i + 1], 0)::INTEGER AS d, i < len(d) AS held FROM p""",
)
def collate(spark, d):
    from ..functions.scalars import rounded_up

    x = durs(spark, d).withColumn("width", rounded_up(F.max(F.size("d")).over(W.partitionBy(F.col("utt") % 8)), 16))
    padded = A.to_length(F.col("d"), F.col("width").cast("int"), F.lit(0))
    return x.select("utt", "width", F.size("d").alias("n"), F.posexplode(padded).alias("i", "d")).select("utt", "width", "i", "d", (F.col("i") < F.col("n")).alias("held"))


_ENDS = f"{RUNS}, ends AS (SELECT utt, t, pos, coalesce(lead(pos) OVER (PARTITION BY utt ORDER BY t) <> pos, true)::INTEGER AS eop FROM runs)"


@query("seq_26_encoder_position", f"WITH {_ENDS} SELECT utt, t, pos + 1 AS place, eop FROM ends")
def encoder_position(spark, d):
    return G.end_flags(with_runs(spark, d)).select("utt", "t", (F.col("pos") + 1).alias("place"), F.col("is_end").cast("int").alias("eop"))


@query("seq_27_position_from_ends", f"WITH {_ENDS} SELECT utt, t, (1 + coalesce(sum(eop) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS place FROM ends")
def position_from_ends(spark, d):
    e = G.end_flags(with_runs(spark, d)).groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", F.col("is_end").cast("int").alias("e")))), lambda s: s["e"]).alias("e"))
    return e.select("utt", F.posexplode(A.positions_of_ends(F.col("e"))).alias("t", "place"))


_CHANNELS = "ours AS (SELECT utt, t, ln(pitch + 1) AS pitch, pitch / 50 AS loud FROM frames)"


def _channels(spark, d):
    """(utt, t, pitch, loud): the logarithm of the pitch, and a share of it as loudness."""
    return frames(spark, d).select("utt", "t", F.log1p("pitch").alias("pitch"), (F.col("pitch") / 50).alias("loud"))


@query(
    "seq_28_gated_delta",
    f"""WITH {FRAMES}, {_CHANNELS}, held AS (SELECT * FROM ours WHERE utt + 1 IN (SELECT utt FROM ours)),
        exemplar AS (SELECT utt - 1 AS utt, t, ln(pitch + 1) - 3.5 AS dp, pitch / 50 - 0.7 AS dl, (pitch > 40)::INTEGER::DOUBLE AS v FROM frames),
        {_stretch('warped', 'exemplar', 'dp dl v', 'held')},
        masks AS (SELECT w.*, (o.pitch > ln(31))::INTEGER::DOUBLE AS mine, (o.pitch > ln(31) AND w.v > 0.5)::INTEGER::DOUBLE AS both_ FROM warped w JOIN held o ON o.utt = w.utt AND o.t = w.t),
        {_gauss('gates', 'masks', 'mine both_', 2.0)},
        gated AS (SELECT m.utt, m.t, m.dp * g.both_ AS dp, m.dl * g.mine AS dl FROM masks m JOIN gates g ON g.utt = m.utt AND g.t = m.t),
        {_gauss('moves', 'gated', 'dp dl', 1.5)}
        SELECT o.utt, o.t, round(o.pitch + 0.8 * coalesce(dp, 0), 6) AS pitch, round(o.loud + 0.8 * coalesce(dl, 0), 6) AS loud FROM ours o LEFT JOIN moves m ON m.utt = o.utt AND m.t = o.t""",
)
def gated_delta(spark, d):
    """The exemplar is the next user: its distance from a mid value is the delta, voiced above 40."""
    e = next_user(frames(spark, d))
    delta = e.select("utt", "t", (F.log1p("pitch") - 3.5).alias("pitch"), (F.col("pitch") / 50 - 0.7).alias("loud"), (F.col("pitch") > 40).cast("double").alias("voiced"))
    return S.with_delta(_channels(spark, d), delta, 0.8).select("utt", "t", r6("pitch").alias("pitch"), r6("loud").alias("loud"))


@query(
    "seq_29_apply_envelope",
    f"""WITH {FRAMES}, {_CHANNELS}, held AS (SELECT * FROM ours WHERE utt + 1 IN (SELECT utt FROM ours)),
        exemplar AS (SELECT utt - 1 AS utt, t, pitch, pitch / 50 AS loud FROM frames), last AS (SELECT utt, max(t) AS last FROM exemplar GROUP BY 1),
        swing AS (SELECT f.utt, f.t, any_value(f.loud) AS loud, CASE WHEN count_if(g.pitch > 40) >= 3 THEN stddev_pop(CASE WHEN g.pitch > 40 THEN g.pitch END) ELSE 0.0 END AS pitch
          FROM exemplar f JOIN last USING (utt), (SELECT unnest(range(-6, 6)) AS k) k, exemplar g WHERE g.utt = f.utt AND g.t = greatest(0, least(f.t + k.k, last)) GROUP BY 1, 2),
        {_gauss('env', 'swing', 'pitch loud', 6.0)},
        scaled AS (SELECT utt, t, least(greatest(pitch / (avg(pitch) OVER (PARTITION BY utt) + 1e-6), 0.5), 3.0) AS pitch, least(greatest(loud / (avg(loud) OVER (PARTITION BY utt) + 1e-6), 0.6), 2.5) AS loud FROM env),
        {_stretch('by_', 'scaled', 'pitch loud', 'held')}, {_gauss('centre', 'ours', 'pitch loud', 20.0)}
        SELECT o.utt, o.t, round(CASE WHEN b.pitch IS NULL THEN o.pitch ELSE c.pitch + (o.pitch - c.pitch) * (1 + 0.7 * (b.pitch - 1)) END, 6) AS pitch,
          round(CASE WHEN b.loud IS NULL THEN o.loud ELSE c.loud + (o.loud - c.loud) * (1 + 0.4 * (b.loud - 1)) END, 6) AS loud
        FROM ours o JOIN centre c ON c.utt = o.utt AND c.t = o.t LEFT JOIN by_ b ON b.utt = o.utt AND b.t = o.t""",
)
def apply_envelope(spark, d):
    """The exemplar is the next user."""
    exemplar = next_user(frames(spark, d)).select("utt", "t", "pitch", (F.col("pitch") / 50).alias("loud"))
    return S.excited(_channels(spark, d), exemplar, 0.7, 0.4).select("utt", "t", r6("pitch").alias("pitch"), r6("loud").alias("loud"))


@query("seq_30_concat_gaps", f"WITH {SEGS} SELECT utt, pos, (coalesce(sum(dur + 6) OVER (PARTITION BY utt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place FROM segs")
def concat_gaps(spark, d):
    w = W.partitionBy("utt").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return segs(spark, d).select("utt", "pos", F.coalesce(F.sum(F.col("dur") + 6).over(w), F.lit(0)).alias("place"))


@query(
    "seq_31_body_delta",
    f"""WITH {_DELTA}, e AS (SELECT utt, arg_min(dur, pos) AS first, arg_max(dur, pos) AS last FROM segs GROUP BY 1),
        b AS (SELECT delta.utt, delta.t + first AS t, delta.pitch AS d FROM delta JOIN e USING (utt) JOIN n USING (utt) WHERE delta.t < n - first - last)
        SELECT f.utt, f.t, round(f.pitch + 0.5 * coalesce(b.d, 0), 6) AS x FROM frames f LEFT JOIN b ON b.utt = f.utt AND b.t = f.t""",
)
def body_delta(spark, d):
    """The first and the last segment stand for the ends; the delta is that of seq_15, which may be shorter or longer than the body."""
    ends = segs(spark, d).groupBy("utt").agg(F.min_by("dur", "pos").alias("first"), F.max_by("dur", "pos").alias("last"))
    return S.with_body_delta(frames(spark, d), _delta(spark, d), ends, "pitch", 0.5).select("utt", "t", r6("pitch").alias("x"))
