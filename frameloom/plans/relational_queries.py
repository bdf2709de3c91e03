"""Projections, filters, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..operators import relational as R
from ..operators import stats as ST
from .base import FRAMES, KINDS, SEGS, frames, long, query, r6, segs, table


@query("prj_01_channel_pack", "SELECT event_id, round(value, 6) AS c0, round(ln(value + 1), 6) AS c1, 3::BIGINT AS n FROM events")
def channel_pack(spark, d):
    e = table(spark, d, "events").withColumn("v", A.packed(F.array("value"), F.log1p("value"), F.lit(0.0)))
    return e.select("event_id", r6(F.col("v")[0]).alias("c0"), r6(F.col("v")[1]).alias("c1"), long(F.size("v")).alias("n"))


@query("prj_02_log_pitch", "SELECT event_id, round(ln(value + 1), 6) AS x, round(exp(ln(value + 1)) - 1, 6) AS hz FROM events")
def log_pitch(spark, d):
    x = S.log_pitch(F.col("value"))
    return table(spark, d, "events").select("event_id", r6(x).alias("x"), r6(S.pitch_of_log(x)).alias("hz"))


@query("prj_03_voicing_floor", "SELECT event_id, CASE WHEN value < 30 THEN 0.0 ELSE value END AS hz FROM events")
def voicing_floor(spark, d):
    return table(spark, d, "events").select("event_id", S.voicing_floor(F.col("value")).alias("hz"))


@query(
    "prj_04_z_score",
    """SELECT event_id, round((value - m) / s, 6) AS z, round((value - m) / (s + 1e-8), 6) AS z_eps, round(((value - m) / s) * s + m, 6) AS back
       FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""",
)
def z_score(spark, d):
    e = table(spark, d, "events")
    x, m, s = F.col("value"), F.col("m"), F.col("s")
    z = S.z_score(x, m, s)
    j = e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))))  # one row
    return j.select("event_id", r6(z).alias("z"), r6(S.z_score(x, m, s, 1e-8)).alias("z_eps"), r6(S.from_z(z, m, s)).alias("back"))


@query(
    "prj_05_speaker_z",
    """WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE value > 40 GROUP BY 1)
       SELECT event_id, round(CASE WHEN value > 40 AND s.s >= 1 THEN (value - m) / s.s ELSE value END, 6) AS pitch
       FROM events LEFT JOIN s USING (user_id)""",
)
def speaker_z(spark, d):
    e = table(spark, d, "events")
    stats = ST.group_stats(e.where(S.voiced(F.col("value"))), "user_id", F.col("value"))
    ok = S.voiced(F.col("value")) & (F.col("std") >= 1)
    return e.join(R.dimension(stats), "user_id", "left").select("event_id", r6(F.when(ok, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(F.col("value"))).alias("pitch"))


@query(
    "prj_06_emotion_rules",
    """SELECT o_orderkey, CASE WHEN a > 0.65 THEN CASE WHEN v > 0.55 THEN 'happy' WHEN v < 0.42 THEN 'angry' ELSE 'surprise' END
         WHEN a < 0.35 THEN 'sad' ELSE 'neutral' END AS emotion
       FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS v, (o_custkey % 100) / 100.0::DOUBLE AS a FROM orders)""",
)
def emotion_rules(spark, d):
    o = table(spark, d, "orders")
    v, a = (F.col("o_orderkey") % 100) / 100.0, (F.col("o_custkey") % 100) / 100.0
    return o.select("o_orderkey", S.emotion_of(v, a).alias("emotion"))


@query(
    "prj_07_remap",
    "SELECT event_id, CASE lower(trim(event_type)) WHEN 'click' THEN 'happy' WHEN 'error' THEN 'angry' WHEN 'signup' THEN 'surprise' ELSE 'neutral' END AS label FROM events",
)
def remap(spark, d):
    return table(spark, d, "events").select("event_id", S.mapped(F.col("event_type"), {"click": "happy", "error": "angry", "signup": "surprise"}, "neutral").alias("label"))


@query(
    "prj_08_knobs",
    """SELECT event_id, (event_type = 'click')::INTEGER::DOUBLE AS k0, (event_type = 'error')::INTEGER::DOUBLE AS k1, (event_type = 'purchase')::INTEGER::DOUBLE AS k2,
       (event_type = 'signup')::INTEGER::DOUBLE AS k3, (event_type = 'view')::INTEGER::DOUBLE AS k4, round(value / 500, 6) AS k5 FROM events""",
)
def knobs(spark, d):
    i = S.mapped(F.col("event_type"), {k: n for n, k in enumerate(KINDS)}, -1)
    e = table(spark, d, "events").withColumn("k", S.knobs(i, F.col("value") / 500))
    return e.select("event_id", *(r6(F.col("k")[n]).alias(f"k{n}") for n in range(6)))


@query("prj_09_rename", "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS parent FROM nation")
def rename(spark, d):
    return table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "id", "n_name": "label", "n_regionkey": "parent"})


_ARRAYS = f"WITH {SEGS}, a AS (SELECT utt, list(dur ORDER BY pos) AS d FROM segs GROUP BY utt)"


def _durs(spark, d):
    return segs(spark, d).groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dur"))), lambda s: s["dur"]).alias("d"))


@query("prj_10_wrap", f"{_ARRAYS} SELECT utt, (len(d) + 2)::BIGINT AS n, 0::BIGINT AS first, 1::BIGINT AS last, list_sum(d)::BIGINT + 1 AS total FROM a")
def wrap(spark, d):
    w = _durs(spark, d).withColumn("w", A.wrapped(F.col("d"), F.lit(0), F.lit(1)))
    return w.select("utt", long(F.size("w")).alias("n"), long(F.col("w")[0]).alias("first"), long(F.element_at("w", -1)).alias("last"), long(A.total(F.col("w"), "long")).alias("total"))


@query("prj_11_body", f"{_ARRAYS} SELECT utt, (len(d) - 2)::BIGINT AS n, (list_sum(d) - d[1] - d[len(d)])::BIGINT AS total FROM a WHERE len(d) > 2")
def body(spark, d):
    w = _durs(spark, d).where(F.size("d") > 2).withColumn("b", A.body(F.col("d")))
    return w.select("utt", long(F.size("b")).alias("n"), long(A.total(F.col("b"), "long")).alias("total"))


@query("flt_01_exclude", "SELECT n_nationkey, n_name FROM nation WHERE n_name <> 'NATION_0'")
def exclude(spark, d):
    return table(spark, d, "nation").where("n_name <> 'NATION_0'").select("n_nationkey", "n_name")


@query("flt_02_range", f"WITH {FRAMES} SELECT utt, count(*)::BIGINT AS frames FROM frames GROUP BY utt HAVING count(*) BETWEEN 60 AND 75")
def in_range(spark, d):
    return R.in_range(frames(spark, d).groupBy("utt").agg(F.count("*").alias("frames")), "frames", 60, 75)


@query("flt_03_voiced", "SELECT event_id, value > 40 AS voiced, ln(value + 1) > ln(31) AS voiced_log FROM events")
def voiced(spark, d):
    return table(spark, d, "events").select("event_id", S.voiced(F.col("value")).alias("voiced"), (F.log1p("value") > F.log(F.lit(31.0))).alias("voiced_log"))


@query("flt_04_consistent", f"{_ARRAYS} SELECT count_if(list_sum(d) <= 66)::BIGINT AS kept, count_if(list_sum(d) > 66)::BIGINT AS skipped FROM a")
def consistent(spark, d):
    x = _durs(spark, d).withColumn("labels", F.col("d")).withColumn("frames", F.lit(66))
    return R.consistent(x, "d", "labels", "frames")[1]


@query("flt_05_tolerance", f"WITH {FRAMES} SELECT utt, count(*)::BIGINT AS frames FROM frames GROUP BY utt HAVING abs(count(*) - 66) <= 5")
def tolerance(spark, d):
    x = frames(spark, d).groupBy("utt").agg(F.count("*").alias("frames")).withColumn("want", F.lit(66))
    return R.within_tolerance(x, "frames", "want", 5).select("utt", "frames")


@query("flt_06_phoneme_tokens", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[A-Z]')))::BIGINT AS n FROM documents")
def phoneme_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", long(F.size(F.filter(F.split("text", " "), S.is_phoneme))).alias("n"))


@query("flt_08_mask", "SELECT event_id, value FROM events WHERE value > 40 AND event_type <> 'error'")
def mask(spark, d):
    return table(spark, d, "events").where("value > 40 AND event_type <> 'error'").select("event_id", "value")


@query(
    "join_01_inner_all",
    "SELECT count(*)::BIGINT AS n, round(sum(l_quantity), 6) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
)
def inner_all(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"))
    return R.inner_all(R.inner_all(li, [o], "k"), [c], "c").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("qty"))


@query("join_02_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("join_03_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("join_04_left_default", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_default(spark, d):
    return R.with_defaults(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": 0})


@query(
    "join_05_fallback",
    """SELECT doc_id, round(coalesce(q::DOUBLE, g), 6) AS x FROM (SELECT doc_id, source FROM documents) LEFT JOIN (SELECT doc_id, quality AS q FROM labels) USING (doc_id)
       LEFT JOIN (SELECT source, avg(quality) AS g FROM documents JOIN labels USING (doc_id) GROUP BY 1) USING (source)""",
)
def fallback(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    own = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("x"))
    group = docs.join(own, "doc_id").groupBy("source").agg(F.avg("x").alias("x"))
    return R.with_fallback(docs, own, group, "doc_id", "source", "x").select("doc_id", r6("x").alias("x"))


_VOCAB = "vocab AS (SELECT * FROM (VALUES ('click', 1), ('error', 2), ('view', 3)) v(symbol, id))"


def _vocab(spark):
    return spark.createDataFrame([("click", 1), ("error", 2), ("view", 3)], "symbol string, id int")


@query("join_06_lookup", f"WITH {_VOCAB} SELECT event_id, coalesce(id, 0) AS id FROM events LEFT JOIN vocab ON event_type = symbol")
def lookup(spark, d):
    return R.lookup(table(spark, d, "events").select("event_id", "event_type"), _vocab(spark), "event_type", 0).select("event_id", "id")


@query("join_06_unknown_report", f"WITH {_VOCAB} SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type NOT IN (SELECT symbol FROM vocab) GROUP BY 1")
def unknown_report(spark, d):
    return R.unknown(table(spark, d, "events"), _vocab(spark), "event_type")


@query(
    "join_07_ordinal_pairs",
    """WITH a AS (SELECT user_id, event_id AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'view'),
       b AS (SELECT user_id, event_id AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'click')
       SELECT user_id, rn::INTEGER AS rn, a, b FROM a JOIN b USING (user_id, rn)""",
)
def ordinal_pairs(spark, d):
    e = table(spark, d, "events")
    return R.ordinal_pairs(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "event_id")


@query(
    "join_08_self_pairs",
    """WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2)
       SELECT a.user_id, a.event_type, a.v AS value, b.v AS base_value FROM l a JOIN l b USING (user_id) WHERE a.event_type <> 'view' AND b.event_type = 'view'""",
)
def self_pairs(spark, d):
    return R.self_pairs(table(spark, d, "events"), ["user_id"], "event_type", "view", "value", "event_id")


@query(
    "join_09_interval_frames",
    """WITH i AS (SELECT event_id, (event_id % 7) * 0.11::DOUBLE AS xmin, (event_id % 7) * 0.11::DOUBLE + (event_id % 5) * 0.03::DOUBLE AS xmax FROM events),
       b AS (SELECT event_id, greatest(0, least(round_even(xmin * 50, 0)::INTEGER, 39)) AS lo, round_even(xmax * 50, 0)::INTEGER AS hi FROM i)
       SELECT event_id, unnest(range(lo, greatest(lo + 1, least(hi, 40))))::INTEGER AS t FROM b""",
)
def interval_frames(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 7) * F.lit(0.11)).alias("xmin"), F.lit(40).alias("n"))
    return R.interval_frames(e.withColumn("xmax", F.col("xmin") + (F.col("event_id") % 5) * F.lit(0.03)), 50, "n").select("event_id", "t")


@query(
    "join_10_table_lookup",
    """WITH g AS (SELECT n_regionkey AS r, n_nationkey AS n, n_nationkey * 0.5::DOUBLE AS delta FROM nation)
       SELECT c_custkey, coalesce(delta, 0.0)::DOUBLE AS delta FROM customer LEFT JOIN g ON n = c_nationkey AND r = c_custkey % 5""",
)
def table_lookup(spark, d):
    g = table(spark, d, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), (F.col("n_nationkey") * 0.5).alias("delta"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 5).alias("r"))
    return c.join(R.dimension(g), ["r", "n"], "left").select("c_custkey", F.coalesce("delta", F.lit(0.0)).alias("delta"))


@query(
    "join_12_singleton",
    "SELECT c_custkey, round(c_acctbal - m, 6) AS x FROM customer, (SELECT avg(c_acctbal) AS m FROM customer)",
)
def singleton(spark, d):
    c = table(spark, d, "customer")
    return c.crossJoin(F.broadcast(c.agg(F.avg("c_acctbal").alias("m")))).select("c_custkey", r6(F.col("c_acctbal") - F.col("m")).alias("x"))


@query("join_13_grid", "SELECT r_name, s.k AS kind, CASE WHEN r_regionkey = 0 THEN 0.0::DOUBLE ELSE (r_regionkey * 10 + len(s.k))::DOUBLE END AS v FROM region, (SELECT DISTINCT event_type AS k FROM events) s")
def grid(spark, d):
    g = R.grid(table(spark, d, "region"), table(spark, d, "events").select(F.col("event_type").alias("kind")).distinct())
    return g.select("r_name", "kind", F.when(F.col("r_regionkey") == 0, 0.0).otherwise((F.col("r_regionkey") * 10 + F.length("kind")).cast("double")).alias("v"))


@query("join_14_transcripts", "SELECT doc_id, coalesce(b.text, '') AS t, b.text IS NULL AS missing FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def transcripts(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("t"))
    j = table(spark, d, "documents").select("doc_id").join(b, "doc_id", "left")
    return j.select("doc_id", F.coalesce("t", F.lit("")).alias("t"), F.col("t").isNull().alias("missing"))


def _slices(spark, d):
    """Two sources that hold all orders between them and share those in progress."""
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.lit("a").alias("src"), "o_totalprice")
    return a, o.where("o_orderstatus <> 'F'").select("o_orderkey", F.lit("b").alias("src"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


_SLICES = """WITH a AS (SELECT o_orderkey, 'a' AS src, o_totalprice FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_orderkey, 'b' AS src, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderstatus <> 'F')"""


@query("set_01_first_wins", _SLICES + " SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def first_wins(spark, d):
    return R.first_wins(list(_slices(spark, d)), "o_orderkey")


@query("set_02_last_wins", _SLICES + " SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def last_wins(spark, d):
    return R.first_wins(list(_slices(spark, d)), "o_orderkey", last=True)


@query(
    "set_03_label_union",
    """WITH a AS (SELECT doc_id, 'human' AS origin, quality AS label FROM labels), b AS (SELECT doc_id, 'rule' AS origin, (n_chars > 1000)::INTEGER AS label FROM documents)
       SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""",
)
def label_union(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.lit("human").alias("origin"), F.col("quality").alias("label"))
    b = table(spark, d, "documents").select("doc_id", F.lit("rule").alias("origin"), (F.col("n_chars") > 1000).cast("int").alias("label"))
    return R.first_wins([b, a], "doc_id", last=True)


@query("set_04_difference", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("set_05_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersection(spark, d):
    return table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query(
    "set_06_vocabulary",
    f"WITH {_VOCAB}, n AS (SELECT DISTINCT event_type AS symbol FROM events WHERE event_type NOT IN (SELECT symbol FROM vocab)) SELECT symbol, id FROM vocab UNION ALL SELECT symbol, (3 + row_number() OVER (ORDER BY symbol))::INTEGER FROM n",
)
def vocabulary(spark, d):
    return R.extended(_vocab(spark), table(spark, d, "events").select(F.col("event_type").alias("symbol")))


@query("set_07_distinct", "SELECT DISTINCT lang, source FROM documents")
def distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


