"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import stats as ST
from .base import BASE, SEGS, query, r6, segs, table


@query(
    "agg_01_channel_stats",
    """SELECT 'value' AS ch, round(avg(value), 6) AS mean, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 1e-8)), 6) AS std, count(*)::BIGINT AS n FROM events
       UNION ALL SELECT 'user_id', round(avg(user_id), 6), round(sqrt(greatest(avg(user_id::DOUBLE * user_id) - avg(user_id) * avg(user_id), 1e-8)), 6), count(*)::BIGINT FROM events""",
)
def channel_stats(spark, d):
    s = ST.channel_stats(table(spark, d, "events"), ["value", "user_id"])
    return s.select("ch", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query("agg_02_unit_floor", "SELECT 'value' AS ch, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END, 6) AS std, count(*)::BIGINT AS n FROM events UNION ALL SELECT 'one', 1.0, 1.0, count(*)::BIGINT FROM events")
def unit_floor(spark, d):
    s = ST.channel_stats(table(spark, d, "events").withColumn("one", F.lit(1.0)), ["value", "one"], "unit")
    return s.select("ch", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query("agg_03_single_precision_mean", "SELECT round(avg(value), 4) AS mean, round(sqrt(avg(value * value) - avg(value) * avg(value)), 2) AS std FROM events")
def single_mean(spark, d):
    m = F.avg("value").cast("float").cast("double")
    return table(spark, d, "events").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value")) - m * m), 2).alias("std"))


@query("agg_04_speaker_stats", "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*)::BIGINT AS n FROM events WHERE value > 40 GROUP BY 1")
def speaker_stats(spark, d):
    s = ST.group_stats(table(spark, d, "events").where("value > 40"), "user_id", F.col("value"))
    return s.select("user_id", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query(
    "agg_05_spread",
    """WITH s AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS std FROM events WHERE value > 40 GROUP BY 1)
       SELECT round(min(mean), 6) AS mean_min, round(max(mean), 6) AS mean_max, round(avg(mean), 6) AS mean_mean, round(median(mean), 6) AS mean_median,
              round(min(std), 6) AS std_min, round(max(std), 6) AS std_max, round(avg(std), 6) AS std_mean, round(median(std), 6) AS std_median FROM s""",
)
def spread(spark, d):
    s = ST.spread_of(ST.group_stats(table(spark, d, "events").where("value > 40"), "user_id", F.col("value")), ["mean", "std"])
    return s.select(*(r6(c).alias(c) for c in s.columns))


@query(
    "agg_06_vector_mean",
    "SELECT label, (i - 1)::INTEGER AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2",
)
def vector_mean(spark, d):
    m = ST.vector_mean(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", r6("x").alias("x"))


_Z = "z AS (SELECT user_id % 40 AS phone, event_type AS emotion, user_id, event_id, (ln(value + 1) - m) / s AS x FROM events, (SELECT avg(ln(value + 1)) AS m, stddev_pop(ln(value + 1)) AS s FROM events))"


def _z(spark, d):
    e = table(spark, d, "events").withColumn("lx", F.log1p("value"))
    j = e.crossJoin(F.broadcast(e.agg(F.avg("lx").alias("m"), F.stddev_pop("lx").alias("s"))))  # one row
    return j.select((F.col("user_id") % 40).alias("phone"), F.col("event_type").alias("emotion"), "user_id", "event_id", ((F.col("lx") - F.col("m")) / F.col("s")).alias("x"))


@query(
    "agg_07_group_delta",
    f"""WITH {_Z}, g AS (SELECT phone, emotion, avg(x) AS m, count(*) AS n FROM z GROUP BY 1, 2)
        SELECT a.phone, a.emotion, round(a.m - b.m, 6) AS delta, least(a.n, b.n)::BIGINT AS n FROM g a JOIN g b USING (phone) WHERE a.emotion <> '{BASE}' AND b.emotion = '{BASE}'""",
)
def group_delta(spark, d):
    return ST.group_delta(_z(spark, d), "phone", "emotion", BASE, "x").select("phone", "emotion", r6("delta").alias("delta"), "n")


@query(
    "agg_07_vector_delta",
    """WITH e AS (SELECT label AS phone, CASE WHEN label = 3 THEN 1 + vec_id % 2 ELSE vec_id % 3 END AS emotion, embedding FROM embeddings),
        g AS (SELECT phone, emotion, i, avg(x) AS m, count(*) AS n FROM (SELECT phone, emotion, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM e) GROUP BY 1, 2, 3)
        SELECT a.phone, a.emotion, a.i::INTEGER AS i, round(a.m - coalesce(b.m, 0), 6) AS delta, least(a.n, coalesce(b.n, 0))::BIGINT AS n
        FROM g a LEFT JOIN g b ON b.phone = a.phone AND b.i = a.i AND b.emotion = 0 WHERE a.emotion <> 0""",
)
def vector_delta(spark, d):
    """One phone has nothing of the base kind."""
    kind = F.when(F.col("label") == 3, 1 + F.col("vec_id") % 2).otherwise(F.col("vec_id") % 3)
    e = table(spark, d, "embeddings").select(F.col("label").alias("phone"), kind.alias("emotion"), "embedding")
    v = ST.vector_delta(e, "phone", "emotion", 0, "embedding")
    return v.select("phone", "emotion", "n", F.posexplode("delta").alias("i", "delta")).select("phone", "emotion", "i", r6("delta").alias("delta"), "n")


@query(
    "agg_08_mean_ratio",
    """WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT a.event_type AS kind, a.c / b.c::DOUBLE AS r FROM n a JOIN n b USING (user_id) WHERE a.event_type <> 'view' AND b.event_type = 'view')
       SELECT k.kind, round(coalesce(avg(r), 1.0), 6) AS ratio, count(r)::BIGINT AS n_pairs FROM (SELECT DISTINCT event_type AS kind FROM events UNION SELECT 'none') k LEFT JOIN p USING (kind) GROUP BY 1""",
)
def mean_ratio(spark, d):
    e = table(spark, d, "events")
    n = e.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("c"))
    pairs = n.where("kind <> 'view'").join(n.where("kind = 'view'").select("user_id", F.col("c").alias("b")), "user_id")
    keys = e.select(F.col("event_type").alias("kind")).distinct().union(spark.createDataFrame([("none",)], "kind string"))
    return ST.mean_ratio(pairs, "kind", "c", "b", keys).select("kind", r6("ratio").alias("ratio"), "n_pairs")


@query("agg_09_low_support", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING count(*) > 0 AND count(*) < 10")
def low_support(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 0 and n < 10")


@query(
    "agg_10_shares",
    """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
       SELECT source, lang, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM n
       UNION ALL SELECT NULL, lang, sum(n)::BIGINT, round(sum(n) / (SELECT count(*) FROM documents), 6) FROM n GROUP BY lang""",
)
def shares(spark, d):
    return ST.shares(table(spark, d, "documents"), "lang", "source").select("source", "lang", "n", r6("share").alias("share"))


@query("agg_11_confusion", "SELECT quality, count_if(toxic = 0)::BIGINT AS toxic_0, count_if(toxic = 1)::BIGINT AS toxic_1 FROM labels GROUP BY 1")
def confusion(spark, d):
    return ST.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1]).select("quality", F.col("0").alias("toxic_0"), F.col("1").alias("toxic_1"))


@query("agg_12_quantiles", "SELECT round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90 FROM events")
def quantiles(spark, d):
    q = ST.quantiles(table(spark, d, "events"), "value")
    return q.select(*(r6(c).alias(c) for c in q.columns))


@query("agg_13_conditional", "SELECT count_if(value > 70)::BIGINT AS n, round(count_if(value > 70) / count(*), 6) AS share FROM events")
def conditional(spark, d):
    return table(spark, d, "events").agg(F.count_if(F.col("value") > 70).alias("n"), r6(F.count_if(F.col("value") > 70) / F.count("*")).alias("share"))


_CODES = "codes AS (SELECT event_type, floor(value / 10)::INTEGER AS code FROM events)"


def _codes(spark, d):
    return table(spark, d, "events").select("event_type", F.floor(F.col("value") / 10).cast("int").alias("code"))


@query("agg_14_histogram", f"WITH {_CODES} SELECT r.code::INTEGER AS code, count(codes.code)::BIGINT AS n FROM (SELECT unnest(range(64)) AS code) r LEFT JOIN codes ON codes.code = r.code GROUP BY 1")
def histogram(spark, d):
    return ST.histogram(_codes(spark, d), "code", 64)


def _usage_sql(by: str, columns: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""WITH {_CODES}, n AS (SELECT {by + ', ' if by else ''}code, count(*) AS c FROM codes GROUP BY ALL),
      p AS (SELECT *, c / sum(c) OVER ({part}) AS p, row_number() OVER ({part} ORDER BY c DESC, code) AS rk, max(c) OVER ({part}) AS top FROM n)
      SELECT {by + ', ' if by else ''}count(*)::INTEGER AS active, round(exp(-sum(p * ln(p))), 6) AS perplexity, {columns} sum(c)::BIGINT AS n FROM p {'GROUP BY ' + by if by else ''}"""


@query("agg_15_usage", _usage_sql("", "round(sum(CASE WHEN rk <= 10 THEN c ELSE 0 END) / sum(c), 6) AS coverage,"))
def usage(spark, d):
    return ST.usage(_codes(spark, d), "code").select("active", r6("perplexity").alias("perplexity"), r6("coverage").alias("coverage"), "n")


@query("agg_16_usage_by_level", _usage_sql("event_type", "round(max(top) / sum(c), 6) AS top1,"))
def usage_by_level(spark, d):
    return ST.usage(_codes(spark, d), "code", ["event_type"]).select("event_type", "active", r6("perplexity").alias("perplexity"), r6("top1").alias("top1"), "n")


@query("agg_17_consistency", f"WITH {_CODES}, n AS (SELECT event_type, code, count(*) AS c FROM codes GROUP BY 1, 2) SELECT event_type, sum(c)::BIGINT AS n, count(*)::BIGINT AS n_codes, round(max(c) / sum(c), 6) AS modal_share FROM n GROUP BY 1")
def consistency(spark, d):
    return ST.consistency(_codes(spark, d), "event_type", "code").select("event_type", "n", F.col("distinct").alias("n_codes"), r6("modal_share").alias("modal_share"))


@query("agg_18_distinct", "SELECT count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT event_type)::BIGINT AS kinds, count(DISTINCT floor(value))::BIGINT AS codes FROM events")
def distinct(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.floor("value")).alias("codes"))


@query("agg_19_masked_mean", "SELECT user_id, round(coalesce(sum(CASE WHEN value > 200 THEN value END), 0.0) / greatest(count_if(value > 200), 1), 6) AS m FROM events GROUP BY 1")
def masked_mean(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(r6(ST.masked_mean(F.col("value"), F.col("value") > 200)).alias("m"))


@query("agg_20_mean_of_means", "SELECT round(avg(m), 6) AS mean_of_means, round((SELECT avg(value) FROM events), 6) AS mean FROM (SELECT avg(value) AS m FROM events GROUP BY user_id % 7)")
def mean_of_means(spark, d):
    e = table(spark, d, "events").withColumn("b", F.col("user_id") % 7)
    m = ST.mean_of_means(e, "b", "value")
    return m.crossJoin(F.broadcast(e.agg(F.avg("value").alias("mean")))).select(r6("mean_of_means").alias("mean_of_means"), r6("mean").alias("mean"))  # one row each


@query("agg_21_grouped_loss", "SELECT event_type, round(avg(-ln((value + 1) / 600)), 6) AS ce, count(*)::BIGINT AS n FROM events WHERE value > 5 GROUP BY 1")
def grouped_loss(spark, d):
    return table(spark, d, "events").where("value > 5").groupBy("event_type").agg(r6(F.avg(-F.log((F.col("value") + 1) / 600))).alias("ce"), F.count("*").alias("n"))


@query("agg_22_weighted_error", "SELECT l_linenumber AS ch, round(avg((l_quantity - l_tax * 300) * (l_quantity - l_tax * 300) * (1 + l_discount)), 6) AS mse, round(avg(abs(l_quantity - l_tax * 300)), 6) AS mae FROM lineitem GROUP BY 1")
def weighted_error(spark, d):
    e = F.col("l_quantity") - F.col("l_tax") * 300
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("ch")).agg(r6(F.avg(e * e * (1 + F.col("l_discount")))).alias("mse"), r6(F.avg(F.abs(e))).alias("mae"))


@query("agg_23_imbalance", "SELECT round(greatest(1.0, count_if(NOT toxic = 1) / greatest(count_if(toxic = 1), 1)), 6) AS w FROM labels")
def imbalance(spark, d):
    return table(spark, d, "labels").agg(r6(ST.imbalance(F.col("toxic") == 1)).alias("w"))


@query("agg_24_norms", "SELECT label, round(avg(n), 6) AS mean_norm, round(max(n), 6) AS max_norm FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) GROUP BY 1")
def norms(spark, d):
    return table(spark, d, "embeddings").withColumn("n", A.norm(F.col("embedding"))).groupBy("label").agg(r6(F.avg("n")).alias("mean_norm"), r6(F.max("n")).alias("max_norm"))


@query("agg_25_totals", f"WITH {SEGS} SELECT count(DISTINCT utt)::BIGINT AS utts, sum(dur)::BIGINT AS frames, round(sum(dur) / 50.0 / 3600, 6) AS hours, round(avg(dur), 6) AS per_segment FROM segs")
def totals(spark, d):
    return segs(spark, d).agg(F.count_distinct("utt").alias("utts"), F.sum("dur").cast("long").alias("frames"), r6(F.sum("dur") / 50.0 / 3600).alias("hours"), r6(F.avg("dur")).alias("per_segment"))


@query("agg_26_gate", "SELECT abs(count(*) - 10000) <= 1000 AS count_ok, avg(ln(value + 1)) BETWEEN 3.0 AND 5.5 AS mean_ok, stddev_pop(ln(value + 1)) BETWEEN 0.2 AND 1.5 AS std_ok FROM events")
def gate(spark, d):
    x = F.log1p("value")
    return table(spark, d, "events").agg((F.abs(F.count("*") - 10000) <= 1000).alias("count_ok"), F.avg(x).between(3.0, 5.5).alias("mean_ok"), F.stddev_pop(x).between(0.2, 1.5).alias("std_ok"))


@query("agg_27_missing", "SELECT source, count(*)::BIGINT AS n, count_if(quality IS NULL)::BIGINT AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def missing(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("missing"))


