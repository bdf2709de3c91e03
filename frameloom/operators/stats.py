"""Statistics: partial and final aggregates by Catalyst, one shuffle each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Accuracy of the sketch that brackets a quantile.
ACCURACY = 10_000


def floored_std(x: Column, policy: str = "variance") -> Column:
    """Population standard deviation; "variance" floors the variance at 1e-8, "unit" gives 1 below 1e-6."""
    if policy == "variance":
        return F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(1e-8)))
    return F.when(F.stddev_pop(x) < 1e-6, 1.0).otherwise(F.stddev_pop(x))


def channel_stats(df: DataFrame, channels: list[str], policy: str = "variance") -> DataFrame:
    """(ch, mean, std, n): one pass over all channels."""
    aggs = [F.struct(F.lit(c).alias("ch"), F.avg(F.col(c).cast("double")).alias("mean"), floored_std(F.col(c).cast("double"), policy).alias("std"), F.count(c).alias("n")) for c in channels]
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def group_stats(df: DataFrame, key: str, x: Column) -> DataFrame:
    return df.groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"))


def spread_of(stats: DataFrame, columns: list[str]) -> DataFrame:
    """Least, largest, mean and median of each column of group statistics, as one row."""
    return stats.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", F.median))))


def of_places(f: Callable[[Column], Column], vector: str, size: int) -> Column:
    """An array of an aggregate over each of the first `size` places of vectors, such as their mean. One row for a group and task goes through the shuffle, however many vectors it has."""
    return F.array(*(f(F.get(vector, F.lit(i)).cast("double")) for i in range(size)))


def vector_mean(df: DataFrame, keys: str | list[str], vector: str) -> DataFrame:
    """(keys, mean, n): mean of each place over the vectors of a group that have one there, and their number; null vectors don't count."""
    keys = [keys] if isinstance(keys, str) else keys
    size = df.agg(F.max(F.size(vector))).first()[0] or 0
    return df.where(F.col(vector).isNotNull()).groupBy(*keys).agg(of_places(F.avg, vector, size).alias("mean"), F.count("*").alias("n"))


def vector_delta(df: DataFrame, unit: str, kind: str, base: str, vector: str) -> DataFrame:
    """(unit, kind, delta, n): mean vector by unit and kind less that of the base kind; n is the smaller count. A unit without the base kind has a base of zeros and n = 0."""
    means = vector_mean(df, [unit, kind], vector)
    b = means.where(F.col(kind) == base).select(unit, F.col("mean").alias("_base"), F.col("n").alias("_n"))
    delta = F.zip_with("mean", F.coalesce("_base", F.transform("mean", lambda _: F.lit(0.0))), lambda x, y: x - y)
    joined = means.where(F.col(kind) != base).join(b, unit, "left")
    return joined.select(unit, kind, delta.alias("delta"), F.least("n", F.coalesce("_n", F.lit(0))).alias("n"))


def group_delta(df: DataFrame, unit: str, kind: str, base: str, x: str) -> DataFrame:
    """(unit, kind, delta, n): mean of x by unit and kind minus that of the base kind; n is the smaller count."""
    means = df.groupBy(unit, kind).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))
    b = means.where(F.col(kind) == base).select(unit, F.col("mean").alias("base_mean"), F.col("n").alias("base_n"))
    return means.where(F.col(kind) != base).join(b, unit).select(unit, kind, (F.col("mean") - F.col("base_mean")).alias("delta"), F.least("n", "base_n").alias("n"))


def mean_ratio(pairs: DataFrame, key: str, a: str, b: str, keys: DataFrame) -> DataFrame:
    """(key, ratio, n_pairs): mean of a / b for each of keys; 1.0 without a pair."""
    r = pairs.groupBy(key).agg(F.avg(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))).alias("ratio"), F.count("*").alias("n_pairs"))
    return keys.join(r, key, "left").select(key, F.coalesce("ratio", F.lit(1.0)).alias("ratio"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def shares(df: DataFrame, label: str, source: str) -> DataFrame:
    """(source, label, n, share): counts by label for each source, and over all with source null."""
    n = df.rollup(label, source).agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 3")
    total = F.sum("n").over(W.partitionBy("g", source))  # over counts, not rows
    return n.select(source, label, "n", (F.col("n") / total).alias("share"))


def confusion(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """(truth, one column for each label): counts, zeros filled."""
    return df.groupBy(truth).pivot(predicted, labels).agg(F.count(F.lit(1))).na.fill(0)


def quantiles(df: DataFrame, x: str, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact quantiles with linear interpolation, a column each; null for a column without values.

    A sketch brackets each quantile; one pass counts what lies below the brackets, and only the distinct values inside, about one in
    ACCURACY / 4 of all rows, are put in order. No task holds the whole column.
    """
    v = df.select(F.col(x).alias("_v")).where(F.col(x).isNotNull())
    bounds = [p for q in at for p in (max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY))]
    got = v.agg(F.count("*").alias("n"), F.percentile_approx("_v", bounds, ACCURACY).alias("b")).first()
    n, low, high = got["n"], (got["b"] or [])[::2], (got["b"] or [])[1::2]
    if not n:
        return df.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(_percent(q)) for q in at))
    below = v.agg(*(F.count_if(F.col("_v") < F.lit(b)).alias(f"b{k}") for k, b in enumerate(low))).first()
    held = F.array_compact(F.array(*(F.when(F.col("_v").between(a, b), F.lit(k)) for k, (a, b) in enumerate(zip(low, high, strict=True)))))
    inside = v.select("_v", F.explode(held).alias("k")).groupBy("k", "_v").agg(F.count("*").alias("c"))
    inside = inside.withColumn("upto", F.sum("c").over(W.partitionBy("k").orderBy("_v")))
    out = []
    for k, q in enumerate(at):
        place = (n - 1) * q
        upto = F.col("upto") + below[k]
        one, two = (F.min(F.when((F.col("k") == k) & (upto > int(place) + d), F.col("_v").cast("double"))) for d in (0, 1))
        out.append((one + F.lit(place - int(place)) * (F.coalesce(two, one) - one)).alias(_percent(q)))
    return inside.agg(*out)


def _percent(q: float) -> str:
    return f"p{round(100 * q)}"


def histogram(codes: DataFrame, code: str, size: int) -> DataFrame:
    """(code, n) for each code below size, those that never occur too."""
    n = codes.groupBy(code).agg(F.count("*").alias("n"))
    domain = codes.sparkSession.range(size).select(F.col("id").cast("int").alias(code))
    return domain.join(n, code, "left").select(code, F.coalesce("n", F.lit(0)).alias("n"))


def usage(codes: DataFrame, code: str, by: list[str] | None = None, top: int = 10) -> DataFrame:
    """([by,] active, perplexity, coverage, top1, n): how evenly codes are used; coverage is the share of the `top` most frequent."""
    by = by or []
    n = codes.groupBy(*by, code).agg(F.count("*").alias("c"))
    counts = n.groupBy(*by).agg(F.sort_array(F.collect_list("c"), asc=False).alias("cs"), F.sum("c").alias("n"))  # a number for each code
    entropy = F.aggregate("cs", F.lit(0.0), lambda a, c: a - (c / F.col("n")) * F.log(c / F.col("n")))
    head = F.aggregate(F.slice("cs", 1, top), F.lit(0).cast("long"), lambda a, c: a + c)
    return counts.select(*by, F.size("cs").alias("active"), F.exp(entropy).alias("perplexity"), (head / F.col("n")).alias("coverage"), (F.col("cs")[0] / F.col("n")).alias("top1"), "n")


def consistency(df: DataFrame, unit: str, code: str) -> DataFrame:
    """(unit, n, distinct, modal_share): how one-valued the codes of a unit are."""
    n = df.groupBy(unit, code).agg(F.count("*").alias("c"))
    return n.groupBy(unit).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), (F.max("c") / F.sum("c")).alias("modal_share"))


def masked_mean(x: Column, mask: Column) -> Column:
    """Sum over the mask by its size, 1 at least."""
    return F.coalesce(F.sum(F.when(mask, x)), F.lit(0.0)) / F.greatest(F.count_if(mask), F.lit(1))


def mean_of_means(df: DataFrame, batch: str, x: str) -> DataFrame:
    """Unweighted mean of the batches' means."""
    return df.groupBy(batch).agg(F.avg(x).alias("m")).agg(F.avg("m").alias("mean_of_means"))


def imbalance(flag: Column) -> Column:
    """Negatives by positives, 1 at least."""
    return F.greatest(F.lit(1.0), F.count_if(~flag) / F.greatest(F.count_if(flag), F.lit(1)))
