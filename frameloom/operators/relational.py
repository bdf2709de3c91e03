"""Filters, joins and set operations of the feature store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered

#: Rows up to which a dimension may be broadcast; the size is checked where it isn't known by construction.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """df for broadcast if it has at most `rows` rows; otherwise as it is, and Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows within the bounds, both included; reaches the Parquet scan."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def consistent(df: DataFrame, durs: str, labels: str, frames: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose durations fit labels and frames, and a row with kept and skipped counts."""
    ok = (F.size(durs) == F.size(labels)) & (F.aggregate(durs, F.lit(0).cast("long"), lambda a, d: a + d) <= F.col(frames))
    counts = df.agg(F.count_if(ok).alias("kept"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("skipped"))
    return df.where(ok), counts


def within_tolerance(df: DataFrame, a: str, b: str, most: int, strict: bool = False) -> DataFrame:
    """Rows with |a - b| <= most; strict raises at the first other row."""
    ok = F.abs(F.col(a) - F.col(b)) <= most
    if strict:
        return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("difference beyond tolerance")).cast("boolean")))
    return df.where(ok)


def inner_all(first: DataFrame, others: list[DataFrame], on: str) -> DataFrame:
    for other in others:
        first = first.join(other, on)
    return first


def with_defaults(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left outer join; columns of right without a match take their defaults."""
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_fallback(left: DataFrame, own: DataFrame, group: DataFrame, on: str, group_on: str, column: str) -> DataFrame:
    """The column by `on`, or else the one of the group."""
    a = own.select(on, F.col(column).alias("_own"))
    b = group.select(group_on, F.col(column).alias("_group"))
    return left.join(a, on, "left").join(b, group_on, "left").withColumn(column, F.coalesce("_own", "_group")).drop("_own", "_group")


def lookup(df: DataFrame, vocabulary: DataFrame, symbol: str, default: int) -> DataFrame:
    """df with id; unknown symbols get the default. vocabulary: (symbol, id)."""
    v = vocabulary.select(F.col("symbol").alias(symbol), F.col("id"))
    return df.join(dimension(v), symbol, "left").withColumn("id", F.coalesce("id", F.lit(default)))


def unknown(df: DataFrame, vocabulary: DataFrame, symbol: str) -> DataFrame:
    """Symbols that the vocabulary lacks, with counts."""
    v = vocabulary.select(F.col("symbol").alias(symbol))
    return df.join(dimension(v), symbol, "left_anti").groupBy(symbol).agg(F.count("*").alias("n"))


def ordinal_pairs(a: DataFrame, b: DataFrame, group: str, order: str) -> DataFrame:
    """(group, rn, a, b): the i-th of a with the i-th of b in each group, as many as both have."""
    w = W.partitionBy(group).orderBy(order)
    x = a.select(group, F.col(order).alias("a"), F.row_number().over(w).alias("rn"))
    y = b.select(group, F.col(order).alias("b"), F.row_number().over(w).alias("rn"))
    return x.join(y, [group, "rn"])


def self_pairs(df: DataFrame, key: list[str], kind: str, base: str, value: str, order: str) -> DataFrame:
    """(key, kind, base_value, value): each kind's value against the base kind's under the same key; of repeats the last by order."""
    last = df.groupBy(*key, kind).agg(F.max_by(value, order).alias("value"))
    b = last.where(F.col(kind) == base).select(*key, F.col("value").alias("base_value"))
    return last.where(F.col(kind) != base).join(b, key)


def interval_frames(intervals: DataFrame, rate: int, frames: str) -> DataFrame:
    """Rows (.., t) of the frames of intervals in seconds: [round(rate * xmin), round(rate * xmax)), clamped, one at least.

    The bounds are projected and exploded; no range join.
    """
    low = F.greatest(F.lit(0), F.least(F.bround(F.col("xmin") * rate).cast("int"), F.col(frames) - 1))
    high = F.greatest(low + 1, F.least(F.bround(F.col("xmax") * rate).cast("int"), F.col(frames)))
    return intervals.withColumn("t", F.explode(F.sequence(low, high - 1)))


def grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """All combinations of two dimensions, one of them of a vocabulary's size; refused where both are larger."""
    if all(x.limit(DIMENSION_ROWS + 1).count() > DIMENSION_ROWS for x in (a, b)):
        raise ValueError(f"a product of two tables of more than {DIMENSION_ROWS} rows")
    return dimension(a).crossJoin(dimension(b))


def first_wins(sources: list[DataFrame], key: str, last: bool = False) -> DataFrame:
    """Union where of one key the earliest source stays, or the last one."""
    tagged = [df.withColumn("_src", F.lit(i)) for i, df in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    pick = F.max_by if last else F.min_by
    row = F.struct(*(c for c in out.columns if c not in (key, "_src")))
    return out.groupBy(key).agg(pick(row, "_src").alias("_row")).select(key, "_row.*")


def extended(vocabulary: DataFrame, more: DataFrame) -> DataFrame:
    """vocabulary (symbol, id) with the unseen symbols of more, by order, after the largest id. New symbols are numbered over ranges."""
    new = more.select("symbol").distinct().join(dimension(vocabulary.select("symbol")), "symbol", "left_anti")
    top = vocabulary.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    added = numbered(new, "symbol", name="_n").crossJoin(F.broadcast(top))  # with one row
    return vocabulary.select("symbol", "id").unionByName(added.select("symbol", (F.col("top") + 1 + F.col("_n")).cast("int").alias("id")))


def first_existing(keys: DataFrame, listing: DataFrame, key: str, priority: Column) -> DataFrame:
    """keys with path, the listed one of least priority, or null."""
    return keys.join(listing.groupBy(key).agg(F.min_by("path", priority).alias("path")), key, "left")
