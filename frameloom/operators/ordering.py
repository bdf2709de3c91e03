"""Order, limits, samples, splits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged


def hashed(key: Column, seed: str) -> Column:
    """A number in [0, 2^32) that depends on key and seed alone: no split depends on partitions."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, by hash."""
    return df.orderBy(hashed(F.col(key), seed), key).limit(n)


def split(df: DataFrame, key: str, validation: float, seed: str) -> DataFrame:
    """df with split: val for a hash below the share."""
    return df.withColumn("split", F.when(hashed(F.col(key), seed) < F.lit(int(validation * 2**32)), "val").otherwise("train"))


def group_split(df: DataFrame, group: str, key: str, validation: float, seed: str) -> DataFrame:
    """df with split: of each group the first by hash are val, one at least."""
    rn = F.row_number().over(W.partitionBy(group).orderBy(hashed(F.col(key), seed), key))
    n = F.count("*").over(W.partitionBy(group))
    return df.withColumn("split", F.when(rn <= F.greatest(F.lit(1), F.floor(n * validation)), "val").otherwise("train"))


def best_of(df: DataFrame, group: str, score: str, index: str) -> DataFrame:
    """The row of each group with the largest score; ties to the least index."""
    rn = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), index))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, group: str, score: str, k: int, ties: bool, index: str) -> DataFrame:
    """The k largest of each group; with ties all that equal the k-th, else exactly k."""
    w = W.partitionBy(group).orderBy(F.desc(score), *([] if ties else [index]))
    return df.withColumn("_r", (F.rank() if ties else F.row_number()).over(w)).where(F.col("_r") <= k).drop("_r")


def numbered(df: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """df with a number from 0 without gaps in a global order that tells all rows apart.

    Rows are range-sorted and written to the shared folder with their place in their partition; the rows of the partitions before are added from a count for each
    partition. No task sees more than its range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # partition * 2^33 + place in it
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy("_one").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_one", F.lit(0)).select("_part", before.alias("_before"))  # a row for each partition
    at = F.col("_at").bitwiseAND((1 << 33) - 1)
    return kept.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + at).drop("_at", "_part", "_before")


def batches(df: DataFrame, length: str, key: str, size: int, seed: str | None = None) -> DataFrame:
    """df with batch and place: all rows by length, cut into batches of `size`; only the last one is short. place is the batch's turn.

    With a seed the turns are shuffled by hash, else in order of length. Rows are numbered over ranges, and there are so many fewer batches than rows.
    """
    out = numbered(df, length, key, name="_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")
    if seed is None:
        return out.withColumn("place", F.col("batch"))
    turns = numbered(out.select("batch").distinct().withColumn("_h", hashed(F.col("batch"), seed)), "_h", "batch", name="place").drop("_h")
    return out.join(turns, "batch")


def fixed_batch(df: DataFrame, group: str, key: str, size: int, seed: str, dummy: dict[str, Column]) -> DataFrame:
    """`size` rows of each group: a sample without replacement, by hash, of larger groups; of smaller ones all, filled up with dummy rows. dummy: column -> value; others are null."""
    rn = F.row_number().over(W.partitionBy(group).orderBy(hashed(F.col(key), seed), key))
    kept = df.withColumn("_rn", rn).where(F.col("_rn") <= size).drop("_rn")
    lacking = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") < size)
    filled = lacking.withColumn("_k", F.explode(F.sequence(F.col("_n") + 1, F.lit(size))))
    columns = [F.col(group) if c == group else dummy.get(c, F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    return kept.unionByName(filled.select(*columns))


def round_robin(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return df.withColumn("slot", F.pmod(F.row_number().over(W.partitionBy(group).orderBy(order)) - 1, F.lit(n)).cast("int"))


def drawn(df: DataFrame, group: str, index: str, logit: str, temperature: float, seed: str) -> DataFrame:
    """One row of each group, drawn by the softmax of its logits at a temperature with a hashed uniform number."""
    g = W.partitionBy(group)
    e = df.withColumn("_e", F.exp((F.col(logit) - F.max(logit).over(g)) / temperature))
    p = e.withColumn("_c", F.sum("_e").over(g.orderBy(index).rowsBetween(W.unboundedPreceding, 0)) / F.sum("_e").over(g))
    u = hashed(F.col(group), seed) / float(2**32)
    rn = F.row_number().over(g.orderBy(index))
    return p.where(F.col("_c") > u).withColumn("_rn", rn).where("_rn = 1").drop("_e", "_c", "_rn")
