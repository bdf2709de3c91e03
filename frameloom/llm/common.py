"""What the operators share: tables, staged results, words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. Java, DuckDB and Python read the pattern alike.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() splits at exactly the six ASCII white spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: Rows whose texts a worker holds as Python objects at once.
TEXT_ROWS = 512


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of so many rows: objects made from a slice are gone before the next one."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session takes a folder of its own machine; a cluster's is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no rework.

    Unlike checkpoint() the result is columnar and compressed, and later reads prune columns.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def free(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_bounded(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; otherwise as it is, and Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Keys that may be broadcast as hot ones, and the rows that make a key hot.
HOT_KEYS, HOT_ROWS = 20_000, 500


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined to keys, where keys has each key once with n, the number of its rows.

    A key of many rows would be one task of a shuffled join. Such keys are broadcast: those with a share of 1 / HOT_KEYS of all
    rows or more are HOT_KEYS at most, whatever the data. Both inputs are read twice or more: staged tables, as a rule.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = keys.where(F.col(n) >= least)
    if hot.isEmpty():
        return rows.join(keys, on)
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col(n) < least), on)
    return cold.unionByName(rows.join(hot, on).select(*cold.columns))


def set_aside(docs: DataFrame, *read: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns that an operator doesn't read under names that clash with nothing; and the name that each column has there."""
    names = {c: c if c in read else f"_aside_{k}" for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}), names


def freed_name(df: DataFrame, want: str) -> str:
    """want, with underscores before it until df has no such column: for helper columns beside a caller's own."""
    names = {c.lower() for c in df.columns}
    while want.lower() in names:
        want = f"_{want}"
    return want


def null_safe(name: str, alias: str) -> tuple[Column, Column]:
    """A nullable string key as two columns that equi-joins and groups treat alike."""
    return F.coalesce(F.col(name), F.lit("")).alias(alias), F.col(name).isNull().alias(f"{alias}_null")
