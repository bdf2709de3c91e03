"""A sink that publishes one file for each row: staged first, checked, renamed into place, with failures kept in a queue.

Rows of a stream go to a staging table, batch by batch. Whenever `every` of them wait, and at the end, those that have not been published are tried. A file is written beside its
name, its size is checked, and it is renamed; what succeeds goes to the manifest. The queue is what is staged and not in the manifest, so
failures stay in it until a later pass, and a driver that starts anew finds it as it was.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Put = Callable[[str, bytes, int], None]
MANIFEST = "key string, pass int, ok boolean, error string"


def write_checked(uri: str, content: bytes, least: int = 500) -> None:
    """Write a file under another name, check that it has its bytes and `least` of them, and rename it: readers see a whole file or none."""
    where, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    task = TaskContext.get()
    part = f"{path}.{task.taskAttemptId() if task else 0}.tmp"
    where.create_dir(path.rpartition("/")[0])
    with where.open_output_stream(part) as out:
        out.write(content)
    size = where.get_file_info(part).size
    if size != len(content) or size < least:
        where.delete_file(part)
        raise OSError(f"{size} bytes, {max(least, len(content))} wanted")
    where.move(part, path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key into some partitions for each core, however few bytes they have: for work that takes time by the row."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


class StagedSink:
    """Publishes rows (key string, content binary) as files out/key. put(uri, content, pass) publishes one, or raises.

    root holds the staging table and the manifest; both are on the shared file system, as out is.
    """

    def __init__(self, spark: SparkSession, root: str, out: str, every: int = 100, put: Put = lambda uri, content, _: write_checked(uri, content)):
        self.spark, self.root, self.out, self.every, self.put = spark, root.rstrip("/"), out.rstrip("/"), every, put
        self.waiting = self.passes = 0

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
            df.isEmpty()
            return df
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """(key, pass, ok, error): a row for each time a key was tried."""
        return self._read("manifest", MANIFEST)

    def queue(self) -> DataFrame:
        """(key, content): what is staged and not published. A key staged again is one file, of the last batch."""
        staged = self._read("staged", "key string, content binary, batch long").groupBy("key").agg(F.max_by("content", "batch").alias("content"))
        return staged.join(self.manifest().where("ok").select("key"), "key", "left_anti")

    def add(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: stage a batch, and flush if enough wait. A batch that is repeated replaces itself."""
        path = f"{self.root}/staged/batch={number}"
        batch.select("key", "content").write.mode("overwrite").parquet(path)
        self.waiting += self.spark.read.schema("key string").parquet(path).count()
        if self.waiting >= self.every:
            self.flush()

    def flush(self) -> int:
        """Try all that wait; returns how many still do."""
        self.passes = (self.manifest().agg(F.coalesce(F.max("pass"), F.lit(0))).first()[0] or 0) + 1
        out, put, number = self.out, self.put, self.passes

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                rows = []
                for key, content in zip(pdf["key"], pdf["content"], strict=True):
                    try:
                        put(f"{out}/{key}", bytes(content), number)
                        rows.append((key, number, True, None))
                    except Exception as e:  # whatever a store says; the row stays in the queue with its reason
                        rows.append((key, number, False, str(e)))
                yield pd.DataFrame(rows, columns=["key", "pass", "ok", "error"])

        dealt(self.queue(), "key").mapInPandas(run, MANIFEST).write.mode("append").parquet(f"{self.root}/manifest")
        self.waiting = self.queue().count()
        return self.waiting

    def finish(self, most: int = 5) -> int:
        """At most so many last passes while anything waits; returns how many files are not published."""
        left = self.queue().count()
        for _ in range(most):
            if not left:
                break
            left = self.flush()
        return left

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
