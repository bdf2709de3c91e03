"""Files of one array set each: NPZ and NPY as a Spark data source, and the tails of logs."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType

from ..streaming.flush import dealt, write_checked


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@dataclass
class Files(InputPartition):
    """Files of a partition below the root, packed: the driver holds the partitions of all."""

    packed: bytes

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.packed = zlib.compress("\0".join(paths).encode()) if paths else b""

    @property
    def paths(self) -> list[str]:
        return zlib.decompress(self.packed).decode().split("\0") if self.packed else []


class ArrayFiles(DataSource):
    """spark.read.format("arrays").schema("key string, pitch array<float>, ...").load(root)

    A row for each .npz or .npy file under root. key is the name without its suffix, path the part below root; a declared array is the file's array of that name (of an .npy file its only
    one), null where the file has none. Arrays that are not declared are not decompressed. A file that can't be read ends the query, or, if a column `_error string` is
    declared, is a row with its reason. Files are dealt into partitions of about `partitionBytes`,
    and of `partitionFiles` at most, as small files take time by their number.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return "key string, path string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options, schema)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.schema = options["path"].rstrip("/"), schema
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.files = int(options.get("partitionFiles", 2000))

    def partitions(self) -> list[InputPartition]:
        where, root = opened(self.root)
        out, held, size, folders = [], [], 0, [root]
        while folders:  # one folder's files at a time
            found = where.get_file_info(fs.FileSelector(folders.pop()))
            folders += sorted((f.path for f in found if f.type == fs.FileType.Directory), reverse=True)
            for path, n in sorted((f.path, f.size) for f in found if f.is_file and re.search(r"\.np[yz]$", f.path) and not re.search(r"/[._][^/]*$", f.path)):
                if held and (size + n > self.bytes or len(held) >= self.files):
                    out.append(Files(held))
                    held, size = [], 0
                held.append(path[len(root) :].lstrip("/"))
                size += n
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        where, root = opened(self.root)
        arrays = {f.name for f in self.schema if isinstance(f.dataType, ArrayType)}
        for path in partition.paths:
            got, error = {}, None
            try:
                with where.open_input_file(f"{root}/{path}") as f:
                    got = {k: self._plain(v) for k, v in _arrays(f, path, arrays).items()}
            except (ValueError, OSError, EOFError, KeyError, zipfile.BadZipFile) as e:
                if "_error" not in self.schema.names:
                    raise
                error = f"{type(e).__name__}: {e}"
            got |= {"key": re.sub(r"\.np[yz]$", "", path.rpartition("/")[2]), "path": path, "_error": error}
            yield tuple(got.get(c) for c in self.schema.names)

    @staticmethod
    def _plain(x: np.ndarray) -> list:
        return x.tolist() if x.ndim else [x.item()]


def _arrays(file, path: str, names: set[str]) -> dict[str, np.ndarray]:
    if path.endswith(".npy"):
        if len(names) != 1:
            raise ValueError("an .npy file has one array")
        return {next(iter(names)): np.load(io.BytesIO(file.read()))}
    with np.load(file) as z:  # reads the directory; an array is read when it is asked for
        got = {n: z[n] for n in names if n in z}
    if odd := sorted(n for n, x in got.items() if not isinstance(x, np.ndarray)):
        raise ValueError(f"no array: {', '.join(odd)}")
    return got


def write_arrays(df: DataFrame, root: str, key: str = "key", suffix: str = "npz", least: int = 0) -> int:
    """Write a file root/key.suffix for each row: NPZ with the array columns by name, or NPY with the only one. Names may have folders. Files are whole or absent; returns their number.

    Rows are dealt over all cores by key, as small rows that are many take time by their number and Spark deals by bytes.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    root = root.rstrip("/")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.to_dict("records"):
                held = io.BytesIO()
                arrays = {n: np.array([np.asarray(x) for x in row[n]], np.float32 if suffix == "npz" else None) for n in names if row[n] is not None}
                np.savez_compressed(held, **arrays) if suffix == "npz" else np.save(held, arrays[names[0]])
                write_checked(f"{root}/{row[key]}.{suffix}", held.getvalue(), least)
            yield pd.DataFrame({"n": [len(pdf)]})

    return dealt(df.select(key, *names), key).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def last_lines(files: DataFrame, pattern: str, size: int = 16_384) -> DataFrame:
    """(path, line, read): of each file (path, length) the last line in its last `size` bytes that has the pattern, or null, and how many bytes were read.

    Lines end at CR or LF, as progress bars write them; bytes that are no UTF-8 are left out. The rest of a file is not read, however long it has grown. Spark lists no empty files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, read = [], []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = opened(path)
                with where.open_input_file(name) as f:
                    f.seek(max(0, length - size))
                    tail = f.read(min(size, length))
                found = [x.strip() for x in re.split(r"[\r\n]+", tail.decode(errors="ignore")) if re.search(pattern, x)]
                lines.append(found[-1] if found else None)
                read.append(len(tail))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string()), pa.array(read, pa.int64())], names=["path", "line", "read"])

    return files.select("path", "length").mapInArrow(run, "path string, line string, read long")
