"""Token ids as binary shards with a minimal perfect hash index for keyed access.

Files of a store:

* shard-NNNNNN.ids: the ids of documents in ascending doc_id order, end id included, as raw little-endian integers.
* index-NNNNNN.mph: for the keys of one hash bucket a minimal perfect hash, and by its slots a 32-bit fingerprint of
  the key, the shard, the first id in the shard and the number of ids.

A key's bucket file, its slot there and its ids' place follow from the key by arithmetic: no search, no key stored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, new_path, stage, table
from .packing import public_tokenizer
from .tokenizing import ids_of

#: Keys of an index file, about.
INDEX_KEYS = 50_000
MAGIC = b"MPHIDX01"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_whole(uri: str, blocks: Iterator[bytes]) -> None:
    """Write beside the name, then rename: a retried or doubled task leaves one whole file."""
    where, path = opened(uri)
    task = TaskContext.get()
    part = f"{path}.{task.taskAttemptId() if task else 0}.part"
    where.create_dir(path.rpartition("/")[0])
    with where.open_output_stream(part) as out:
        for block in blocks:
            out.write(block)
    where.move(part, path)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64 bits for (doc_id, how many equal ids come before it); distinct for distinct ids with no others before."""
    return mixed(ids.astype(np.uint64), 1) ^ mixed(occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64), 2)


class PerfectHash:
    """Levels of bits: a key takes its place in the first level where no other key of the level falls on it.

    A key's slot is the number of bits set before its own, over all levels. Keys that 40 levels don't part (equal
    hashes) go to a sorted list of their own after them.
    """

    def __init__(self, bits: np.ndarray, ends: np.ndarray, rest: np.ndarray):
        self.bits, self.ends, self.rest = bits, ends, rest
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def of(cls, keys: np.ndarray, load: float = 1.7) -> "PerfectHash":
        levels, ends = [], []
        while len(keys) and len(levels) < 40:
            size = -(-int(load * len(keys) + 1) // 64) * 64
            at = (mixed(keys, 10 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            ends.append(size + (ends[-1] if ends else 0))
            keys = keys[~alone[at]]
        return cls(np.concatenate(levels) if levels else np.zeros(0, "<u8"), np.array(ends, np.int64), np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; those outside the set get some slot, or -1."""
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, end in enumerate(self.ends.tolist()):
            at = (mixed(keys[left], 10 + level) % np.uint64(end - start)).astype(np.int64) + start
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below
            left, start = left[~hit], end
        if len(self.rest) and len(left):
            at = np.searchsorted(self.rest, keys[left])
            same = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[left])
            out[left[same]] = self.before[-1] + at[same]
        return out


def index_bytes(keys: np.ndarray, shard: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    ph = PerfectHash.of(keys)
    slots = ph.slots(keys)
    by = np.empty(len(keys), np.int64)
    by[slots] = np.arange(len(keys))
    arrays = {
        "bits": ph.bits, "ends": ph.ends, "rest": ph.rest, "print": mixed(keys, 3)[by].astype("<u4"),
        "shard": shard[by].astype("<u4"), "start": start[by].astype("<u8"), "count": count[by].astype("<u8"),
    }
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(v.tobytes() for v in arrays.values())])


class Index:
    """One index file, read."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        at = 12 + int.from_bytes(data[8:12], "little")
        got = {}
        for k, (kind, n) in json.loads(data[12:at]).items():
            got[k] = np.frombuffer(data, kind, n, at)
            at += got[k].nbytes
        self.hash, self.got = PerfectHash(got["bits"], got["ends"], got["rest"]), got

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """found, shard, start, count of each key."""
        slots, got = self.hash.slots(keys), self.got
        n = len(got["print"])
        at = np.maximum(slots, 0)
        if not n:
            return np.zeros(len(keys), bool), at, at, at
        found = (slots >= 0) & (got["print"][at] == mixed(keys, 3).astype("<u4"))
        return found, got["shard"][at].astype(np.int64), got["start"][at].astype(np.int64), got["count"][at].astype(np.int64)


def _keys(ids: pa.ChunkedArray | pa.Array, occurrence: np.ndarray) -> np.ndarray:
    return key_hash(ids.fill_null(0).to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.fill_null(0).to_numpy(), occurrence, ids.is_null().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.is_null().to_numpy())


class TokenStore:
    """A written store: path, number of index files, ids' type, and shards: DataFrame (shard, base, n_ids), base the ids before it."""

    def __init__(self, path: str, buckets: int, dtype: str, shards: DataFrame):
        self.path, self.buckets, self.dtype, self.shards = path, buckets, dtype, shards

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).alias("_bucket")

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str, end_id: int) -> "TokenStore":
        """Write docs (doc_id long, text) to path. One sort by doc_id; each task of it encodes its texts and writes one shard.

        Null doc_id: first. Equal doc_ids: in the order of their texts, one after the other, each kept. Null or
        empty text: the end id alone. Long texts are encoded whole. Other columns are not read. Empty table: no shard, one empty index.
        """
        dtype = ids_of(tokenizer).dtype.str

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, shard, out = ids_of(tokenizer), TaskContext.get().partitionId(), []
            end = np.array([end_id], ids.dtype).tobytes()
            doc, occurrence, at, metas = object(), 0, 0, []

            def blocks() -> Iterator[bytes]:
                nonlocal doc, occurrence, at
                for batch in batches:
                    rows = []
                    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        occurrence = occurrence + 1 if key == doc else 0
                        doc = key
                        data = ids.encode(text) + end
                        n = len(data) // ids.dtype.itemsize
                        rows.append((key, occurrence, shard, at, n))
                        at += n
                        yield data
                    metas.append(rows)

            write_whole(f"{path}/shard-{shard:06d}.ids", blocks())
            for rows in metas:
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "occurrence", "shard", "start", "n_tokens"])

        ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        meta = stage(ordered.mapInArrow(run, "doc_id long, occurrence long, shard long, start long, n_tokens long"), "store-meta")
        base = F.coalesce(F.sum("n_ids").over(W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        shards = meta.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids")).select("shard", base.alias("base"), "n_ids")
        store = cls(path, max(1, round(meta.count() / INDEX_KEYS)), dtype, stage(shards, "store-shards"))

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            bucket = key[0].as_py()
            keys = _keys(rows["doc_id"], rows["occurrence"].to_numpy())
            data = index_bytes(keys, *(rows[c].to_numpy() for c in ("shard", "start", "n_tokens")))
            write_whole(f"{path}/index-{bucket:06d}.mph", iter([data]))
            return pa.table({"bucket": [bucket], "n": pa.array([len(keys)], pa.int64())})

        meta.groupBy(store._bucket()).applyInArrow(build, "bucket long, n long").agg(F.sum("n")).collect()
        free(meta)
        return store

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, start, n_tokens) for each document under the keys (doc_id). Unknown keys give no row (or a false one in 2^32)."""
        path = self.path

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            where, name = opened(f"{path}/index-{key[0].as_py():06d}.mph")
            ids, out = rows["doc_id"].combine_chunks(), []
            if where.get_file_info(name).type == fs.FileType.File:
                with where.open_input_stream(name) as f:
                    index = Index(f.read())
                occurrence = 0
                while len(ids):
                    found, *place = index.find(_keys(ids, np.full(len(ids), occurrence)))
                    ids = ids.filter(pa.array(found))
                    out.append(pa.table([ids, *(pa.array(x[found], pa.int64()) for x in place)], names=["doc_id", "shard", "start", "n_tokens"]))
                    occurrence += 1
            kind = pa.schema([(c, pa.int64()) for c in ("doc_id", "shard", "start", "n_tokens")])
            return pa.concat_tables(out) if out else kind.empty_table()

        return keys.select(F.col("doc_id").cast("long")).distinct().groupBy(self._bucket()).applyInArrow(run, "doc_id long, shard long, start long, n_tokens long")

    def read(self, located: DataFrame, digest: bool = False) -> DataFrame:
        """located with ids array<int>, or with ids_crc32, the CRC of the ids as 32-bit integers, read from the shards."""
        path, dtype = self.path, np.dtype(self.dtype)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            @functools.lru_cache(maxsize=1)
            def shard_file(shard: int) -> pa.NativeFile:
                where, name = opened(f"{path}/shard-{shard:06d}.ids")
                return where.open_input_file(name)

            for batch in batches:
                got = []
                for shard, start, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "start", "n_tokens")), strict=True):
                    f = shard_file(shard)
                    f.seek(start * dtype.itemsize)
                    ids = np.frombuffer(f.read(n * dtype.itemsize), dtype)
                    got.append(zlib.crc32(ids.astype("<u4")) if digest else ids.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64() if digest else pa.list_(pa.int32()))], names=[*batch.schema.names, "ids_crc32" if digest else "ids"])

        by_place = located.repartition("shard").sortWithinPartitions("shard", "start")
        more = "ids_crc32 long" if digest else "ids array<int>"
        return by_place.mapInArrow(run, f"doc_id long, shard long, start long, n_tokens long, {more}")


def op10(spark, sf_dir: str) -> DataFrame:
    """The ids of all documents, written and read back; nulls, empty and long texts, ties and repeats as in TokenStore.write()."""
    docs = table(spark, sf_dir, "documents")
    store = TokenStore.write(docs, new_path(spark, "store"), public_tokenizer("word_bpe_49k.json"), end_id=2)
    got = store.read(store.locate(docs), digest=True).join(store.shards, "shard")
    return got.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
