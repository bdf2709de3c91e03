"""Packing token sequences: full windows first, the rest by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_parts, stage, table
from .tokenizing import ids_of

WINDOW = 2048
#: Pieces of a group that one task packs. Only the last windows of a group can be far from full.
GROUP = 40_000


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: (doc_id, start, length, ids_crc32, doc_tokens[, ids]). Overlong documents are cut into full windows.

    Null or empty text: one piece with the end id alone. Null doc_id and repeated rows: pieces of their own.
    """
    kept = ", ids array<int>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        for batch in in_parts(batches):
            rows: list[list] = [[] for _ in range(6 if keep_ids else 5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                all_ids = np.append(np.frombuffer(ids.encode(text), ids.dtype), ids.dtype.type(end_id)).astype("<u4")
                for at in range(0, len(all_ids), window):
                    piece = all_ids[at : at + window]
                    for column, x in zip(rows, (doc, at, len(piece), zlib.crc32(piece), len(all_ids), piece.astype("<i4")), strict=False):
                        column.append(x)
            types = [batch.schema.field(0).type, *[pa.int64()] * 4, *[pa.list_(pa.int32())] * keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])

    of = docs.select("doc_id", "text")
    kind = of.schema["doc_id"].dataType.simpleString()
    return of.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{kept}")


class OpenWindows:
    """Windows by remaining capacity. A segment tree over the capacities finds the smallest that is large enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with room for least; it is open no more."""
        k, count = least + self.leaves, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up, until there is something to the right
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece. lengths: in decreasing order, none above window."""
    tree, used = OpenWindows(window), 0
    places, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        got = tree.take(n) if n < window else None
        if got is None:
            got, used = (window, used), used + 1
        room, places[k] = got
        offsets[k] = window - room
        if room > n:
            tree.put(room - n, int(places[k]))
    return places, offsets


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a staged table with columns length and _row, a number of its own for each row.

    Rows are dealt by _row into groups of about `group` pieces, whatever document they are from, so no key makes
    a group large. In a group longer pieces come first and each goes to the tightest open window. sequence_id is group * 2^40
    + window. Padding comes from the last windows of a group and what no piece fits; both fall with the group's size.
    """
    groups = max(1, round(pieces.count() / group))
    schema = T.StructType([*(f for f in pieces.schema if f.name != "_row"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        order = np.lexsort((rows["_row"].to_numpy(), -lengths))
        places, offsets = best_fit(lengths[order], window)
        rows = rows.drop_columns("_row").take(pa.array(order))
        return rows.append_column("sequence_id", pa.array(places + (key[0].as_py() << 40))).append_column("offset", pa.array(offsets))

    return pieces.groupBy(F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group")).applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Documents as pieces in sequences of at most `window` tokens. Empty table: empty result. Other columns are not read."""
    pieces = pieces_of(docs, tokenizer, end_id, window, keep_ids).withColumn("_row", F.monotonically_increasing_id())
    return pack(stage(pieces, "pieces"), window)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents; nulls, empty and long texts, ties and repeats as in pieces_of() and pack()."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=1)


def stage_pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of the documents with their places. Nulls, empty and long texts, ties, repeats, empty tables
    and other columns as in pieces_of() and pack()."""
    return pack_documents(docs, public_tokenizer("byte_bpe_50k.json"), end_id=1)
