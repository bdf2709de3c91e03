"""Removal of byte strings of WINDOW bytes that occur elsewhere, after the prefix-free parsing of suffix array building.

Parsing. A rolling hash runs over every text; the least hash among the first SPREAD places of a window is its trigger. A
trigger is the trigger of a run of neighbouring window starts; the text from the first of these starts to the end of the
last one's window is a phrase (up to SPREAD + WINDOW - 1 bytes). All windows belong to exactly one phrase, and equal windows have
equal triggers at equal places, whatever surrounds them.

Dictionary. Phrases that are equal are one entry with a count, so highly repetitive text shrinks to little more than
one copy of itself. An entry found twice has all its windows elsewhere. Other entries matter only where the
text after the trigger, which is part of each of their windows, is found in other entries too.

Order of the parse. The suffixes of the parse are the texts that begin at triggers. They are range-sorted by a fingerprint of the bytes that are part of
every window of the entry, then by the bytes after these, as far as a window can reach. What a suffix shares with its neighbours is the most
that it shares with any other.

Order of the dictionary. All suffixes of an entry that hold its trigger end their own part there, so the entries are sorted once by the
bytes before the trigger, read backwards, and what neighbours share gives the order of all these suffixes.

Corpus order. A window is a suffix of an entry, of some bytes before the trigger, followed by a suffix of the parse. It can be elsewhere
only if both of its parts are within what the two orders share; for most entries that leaves no window. Those that are
left have equal neighbours in the order of (part before, part after), found by grouping fingerprints of the two parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_KEYS, HOT_ROWS, free, join_counted, stage, table
from .token_store import mixed

WINDOW = 400
#: Places of a window among which its trigger lies (a power of 2), and bytes that the rolling hash covers.
SPREAD, GRAM = 128, 12
#: Bytes from the trigger on that are part of every window of a phrase.
KNOWN = WINDOW - SPREAD + 1
#: Bytes hashed at once; longer texts are walked in overlapping blocks.
BLOCK = 1 << 22

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_R = np.random.default_rng(17).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2^64 and of its inverse."""
    while len(_POWERS) <= which:
        _POWERS.append((np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(_POWERS[which][0]) < n:
        size, base = 1 << n.bit_length(), _BASES[which]
        with np.errstate(over="ignore"):
            _POWERS[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    up, down = _POWERS[which]
    return up[:n], down[:n]


class Hashes:
    """Fingerprints of any part of a text, by one of two bases."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(which, len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_R[which][data] * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start], 5)


def phrases(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, starts, places from the first start to the trigger, fingerprint after the trigger, fingerprint of all) of each phrase."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    one, two = Hashes(data, 0), Hashes(data, 1)
    places = np.arange(n + SPREAD - 1)
    least = (one.of(places, places + GRAM) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - places.astype(np.uint64))
    step = 1
    while step < SPREAD:  # the least of 2, 4, 8 ... neighbours; of equal hashes the last
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    trigger = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(trigger)) + 1])
    starts = np.diff(np.append(first, n))
    at = trigger[first]
    after = one.of(at, at + KNOWN)
    whole = mixed(two.of(first, first + starts + WINDOW - 1) ^ ((at - first) * SPREAD + starts).astype(np.uint64), 6)
    return first, starts, at - first, after, whole


def _blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text whose windows are all of its windows, once each."""
    for at in range(0, max(1, len(data) - WINDOW + 1), BLOCK):
        yield at, data[at : at + BLOCK + WINDOW - 1]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def row_key() -> Column:
    """What rows of one doc_id and text share: all that follows depends on these alone."""
    return F.xxhash64("doc_id", "text").alias("key")


def parse(docs: DataFrame, only_after: bool) -> DataFrame:
    """(after) of each phrase, or (key, after, whole, place): place is first start * 2^20 + starts * 2^10 + places to the trigger.

    Blocks of long texts begin phrases of their own; a phrase cut so is a shorter phrase, and its windows are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0).to_numpy(), []
            for key, text in zip(keys, batch.column(1).to_pylist(), strict=True):
                data = _bytes(text)
                for at, part in _blocks(data):
                    first, starts, lead, after, whole = phrases(part)
                    if only_after:
                        out.append((after.view(np.int64),))
                    else:
                        out.append((np.full(len(first), key), after.view(np.int64), whole.view(np.int64), (first + at << 20) + (starts << 10) + lead))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * (1 if only_after else 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["after"] if only_after else ["key", "after", "whole", "place"])

    schema = "after long" if only_after else "key long, after long, whole long, place long"
    return docs.where(F.octet_length("text") >= WINDOW).select(row_key(), "text").mapInArrow(run, schema)


def _pieces(texts: DataFrame) -> DataFrame:
    """One row for each entry in texts (text, key, entries): before, the bytes before its trigger read backwards, and tail, those after the KNOWN bytes from the trigger on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, text, entries in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = _bytes(text).tobytes()
                for e in entries:
                    first, starts, lead = e["place"] >> 20, e["place"] >> 10 & 1023, e["place"] & 1023
                    at = first + lead
                    yield e["after"], data[first:at][::-1], data[at + KNOWN : first + starts + WINDOW - 1], key, e["place"], e["count"], e["many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        names = ["after", "before", "tail", "key", "place", "count", "many"]
        every = rows(batches)
        while part := list(islice(every, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(run, "after long, before binary, tail binary, key long, place long, count int, many boolean")


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, offset of each and of the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def shared_prefixes(column: pa.Array) -> np.ndarray:
    """How many first bytes each string shares with the next one."""
    data, offsets = _strings(column)
    lengths = np.diff(offsets)
    least = np.minimum(lengths[1:], lengths[:-1])
    places = np.arange(int(least.max(initial=0)) + 1)
    padded = np.append(data, np.zeros(len(places), np.uint8))
    own = padded[offsets[:-1, None] + places]
    return np.argmin((own[1:] == own[:-1]) & (places < least[:, None]), axis=1)


def _beside(rows: DataFrame, order: list[str], by: str, name: str, within: str | None = None) -> DataFrame:
    """rows in a global order, with the most first bytes of column by that a row shares with a neighbour; -1 where none has an equal within.

    The first and last row of a partition have a neighbour elsewhere, and get the length of by: the most it can be.
    """
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(part: pa.Table, most: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from part.append_column(name, pa.array(most, pa.int32())).to_batches()

        held, up = None, 0  # the last row so far, and what it shares with the row before
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = pa.Table.from_batches([batch])
            if held is None:
                up = len(part[by][0].as_py())
            else:
                part = pa.concat_tables([held, part]).combine_chunks()
            shared = shared_prefixes(part[by].combine_chunks())
            if within:
                group = part[within].to_numpy()
                shared = np.where(group[1:] == group[:-1], shared, -1)
            before = np.append(up, shared)
            yield from given(part.slice(0, len(shared)), np.maximum(before[:-1], shared))
            held, up = part.slice(len(shared)), before[-1]
        if held is not None:
            yield from given(held, np.array([len(held[by][0].as_py())]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {name} int")


def _windows(entries: DataFrame) -> DataFrame:
    """(after, rank, key, at, phrase, count): the windows of entries within what both orders share; equal (after, rank) for equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after, key, place, count, reach, back = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("after", "key", "place", "count", "reach", "back"))
            (before, b), (tail, t) = (_strings(batch.column(batch.schema.get_field_index(c))) for c in ("before", "tail"))
            first, starts, lead = place >> 20, place >> 10 & 1023, place & 1023
            low, high = np.maximum(0, lead - back), np.minimum(starts, reach + lead - SPREAD + 2)
            n = np.maximum(0, high - low)
            e = np.repeat(np.arange(len(n)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[e]
            ahead = lead[e] - j  # bytes of the window before the trigger
            one, two = Hashes(before, 0).of(b[e], b[e] + ahead), Hashes(tail, 1).of(t[e], t[e] + SPREAD - 1 - ahead)
            rank = mixed(mixed(one + ahead.astype(np.uint64), 9) ^ two, 8).view(np.int64)
            columns = [after[e], rank, key[e], first[e] + j, first[e], count[e]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["after", "rank", "key", "at", "phrase", "count"])

    return entries.mapInArrow(run, "after long, rank long, key long, at long, phrase long, count long")


def _found_again(occurrences: DataFrame, again: DataFrame) -> DataFrame:
    """The occurrences whose text after the trigger is in again (after, count). Texts of many occurrences are known by a broadcast; their
    rows are dealt by keys of their own, so that the join gathers none of them."""
    total = again.agg(F.sum("count")).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(again.where(F.col("count") >= least).select("after", F.lit(True).alias("_hot")))  # HOT_KEYS at most
    rest = again.where(F.col("count") < least).select(F.col("after").alias("_k"), F.lit(True).alias("_cold"))
    known = occurrences.join(hot, "after", "left").withColumn("_k", F.when(F.col("_hot"), F.xxhash64("key", "place")).otherwise(F.col("after")))
    return known.join(rest, "_k", "left").where("_hot or _cold").select("key", "after", "whole", "place")


def _shared_windows(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, phrase, at): the windows of entries (after, key, place, count, entries) found once that are windows of other entries too."""
    many = (F.col("entries") >= HOT_ROWS).alias("many")
    by_text = entries.groupBy("key").agg(F.collect_list(F.struct("after", "place", F.least("count", F.lit(2)).cast("int").alias("count"), many)).alias("entries"))
    by_text = stage(by_text, "open-texts")  # of one document
    texts = docs.where(F.octet_length("text") >= WINDOW).select(row_key(), "text").join(by_text.select("key"), "key", "left_semi")
    pieces = stage(_pieces(texts.dropDuplicates(["key"]).join(by_text, "key").select("key", "text", "entries")), "pieces")

    # Short sort keys: samples of them go to the driver, three million at most.
    parse_order = _beside(pieces, ["after", "tail", "key", "place"], "tail", "reach", "after")
    reaching = parse_order.where(F.col("reach") >= F.greatest(F.lit(0), SPREAD - 1 - F.col("place").bitwiseAND(1023)))
    reaching = reaching.withColumn("tail", F.expr("substring(tail, 1, reach)"))
    reaching = stage(reaching, "parse-order")
    both = stage(_beside(reaching, ["after", "before", "key", "place"], "before", "back", "after").where("back >= 0"), "dictionary-order")
    free(by_text, pieces, reaching)

    # A group of few entries is a few rows for each rank; where many share a text after the trigger, counts add up before a shuffle.
    few = _windows(both.where("not many")).withColumn("n", F.sum("count").over(W.partitionBy("after", "rank")))
    shared = few.where("n > 1 and count = 1").select("key", "phrase", "at")
    if both.where("many").isEmpty():
        return shared
    windows = stage(_windows(both.where("many")), "hot-windows")
    n = windows.groupBy("after", "rank").agg(F.sum("count").alias("n"), F.count("*").alias("rows")).where("n > 1")
    hot = join_counted(windows.where("count = 1"), stage(n, "hot-ranks"), ["after", "rank"], "rows")
    return shared.unionByName(hot.select("key", "phrase", "at"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans): for rows by row_key() the parts [start, end) of bytes covered by windows that are elsewhere too, not merged.

    Rows that repeat count as occurrences, but have one set of parts, which is no longer than a text has phrases.
    """
    again = stage(parse(docs, only_after=True).groupBy("after").count().where("count > 1"), "again")
    occurrences = stage(_found_again(parse(docs, only_after=False), again), "occurrences")
    dictionary = occurrences.groupBy("after", "whole").agg(F.count("*").alias("count"), F.min(F.struct("key", "place")).alias("of"))
    dictionary = stage(dictionary.select("after", "whole", "count", "of.*"), "dictionary")

    first, starts = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(1023)
    several = dictionary.where("count > 1").select("after", "whole", F.col("count").alias("n"))
    whole = join_counted(occurrences, several, ["after", "whole"]).select("key", first.alias("start"), (first + starts + WINDOW - 1).alias("end"))

    # Entries found once, and the entries they may share windows with: each once, however often it occurs.
    by_after = dictionary.groupBy("after").agg(F.count("*").alias("entries"), F.min("count").alias("least")).where("entries > 1 and least = 1")
    open_ = stage(join_counted(dictionary, stage(by_after, "by-after"), ["after"], "entries"), "open")
    shared = _shared_windows(docs, open_)
    parts = shared.groupBy("key", "phrase").agg(F.min("at").alias("start"), (F.max("at") + WINDOW).alias("end"))
    spans = whole.union(parts.select("key", "start", "end"))
    return stage(spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs; parts that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept binary, the bytes left. Columns of these names are replaced.

    Null or empty text: 0 bytes, nothing removed. Long texts are hashed in overlapping blocks of 4 MB. Repeated rows: each is elsewhere for the other, so both lose what
    is 400 bytes or longer. Ties do not arise: a window is elsewhere or not. Null doc_id: like another. Empty table: empty result. Other columns pass through.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "_text_key", "_spans")
    spans = repeated_spans(docs).select(F.col("key").alias("_text_key"), F.col("spans").alias("_spans"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    joined = docs.withColumn("_text_key", row_key()).join(spans, "_text_key", "left").drop("_text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "_spans"))
            more: list[list] = [[], [], [], []]
            for text, s in zip(texts, own, strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                gone = merged(s or [])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                for column, x in zip(more, (sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), left if keep_text else None), strict=True):
                    column.append(x)
            columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if c != "_spans"}
            columns |= {"n_removed": pa.array(more[0], pa.int64()), "n_spans": pa.array(more[1], pa.int64()), "kept_sha256": pa.array(more[2], pa.string()), "kept": pa.array(more[3], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = joined.withColumn("n_bytes", n_bytes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_spans")
    out = rows.mapInArrow(run, f"{schema}, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def op4(spark, sf_dir: str) -> DataFrame:
    """Repeated strings of all documents; nulls, empty and long texts, ties and repeats as in without_repeats()."""
    got = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
