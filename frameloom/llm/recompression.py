"""Removal of word windows that stand in an earlier document too, by recompression.

Names. A text is a sequence of symbols, first its words. A round turns each maximal run of one symbol into a symbol named by (symbol, count), then each
pair of a left and a right symbol, as a hash of their names and the round divides them, into a symbol named by the two. A name depends on what it
stands for alone, so it is the same in all texts and tasks. Beside its place each symbol has its context: the words
that decide that it stands there. That are its own, and those by which its neighbours ended runs or were paired otherwise.

Anchors. A window of WINDOW words holds symbols whose context lies within it. Equal windows hold the same ones at the same places, whatever surrounds
them. Of those of the highest round there is one with the least hash, the window's anchor; words are their own context, so there always is one.
Neighbouring windows with one anchor are a phrase, of some ten windows in ordinary text.

Rounds on Spark. First anchors are counted: text that is found once has anchors found in one document only, and goes. Then the phrases that are left: of
equal phrases those that are not in the first document are repeats as a whole, all windows at once. What remains are phrases with an anchor of other phrases too,
at the edges of repeated passages: their windows are compared one by one, by fingerprints of their words that are independent of the names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_ROWS, free, in_parts, join_counted, set_aside, stage, table, words
from .suffix_dedup import Hashes
from .token_store import mixed

#: Words of a window, at most 63.
WINDOW = 50
#: Rounds of runs and pairs; a round makes symbols a third longer. More rounds make anchors rarer in text that is not shared, fewer make phrases longer.
ROUNDS = 4
#: Words parsed at once; longer texts are parsed in parts that overlap. Bytes of texts that are turned into words at once, about.
BLOCK, BYTES = 1 << 17, 1 << 20
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LAST_ID = (1 << 63) - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number) of words in texts that lie one after the other; number: words before each text, and of all."""
    is_word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = is_word & edge[:-1], is_word & edge[1:]
    begins[1:] |= is_word[1:] & ~is_word[:-1]
    ends[:-1] |= is_word[:-1] & ~is_word[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


class Sums:
    """Fingerprints of any part of a sequence of names."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)
    BASE = 0xC2B2AE3D27D4EB4F

    def __init__(self, names: np.ndarray):
        if len(self.up) <= len(names):
            n = 1 << len(names).bit_length()
            with np.errstate(over="ignore"):
                Sums.up, Sums.down = (np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        with np.errstate(over="ignore"):
            self.sums = np.append(np.uint64(0), np.cumsum(names * self.up[: len(names)], dtype=np.uint64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start], 7)


class Symbols:
    """A sequence of symbols: names, first word and end, first word of the context and its end. wall: symbols between texts, which join nothing."""

    def __init__(self, name, start, end, low, high, wall):
        self.name, self.start, self.end, self.low, self.high, self.wall = name, start, end, low, high, wall

    @classmethod
    def of_words(cls, names: np.ndarray, wall: np.ndarray) -> "Symbols":
        at = np.arange(len(names))
        return cls(names, at, at + 1, at, at + 1, wall)

    def runs(self) -> "Symbols":
        """Each maximal run as one symbol. That a symbol's run ends beside it is known by the neighbours."""
        first = np.flatnonzero(np.append(True, (self.name[1:] != self.name[:-1]) | self.wall[1:] | self.wall[:-1]))
        count = np.diff(np.append(first, len(self.name)))
        last = first + count - 1
        name = self.name[first]
        many = count > 1
        name[many] = mixed(mixed(name[many], 11) ^ count[many].astype(np.uint64), 12)
        low, high = self.low[np.maximum(first - 1, 0)], self.high[np.minimum(last + 1, len(self.name) - 1)]
        return Symbols(name, self.start[first], self.end[last], low, high, self.wall[first])

    def pairs(self, turn: int) -> "Symbols":
        """Each left symbol with a right one after it as one symbol. What stays alone is known by the side on which it looked for a partner."""
        right = (mixed(self.name, 20 + turn) >> np.uint64(63)).astype(bool)
        joins = np.append(~right[:-1] & right[1:] & ~self.wall[:-1] & ~self.wall[1:], False)
        left = np.flatnonzero(np.append(True, ~joins[:-1]))
        pair = joins[left]
        second = left + pair
        name = self.name[left]
        with np.errstate(over="ignore"):
            name[pair] = mixed(mixed(name[pair], 13) * np.uint64(3) ^ self.name[left[pair] + 1], 14)
        alone_left, alone_right = ~pair & ~right[left], ~pair & right[left]
        low = np.where(alone_right, self.low[np.maximum(left - 1, 0)], self.low[left])
        high = np.where(alone_left, self.high[np.minimum(left + 1, len(self.name) - 1)], self.high[second])
        return Symbols(name, self.start[left], self.end[second], low, high, self.wall[left])


def levels(names: np.ndarray, wall: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols before the first and after each round."""
    out = [Symbols.of_words(names, wall)]
    for turn in range(rounds):
        out.append(out[-1].runs().pairs(turn))
    return out


def anchors(names: np.ndarray, wall: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, name of the anchor, which occurrence it is) of each window without a wall."""
    at = np.cumsum(np.append(0, wall))
    windows = np.flatnonzero(at[window:] == at[:-window]) if len(wall) >= window else np.zeros(0, np.int64)
    name, which, open_ = np.zeros(len(windows), np.uint64), np.full(len(windows), -1), np.arange(len(windows))
    made = levels(names, wall, rounds)
    for level in range(rounds, -1, -1):
        x = made[level]
        a, b = np.searchsorted(x.low, windows[open_]), np.searchsorted(x.high, windows[open_] + window, side="right") - 1
        has = a <= b
        a, b, found = a[has], b[has], open_[has]
        if len(found):
            own = mixed(x.name, 40 + level)
            least = [(own & np.uint64((1 << 64) - (1 << 20))) | np.arange(len(own)).astype(np.uint64)]  # of equal hashes the first
            best = np.zeros(len(found), np.uint64)
            power = np.frexp(b - a + 1)[1] - 1  # the length's power of 2
            for k in range(int(power.max()) + 1):
                now = power == k
                best[now] = np.minimum(least[k][a[now]], least[k][b[now] - (1 << k) + 1])
                least.append(np.minimum(least[k][: -(1 << k)], least[k][1 << k :]))
            symbol = (best & np.uint64((1 << 20) - 1)).astype(np.int64)
            name[found], which[found] = own[symbol], x.start[symbol] * (rounds + 1) + level
        open_ = open_[~has]
        if not len(open_):
            break
    return windows, name, which


def phrases(names: np.ndarray, proof: np.ndarray, wall: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, anchor, fingerprint of all words) of each phrase. proof: names of the words by another hash."""
    windows, name, which = anchors(names, wall, window)
    new = np.append(True, (np.diff(which) != 0) | (np.diff(windows) != 1))[: len(windows)]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(windows)))
    first = windows[begin]
    whole = mixed(Sums(proof).of(first, first + count + window - 1) ^ count.astype(np.uint64), 8)
    return first, count, name[begin], whole


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bytes, offsets) of the texts of a column, some BYTES at a time; null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BYTES, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _named(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words by two hashes, and the number of words before each text."""
    start, end, number = word_spans(data, offsets)
    return Hashes(data, 0).of(start, end), Hashes(data, 1).of(start, end), number


def _parts(number: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, first word, end) with BLOCK words or little more; a text's parts overlap so that each window is in one of them."""
    out, size = [], 0
    for text in np.flatnonzero(np.diff(number) >= window).tolist():
        a, b = int(number[text]), int(number[text + 1])
        for at in range(a, b - window + 1, BLOCK):
            out.append((text, at, min(b, at + BLOCK + window - 1)))
            size += out[-1][2] - at
            if size >= BLOCK:
                yield out
                out, size = [], 0
    if out:
        yield out


def row_key() -> Column:
    """What equal rows share; beside a doc_id it tells texts apart."""
    return F.xxhash64("doc_id", "text").alias("key")


def _order() -> Column:
    """The order of documents: by doc_id, null last."""
    return F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id")


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, key, anchor, whole, place) of each phrase; place is 64 * first word + number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, offsets in _texts(batch.column(2)):
                names, proof, number = _named(data, offsets)
                for parts in _parts(number, window):
                    at = np.cumsum([1, *(b - a + 1 for _, a, b in parts)])  # a wall before each part and after the last
                    own, two, wall = np.zeros(at[-1], np.uint64), np.zeros(at[-1], np.uint64), np.zeros(at[-1], bool)
                    wall[at - 1] = True
                    for (_, a, b), to in zip(parts, at, strict=False):
                        own[to : to + b - a], two[to : to + b - a] = names[a:b], proof[a:b]
                    first, count, anchor, whole = phrases(own, two, wall, window)
                    part = np.searchsorted(at, first, side="right") - 1
                    text = np.array([t for t, _, _ in parts])[part]
                    word = first - at[part] + np.array([a for _, a, _ in parts])[part] - number[text]
                    columns = [ids[row + text], keys[row + text], anchor.view(np.int64), whole.view(np.int64), word * 64 + count]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "key", "anchor", "whole", "place"])

    return docs.select(_order(), row_key(), "text").mapInArrow(run, "id long, key long, anchor long, whole long, place long")


def _edge_windows(docs: DataFrame, open_: DataFrame, window: int) -> DataFrame:
    """(anchor, id, tag, rank, many): the windows of the open phrases (anchor, entry, id, key, place, many); tag: 64 * entry + place after the phrase's first, rank: a fingerprint."""
    listed = open_.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "entry", "place", "many")).alias("open"))  # of one text
    texts = docs.select(_order(), row_key(), "text").join(listed, ["id", "key"]).dropDuplicates(["id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for row, data, offsets in _texts(batch.column(1)):
                names, proof, number = _named(data, offsets)
                one, two = Sums(names), Sums(proof)
                for k in range(len(offsets) - 1):
                    anchor, entry, place = (lists[row + k].values.field(c).to_numpy() for c in ("anchor", "entry", "place"))
                    many = lists[row + k].values.field("many").to_numpy(zero_copy_only=False)
                    count, first = place & 63, (place >> 6) + number[k]
                    of = np.repeat(np.arange(len(count)), count)
                    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                    start = first[of] + at
                    rank = mixed(one.of(start, start + window) ^ mixed(two.of(start, start + window), 9), 10).view(np.int64)
                    columns = [pa.array(c, pa.int64()) for c in (anchor[of], np.full(len(of), ids[row + k]), entry[of] * 64 + at, rank)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(many[of], pa.bool_())], names=["anchor", "id", "tag", "rank", "many"])

    return texts.select("id", "text", "open").mapInArrow(run, "anchor long, id long, tag long, rank long, many boolean")


def earlier_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, key, phrases): for each text with windows that are in an earlier document its phrases (place, bits), where bit k is the k-th window of the phrase."""
    parsed = stage(parse(docs, window), "phrases")

    # First round: symbols. An anchor of one document has no window elsewhere.
    names = parsed.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    several = stage(names.where("least < most").select("anchor", "n"), "anchors")
    found = stage(join_counted(parsed, several, ["anchor"]).drop("n"), "shared-phrases")
    free(parsed, several)

    # Second round: phrases. Of equal ones all but those of the first document are repeats.
    entries = found.groupBy("anchor", "whole").agg(F.min(F.struct("id", "key", "place")).alias("of"), F.count("*").alias("n"))
    entries = stage(entries.select("anchor", "whole", "n", F.col("of.id").alias("owner"), F.col("of.key").alias("key"), F.col("of.place").alias("place")), "entries")

    # Third round: windows of phrases whose anchor is in other phrases too.
    by_anchor = stage(entries.groupBy("anchor").agg(F.count("*").alias("n"), F.min("owner").alias("first"), F.max("owner").alias("last")).where("n > 1 and first < last"), "open-anchors")
    open_ = join_counted(entries.drop("n"), by_anchor, ["anchor"]).select("anchor", "whole", F.col("owner").alias("id"), "key", "place", (F.col("n") >= HOT_ROWS).alias("many"))
    open_ = stage(open_.withColumn("entry", F.monotonically_increasing_id()), "open-phrases")
    windows = _edge_windows(docs, open_, window)
    staged = []
    # A window of an anchor with few phrases is a few rows; of others the counts add up before a shuffle, and hot ones are broadcast.
    least = F.min("id").over(W.partitionBy("anchor", "rank"))
    if open_.where("many").isEmpty():
        again = windows.drop("many").withColumn("least", least)
    else:
        windows = stage(windows, "windows")
        hot = windows.where("many").drop("many")
        ranks = hot.groupBy("anchor", "rank").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
        ranks = stage(ranks.where("least < most").drop("most"), "ranks")
        again = windows.where("not many").drop("many").withColumn("least", least).unionByName(join_counted(hot, ranks, ["anchor", "rank"]).drop("n"))
        staged = [windows, ranks]
    bit = F.expr("shiftleft(1L, cast(tag & 63 as int))")
    edges = again.where("least < id").groupBy(F.shiftright("tag", 6).alias("entry")).agg(F.bit_or(bit).alias("bits"))
    edges = open_.select("entry", "anchor", "whole").join(edges, "entry").drop("entry")

    all_ = F.expr("shiftleft(1L, cast(place & 63 as int)) - 1")
    repeated = entries.join(edges, ["anchor", "whole"], "left").select("anchor", "whole", "n", "owner", F.coalesce("bits", F.lit(0)).alias("bits"))
    repeated = stage(repeated.where("n > 1 or bits <> 0"), "repeated")
    free(entries, by_anchor, open_, *staged)
    placed = join_counted(found, repeated, ["anchor", "whole"]).select("id", "key", "place", F.when(F.col("owner") < F.col("id"), all_).otherwise(F.col("bits")).alias("bits"))
    placed = placed.where("bits <> 0").groupBy("id", "key", "place").agg(F.bit_or("bits").alias("bits"))  # rows that repeat are one
    out = stage(placed.groupBy("id", "key").agg(F.collect_list(F.struct("place", "bits")).alias("phrases")), "earlier-windows")
    free(found, repeated)
    return out


def covered(n_words: int, place: np.ndarray, bits: np.ndarray, window: int) -> np.ndarray:
    """Which words stand in a window that the phrases mark."""
    phrase, at = np.nonzero(bits[:, None] >> np.arange(63) & 1)
    start = (place >> 6)[phrase] + at
    change = np.zeros(n_words + window + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + window, -1)
    return np.cumsum(change)[:n_words] > 0


def without_earlier_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed, kept (the words left, joined by a space) and kept_sha256. Columns of these names are replaced.

    A word is removed if it stands in a window of `window` consecutive words (63 at most) whose words are also, in this order, in a document of a smaller
    doc_id. Windows are judged on the input.

    Null, empty or blank text: 0 words. Texts of fewer words than a window lose nothing. Long texts are parsed in overlapping parts of BLOCK words. Rows of one
    doc_id are one document: what they share stays; rows that repeat have the same result. A null doc_id counts as the largest, so such rows
    lose what others hold, and not what they share. Empty table: empty result. Other columns pass through.
    """
    if not 1 < window < 64:
        raise ValueError("a phrase's windows are the bits of a long: 2 to 63 words")
    docs = docs.drop("n_words", "n_removed", "kept", "kept_sha256")
    aside, names = set_aside(docs, "doc_id", "text")
    marks = earlier_windows(aside, window).select("id", "key", F.col("phrases").alias("_phrases"))
    joined = aside.select(*aside.columns, _order(), row_key()).join(marks, ["id", "key"], "left").select(*aside.columns, "_phrases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts([whole])):
            marked, more = batch.column(batch.schema.get_field_index("_phrases")), [[], [], [], []]
            for k, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                own = words(text)
                left = own
                if marked[k].is_valid:
                    place, bits = (marked[k].values.field(c).to_numpy() for c in ("place", "bits"))
                    left = [w for w, gone in zip(own, covered(len(own), place, bits, window).tolist(), strict=True) if not gone]
                kept = b" ".join(left)
                for column, x in zip(more, (len(own), len(own) - len(left), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(x)
            columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if c != "_phrases"}
            columns |= {"n_words": pa.array(more[0], pa.int64()), "n_removed": pa.array(more[1], pa.int64()), "kept": pa.array(more[2], pa.binary()).cast(pa.string()), "kept_sha256": pa.array(more[3], pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aside.schema)
    out = joined.mapInArrow(run, f"{schema}, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumnsRenamed({n: c for c, n in names.items() if c != n})


def op13(spark, sf_dir: str) -> DataFrame:
    """Windows of 50 words of all documents; nulls, empty and long texts, ties and repeats as in without_earlier_windows()."""
    got = without_earlier_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
bad AS (
  SELECT doc_id, i FROM starts JOIN (SELECT h, min(doc_id) AS least FROM starts GROUP BY h) USING (h) WHERE least < doc_id),
marked AS (
  SELECT p.doc_id, p.i, p.word, count(bad.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w) p LEFT JOIN bad ON p.doc_id = bad.doc_id AND p.i = bad.i)
SELECT w.doc_id, len(w.ws) AS n_words, count(*) FILTER (m.gone) AS n_removed, sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (NOT m.gone), '')) AS kept_sha256
FROM w LEFT JOIN marked m ON w.doc_id = m.doc_id GROUP BY w.doc_id, len(w.ws)
"""
