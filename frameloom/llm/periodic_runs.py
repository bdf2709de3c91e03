"""Periodic runs of words in each text, by a suffix automaton with end positions merged from small sets into large ones.

A run is a stretch of words that repeats with a smallest period, at least `exponent` periods long, and that no neighbouring word
extends. Let a run have period q and length L >= e * q. Its part without the last period, L - q words, ends at two places that are q apart.
In the automaton these are two end positions of one state, next to each other there (a nearer one would be a smaller
period), and they come together for the first time in the state whose longest string is what the two prefixes have
in common as suffix: exactly those L - q words, since nothing to the left of the run fits. So after the sets of a state's children are
merged, each new pair of neighbours at a distance d with (e - 1) * d <= the state's length is the seed of a run with period d, which
starts where that string starts; for e = 2 that are squares. Seeds of one start and period belong to one run; the furthest is its end.

Stretches. All words of a run stand in some window of GRAM words that is found again within a quarter (1 / e) of the stretch of such windows.
Only stretches that can be so are given to an automaton; in prose that is little. The narrowing is by counts of windows, and exact.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, in_parts, set_aside, table, words

#: Words of the windows by which stretches are narrowed: a run of 6 words and 4 periods has each of its windows twice or more.
GRAM = 3
#: End positions in one list; larger sets are lists of lists, so that an insertion moves no more than this.
BLOCK = 1024

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Ends:
    """An ordered set of numbers with insertion and neighbours, in blocks of bounded length."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, one: int):
        self.blocks, self.firsts, self.size = [[one]], [one], 1

    def _block(self, x: int) -> int:
        return max(0, bisect_left(self.firsts, x + 1) - 1)

    def add(self, x: int) -> None:
        k = self._block(x) if len(self.blocks) > 1 else 0
        block = self.blocks[k]
        insort(block, x)
        self.firsts[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(k + 1, block[half:])
            self.firsts.insert(k + 1, block[half])
            del block[half:]

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours of x, which is in the set."""
        k = self._block(x) if len(self.blocks) > 1 else 0
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else (self.blocks[k - 1][-1] if k else None)
        after = block[at + 1] if at + 1 < len(block) else (self.firsts[k + 1] if k + 1 < len(self.blocks) else None)
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length of the longest string, suffix link, first end position or -1 for a clone) of each state; state 0 is the root."""
    length, link, end, moves = [0], [-1], [-1], [{}]
    last = 0
    for at, x in enumerate(symbols):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(at)
        moves.append({})
        p = last
        while p >= 0 and x not in moves[p]:
            moves[p][x] = new
            p = link[p]
        if p >= 0:
            q = moves[p][x]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(x) == q:
                    moves[p][x] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def runs_of(symbols: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` symbols and `exponent` periods, by start, then period."""
    if len(symbols) < max(least, exponent):
        return []
    length, link, end = automaton(symbols)
    ends: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    children: list[list[int]] = [[] for _ in length]
    order = sorted(range(1, len(length)), key=length.__getitem__, reverse=True)
    for state in order:
        children[link[state]].append(state)
    furthest: dict[tuple[int, int], int] = {}
    for state in order:
        if length[state] < exponent - 1:  # no distance is short enough here or nearer to the root
            break
        if not children[state]:
            continue
        sets = [s for s in (ends[state], *(ends[c] for c in children[state])) if s is not None]
        big = max(sets, key=lambda s: s.size)
        new = {x: k for k, s in enumerate(sets) if s is not big for x in s}
        for c in children[state]:
            ends[c] = None
        for x in new:
            big.add(x)
        ends[state] = big
        most, reach = length[state] // (exponent - 1), length[state]
        for x, own in new.items():
            before, after = big.around(x)
            for other in (before, after):  # neighbours of one child have met before
                if other is not None and abs(x - other) <= most and new.get(other) != own:
                    a, b = min(x, other), max(x, other)
                    key = (a - reach + 1, b - a)
                    if furthest.get(key, -1) < b:
                        furthest[key] = b
    return sorted((s, e - s + 1, d) for (s, d), e in furthest.items() if e - s + 1 >= least)


def stretches(symbols: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """[start, end) of disjoint stretches that hold every run whole.

    In a run of L >= exponent * q words each window of GRAM words is found again q words on or back, within the run. So the run
    lies in a stretch of R words all of whose windows have an equal one at most R / exponent words away. Stretches are cut where that
    fails until it holds throughout.
    """
    n, shortest = len(symbols), max(least, GRAM)
    if n < shortest:
        return []
    grams, high = symbols[: n - GRAM + 1].astype(np.int64), int(symbols.max()) + 1
    for k in range(1, GRAM):  # names of windows of 2, 3 ... words
        if high**GRAM > 1 << 62:
            grams = np.unique(grams, return_inverse=True)[1]
        grams = grams * high + symbols[k : n - GRAM + 1 + k]
    order = np.argsort(grams, kind="stable")
    gaps = np.where(np.diff(grams[order]) == 0, np.diff(order), n)
    near = np.full(len(grams), n)
    near[order[1:]] = gaps
    near[order[:-1]] = np.minimum(near[order[:-1]], gaps)
    found, open_ = [], [(0, len(near))]
    while open_:
        a, b = open_.pop()
        size = b - a + GRAM - 1
        if size < shortest:
            continue
        good = np.concatenate([[False], near[a:b] <= size // exponent, [False]])
        edges = np.flatnonzero(good[1:] != good[:-1]) + a
        starts, stops = edges[::2], edges[1::2]
        if len(starts) == 1 and stops[0] - starts[0] == b - a:
            found.append((a, b + GRAM - 1))
        else:
            long_ = stops - starts + GRAM - 1 >= shortest
            open_ += zip(starts[long_].tolist(), stops[long_].tolist(), strict=True)
    return sorted(found)


def periodic_runs_of(text: list[bytes], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    names: dict[bytes, int] = {}
    symbols = np.fromiter((names.setdefault(w, len(names)) for w in text), np.int64, len(text))
    return sorted((a + s, n, q) for a, b in stretches(symbols, least, exponent) for s, n, q in runs_of(symbols[a:b].tolist(), least, exponent))


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of all runs' parts after their first period."""
    gone = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, x in zip(text, np.cumsum(gone).tolist(), strict=False) if not x]


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """docs with n_words long, runs array<struct<start, length, period>> (by start, then period) and collapsed string, the kept words joined by a space.

    A run has at least `least` words (more than GRAM) and `exponent` periods (3 or more). A word is dropped if it stands in a run after that run's first period.

    Null, empty or blank text: no words, no runs, collapsed is "". Long texts are taken whole; a task's memory grows with its longest periodic stretch, about 1 kB a
    word. Each row is a result of its own: repeated rows and rows with one or no doc_id do not touch each other. Empty table: empty result. Other columns pass through; columns
    named n_words, runs or collapsed are replaced.
    """
    if least <= GRAM or exponent < 3:
        raise ValueError(f"runs of {GRAM} words or fewer, or of fewer than 3 periods, are not narrowed exactly")
    docs = docs.drop("n_words", "runs", "collapsed")
    aside, names = set_aside(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            more: list[list] = [[], [], []]
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                own = words(text)
                runs = periodic_runs_of(own, least, exponent)
                for column, x in zip(more, (len(own), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(collapsed(own, runs))), strict=True):
                    column.append(x)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns |= {"n_words": pa.array(more[0], pa.int64()), "runs": pa.array(more[1], kind), "collapsed": pa.array(more[2], pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aside.schema)
    out = aside.mapInArrow(run, f"{schema}, n_words long, runs array<{RUN}>, collapsed string")
    return out.withColumnsRenamed({n: c for c, n in names.items() if c != n})


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text); where crc32(doc_id) % 10 is 0, the text's words from a on repeat with period p (both by the crc). A null doc_id leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10).cast("long")))
    docs = docs.withColumn("_own", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    docs = docs.withColumn("_n", F.greatest(F.size("_own"), F.lit(1)))
    docs = docs.withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
    left = F.col("_n") - F.col("_a")
    docs = docs.withColumn("_p", (1 + F.floor(left / (3 + F.col("_g") % 8))).cast("int"))
    period = F.slice("_own", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("_p")).cast("int"))), F.lit(1), left)
    new = F.array_join(F.concat(F.slice("_own", F.lit(1), F.col("_a")), tail), " ")
    return docs.withColumn("text", F.when(F.size("_own") > 0, new).otherwise(F.col("text"))).select("doc_id", "text")


def longest_first(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones that of the smallest start, then period. Null without runs."""
    better = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    first = F.when(F.size(runs) > 0, F.try_element_at(runs, F.lit(1)))
    return F.aggregate(runs, first, lambda a, x: F.when(better(a, x), x).otherwise(a))


def op11(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them with periodic tails of their own; nulls, empty and long texts and repeats as in periodic_runs()."""
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs).withColumn("best", longest_first(F.col("runs")))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

