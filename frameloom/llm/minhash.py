"""MinHash near-duplicates as a chosen-path set similarity join.

A document is the set of its word shingles, known by a signature of VALUES minwise tokens. In each of several independent
trees it takes a path from the root: at a node the path chooses a place of the signature, and documents branch by the
minwise token that they have there. So sets of similarity s share a branch with probability s, and a path of k branches with s^k.

The first levels, where any node is large, are taken at once. Below, a node is split again as long as it holds many documents that
are not yet linked with its least one's component; there a document takes 1 / threshold branches on average, so that a pair at the
threshold has one common branch on average, however deep the recursion goes. What is small is compared exhaustively: members first
by their signatures, then, those that have a partner, by their full sets. No candidate is dropped: a node at the last level is compared
whatever its size, in blocks. Before that each document meets the least one of each of its nodes, which joins most
of a group of near copies at a comparison each, and then one by hash, another in each node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import free, in_parts, join_counted, size_bounded, stage, table
from .graph import components
from .token_store import mixed

#: A pair at the threshold is missed by all trees with this probability, before any splitting.
MISS = 1e-5
#: Similarity of unrelated documents that the first levels allow for: below them, a document meets one other by chance.
CHANCE = 0.03
#: Minwise tokens of a signature.
VALUES = 128
#: Members outside its least one's component up to which a node is compared, and levels of splitting below the first ones.
SMALL, LEVELS = 1024, 24
#: Members of a node that one comparison of signatures takes; of full sets; and shingles in one product.
SIGNED, BLOCK, COLUMNS = 4096, 256, 8192
#: Ids that a broadcast may hold (8 bytes each); above, the join shuffles.
BROADCAST_IDS = 1_000_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """The set of hashed shingles of `size` words, A-Z lower-cased; with fewer words the whole sequence, with none empty."""
    got = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not got:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxh3_64_intdigest, got)), np.uint64)
    n = min(size, len(h))
    out = mixed(h[: len(h) - n + 1], 20 + n)
    for k in range(1, n):
        out = mixed(out ^ h[k : len(h) - n + 1 + k], 20 + k)
    return np.unique(out)


def agreement(threshold: float) -> list[float]:
    """Chances that sets at the threshold agree in 0, 1, .. VALUES places of their signatures."""
    f, p, q = math.lgamma, math.log(threshold), math.log(max(1e-300, 1 - threshold))
    return [math.exp(f(VALUES + 1) - f(k + 1) - f(VALUES - k + 1) + k * p + (VALUES - k) * q) for k in range(VALUES + 1)]


def shape(n: int, threshold: float) -> tuple[int, int, int]:
    """First levels, number of trees, and places in which signatures of similar sets agree at least, for n sets.

    Few chance meetings below the first levels; misses by trees and by signatures below MISS each.
    """
    depth = max(2, math.ceil(math.log(max(n, 2)) / math.log(1 / CHANCE)))
    of = agreement(threshold)
    trees = 1
    while sum(p * (1 - (k / VALUES) ** depth) ** trees for k, p in enumerate(of)) > MISS and trees < 1000:
        trees += 1
    cut = 0
    while sum(of[: cut + 1]) <= MISS:
        cut += 1
    return depth, trees, cut


@lru_cache
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The minwise token of a set under each of VALUES hashes, as 32-bit numbers; in bounded memory for long texts."""
    a, b = _hashes()
    folded, out = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32), np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 1024):
        x = folded[at : at + 1024, None] ^ b
        x *= a
        np.minimum(out, x.min(axis=0), out=out)
    return out


def signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A binary column of signatures as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def branched(key: np.ndarray, signed: np.ndarray, salt: int = 0) -> np.ndarray:
    """The node below key (one for each row of signed) by the token at the place that key chooses."""
    place = (mixed(key, 40 + salt) % np.uint64(VALUES)).astype(np.intp)
    return mixed(key ^ signed[np.arange(len(key)), place].astype(np.uint64), 50 + salt)


def paths(reps: DataFrame, trees: int, depth: int) -> DataFrame:
    """(id, key): the node of each set in each tree below the first levels. reps: (id, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                signed, ids = signatures(part.column(1)), part.column(0).to_numpy()
                for tree in range(trees):
                    key = mixed(np.full(len(part), tree, np.uint64), 39)
                    for _ in range(depth):
                        key = branched(key, signed)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.view(np.int64))], names=["id", "key"])

    return reps.select("id", "sig").mapInArrow(run, "id long, key long")


def split_nodes(at: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """(key, id, comp) one level down. at: (key, id, comp). A node's path decides whether its members take one branch or two."""
    second = int((1 / threshold - 1) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, signed = batch.column(0).to_numpy().view(np.uint64), signatures(batch.column(3))
            twice = mixed(key, 60) % np.uint64(1_000_000) < np.uint64(second)
            keys = np.concatenate([branched(key, signed), branched(key, signed, 1)[twice]])
            rows = np.concatenate([np.arange(len(key)), np.flatnonzero(twice)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(k).take(pa.array(rows)) for k in (1, 2))], names=["key", "id", "comp"])

    return at.join(sigs, "id").select("key", "id", "comp", "sig").mapInArrow(run, "key long, id long, comp long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def fingerprint(s: np.ndarray) -> bytes | None:
    return xxh3_128_digest(s.tobytes()) if len(s) else None


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set binary, sig binary): size, fingerprint and signature of each document's set; null ones for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            n, prints, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                prints.append(fingerprint(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set binary, sig binary")


def agreeing(pairs: DataFrame, sigs: DataFrame, cut: int) -> DataFrame:
    """The pairs (x, y) whose signatures agree in cut places or more. Many x may have one y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (signatures(batch.column(2)) == signatures(batch.column(3))).sum(axis=1) >= cut
            yield batch.select([0, 1]).filter(pa.array(same))

    y = pairs.groupBy("y").agg(F.count("*").alias("n")).join(sigs.select(F.col("id").alias("y"), F.col("sig").alias("sy")), "y")
    both = join_counted(pairs, stage(y, "pivots"), ["y"]).join(sigs.select(F.col("id").alias("x"), F.col("sig").alias("sx")), "x")
    return both.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar, as links (a, b). texts: (id, z), compressed texts of all ids in pairs.

    Pairs come sorted by y, and a worker keeps the last set of y, so the many partners of one document cost
    its shingling once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()

        @lru_cache(maxsize=4)
        def of(z: bytes) -> np.ndarray:
            return shingles(unzip.decompress(z).decode("utf-8", "surrogatepass"), size)

        for batch in in_parts(batches):
            x, y, zx, zy = (batch.column(k).to_pylist() for k in range(4))
            keep = [similar(shingles(unzip.decompress(p).decode("utf-8", "surrogatepass"), size), of(q), percent) for p, q in zip(zx, zy, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = texts.select(F.col("id").alias("x"), F.col("z").alias("zx"))
    y = texts.select(F.col("id").alias("y"), F.col("z").alias("zy"))
    both = pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", "zx", "zy")
    return both.mapInArrow(run, "a long, b long").distinct()


def compressed(docs: DataFrame, size: int | None = None) -> DataFrame:
    """(id, z) from (doc_id, text); with a size also set, the fingerprint of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in in_parts(batches):
            texts = batch.column(1).to_pylist()
            z = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            columns = {"id": batch.column(0), "z": pa.array(z, pa.binary())}
            if size is not None:
                columns["set"] = pa.array([fingerprint(shingles(t, size)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    more = "" if size is None else ", set binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"id long, z binary{more}")


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y, exactly, by products of 0/1 matrices."""
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)  # whole numbers below 2^24
    places = []
    for sets in (x, y):
        row, of = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, of), max(0, len(both) - 1))
        hit = both[at] == of if len(both) else np.zeros(len(of), bool)
        places.append((row[hit], at[hit]))
    for low in range(0, len(both), COLUMNS):
        m = []
        for sets, (row, at) in zip((x, y), places, strict=True):
            part = np.zeros((len(sets), min(COLUMNS, len(both) - low)), np.float32)
            own = (at >= low) & (at < low + COLUMNS)
            part[row[own], at[own] - low] = 1
            m.append(part)
        out += m[0] @ m[1].T
    return out


def spanning(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of pairs that are enough to join all that the pairs (x[k], y[k]) join."""
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    keep = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            keep.append(k)
    return keep


def _blocks(at: DataFrame, x_size: int, y_size: int) -> DataFrame:
    """at (key, id, comp, low, m, u) as rows (key, xb, yb, id, comp, left): the u members outside the component low against all m.

    Both sides are dealt by hash into blocks, a task for each pair of blocks, so a node of any size is dealt out.
    """
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    deal = lambda n, size: F.pmod(F.xxhash64("id"), blocks(n, size)).cast("int")
    each = lambda n, size: F.explode(F.sequence(F.lit(0), blocks(n, size) - 1))
    x = at.where("comp <> low").select("key", deal("u", x_size).alias("xb"), each("m", y_size).alias("yb"), "id", "comp", F.lit(True).alias("left"))
    y = at.select("key", each("u", x_size).alias("xb"), deal("m", y_size).alias("yb"), "id", "comp", F.lit(False).alias("left"))
    return x.union(y)


_SIDES = "key long, xb int, yb int, id long, comp long, left boolean"


def partnered(at: DataFrame, sigs: DataFrame, cut: int) -> DataFrame:
    """The members of nodes that have a partner of another component by their signatures, as rows of _SIDES. No pair is a row."""

    def run(rows: pa.Table) -> pa.Table:
        left, right = rows.filter(rows["left"]), rows.filter(pc.invert(rows["left"]))
        if not len(left) or not len(right):
            return rows.slice(0, 0).drop_columns("sig")
        sx, sy, cx, cy = signatures(left["sig"]), signatures(right["sig"]), left["comp"].to_numpy(), right["comp"].to_numpy()
        of_x, of_y = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for k in range(len(left)):
            hit = ((sy == sx[k]).sum(axis=1) >= cut) & (cy != cx[k])
            of_x[k] = hit.any()
            of_y |= hit
        return pa.concat_tables([left.filter(pa.array(of_x)), right.filter(pa.array(of_y))]).drop_columns("sig")

    return _blocks(at, SIGNED, SIGNED).join(sigs, "id").select("key", "xb", "yb", "id", "comp", "left", "sig").groupBy("key", "xb", "yb").applyInArrow(run, _SIDES)


def compared(sides: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components, by full sets. sides: rows of partnered().

    A block's members meet in sub-blocks of BLOCK; inside, all intersections are one matrix product, and only links that
    join components leave the task.
    """
    none = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        left, right = rows.filter(rows["left"]), rows.filter(pc.invert(rows["left"]))
        unzip, out = zstandard.ZstdDecompressor(), [none.empty_table()]
        sets = lambda t: [shingles(unzip.decompress(z).decode("utf-8", "surrogatepass"), size) for z in t["z"].to_pylist()]
        for i in range(0, len(left), BLOCK):
            x = left.slice(i, BLOCK)
            of_x, cx = sets(x), x["comp"].to_numpy()
            for j in range(0, len(right), BLOCK):
                y = right.slice(j, BLOCK)
                of_y, cy = sets(y), y["comp"].to_numpy()
                both = intersections(of_x, of_y)
                n, m = (np.array([len(s) for s in part]) for part in (of_x, of_y))
                a, b = np.nonzero((100 * both >= percent * (n[:, None] + m[None, :] - both)) & (cx[:, None] != cy[None, :]))
                keep = spanning(cx[a], cy[b])
                out.append(pa.table([pa.array(x["id"].to_numpy()[a[keep]], pa.int64()), pa.array(y["id"].to_numpy()[b[keep]], pa.int64())], schema=none))
        return pa.concat_tables(out)

    return sides.join(texts, "id").groupBy("key", "xb", "yb").applyInArrow(run, "a long, b long").distinct()


def small_nodes(at: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """(key, id, comp, low, m, u): the members of nodes that hold several components, after splitting the large ones.

    at: (key, id, comp), staged. low is a node's least component, m the number of its members and u of those outside low.
    """
    found, level = [], 0
    while True:
        by_comp = at.groupBy("key", "comp").agg(F.count("*").alias("c"))
        stat = by_comp.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("c").alias("m"), F.min_by("c", "comp").alias("own"))
        stat = stage(stat.where("low <> high").select("key", "low", "m", (F.col("m") - F.col("own")).alias("u")), "node-sizes")
        several = stage(join_counted(at, stat, ["key"], "m").select("key", "id", "comp", "low", "m", "u"), "mixed-nodes")
        free(stat, at)
        large = several.where(F.col("u") > SMALL)
        if level == LEVELS or large.isEmpty():
            found.append(several)
            break
        found.append(several.where(F.col("u") <= SMALL))
        at = stage(split_nodes(large, sigs, threshold), "split-nodes")
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id that each document reaches over links of percent/100 or more.

    Null or empty text, or no word: an empty set, linked with nothing. Null doc_id: not linked, component_id null.
    Very long texts: whole, in bounded memory. Rows of one doc_id with several texts are one document with several sets, linked by
    any of them; equal rows count once in the joins and come back as often as they are there. Empty table: empty
    result. Other columns are not read, whatever their names.
    """
    threshold = percent / 100
    depth, trees, cut = shape(docs.count(), threshold)
    base = stage(sets_of(docs, size), "sets")
    usable = base.where("set is not null and doc_id is not null")
    # Equal sets have equal signatures: the least doc_id stands for them. Rows add up before the shuffle.
    reps = usable.groupBy("set").agg(F.min(F.struct("doc_id", "sig")).alias("least"), F.count("*").alias("n"))
    reps = stage(reps.select("set", F.col("least.doc_id").alias("id"), F.col("least.sig").alias("sig"), "n"), "reps")
    sigs = reps.select("id", "sig")
    rows = paths(reps, trees, depth)
    nodes = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.min(F.struct(F.xxhash64("id", "key"), "id"))["id"].alias("other"), F.count("*").alias("n"))
    nodes = nodes.where("pivot <> last").select("key", "pivot", "other", "n")
    met = stage(join_counted(rows, stage(nodes, "met-nodes"), ["key"]).select("key", "id", "pivot", "other"), "met")  # only nodes where documents meet

    several = stage(usable.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set").alias("low"), F.max("set").alias("high")).where("n > 1"), "several")
    # First each with the least document of each of its nodes, as far as their signatures agree.
    pairs = met.where("id <> pivot").select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct()
    near = stage(agreeing(stage(pairs, "star-pairs"), sigs, cut), "near")
    ids = met.select("id").distinct()
    texts = texts_of(docs, _both(near), several, size)
    one = near.groupBy("x").agg(F.min("y").alias("y"))
    links = confirmed(one, texts, size, percent)
    if not several.isEmpty():
        same = stage(_same_document(usable, several, reps), "same")
        links = links.union(same)
        ids = ids.union(same.select("a")).union(same.select("b")).distinct()
    ids = stage(ids, "linked-ids")
    comp = _merged(None, ids, stage(links, "links"))
    # Then with the others of its nodes that are least or chosen by hash, one of each component that is not its own.
    rest = _apart(near, comp).unionByName(_apart(met.where("id <> other").select(F.col("id").alias("x"), F.col("other").alias("y")), comp))
    rest = agreeing(stage(rest.groupBy("x", "cy").agg(F.min("y").alias("y")).select("x", "y"), "star-pairs"), sigs, cut)
    rest = stage(rest, "near")
    if not rest.isEmpty():
        free(texts)
        texts = texts_of(docs, _both(rest), several, size)
        comp = _merged(comp, ids, stage(confirmed(rest, texts, size, percent), "links"))
    free(texts, near, rest)
    # Then the members of different components in each node, large nodes split until they are small.
    at = stage(met.select("key", "id").join(comp, "id"), "nodes")
    sides = stage(partnered(small_nodes(at, sigs, threshold), sigs, cut), "partnered")
    if not sides.isEmpty():
        texts = texts_of(docs, sides.select("id").distinct(), several, size)
        comp = _merged(comp, ids, stage(compared(sides, texts, size, percent), "links"))

    roots = reps.join(comp, "id", "left").select("set", F.coalesce("comp", "id").alias("_root"), "n")
    rows = base.select("doc_id", "n_shingles", "set")
    # The sets of one doc_id are linked, so they have one root.
    linked = join_counted(rows.where("set is not null and doc_id is not null"), stage(roots, "roots"), ["set"])
    alone = rows.where("set is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", F.col("_root").alias("component_id")).unionByName(alone)


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(x, y, cy): the pairs of different components. Many x may have one y."""
    x, y = (comp.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")) for c in "xy")
    pairs = stage(pairs.distinct(), "apart")
    n = stage(pairs.groupBy("y").agg(F.count("*").alias("n")).join(y, "y"), "apart-y")
    return join_counted(pairs, n, ["y"]).join(x, "x").where("cx <> cy").select("x", "y", "cy")


def texts_of(docs: DataFrame, ids: DataFrame, several: DataFrame, size: int) -> DataFrame:
    """(id, z): the compressed texts of the documents in ids, staged; a doc_id with several texts has each of its sets once."""
    own = size_bounded(stage(ids, "text-ids"), BROADCAST_IDS)
    texts = docs.select("doc_id", "text").join(own.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    if several.isEmpty():
        return stage(compressed(texts), "texts")
    of = size_bounded(several.select("doc_id"), BROADCAST_IDS)
    once = compressed(texts.join(of, "doc_id", "left_semi"), size).dropDuplicates(["id", "set"]).select("id", "z")
    return stage(compressed(texts.join(of, "doc_id", "left_anti")).unionByName(once), "texts")


def _same_document(usable: DataFrame, several: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the ids that stand for the sets of one doc_id."""
    of = usable.join(size_bounded(several.where("low <> high").select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi")
    at = stage(of.select("doc_id", "set").distinct().join(reps, "set").select("doc_id", "id").distinct(), "own-ids")
    least = at.groupBy("doc_id").agg(F.min("id").alias("b"))
    return at.join(size_bounded(least, BROADCAST_IDS), "doc_id").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def _merged(comp: DataFrame | None, ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) after the links (a, b) between ids."""
    if comp is None:
        start = ids.select("id", F.col("id").alias("comp"))
        roots = components(links)
        return stage(start.join(roots, start["id"] == roots["node"], "left").select("id", F.coalesce("root", "comp").alias("comp")), "comp")
    a, b = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    roots = components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = stage(comp.join(roots, comp["comp"] == roots["node"], "left").select("id", F.coalesce("root", "comp").alias("comp")), "comp")
    free(comp)
    return new


def op6(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by their two-word shingles; nulls, empty texts, repeats and ties as in near_duplicates(). Null doc_id: kept."""
    got = near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return got.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five words, 0.8) the document with the least doc_id.

    Null, empty and wordless texts and rows without a doc_id stay. Rows that repeat a kept doc_id stay as often as they are there. Very
    long texts are compared whole. Empty table: empty result. All columns pass through, whatever their names.
    """
    got = near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    dropped = stage(got.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return docs.join(size_bounded(dropped, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
