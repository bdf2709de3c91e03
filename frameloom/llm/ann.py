"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on bounded samples: one of the whole table for its upper levels, then, for as long as leaves hold many more rows than
they should, one of each such leaf for the levels below it. So leaves stay small as the table grows. Every row is put in a leaf. A query visits leaves in the order of a priority queue
over the distances to nodes' centres. How many it visits is calibrated: the visits widen until a set of calibration
queries, whose true neighbours are found by a scan of all rows, reach RECALL.

Largest inner product becomes least distance by one more component: a row x gets sqrt(M^2 - |x|^2), M the
largest norm, and a query 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, stage, table

#: Rows the tree is fitted on, at most, and rows of the sample for each leaf, at least.
SAMPLE, SAMPLE_PER_LEAF = 20_000, 12
#: Rows of a leaf aimed at, and children of a node.
LEAF_ROWS, BRANCH = 400, 12
CALIBRATION_QUERIES, RECALL = 96, 0.97
#: Times LEAF_ROWS from which a leaf is split again, rows of it that this is fitted on, and leaves of a tree at most (70 MB of 64-place centres).
GROWN, LEAF_SAMPLE, MOST_LEAVES = 4, 2_000, 131_072
#: Leaves next to each other in the tree that a task takes together, and its rows and queries: what has more is dealt into blocks.
SHARD_LEAVES = 40
BLOCK, QUERY_BLOCK = 32_768, 1024


@dataclass
class Node:
    centre: np.ndarray
    children: "list[Node]"
    leaf: int = -1


def kmeans(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Centres by Lloyd's rounds from a k-means++ start."""
    centres = [x[r.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.max() > 0:
        centres.append(x[r.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


class Tree:
    def __init__(self, sample: np.ndarray, leaf_rows: int, norm: float, seed: int = 3):
        """sample: augmented rows. leaf_rows: rows of the sample that a leaf may have."""
        self.norm, self.leaves = norm, 0
        self.root = self._grown(sample, max(1, leaf_rows), np.random.default_rng(seed))

    def _grown(self, x: np.ndarray, leaf_rows: int, r: np.random.Generator) -> Node:
        node = Node(x.mean(axis=0) if len(x) else np.zeros(0), [])
        if len(x) > leaf_rows:
            c = kmeans(x, min(BRANCH, -(-len(x) // leaf_rows)), r)
            own = nearest(x, c)
            parts = [x[own == k] for k in range(len(c))]
            if sum(len(p) > 0 for p in parts) > 1:
                node.children = [self._grown(p, leaf_rows, r) for p in parts if len(p)]
                return node
        node.leaf = self.leaves
        self.leaves += 1
        return node

    def graft(self, below: dict[int, "Node"]) -> None:
        """Put nodes in the place of leaves, and number the leaves anew."""
        todo, n = [self.root], 0
        while todo:
            node = todo.pop()
            if node.children:
                todo += node.children
            elif node.leaf in below:  # what is put below has leaf numbers of its own
                node.children, node.leaf = below[node.leaf].children, -1
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.children:
                todo += reversed(node.children)
            else:
                node.leaf, n = n, n + 1
        self.leaves = n

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(axis=1)))[:, None]])

    def centre_of(self, leaf: int) -> bytes:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.leaf == leaf and not node.children:
                return node.centre.tobytes()
            todo += node.children
        raise KeyError(leaf)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every node."""
        x, out = self.augmented(rows), np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not node.children:
                out[at] = node.leaf
                continue
            own = nearest(x[at], np.array([c.centre for c in node.children]))
            todo += [(c, at[own == k]) for k, c in enumerate(node.children) if (own == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves for a query, best bin first."""
        q = np.append(query, 0.0)
        out: list[int] = []
        queue: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        n = 1
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if not node.children:
                out.append(node.leaf)
                continue
            d = ((np.array([c.centre for c in node.children]) - q) ** 2).sum(axis=1)
            for dist, child in zip(d.tolist(), node.children, strict=True):
                heapq.heappush(queue, (dist, n, child))
                n += 1
        return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An array column of equal lengths as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k largest inner products among the rows, itself left out; ties to smaller ids.

    A matrix product finds who can be among them, and a sum in fixed order gives the scores, so that equal
    vectors score equally wherever they stand.
    """
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.finfo(float).max)
    slack = 1e-12 * (1 + np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1])
    at, row = np.nonzero((s >= least[:, None] - slack) & (s > -np.inf))
    score = (q[at] * x[row]).sum(axis=1)
    return ranked(q_ids[at], ids[row], score, k)


def ranked(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, best first, ties to smaller rows."""
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1]) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return query[keep], row[keep], score[keep]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _found(*columns: np.ndarray) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part: with finite components, not all of them 0."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def padded(rows: DataFrame, size: int) -> DataFrame:
    """rows with v filled with zeros to one length: an inner product then is over the places that both vectors have."""
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v"))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, embedding) its k nearest rows of vectors found.

    Null vec_id, and vectors that are null, empty, all zero or with null or non-finite components, take no part. Vectors of different lengths
    count as if filled with zeros. Rows that repeat a vec_id are one candidate, of
    its best score; a vec_id repeated among the queries is one query, of its least vector. Empty table: empty result.
    Other columns are not read. Of equal vectors only the k + 1 with the least vec_id can be among the nearest of any
    query: the others are left out of the index, before any shuffle, and so no vector is hot.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors), usable(queries)
    size = max(df.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0] for df in (rows, asked))
    rows, asked = padded(rows, size), padded(asked, size)
    same = W.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit(1), F.reverse("v"))).orderBy("vec_id")
    rows = stage(rows.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "v"), "vectors")
    asked = stage(asked.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = rows.count()
    if n == 0 or asked.isEmpty():
        return empty
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    tree, index = indexed(rows, n, norm)
    free(rows)
    shared = spark.sparkContext.broadcast(tree)  # at most MOST_LEAVES leaves
    most = _calibrated(index, asked, tree, k, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [shared.value.visits(q, most) for q in matrix(batch.column(1))] if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=["query_id", "q", "leaves"])

    probes = stage(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).mapInArrow(probe, "query_id long, q array<double>, leaves array<long>"), "probes")
    shard = F.floor(F.col("leaf") / SHARD_LEAVES).alias("shard")
    shards_of = F.array_distinct(F.transform("leaves", lambda x: F.floor(x / SHARD_LEAVES)))
    asks = probes.select("query_id", "q", "leaves", F.explode(shards_of).alias("shard"))
    asks = asks.withColumn("leaves", F.filter("leaves", lambda x: F.floor(x / SHARD_LEAVES) == F.col("shard")))
    in_shard = index.groupBy(shard).agg(F.count("*").alias("n_rows"))
    at_shard = asks.groupBy("shard").agg(F.count("*").alias("n_queries"))
    blocks = in_shard.join(at_shard, "shard").select("shard", F.ceil(F.col("n_rows") / BLOCK).alias("row_blocks"), F.ceil(F.col("n_queries") / QUERY_BLOCK).alias("query_blocks"))
    blocks = F.broadcast(stage(blocks, "blocks"))  # a row for each shard, of which there are fewer than leaves

    x = index.withColumn("shard", shard).join(blocks, "shard")
    x = x.select("shard", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).alias("rb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "vec_id", "v", "leaf")
    q = asks.join(blocks, "shard")
    q = q.select("shard", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).alias("qb"), "query_id", "q", "leaves")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each query the best rows of the leaves it visits here, so that a task passes on k rows for a query."""
        if not len(left) or not len(right):
            return _FOUND.empty_table()
        query, vectors, rows, leaf = left["query_id"].to_numpy(), matrix(left["q"]), right["vec_id"].to_numpy(), right["leaf"].to_numpy()
        points, lists = matrix(right["v"]), left["leaves"].combine_chunks()
        asked_of, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(left)), np.diff(lists.offsets.to_numpy()))
        parts = []
        for one in np.unique(leaf):
            who, at = asker[asked_of == one], np.flatnonzero(leaf == one)
            if len(who):
                parts.append(top(query[who], vectors[who], rows[at], points[at], k))
        return _found(*ranked(*map(np.concatenate, zip(*parts, strict=True)), k)) if parts else _FOUND.empty_table()

    key = ["shard", "rb", "qb"]
    found = q.groupBy(*key).cogroup(x.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    placed = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return placed.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def indexed(rows: DataFrame, n: int, norm: float) -> tuple[Tree, DataFrame]:
    """The tree over rows (vec_id, v), n of them, and each row's leaf: (vec_id, v, leaf), staged."""
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()["v"])
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), 1, norm)
    leaves = max(1, min(n // LEAF_ROWS, len(sample) // SAMPLE_PER_LEAF))
    tree = Tree(tree.augmented(sample), -(-len(sample) // leaves), norm)
    settled: set[bytes] = set()  # leaves of equal vectors, by their centres: they do not split
    while True:
        shared = rows.sparkSession.sparkContext.broadcast(tree)

        def put(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = shared.value.leaf_of(matrix(batch.column(1))) if len(batch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "v", "leaf"])

        index = stage(rows.mapInArrow(put, "vec_id long, v array<double>, leaf long"), "index")
        below = _split_leaves(index, tree, settled)
        if not below:
            return tree, index
        free(index)
        tree.graft(below)


def _split_leaves(index: DataFrame, tree: Tree, settled: set[bytes]) -> dict[int, Node]:
    """Subtrees for the leaves that hold GROWN * LEAF_ROWS rows or more, each fitted in a task on LEAF_SAMPLE of its rows."""
    sizes = index.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= GROWN * LEAF_ROWS)
    many = [r for r in sizes.collect() if tree.centre_of(r["leaf"]) not in settled]  # a row for each leaf at most
    room = MOST_LEAVES - tree.leaves
    many = sorted(many, key=lambda r: (-r["n"], r["leaf"]))[: max(0, room // (LEAF_SAMPLE // SAMPLE_PER_LEAF))]
    if not many:
        return {}
    wanted = F.broadcast(index.sparkSession.createDataFrame([(r["leaf"], r["n"]) for r in many], "leaf long, n long"))
    nth = F.row_number().over(W.partitionBy("leaf").orderBy(F.xxhash64("vec_id"), "vec_id"))
    some = index.join(wanted, "leaf").withColumn("nth", nth).where(F.col("nth") <= LEAF_SAMPLE)
    norm = tree.norm

    def grow(key: tuple, part: pa.Table) -> pa.Table:
        x, n = matrix(part["v"]), part["n"][0].as_py()
        plain = Tree(np.zeros((1, x.shape[1] + 1)), 1, norm)
        leaves = max(2, min(n // LEAF_ROWS, len(x) // SAMPLE_PER_LEAF))
        grown = Tree(plain.augmented(x), -(-len(x) // leaves), norm)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "root": pa.array([pickle.dumps(grown.root)], pa.binary())})

    got = {r["leaf"]: pickle.loads(r["root"]) for r in some.groupBy("leaf").applyInArrow(grow, "leaf long, root binary").collect()}  # nodes of at most MOST_LEAVES leaves
    settled.update(tree.centre_of(leaf) for leaf, root in got.items() if not root.children)
    return {leaf: root for leaf, root in got.items() if root.children}


def _calibrated(index: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit: the least number by which the calibration queries find `recall` of their true neighbours."""
    got = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION_QUERIES).toArrow()
    ids, q = got["vec_id"].to_numpy(), matrix(got["v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                query, row, score = top(ids, q, rows, matrix(batch.column(1)), k)
                order = np.argsort(rows)
                of = leaf[order[np.searchsorted(rows, row, sorter=order)]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (query, row, score, of)], names=["query_id", "vec_id", "score", "leaf"])

    all_of = index.mapInArrow(scan, "query_id long, vec_id long, score double, leaf long")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = all_of.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "leaf").toArrow()  # k for each calibration query
    place = {i: {leaf: p for p, leaf in enumerate(tree.visits(v, tree.leaves))} for i, v in zip(ids.tolist(), q, strict=True)}
    needed = np.sort([place[i][leaf] + 1 for i, leaf in zip(true["query_id"].to_pylist(), true["leaf"].to_pylist(), strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1


def op1(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id 20 divides; nulls, odd vectors, ties and repeats as in search()."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
