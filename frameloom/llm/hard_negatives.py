"""Hard-negative mining with product quantisation, exact by bounds on what the quantisation leaves over.

Vectors are of integers. Their places are cut into parts of SUB places; each part is coded by the nearest of at most CODES centres, fitted on a bounded
sample, and what is left over is kept as one norm for each part. For an anchor a table holds the products of its parts with all centres, so the sum of
a row's table entries is the anchor's product with the coded row, and the true product differs by at most the sum over the parts of
(norm of the anchor's part) * (norm of the row's rest), by Cauchy and Schwarz.

Both passes, for the anchors' positives and then for the negatives in the window below each positive, use these bounds alike: a row stays a candidate
if its upper bound reaches the k-th best of what is known, which is the k-th best lower bound of rows that are surely in the window or exact score so far. Candidates are
scored exactly in integers. No row is passed over that could be among the first k, whatever centres the sample gives.

Anchors come in waves of bounded size, which are broadcast; the table of all rows is scanned in blocks, where it lies, and a task passes on k rows for each window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ann import kmeans, nearest
from .common import free, new_path, stage, table

#: Rows that centres are fitted on, at most; places of a part; centres of a part, at most.
SAMPLE, SUB, CODES = 8_192, 4, 256
#: Anchors of a wave, about (they are dealt by a hash); anchors and rows that a task compares at once.
WAVE, ANCHORS, ROWS = 4_096, 512, 4_096
#: Integer components beyond this have no exact product in 64 bits.
LARGEST = 1 << 24
_LOW = np.iinfo(np.int64).min

OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS y
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.y, b.y)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, y): a row for each vec_id with label and vector, y the components floor(scale * x). See hard_negatives()."""
    x = F.transform("embedding", lambda c: F.floor(scale * c.cast("double")))
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(scale * c.cast("double")) > LARGEST))
    rows = vectors.where("vec_id is not null and label is not null and size(embedding) > 0").where(~odd)
    rows = rows.select("vec_id", F.struct(F.col("label").cast("long").alias("label"), x.alias("y")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.y")


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of integers, filled with zeros up to size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = column.flatten().to_numpy()
    return out


class Quantiser:
    """Centres for each part of the places."""

    def __init__(self, sample: np.ndarray, size: int):
        self.size = -(-max(size, 1) // SUB) * SUB
        r, parts = np.random.default_rng(5), self.parts(sample)
        self.centres = [kmeans(parts[:, j], min(CODES, len(sample)), r, rounds=5) for j in range(self.size // SUB)]

    def parts(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), self.size))
        out[:, : y.shape[1]] = y
        return out.reshape(len(y), -1, SUB)

    def coded(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, norm of the rest) of each part of each row."""
        parts = self.parts(y)
        codes = np.stack([nearest(parts[:, j], c) for j, c in enumerate(self.centres)], axis=1)
        rest = np.stack([np.linalg.norm(parts[:, j] - c[codes[:, j]], axis=1) for j, c in enumerate(self.centres)], axis=1)
        return codes.astype(np.uint8), np.nextafter(rest.astype(np.float32), np.float32(np.inf))

    def tables(self, anchors: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each part the products with its centres; the norms of the anchors' parts."""
        parts = self.parts(anchors)
        return [parts[:, j] @ c.T for j, c in enumerate(self.centres)], np.linalg.norm(parts, axis=2)


def bounds(tables: list[np.ndarray], norms: np.ndarray, codes: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products, anchors by rows."""
    score = np.zeros((len(norms), len(codes)))
    for j, t in enumerate(tables):
        score += np.take(t, codes[:, j], axis=1)
    off = norms @ rests.T.astype(np.float64)
    off += 1e-3 + 1e-12 * (np.abs(score).max(initial=0) + off.max(initial=0))  # of rounding in the sums
    return score - off, score + off


class Best:
    """The first k rows of each of n windows seen so far, by score, then least id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _LOW), np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, window: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(window):
            return
        touched, k = np.unique(window), self.score.shape[1]
        w = np.concatenate([np.repeat(touched, k), window])
        s, i = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), row])
        order = np.lexsort((i, ~s, w))  # ~ turns the order of all integers, the least one too
        w, s, i = w[order], s[order], i[order]
        first = np.searchsorted(w, touched)
        at = first[:, None] + np.arange(k)
        self.score[touched], self.id[touched] = s[at], i[at]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        window, place = np.nonzero(self.score > _LOW)
        return window, self.score[window, place], self.id[window, place]


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def _scan(rows: DataFrame, quantiser, wave, size: int, slots: int, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(window, score, vec_id): of each task's rows the first k of every window. wave: broadcast (ids, labels, vectors, high scores by anchor and slot).

    A window is a slot of an anchor: with its label and no bound (same), or with other labels and
    low * h <= 100 * score <= high * h, where h is the slot's score; slots without a score have the least integer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, tops = wave.value
        best = Best(len(ids) * slots, k)
        made = [(a, *quantiser.value.tables(vectors[a : a + ANCHORS])) for a in range(0, len(ids), ANCHORS)]
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                vec_id, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                y = matrix(batch.column(2), size)
                n_parts = len(quantiser.value.centres)
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, n_parts)
                rests = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(-1, n_parts)
                for a, tables, norms in made:
                    lower, upper = bounds(tables, norms, codes, rests)
                    n = len(norms)
                    mine = labels[a : a + n, None] == label
                    valid = (mine if same else ~mine) & (ids[a : a + n, None] != vec_id)
                    for slot in range(slots):
                        window = np.arange(a, a + n) * slots + slot
                        known = best.least()[window].astype(np.float64)
                        if same:
                            inside, sure = valid, valid
                        else:
                            top = tops[a : a + n, slot].astype(np.float64)[:, None]
                            inside = valid & (100 * upper >= low * top) & (100 * lower <= high * top) & (top > _LOW)
                            sure = inside & (100 * upper <= high * top) & (100 * lower >= low * top)
                        if not inside.any():
                            continue
                        reach = np.maximum(kth_largest(np.where(sure, lower, -np.inf), k), known)
                        which, row = np.nonzero(inside & (upper >= reach[:, None]))
                        score = np.einsum("ij,ij->i", vectors[a + which], y[row])
                        if not same:
                            h = tops[a + which, slot]
                            fits = (low * h <= 100 * score) & (100 * score <= high * h)
                            which, row, score = which[fits], row[fits], score[fits]
                        best.add(window[which], score, vec_id[row])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best.rows()], names=["window", "score", "vec_id"])

    return rows.mapInArrow(run, "window long, score long, vec_id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window over all tasks, with their rank."""
    placed = found.withColumn("rank", F.row_number().over(W.partitionBy("window").orderBy(F.desc("score"), "vec_id")))
    return placed.where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among rows, both (vec_id, label, y) as usable() gives them.

    An anchor's positives are the first rows of its label but itself, by integer inner product, ties to the smaller vec_id. For each of these the first rows of other
    labels with low * positive_score <= 100 * score <= high * positive_score follow, in the same order.

    Rows with a null vec_id or label, with a null or empty vector, or with a component that is null, not finite or, scaled, beyond 2^24 take no part. Vectors of different lengths count as
    if filled with zeros. Of rows that repeat a vec_id the least (label, vector) takes part. An anchor without another row of its label, and a positive without
    a negative in its window, give no row; an empty table gives an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stage(rows.select("vec_id", "label", "y"), "integers")
    n_anchors = anchors.count()
    size = rows.agg(F.max(F.size("y"))).first()[0]
    if not n_anchors or not size:
        return spark.createDataFrame([], schema)
    waves = -(-n_anchors // WAVE)
    asked = stage(anchors.select("vec_id", "label", "y", F.pmod(F.xxhash64("vec_id"), F.lit(waves)).alias("wave")), "anchors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("y").toArrow()
    quantiser = spark.sparkContext.broadcast(Quantiser(matrix(sample["y"], size).astype(np.float64), size))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, rests = quantiser.value.coded(matrix(batch.column(2), size).astype(np.float64))
            more = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (codes, rests)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["vec_id", "label", "y", "codes", "rests"])

    coded = stage(rows.mapInArrow(code, "vec_id long, label long, y array<long>, codes binary, rests binary"), "coded")
    free(rows)
    out = new_path(spark, "hard-negatives")
    for wave in range(waves):
        part = asked.where(F.col("wave") == wave).toArrow()  # about WAVE rows
        if not len(part):
            continue
        ids, labels, vectors = part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["y"], size)
        send: Callable = lambda tops: spark.sparkContext.broadcast((ids, labels, vectors, tops))  # noqa: B023, E731
        found = _first(_scan(coded, quantiser, send(None), size, 1, positives, True, low, high), positives).toArrow()
        window, rank = found["window"].to_numpy(), found["rank"].to_numpy() - 1
        tops, chosen = np.full((len(ids), positives), _LOW), np.zeros((len(ids), positives), np.int64)
        tops[window, rank], chosen[window, rank] = found["score"].to_numpy(), found["vec_id"].to_numpy()
        named = spark.createDataFrame(pa.table({"window": np.arange(tops.size), "anchor_id": np.repeat(ids, positives), "positive_id": chosen.ravel(), "positive_score": tops.ravel()}))
        first = _first(_scan(coded, quantiser, send(tops), size, positives, negatives, False, low, high), negatives)
        got = first.join(F.broadcast(named), "window")  # WAVE * positives rows
        got.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    free(coded, asked)
    return spark.read.schema(schema).parquet(out)


def op12(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id 100 divides, labels moved by one where 7 divides it; nulls, odd vectors, ties and repeats as in hard_negatives()."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(rows.withColumn("label", moved))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))
