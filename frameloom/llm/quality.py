"""Quality: a convolutional network over bytes, in numpy, that reads whole documents in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .learning import labelled, remainder, sigmoid

#: Labelled documents that the network is fitted on, at most.
SAMPLE = 2000
EPOCHS = 8
#: Bytes of their texts together, at most, and bytes of one text that is learned from.
SAMPLE_BYTES, TEXT_BYTES = 64 << 20, 4 << 20
THRESHOLD = 0.3
#: Bytes of a chunk, and from one chunk's start to the next.
CHUNK, STEP = 256, 192
WIDTH, STRIDE, CHANNELS, FILTERS = 8, 2, 6, 24
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks(text: str | None) -> np.ndarray:
    """Overlapping chunks over all bytes of a text, padded with 0; one chunk of padding for null or empty."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1))


class ByteNet:
    """Bytes to vectors, filters over WIDTH bytes, the maximum of each filter in a chunk, mean and maximum over chunks, one logit."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "table": r.normal(0, 0.5, (256, CHANNELS)).astype(f32), "filters": r.normal(0, 0.25, (WIDTH * CHANNELS, FILTERS)).astype(f32),
            "bias": np.zeros(FILTERS, f32), "out": r.normal(0, 0.1, 2 * FILTERS).astype(f32), "base": np.zeros(1, f32),
        }

    def _windows(self, block: np.ndarray) -> np.ndarray:
        x = self.p["table"][block]
        a, b, c = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(block), PLACES, WIDTH * CHANNELS), (a, STRIDE * b, c))

    def pooled(self, block: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maxima of the filters in each chunk, and their places."""
        tops, places = np.empty((len(block), FILTERS), np.float32), np.empty((len(block), FILTERS), np.int64) if where else None
        for at in range(0, len(block), 256):
            got = np.ascontiguousarray(self._windows(block[at : at + 256])).reshape(-1, WIDTH * CHANNELS) @ self.p["filters"]
            got = got.reshape(-1, PLACES, FILTERS)
            if where:
                places[at : at + 256] = got.argmax(axis=1)
            tops[at : at + 256] = got.max(axis=1)
        return np.maximum(tops + self.p["bias"], 0), places

    def logits(self, tops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        both = np.hstack([np.add.reduceat(tops, starts) / sizes[:, None], np.maximum.reduceat(tops, starts)])
        return both @ self.p["out"] + self.p["base"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One probability for each text; long texts take memory by chunk, not whole."""
        out, held, rows = [], [], 0
        for text in texts:
            held.append(chunks(text))
            rows += len(held[-1])
            if rows >= 4096:
                out.append(self._some(held))
                held, rows = [], 0
        if held:
            out.append(self._some(held))
        return sigmoid(np.concatenate(out).astype(float)) if out else np.zeros(0)

    def _some(self, held: list[np.ndarray]) -> np.ndarray:
        tops = np.concatenate([self.pooled(part)[0] for part in ([np.concatenate(held)] if sum(map(len, held)) < 20_000 else held)])
        return self.logits(tops, np.array([len(c) for c in held]))

    def fit(self, texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01) -> "ByteNet":
        """Logistic loss by Adam over whole documents; gradients flow to the places of the maxima."""
        docs, y = [chunks(t) for t in texts], labels.astype(np.float32)
        if not len(y) or y.min() == y.max():
            self.p["base"][:] = 3.0 if len(y) and y[0] else -3.0 if len(y) else 0.0
            self.p["out"][:] = 0
            return self
        share = y.mean()
        self.p["base"][:] = np.log(share / (1 - share))
        r, m, v, t = np.random.default_rng(11), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                own = order[at : at + batch]
                g = self._gradient([docs[k] for k in own], y[own])
                t += 1
                speed = rate * min(1, 2 * (1 - t / (steps + 1)))
                for k, x in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] ** 2 - v[k])
                    x -= speed * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def _gradient(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        sizes = np.array([len(d) for d in docs])
        block = np.concatenate(docs)
        tops, places = self.pooled(block, where=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        of = np.repeat(np.arange(len(docs)), sizes)
        high = np.maximum.reduceat(tops, starts)
        both = np.hstack([np.add.reduceat(tops, starts) / sizes[:, None], high])
        d = ((sigmoid(both @ self.p["out"] + self.p["base"]) - y) / len(y)).astype(np.float32)
        first = tops == high[of]
        ties = np.add.reduceat(first.astype(np.float32), starts)
        up = d[of, None] * (self.p["out"][:FILTERS] / sizes[of, None] + first * self.p["out"][FILTERS:] / ties[of])
        up = np.where(tops > 0, up, 0).astype(np.float32)
        row, f = np.nonzero(up)
        g, place = up[row, f], places[row, f]
        at = place[:, None] * STRIDE + np.arange(WIDTH)
        letters = block[row[:, None], at]
        window = self.p["table"][letters].reshape(len(row), -1)
        filters = np.zeros((FILTERS, WIDTH * CHANNELS), np.float32)
        order = np.argsort(f, kind="stable")
        for k in range(FILTERS):
            lo, hi = np.searchsorted(f[order], [k, k + 1])
            filters[k] = g[order[lo:hi]] @ window[order[lo:hi]]
        back = (g[:, None] * self.p["filters"].T[f]).reshape(-1, CHANNELS)
        letters = letters.ravel()
        lettered = np.stack([np.bincount(letters, back[:, c], 256) for c in range(CHANNELS)], axis=1)
        return {"table": lettered.astype(np.float32), "filters": filters.T, "bias": up.sum(axis=0), "out": d @ both + 1e-4 * self.p["out"], "base": d.sum(keepdims=True)}


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> ByteNet:
    """Fit on labelled documents outside the held-out fifth: the driver gets `rows` whole texts of SAMPLE_BYTES together at most.

    Texts beyond TEXT_BYTES are not learned from (they are scored like others).
    """
    sample = labelled(docs, labels, "quality", F.coalesce(remainder(5) == 0, F.lit(True)), rows)
    sample = sample.withColumn("_n", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("_n") <= TEXT_BYTES)
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))  # `rows` rows at most
    sample = sample.withColumn("_upto", before).where(F.col("_upto") <= SAMPLE_BYTES).select("doc_id", "text", "label").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return ByteNet().fit(sample["text"].to_pylist(), sample["label"].to_numpy())


def score(docs: DataFrame, model: ByteNet) -> DataFrame:
    """docs with _score double, in place of a column of that name.

    Null and empty texts get the score of a chunk of padding. Long texts are read whole, chunk by chunk. Equal texts have equal scores, whatever their ids; rows that
    repeat are each scored. Empty table: empty result. Other columns pass through.
    """
    docs = docs.drop("_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("_score", T.DoubleType())]))


def op9(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls and empty texts as in score(), a row each; null doc_id: not held out, never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
