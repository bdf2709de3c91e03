"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, in_parts, set_aside, stage, table
from .learning import BoostedTrees, Isotonic, labelled, remainder

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Letters that make a term: a word's beginning, so that inflected forms meet.
STEM = 5
LEXICON = 150
#: Least likelihood ratio of a term's counts; a chance of about 1 in 30,000 for a term without meaning.
EVIDENCE = 17.0
THRESHOLD = 0.7
#: Second person in the languages of the corpus (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
SECOND_STEMS = frozenset(w[:STEM] for w in SECOND_PERSON)
#: Characters that stand for letters in disguised words (fixed values).
LEET = str.maketrans("0134578@$!", "oieastbasi")

_TOKEN = re.compile(r"\w+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_DISGUISED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_UPPER = bytes(b for b in range(256) if chr(b).isupper())
_MARKS = b"!?"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def terms(text: str | None) -> list[str]:
    return [w[:STEM] for w in _TOKEN.findall((text or "").lower())]


@dataclass
class Lexicon:
    """Terms with the log ratio of their rates in toxic and other documents, learned from labelled rows."""

    weight: dict[str, float]

    def features(self, text: str | None) -> list[float]:
        """Dense features of a whole text; all 0 for null or empty."""
        text = text or ""
        got = terms(text)
        n = max(1, len(got))
        hits = [k for k, w in enumerate(got) if w in self.weight]
        weights = [self.weight[got[k]] for k in hits]
        second = [0, *accumulate(w in SECOND_STEMS for w in got)]
        near = sum(second[min(len(got), k + 6)] > second[max(0, k - 5)] for k in hits)
        closest = min((b - a for a, b in zip(hits, hits[1:], strict=False)), default=n)
        flat = text.encode("latin-1", "replace")
        upper = len(flat) - len(flat.translate(None, _UPPER))
        marks = len(flat) - len(flat.translate(None, _MARKS))
        punctuation = len(flat) - len(flat.translate(None, _PUNCTUATION))
        disguised = _DISGUISED.findall(text)
        revealed = sum(w.lower().translate(LEET)[:STEM] in self.weight for w in disguised)
        size = max(1, len(text))
        return [
            (len(hits) + revealed) / n, (sum(weights) + revealed) / n, max(weights, default=0.0), float(np.log1p(len(hits) + revealed)), len({got[k] for k in hits}) / (1 + len(hits)),
            near / n, near / max(1, len(hits)), float(np.log1p(closest)), upper / size, len(_SHOUT.findall(text)) / n, marks / size,
            punctuation / size, len(disguised) / n, revealed / n, len(_STRETCHED.findall(text)) / n, float(np.log1p(n)),
        ]


N_FEATURES = len(Lexicon({}).features(""))


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> Lexicon:
    """The terms whose document rate is highest among toxic documents against the others; copies of a text count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in set(terms(text)):
                    n.setdefault(t, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), *(pa.array([v[k] for v in n.values()], pa.int64()) for k in (0, 1))], names=["term", "other", "toxic"])

    once = sample.groupBy(F.xxhash64("text"), F.md5("text")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    totals = dict(once.groupBy("label").count().collect())
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    by_term = once.select("text", "label").mapInArrow(count, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("other") + 0.5) / F.lit(n0 + 1.0))
    n = n1 + n0

    def cell(found: Column, of: int, hit: Column) -> Column:
        """A cell's part in the likelihood ratio of the term's 2 x 2 table."""
        return F.when(found > 0, found * F.log(found * F.lit(float(n)) / (F.lit(float(max(of, 1))) * hit))).otherwise(0.0)

    both = F.col("toxic") + F.col("other")
    ratio_g = 2 * (cell(F.col("toxic"), n1, both) + cell(F.col("other"), n0, both) + cell(n1 - F.col("toxic"), n1, n - both) + cell(n0 - F.col("other"), n0, n - both))
    strong = by_term.where(F.col("toxic") >= max(3, n1 // 200)).withColumn("ratio", ratio).withColumn("g", ratio_g)
    rows = strong.where((F.col("ratio") > 1.1) & (F.col("g") > EVIDENCE)).orderBy(F.desc("g"), "term").limit(size).collect()
    return Lexicon({r["term"]: float(r["ratio"]) for r in rows})


@dataclass
class Toxicity:
    lexicon: Lexicon
    trees: BoostedTrees
    calibrated: Isotonic

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts], float).reshape(len(texts), N_FEATURES)
        return self.calibrated(self.trees.score(x))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Toxicity:
    """Fit on labelled documents outside the held-out third. The driver gets their features: rows * 16 numbers."""
    sample = stage(labelled(docs, labels, "toxic", F.coalesce(remainder(3) == 1, F.lit(True)), rows), "toxicity-sample")
    lexicon = learn_lexicon(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sample.mapInArrow(features, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    free(sample)
    x = np.array(got["x"].to_pylist(), float).reshape(len(got), N_FEATURES)
    y = got["label"].to_numpy().astype(float)
    fold, out = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):  # calibrated on scores of trees that have not seen the row
        out[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).score(x[fold == k])
    return Toxicity(lexicon, BoostedTrees().fit(x, y), Isotonic(out, y))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs with _score double, in place of a column of that name.

    Null and empty texts get the score of a text without features. Long texts are read whole. Equal texts have equal scores, whatever their ids; rows that repeat
    are each scored. Empty table: empty result. Other columns pass through.
    """
    docs = docs.drop("_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            scores = model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("_score", T.DoubleType())]))


def op5(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls and empty texts as in score(), a row each; null doc_id: not held out, never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not toxic.

    Null and empty texts have the score of a text without features. Null doc_id: never labelled. Ties and repeated rows: each row on its own. Very
    long texts: whole. Empty table: empty result. All columns pass through, whatever their names.
    """
    inner, names = set_aside(docs, "text")
    kept = score(inner, train(docs, table(spark, sf_dir, "labels"))).where(F.col("_score") < THRESHOLD)
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
