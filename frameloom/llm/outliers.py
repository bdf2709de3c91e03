"""Quality rules: base statistics of texts, and robust multivariate outliers for each language and source.

The statistics of a group's documents are transformed to be about normal; their centre and scatter come from the minimum covariance
determinant: the part H of the rows whose scatter has the least determinant. A bounded sample of each group gives the start: many
random ones, each followed by concentration steps until it settles, the best kept. From there concentration steps run over all rows, with
exactly H of them each, until the determinant settles. A document is rejected if its Mahalanobis distance is beyond the quantile that
fits the number of rows in H.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, size_bounded, stage, table, words

MIN_WORDS, MAX_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Words from which a text's windows are counted in arrays, not objects.
LONG = 50_000
#: Part of the rows in H; distinct vectors of a group that starts are tried on, random starts, and starts that go on until they settle.
H, SAMPLE, STARTS, BEST = 0.75, 1500, 40, 8
#: Fall of a log determinant below which an estimate has settled, and steps over all rows at most.
SETTLED, STEPS = 1e-4, 40
P = 5
#: Chance that a normal row is beyond the cut.
BEYOND = 1e-3
#: Steps of log distance (to the base 2) that rows add up by, and estimates that a broadcast may hold.
FINE, BROADCAST_GROUPS = 64, 50_000


def repeated_words(got: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    if len(got) < 4:
        return 0
    if len(got) < LONG:
        windows = list(zip(got, got[1:], got[2:], strict=False))
        n = Counter(windows)
        if len(n) == len(windows):
            return 0
        hit = np.array([n[w] > 1 for w in windows])
    else:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in got], np.int64)
        _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
        _, at, n = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        hit = n[at] > 1
    cover = np.zeros(len(got), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; all 0 for null or empty."""
    if not text:
        return 0, 0, 0, 0, 0
    got = words(text)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\f\r")]
    return len(got), chars, symbols, len(lines) - len(set(lines)), repeated_words(got)


def with_counts(docs: DataFrame) -> DataFrame:
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counts(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            more = [pa.array([g[k] for g in got], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *COUNTS])

    return docs.mapInArrow(run, schema)


def transformed() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p("n_words"), F.log(chars / n), F.log1p(1000 * F.col("n_symbols") / chars),
        F.log1p(20 * F.col("n_dup_lines") / n), F.asin(F.sqrt(F.col("n_repeat_words") / n)),
    ]


def resolution() -> list[Column]:
    """What one count more is worth in each transformed statistic of a row: a word, a mean's sampling error, a symbol, a line, four words in repeated windows.

    Most texts have no symbol or repeated line at all, so that the scatter of H is none; in the mean square over the rows of a
    group this adds to the variance, and follows the group's lengths.
    """
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [1 / n, 1 / F.sqrt(n), F.log1p(1000 / chars), F.log1p(20 / n), F.asin(F.sqrt(F.least(F.lit(1.0), 4 / n)))]


def chi2_cdf(x: float, dof: int) -> float:
    """For odd degrees of freedom."""
    if x <= 0:
        return 0.0
    out, k = math.erf(math.sqrt(x / 2)), 1
    while k < dof:
        out -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
        k += 2
    return max(0.0, out)


def chi2_at(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def beta_at(p: float, a: float, b: float) -> float:
    """The p-quantile of the beta distribution for a and b of 1/2 or more, by the angle t = asin(sqrt(x)) over where it has weight."""
    t = np.linspace(0, min(math.pi / 2, 12 * math.sqrt((a + 5) / b)), 40_001)[1:-1]
    log = (2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t))
    mass = np.cumsum(np.exp(log - log.max()))
    return float(np.sin(t[min(len(t) - 1, int(np.searchsorted(mass, p * mass[-1])))]) ** 2)


def freedom(n: int, h: int) -> float:
    """Degrees of freedom of the scatter of the h rows of least determinant among n normal ones (Hardin and Rocke, 2005)."""
    if h >= n:
        return n - 1.0
    kept = h / n
    q = chi2_at(kept, P)
    c = kept / chi2_cdf(q, P + 2)
    c2, c3 = -chi2_cdf(q, P + 2) / 2, -chi2_cdf(q, P + 4) / 2
    b1 = -2 * c * c3 / kept
    b2 = 0.5 + c / kept * (c3 - q / P * (c2 + kept / 2))
    v1 = kept * b1**2 * ((1 - kept) * (c * q / P - 1) ** 2 - 1) - 2 * c3 * c**2 * (3 * (b1 - P * b2) ** 2 + (P + 2) * b2 * (2 * b1 - P * b2))
    v = v1 / (n * (b1 * (b1 - P * b2) * kept) ** 2 * c**2)
    return 2 / (c**2 * v) * math.exp(0.725 - 0.00663 * P - 0.0780 * math.log(n))


@functools.lru_cache(4096)
def cut_of(n: int, h: int) -> float:
    """The squared distance that one of n normal rows exceeds with a chance of BEYOND, by the h in H; none where these leave no freedom.

    The distance follows Hotelling's distribution, which becomes chi-square as n grows.
    """
    m = freedom(n, h)
    if m <= P - 0.9:
        return math.inf
    x = beta_at(1 - BEYOND, P / 2, max(0.5, (m - P + 1) / 2))
    return m * x / (1 - x)


def in_h(n: int) -> int:
    """Rows in H of n: the part H of them, and never fewer than the least number that a scatter of P statistics needs."""
    return max(math.ceil(H * n), min(n, (n + P + 1) // 2))


_UPPER = [(i, j) for i in range(P) for j in range(i, P)]
_PARAMS = "est string, m array<double>, inv array<double>, floor array<double>, rows long, h long, logdet double, cut double"
_X = [f"_x{i}" for i in range(P)]


def _distance() -> Column:
    """Squared Mahalanobis distance of _x0.. from the columns m and inv (the upper triangle, row by row)."""
    d = [F.col(x) - F.col("m")[i] for i, x in enumerate(_X)]
    return sum((F.col("inv")[k] * d[i] * d[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_UPPER)), F.lit(0.0))


def scatter(mean: np.ndarray, cov: np.ndarray, floor: np.ndarray, rows: int, h: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, inverse, log determinant) of the scatter of the h nearest of normal rows, made that of all.

    floor, the variance that counting in whole units has, adds to it: so rows on a line or copies of one have a proper scatter too.
    """
    part = h / rows
    if part < 1:
        cov = cov * part / chi2_cdf(chi2_at(part, P), P + 2)
    cov = cov + np.diag(floor)
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def nearest_h(x: np.ndarray, n: np.ndarray, d: np.ndarray, h: int) -> np.ndarray:
    """How many rows of each distinct vector x (n rows each) are among the h nearest; ties by the vector."""
    order = np.lexsort((*x.T[::-1], d))
    upto = np.cumsum(n[order])
    out = np.zeros(len(n), np.int64)
    out[order] = np.clip(h - (upto - n[order]), 0, n[order])
    return out


def concentrated(x: np.ndarray, n: np.ndarray, floor: np.ndarray, at: tuple, h: int) -> tuple:
    d = x - at[0]
    w = nearest_h(x, n, np.einsum("ij,jk,ik->i", d, at[1], d), h)
    mean = w @ x / h
    c = x - mean
    return scatter(mean, (c * w[:, None]).T @ c / h, floor, int(n.sum()), h)


def determinant_of_sample(x: np.ndarray, n: np.ndarray, floor: np.ndarray, seed: int) -> tuple:
    """The best of many starts: P + 1 random vectors each, two steps, then the best ones until they settle."""
    r, h = np.random.default_rng(seed), in_h(int(n.sum()))
    tried = [scatter(x.mean(axis=0), np.cov(x.T, bias=True).reshape(P, P), floor, 1, 1)]
    for _ in range(STARTS if len(x) > P + 1 else 0):
        own = x[r.choice(len(x), P + 1, replace=False)]
        tried.append(scatter(own.mean(axis=0), np.cov(own.T, bias=True), floor, 1, 1))
    tried = [concentrated(x, n, floor, concentrated(x, n, floor, t, h), h) for t in tried]
    best = None
    for t in sorted(tried, key=lambda t: t[2])[:BEST]:
        for _ in range(200):
            new = concentrated(x, n, floor, t, h)
            settled = new[2] > t[2] - 1e-9
            t = min(t, new, key=lambda t: t[2])
            if settled:
                break
        best = t if best is None or t[2] < best[2] else best
    return best


def _row(est: str, at: tuple, floor: np.ndarray, rows: int, h: int) -> dict:
    return {"est": [est], "m": [at[0].tolist()], "inv": [[float(at[1][i, j]) for i, j in _UPPER]], "floor": [list(map(float, floor))], "rows": [rows], "h": [h], "logdet": [at[2]], "cut": [cut_of(rows, h)]}


def _start(points: DataFrame, groups: DataFrame) -> DataFrame:
    """Estimates from at most SAMPLE distinct vectors of each group, those with the least hashes."""
    nth = F.row_number().over(W.partitionBy("est").orderBy(F.xxhash64(*_X), *_X))
    some = points.withColumn("nth", nth).where(F.col("nth") <= SAMPLE).drop("nth")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x, n = np.stack([left[c].to_numpy() for c in _X], axis=1), left["n"].to_numpy()
        floor, rows = np.array(right["floor"][0].as_py()), right["rows"][0].as_py()
        return pa.table(_row(key[0].as_py(), determinant_of_sample(x, n, floor, len(x)), floor, rows, in_h(rows)))

    return some.groupBy("est").cogroup(groups.groupBy("est")).applyInArrow(run, _PARAMS)


def _with(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows joined to the estimate of their group: by broadcast up to BROADCAST_GROUPS groups, else only of the groups that have many rows."""
    return rows.join(F.broadcast(params), "est") if params.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else join_counted(rows, params, ["est"], "rows")


def _concentrated(points: DataFrame, params: DataFrame) -> DataFrame:
    """A concentration step over all rows: centre and scatter of exactly the h nearest of each group.

    Distinct vectors add up by group and step of log distance, before any shuffle: some thousand rows for a group of any size. Steps
    that lie within the nearest h count whole; of the step where they end, one in some hundred of a group's vectors, a
    window by distance finds how many rows count.
    """
    near = _with(points, params).withColumn("d", _distance())
    near = near.withColumn("step", F.floor(FINE * F.log2(F.col("d") + 1e-9)).cast("int"))
    w = F.col("w")
    moments = [F.sum(w * F.col(x)).alias(f"s{i}") for i, x in enumerate(_X)] + [F.sum(w * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"s{i}_{j}") for i, j in _UPPER]
    names = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in _UPPER)]
    steps = near.withColumn("w", F.col("n")).groupBy("est", "step").agg(F.first("h").alias("h"), F.sum("n").alias("n"), *moments)
    steps = stage(steps.withColumn("upto", F.sum("n").over(W.partitionBy("est").orderBy("step"))), "mcd-steps")
    ends = steps.where((F.col("upto") > F.col("h")) & (F.col("upto") - F.col("n") < F.col("h"))).select("est", "step", (F.col("h") - F.col("upto") + F.col("n")).alias("need"))
    edge = near.join(size_bounded(ends, BROADCAST_GROUPS), ["est", "step"])
    upto = F.sum("n").over(W.partitionBy("est").orderBy("d", *_X).rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("w", F.least("n", F.col("need") - upto + F.col("n"))).where("w > 0").groupBy("est").agg(F.sum("w").alias("n"), *moments)
    sums = steps.where("upto <= h").select("est", *names).unionByName(edge.select("est", *names)).groupBy("est").agg(*(F.sum(c).alias(c) for c in names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [pd.DataFrame({"est": [], "m": [], "inv": [], "floor": [], "rows": [], "h": [], "logdet": [], "cut": []})]
            for row in pdf.itertuples():
                mean, cov = np.array([getattr(row, f"s{i}") for i in range(P)]) / row.n, np.zeros((P, P))
                for i, j in _UPPER:
                    cov[i, j] = cov[j, i] = getattr(row, f"s{i}_{j}") / row.n - mean[i] * mean[j]
                floor = np.array(row.floor)
                out.append(pd.DataFrame(_row(row.est, scatter(mean, cov, floor, row.rows, row.h), floor, row.rows, row.h)))
            yield pd.concat(out[1:] or out)

    return sums.join(params.select("est", "floor", "rows", "h"), "est").mapInPandas(run, _PARAMS)


def _estimated(points: DataFrame, groups: DataFrame) -> DataFrame:
    """Estimates after concentration steps over all rows, each group's until its determinant has settled."""
    params, settled = stage(_start(points, groups), "mcd"), []
    # The start's determinant is that of a sample: the first step over all rows is taken whatever it gives.
    params = stage(_concentrated(points, params), "mcd")
    for _ in range(STEPS):
        new = stage(_concentrated(points, params).join(params.select("est", F.col("logdet").alias("was")), "est"), "mcd")
        settled.append(new.where(F.col("logdet") > F.col("was") - SETTLED).drop("was"))
        params = new.where(F.col("logdet") <= F.col("was") - SETTLED).drop("was")
        if params.isEmpty():
            break
    for more in settled:
        params = params.unionByName(more)
    return stage(params, "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """docs with the COUNTS, base_failed, _distance (squared; null if base_failed) and kept.

    Null or empty text: counts of 0, so base_failed. Null lang or source: a value like another. Very long texts: counted whole. Ties and
    repeated rows: each counts. Each language and source has an estimate of its own, from a single row on; where H holds P rows or fewer the
    cut is infinite, so that such rows are kept unless base_failed. Empty table: empty result. Other columns pass through, but
    for the results' names; helper columns take names that docs does not have.
    """
    docs = docs.drop(*COUNTS, "base_failed", "kept", "_distance")
    names, inner = docs.columns, {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.withColumnsRenamed({c: n for c, n in inner.items() if c != "text"})
    text = lambda c: F.col(inner[c]).cast("string")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = with_counts(renamed).withColumn("base_failed", failed)
    est = F.to_json(F.struct(text("lang").alias("lang"), text("source").alias("source")))
    rows = stage(rows.withColumn("est", est).withColumns({f"_{k}{i}": x for k, of in (("x", transformed()), ("r", resolution())) for i, x in enumerate(of)}), "statistics")
    sound = rows.where("not base_failed")
    groups = stage(sound.groupBy("est").agg(F.array(*(F.avg(F.col(f"_r{i}") * F.col(f"_r{i}")) for i in range(P))).alias("floor"), F.count("*").alias("rows")), "groups")
    points = stage(sound.groupBy("est", *_X).agg(F.count("*").alias("n")), "points")
    params = _estimated(points, groups)
    clean = _with(sound, params.select("est", "m", "inv", "cut", F.col("rows"))).withColumn("_distance", _distance())
    clean = clean.withColumn("kept", F.col("_distance") <= F.col("cut"))
    bad = rows.where("base_failed").withColumns({"_distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    out = [F.col("text") if c == "text" else F.col(inner[c]).alias(c) for c in names]
    return clean.select(*out, *COUNTS, "base_failed", "_distance", "kept").unionByName(bad.select(*out, *COUNTS, "base_failed", "_distance", "kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents; nulls, empty and long texts, ties and repeats as in judge(). One more column: _distance."""
    got = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return got.select("doc_id", *COUNTS, "base_failed", "kept", "_distance")
