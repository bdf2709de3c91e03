"""Vector quantisation: nearest codewords, residual levels, decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import dot, let, softmax
from .ordering import numbered
from .relational import dimension
from .staging import staged
from .stats import of_places

#: Numbers of a codebook whose codewords are all wanted for each row, as logits over them are. A larger one is refused.
MOST_NUMBERS = 1 << 24
#: Numbers of codewords that are broadcast and searched at once; rows a task compares at once, and products at once.
BLOCK, ROWS, CELLS = 1 << 22, 4096, 1 << 21


def codebook_row(codebook: DataFrame, name: str = "cb") -> DataFrame:
    """codebook (code, v) as one row with an array of all (code, v), by code."""
    numbers = codebook.agg(F.sum(F.size("v"))).first()[0] or 0
    if numbers > MOST_NUMBERS:
        raise ValueError(f"a codebook of {numbers} numbers; {MOST_NUMBERS} at most")
    return F.broadcast(codebook.agg(F.array_sort(F.collect_list(F.struct("code", "v"))).alias(name)))


def _nearest(r: np.ndarray, words: np.ndarray, codes: np.ndarray, best: "Best") -> None:
    """Take the codewords of a block into the best of each row: least squared distance, ties to the least code.

    A block whose norms are further from a row's than its best distance cannot hold a nearer one and is passed over. What the product form leaves within its
    rounding of the least is compared by differences, so distances and ties are exact.
    """
    norms, own = np.sqrt((words**2).sum(axis=1)), np.sqrt((r**2).sum(axis=1))
    gap = np.maximum(0, np.maximum(norms.min() - own, own - norms.max()))
    open_ = np.flatnonzero(gap**2 <= best.distance * (1 + 1e-9))
    step = max(1, CELLS // len(words))
    for at in range(0, len(open_), step):
        rows = open_[at : at + step]
        about = own[rows, None] ** 2 - 2 * r[rows] @ words.T + norms**2
        off = 1e-12 * len(words[0]) * (own[rows] ** 2 + norms.max() ** 2)
        i, j = np.nonzero(about <= (np.minimum(about.min(axis=1), best.distance[rows]) + 2 * off)[:, None])
        d = ((r[rows[i]] - words[j]) ** 2).sum(axis=1)
        order = np.lexsort((codes[j], d, i))
        first = order[np.concatenate([[True], np.diff(i[order]) > 0])] if len(order) else order
        at_row, d, j = rows[i[first]], d[first], j[first]
        nearer = (d < best.distance[at_row]) | ((d == best.distance[at_row]) & (codes[j] < best.code[at_row]))
        best.distance[at_row[nearer]], best.code[at_row[nearer]], best.word[at_row[nearer]] = d[nearer], codes[j[nearer]], words[j[nearer]]


@dataclass
class Best:
    """The nearest codeword of each row so far."""

    distance: np.ndarray
    code: np.ndarray
    word: np.ndarray


def _blocks(codebook: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, words) of a codebook, in blocks of BLOCK numbers by norm; one block where it is no larger."""
    book = codebook.select(F.col("code").cast("long").alias("code"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    size, numbers = book.agg(F.max(F.size("v")), F.sum(F.size("v"))).first()
    if not numbers:
        return
    whole = numbers <= BLOCK
    if not whole:
        book = numbered(book.withColumn("_norm", dot(F.col("v"), F.col("v"))), "_norm", "code", name="_n")
    each = BLOCK // size or 1
    for at in range(0, 1 if whole else -(-numbers // size), each):
        part = (book if whole else book.where(F.col("_n").between(at, at + each - 1))).select("code", "v").toArrow()
        words = part["v"].combine_chunks().flatten().to_numpy().reshape(-1, size)
        yield part["code"].to_numpy(), words


def _pass(rows: DataFrame, steps: list, schema: str, final: bool) -> DataFrame:
    """rows with the state columns of residual_search(), moved on by steps (codes, words, last of its level), which are broadcast. final: no level comes after them."""
    held = rows.sparkSession.sparkContext.broadcast(steps)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = held.value
        size = steps[0][1].shape[1]
        for batch in (part for whole in batches for part in (whole.slice(a, ROWS) for a in range(0, len(whole), ROWS))):
            state = {c: batch.column(columns.index(c)) for c in ("_rest", "_codes", "_d", "_code", "_word")}
            lists = state["_rest"]
            whole_ = np.array([x is not None and len(x) == size and None not in x for x in lists.to_pylist()], bool)
            pick = np.flatnonzero(whole_)
            rest = np.array(lists.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)
            d = np.array(state["_d"].fill_null(np.inf).to_numpy(zero_copy_only=False))[pick]
            code = np.array(state["_code"].fill_null(-1).to_numpy(zero_copy_only=False))[pick]
            word = np.array([x if x is not None else [0.0] * size for x in state["_word"].take(pa.array(pick)).to_pylist()], float).reshape(-1, size)
            best = Best(d, code, word)
            made = []
            for codes, words, last in steps:
                _nearest(rest, words, codes, best)
                if last:
                    made.append(best.code)
                    rest, done = rest - best.word, best
                    best = Best(np.full(len(pick), np.inf), np.full(len(pick), -1), np.zeros_like(rest))
            kept = done if steps[-1][2] else best
            full = lambda xs, none=None: [none if k is None else xs[k] for k in place]  # noqa: E731, B023
            place = [None] * len(batch)
            for k, row in enumerate(pick.tolist()):
                place[row] = k
            before = state["_codes"].to_pylist()
            new = [None if k is None else [*(before[row] or []), *(int(m[k]) for m in made)] for row, k in enumerate(place)]
            columns_ = dict(zip(columns, batch.columns, strict=True)) | {
                "_rest": pa.array(full(rest.tolist()), pa.list_(pa.float64())), "_codes": pa.array(new, pa.list_(pa.int64())), "_d": pa.array(full(kept.distance.tolist()), pa.float64()),
                "_code": pa.array(full(kept.code.tolist()), pa.int64()), "_word": pa.array(full(kept.word.tolist()), pa.list_(pa.float64())),
            }
            if steps[-1][2] and not final:  # the next level begins with nothing found
                columns_ |= {c: pa.nulls(len(batch), t) for c, t in (("_d", pa.float64()), ("_code", pa.int64()), ("_word", pa.list_(pa.float64())))}
            yield pa.RecordBatch.from_arrays(list(columns_.values()), names=list(columns_))

    return rows.mapInArrow(run, schema)


def residual_search(rows: DataFrame, codebooks: list[DataFrame], vector: str = "v") -> DataFrame:
    """rows with _codes, one for each level, _rest, what is left after them, and _code and _d, the last code and its squared distance.

    A codebook of any size is searched in blocks that are broadcast one after the other; blocks and levels that fit in one are one pass over the rows. A vector that is null, has nulls or
    another length than the codewords gets null.
    """
    out = rows.withColumns({
        "_rest": F.transform(vector, lambda x: x.cast("double")), "_codes": F.array().cast("array<bigint>"), "_d": F.lit(None).cast("double"), "_code": F.lit(None).cast("long"),
        "_word": F.lit(None).cast("array<double>"),
    })
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    group, passes = [], 0

    def passed(out: DataFrame, group: list, final: bool) -> DataFrame:
        nonlocal passes
        passes += 1
        out = _pass(out, list(group), schema, final)
        return staged(out, "search") if passes % 8 == 0 else out  # so that a task holds few blocks

    for level, book in enumerate(codebooks):
        blocks = _blocks(book)
        block = next(blocks, None)
        if block is None:
            raise ValueError("a codebook without codewords")
        while block:
            after = next(blocks, None)
            if group and sum(w.size for _, w, _ in group) + block[1].size > BLOCK:
                out, group = passed(out, group, False), []
            group.append((*block, after is None))
            block = after
        if level == len(codebooks) - 1:
            out = passed(out, group, True)
    return out


def assign(rows: DataFrame, codebook: DataFrame, vector: str = "v") -> DataFrame:
    """rows with code and dist, the nearest codeword and its squared distance; ties to the least code. Rows are not shuffled."""
    got = residual_search(rows, [codebook], vector)
    kind = codebook.schema["code"].dataType
    return got.withColumn("code", F.col("_code").cast(kind)).withColumn("dist", F.col("_d")).drop("_rest", "_codes", "_d", "_code", "_word")


def residual_assign(rows: DataFrame, codebooks: list[DataFrame], vector: str = "v") -> DataFrame:
    """rows with codes, one for each level, and error, the squared length of what is left; a level quantises the rest of those before."""
    got = residual_search(rows, codebooks, vector)
    out = got.withColumn("codes", F.col("_codes").cast("array<int>")).withColumn("error", F.when(F.col("_codes").isNotNull(), dot(F.col("_rest"), F.col("_rest"))))
    return out.drop("_rest", "_codes", "_d", "_code", "_word")


def decoded(codes: DataFrame, codebooks: list[DataFrame], pad: int = -1) -> DataFrame:
    """codes (.., codes) with v, the sum of their codewords; a pad code, and one that a codebook lacks, adds zeros. Codewords are looked up by a join for each level."""
    out, v = codes, None
    for k, book in enumerate(codebooks):
        size = book.agg(F.max(F.size("v"))).first()[0] or 0
        words = book.where(F.col("code") != pad).select(F.col("code").alias("_c"), F.transform("v", lambda x: x.cast("double")).alias(f"_v{k}"))
        out = out.join(dimension(words), F.get("codes", F.lit(k)) == F.col("_c"), "left").drop("_c")
        word = F.coalesce(F.col(f"_v{k}"), F.array_repeat(F.lit(0.0), size))
        v = word if v is None else F.zip_with(v, word, lambda a, b: a + b)
    return out.withColumn("v", v).drop(*(f"_v{k}" for k in range(len(codebooks))))


def soft_decoded(logits: Column, book: Column, temperature: float) -> Column:
    """Codewords weighted by the softmax of the logits."""
    zero = F.transform(book[0]["v"], lambda _: F.lit(0.0))
    add = lambda a, x: F.zip_with(a, x["c"]["v"], lambda s, y: s + x["p"] * y.cast("double"))
    return let(F.arrays_zip(softmax(logits, temperature).alias("p"), book.alias("c")), lambda pairs: F.aggregate(pairs, zero, add))


def tied_logits(h: Column, book: Column, log_scale: float) -> Column:
    return F.transform(book, lambda c: dot(h, c["v"]) * F.exp(F.lit(log_scale)))


def match_rate(a: DataFrame, b: DataFrame, key: list[str], code: str) -> DataFrame:
    """(n, rate, stale): how many codes agree; stale below 99 %."""
    j = a.select(*key, F.col(code).alias("_a")).join(b.select(*key, F.col(code).alias("_b")), key)
    rate = F.avg((F.col("_a") == F.col("_b")).cast("double"))
    return j.agg(F.count("*").alias("n"), rate.alias("rate"), (rate < 0.99).alias("stale"))


def fit_codebook(rows: DataFrame, size: int, rounds: int = 10, seed: int = 1, vector: str = "v") -> DataFrame:
    """(code, v): centres by k-means, distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=size, maxIter=rounds, seed=seed, featuresCol="_f").fit(rows.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    return rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "code int, v array<double>")


def moved_codebook(rows: DataFrame, codebook: DataFrame, decay: float = 0.99, least: float = 2.0, seed: str = "revive", vector: str = "v") -> DataFrame:
    """(code, v, weight): a step of moving averages over rows (id, v), for a codebook (code, v, weight).

    Weight and weighted sum of a codeword go towards the number and the sum of the rows nearest to it; v is their
    ratio. A codeword whose weight falls below `least` is dead: the k-th of them takes the row with the k-th least hash of id and
    weight `least`; where rows run out it stays as it is.
    """
    assigned = assign(rows, codebook.select("code", "v"), vector)
    size = codebook.agg(F.max(F.size("v"))).first()[0] or 0
    codes = assigned.groupBy("code").agg(F.count("*").alias("_n"), of_places(F.sum, vector, size).alias("_s"))
    at = codebook.join(codes, "code", "left")
    dims = F.transform("v", lambda x: x.cast("double"))
    old = at.withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_s", F.coalesce("_s", F.transform("v", lambda _: F.lit(0.0)))).withColumn("v", dims)
    # The new weight has a name of its own: within a lambda "weight" would mean the alias of the same select.
    old = old.withColumn("_w", decay * F.col("weight") + (1 - decay) * F.col("_n"))
    summed = F.zip_with("v", "_s", lambda v, s: decay * F.col("weight") * v + (1 - decay) * s)
    old = old.withColumn("_v", F.when(F.col("_w") > 0, F.transform(summed, lambda x: x / F.col("_w"))).otherwise(F.col("v")))
    new = old.select("code", F.col("_w").alias("weight"), F.col("_v").alias("v"))
    new = new.withColumn("_rank", F.when(F.col("weight") < least, F.row_number().over(W.partitionBy(F.col("weight") < least).orderBy("code"))))
    fresh = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(max(1, codebook.count()))
    fresh = fresh.select(F.row_number().over(W.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")).alias("_rank"), F.transform(vector, lambda x: x.cast("double")).alias("_fresh"))
    out = new.join(F.broadcast(fresh), "_rank", "left")  # of the codebook's own size
    return out.select("code", F.coalesce("_fresh", "v").alias("v"), F.when(F.col("_fresh").isNotNull(), F.lit(least)).otherwise(F.col("weight")).alias("weight"))


def cross_entropy(logits: Column, target: Column) -> Column:
    from ..functions.arrays import log_sum_exp

    return log_sum_exp(logits) - F.get(logits, target)


def leveled_loss(rows: DataFrame, level: str, logits: Column, target: Column, mask: Column, weights: dict[int, float]) -> DataFrame:
    """(level, ce, acc, weight, total): mean cross-entropy and accuracy of each level over the rows that the mask (0 or 1) keeps, and the sum over levels of weight * ce.

    A level that is masked whole has 0; levels without a weight have weight 0.
    """
    from ..functions.arrays import argmax

    kept = F.greatest(F.sum(mask), F.lit(1))
    hit = (argmax(logits) == target).cast("int")
    by = rows.groupBy(level).agg((F.sum(cross_entropy(logits, target) * mask) / kept).alias("ce"), (F.sum(hit * mask) / kept).alias("acc"))
    weight = F.lit(0.0)
    for k, w in weights.items():
        weight = F.when(F.col(level) == k, w).otherwise(weight)
    by = by.withColumn("weight", weight)
    return by.withColumn("total", F.sum(F.col("ce") * F.col("weight")).over(W.partitionBy(F.lit(0))))  # a row for each level


def bce_with_logits(x: Column, y: Column, positive_weight: float = 1.0) -> Column:
    """Binary cross-entropy in the stable form."""
    soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return positive_weight * y * soft(-x) + (1 - y) * soft(x)


def gaussian_nll(x: Column, mean: Column, log_var: Column) -> Column:
    return 0.5 * (log_var + (x - mean) * (x - mean) * F.exp(-log_var))


def mean_squared(a: Column, b: Column) -> Column:
    return F.avg((a - b) * (a - b))


