"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each document of a source, in shuffled order, has a virtual finish time: the source's words up to it divided by the source's target.
The mix is the stream of all documents, as often as `repeats` times each, in the order of that time, up to the budget, the size of all
sources. Targets add up to the budget, so the stream is cut at time 1, where every source has given its target:
the document of a source that is under way then is cut at the target, and so a source misses its target by less than a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, freed_name, stage, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Hexadecimal digits of the shuffle key that name a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3
#: A word with the white space before it.
_LED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Each source's target. sizes: (_src, _src_null, _source_size), a row for each source.

    Sources by code point, null last, get the weights in turn. A target stops at repeats times the
    source's size and the excess goes to the others by weight. With the sources by (cap / weight), the level
    that fills the budget is the largest of the levels left after capping each prefix.
    Sums are of whole numbers and each target has one division, so that SQL gets the same bits.
    """
    every = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_rank", F.row_number().over(every.orderBy("_src_null", "_src")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    x = ranked.withColumn("_w", weight).withColumn("_cap", (F.col("_source_size") * repeats).cast("double"))
    order = every.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    x = x.withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("_left", F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("_total", F.sum("_source_size").over(every))
    x = x.withColumn("_level", F.max((F.col("_total") - F.col("_before")) / F.col("_left")).over(every))
    target = F.round(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), 6)
    return x.select("_src", "_src_null", "_source_size", target.alias("_target"), "_total")


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """docs with columns _size, _source_size, _target, _total, _words and _finish: for each pass the words that the mix takes of the row
    and the row's virtual finish time; _words holds null for a pass that the row takes no part in.

    Rows of a source are shuffled by md5(seed, doc_id); passes 1 to `repeats` run over a source in that order.
    A row's virtual finish time in pass e is (words of its source up to it + (e - 1) * source size) / target.

    The running sum of a source is split: sums of 4096 buckets of the shuffle key first, then rows within a
    bucket, so that a source with a third of all rows is dealt over as many tasks. The sums come from a staged table of sizes.

    Null or empty text: size 0, part of a pass as its neighbours are, with no words. Null source: a source of its own,
    last. Null doc_id: one shuffle key, so such rows stay together. Ties and repeated rows: by doc_id, size and a hash of the text; each
    counts. Very long texts: counted whole. Empty table: empty result. Other columns pass through, but for the names of the results; helper
    columns take names that docs does not have.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_total", "_words", "_finish")
    h = {c: freed_name(docs, f"_{c}") for c in ("src", "src_null", "key", "bucket", "tie", "in_bucket", "start", "run")}
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.withColumns({
        h["src"]: F.coalesce(F.col("source"), F.lit("")), h["src_null"]: F.col("source").isNull(), "_size": word_count() if size is None else size,
        h["key"]: key, h["tie"]: F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long"),
    }).withColumn(h["bucket"], F.substring(h["key"], 1, BUCKET_DIGITS))
    source, keys = [h["src"], h["src_null"]], [h["src"], h["src_null"], h["bucket"]]
    buckets = stage(rows.groupBy(*keys).agg(F.sum("_size").alias(h["in_bucket"])), "mix-buckets")
    sizes = buckets.groupBy(*source).agg(F.sum(h["in_bucket"]).alias("_source_size"))
    of = targets(sizes.select(F.col(source[0]).alias("_src"), F.col(source[1]).alias("_src_null"), "_source_size"), weights, repeats)
    of = of.withColumnsRenamed({"_src": source[0], "_src_null": source[1]})
    before = F.sum(h["in_bucket"]).over(W.partitionBy(*source).orderBy(h["bucket"]).rowsBetween(W.unboundedPreceding, -1))
    starts = stage(buckets.select(*keys, F.coalesce(before, F.lit(0)).alias(h["start"])).join(of, source), "mix-starts")

    within = W.partitionBy(*keys).orderBy(h["key"], "doc_id", "_size", h["tie"]).rowsBetween(W.unboundedPreceding, 0)
    timed = rows.withColumn(h["run"], F.sum("_size").over(within)).join(starts, keys)
    upto = F.col(h["start"]) + F.col(h["run"])
    limit = F.floor("_target")
    words, finish = [], []
    for e in range(repeats):
        first = upto - F.col("_size") + F.col("_source_size") * e
        takes = (F.col("_size") > 0) & (first < limit) | (F.col("_size") == 0) & (first <= limit) & ((F.col("_source_size") > 0) | F.lit(e == 0))
        words.append(F.when(takes, F.least(F.col("_size"), limit - first)))
        finish.append(F.coalesce(F.try_divide((upto + F.col("_source_size") * e).cast("double"), F.col("_target")), F.lit(e + 1.0)))
    return timed.withColumns({"_words": F.array(*words), "_finish": F.array(*finish)}).drop(*h.values())


def placed(mixed: DataFrame) -> DataFrame:
    """mixed (rows of mix() with doc_id and source) with _place, the words of the mix before the row's first; null for a row without words in it.

    All parts of the stream are range-sorted by finish time, equal times by source, pass, shuffle key, doc_id and size; sums of the sorted
    partitions, a row each, give what comes before one, and running sums within partitions the rest. No time or row is hot: the
    order goes on to the row's own key. The stream ends at the budget.
    """
    parts = mixed.select("*", F.posexplode("_words").alias("_pass", "_part"), F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_key"))
    parts = parts.where((F.col("_pass") == 0) | (F.col("_part") > 0)).withColumns({"_time": F.get("_finish", F.col("_pass")), "_part": F.coalesce("_part", F.lit(0))})
    order = [F.col("_time"), F.col("source").asc_nulls_last(), F.col("_pass"), F.col("_key"), F.col("doc_id"), F.col("_size")]
    ranged = stage(parts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-order")
    sums = ranged.groupBy("_range").agg(F.sum("_part").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("_range", before.alias("_before")))  # a row for each partition of the sort
    run = F.sum("_part").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    place = F.col("_before") + run - F.col("_part")
    out = ranged.join(starts, "_range").withColumn("_place", F.when((F.col("_part") > 0) & (place < F.col("_total")), place))
    return out.where("_pass = 0").drop("_pass", "_part", "_key", "_time", "_range", "_before")


def op2(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; nulls, empty texts, ties and repeats as in mix(). One more column: first_place, as in placed()."""
    docs = table(spark, sf_dir, "documents")
    sizes = stage(docs.select("doc_id", "source", word_count().alias("words")), "mix-sizes")
    mixed = placed(mix(sizes, size=F.col("words")))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("taken"), F.col("_place").alias("first_place"),
    )


def stage_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; one under way at its source's target is cut after the words that are taken.

    Null and empty texts are taken as their neighbours are. Null doc_id or source, ties, repeated rows and very long texts: as in mix(). Empty
    table: empty result. All columns pass through, whatever their names; n_chars follows a text that is cut.
    """
    names, h = docs.columns, {c: f"_mix_{k}" for k, c in enumerate(docs.columns)}
    inner = docs.withColumnsRenamed({c: h[c] for c in names if c not in ("doc_id", "source", "text")})
    takes = mix(inner).withColumn("_taken", F.explode(F.filter("_words", lambda w: w.isNotNull())))
    cut = F.col("_taken") < F.col("_size")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_LED_WORD), F.lit(0)), F.lit(1), F.col("_taken").cast("int")), "")
    out = {c: F.col(c if c in ("doc_id", "source", "text") else h[c]) for c in names} | {"text": F.when(cut, head).otherwise(F.col("text"))}
    if "n_chars" in names:
        out["n_chars"] = F.when(cut, F.char_length(head).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return takes.select(*(out[c].alias(c) for c in names))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s),
w AS (SELECT *, (CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM r),
p AS (SELECT *,
        coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bef,
        sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft,
        sum(source_size) OVER () AS total
      FROM w),
l AS (SELECT *, max((total - bef) / lft) OVER () AS lvl FROM p),
t AS (SELECT source, source_size, total::BIGINT AS total, round(least(cap, lvl * w), 6) AS target FROM l),
c AS (SELECT d.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS run FROM d),
j AS (SELECT c.doc_id, c.source, c.k, c.size, c.run, t.source_size, t.target, t.total FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
i AS (SELECT j.*, e, CASE WHEN target = 0 THEN e + 1.0::DOUBLE ELSE (run + e * source_size)::DOUBLE / target END AS f,
             greatest(0, least(size, floor(target)::BIGINT - (run - size + e * source_size)))::BIGINT AS part
      FROM j, (SELECT unnest([0, 1, 2]) AS e)),
o AS (SELECT *, sum(part) OVER (ORDER BY f, source ASC NULLS LAST, e, k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - part AS place FROM i),
g AS (SELECT source, k, doc_id, size, run, sum(part)::BIGINT AS taken FROM i GROUP BY ALL)
SELECT o.doc_id, o.size, o.source_size, o.target, g.taken, CASE WHEN part > 0 AND place < total THEN place::BIGINT END AS first_place
FROM o JOIN g ON g.source IS NOT DISTINCT FROM o.source AND g.k = o.k AND g.doc_id IS NOT DISTINCT FROM o.doc_id AND g.size = o.size AND g.run = o.run
WHERE e = 0
"""
