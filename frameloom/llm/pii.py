"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence.

A protected entity is a found value (an address, a number) with its kind. A term is a run of letters and digits anywhere in a
text with an entity. Over the whole corpus, IC(e) = -log2 p(e) is what knowing the entity is worth and
PMI(t, e) = log2 p(t, e) / (p(t) p(e)) is how much of it the term gives away; p counts documents. A term that gives away
DISCLOSURE of an entity or more is sanitised wherever the entity stands in the same text, if that is more than chance:
either the entity stands in different surroundings and so many common documents are expected of at most FALSE_TERMS of all terms
that are as rare (upper tail of the hypergeometric distribution, times their number); or the term is always so near to the entity that
at most FALSE_TERMS words as rare are expected within that distance. Copies of a text show an entity in the same surroundings, which
is evidence once. So a name met once is found beside its entity, and a rare word elsewhere in the text of a corpus full of rare
words is left alone. A term is removed if it gives away all that the entity is worth, else replaced by a general word.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import in_parts, set_aside, size_bounded, stage, table

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.8
#: Terms that each of the two tests is expected to take for an entity where terms are independent of it.
FALSE_TERMS = 0.2
#: Counts of terms or entities that a task may hold (16 bytes each); those of the rarer ones are then met by joins only.
BROADCAST_TERMS = 1_000_000
#: Terms beside entities that a task holds before it passes them on.
HELD_TERMS = 500_000
#: Distinct terms that a task counts before it hands them on: about 40 MB of Python objects.
COUNTED_TERMS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits before a match would be its own first digits: the leftmost match starts where a run of digits starts.
_IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]++){3})")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches, found from each @ to the left: no rescans of long runs without one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        got = _DOMAIN.match(text, at) if start < at else None
        if got:
            done = got.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[Span]:
    """Spans (kind, start, end) in code points, by kind as listed and then start."""
    if not text:
        return []
    out = list(emails(text))
    digits = re.search("[0-9]", text)
    if not digits:
        return out
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        number = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(number) <= 19 and _luhn(number):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _key(text: str) -> int:
    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def entity_key(text: str, span: Span) -> int:
    kind, a, b = span
    value = text[a:b].lower() if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", text[a:b])
    return _key(f"{kind}:{value}")


def term_places(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """(term key, start, end) of each word outside the spans, in order."""
    covered, places = sorted((a, b) for _, a, b in spans), []
    k = 0
    for m in _WORD.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or m.end() <= covered[k][0]:
            places.append((_key(m[0].lower()), m.start(), m.end()))
    return places


def found(docs: DataFrame, text_where_clean: bool = True) -> DataFrame:
    """docs with _row, _base (struct of spans) and _entities (keys). text_where_clean False: no text for rows without an entity."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema, T.StructField("_base", span), T.StructField("_entities", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in in_parts(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            spans = [base_spans(t) for t in texts]
            keys = [sorted({entity_key(t, s) for s in got}) for t, got in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            if not text_where_clean:
                columns[at] = pa.array([t if got else None for t, got in zip(texts, spans, strict=True)], batch.schema.field(at).type)
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in got] for got in spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind), pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "_base", "_entities"])

    return numbered.mapInArrow(run, schema)


def _spans(row: list[dict]) -> list[Span]:
    return [(s["kind"], s["start"], s["end"]) for s in row]


def by_chance(n_te: int, n_t: int, n_e: int, total: int) -> float:
    """The chance that a term of n_t and an entity of n_e documents, independent of each other, share n_te or more of them."""
    if n_te <= max(0, n_t + n_e - total):
        return 1.0
    f = math.lgamma
    log = f(n_t + 1) - f(n_te + 1) - f(n_t - n_te + 1) + f(total - n_t + 1) - f(n_e - n_te + 1) - f(total - n_t - n_e + n_te + 1)
    term = math.exp(min(0.0, log - f(total + 1) + f(n_e + 1) + f(total - n_e + 1)))
    out, k = 0.0, n_te
    while term > 0 and k <= min(n_t, n_e):
        out += term
        if term < 1e-15 * out and (n_t - k) * (n_e - k) < (k + 1) * (total - n_t - n_e + k + 1):
            break
        term *= (n_t - k) * (n_e - k) / ((k + 1) * (total - n_t - n_e + k + 1))
        k += 1
    return min(1.0, out)


class Known:
    """The counts of the most frequent keys, as arrays; of any other key the count is at most rest."""

    def __init__(self, counts: DataFrame, key: str, n: str):
        low = 1  # a key without an entry has one document
        while counts.where(F.col(n) > low).count() > BROADCAST_TERMS:
            low *= 2
        got = counts.where(F.col(n) > low).select(key, n).toArrow()
        order = np.argsort(got[key].to_numpy())
        self.keys, self.n, self.rest = got[key].to_numpy()[order], got[n].to_numpy()[order], low

    def __call__(self, keys: np.ndarray, rest: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), rest)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], rest)


def distances(n_words: int, places: np.ndarray) -> np.ndarray:
    """Each word's distance in words, from 1, to the nearest place; places are sorted numbers of the words that follow them."""
    at = np.arange(n_words)
    k = np.searchsorted(places, at, "right")
    after = np.where(k > 0, at - places[np.maximum(k - 1, 0)] + 1, n_words + 1)
    before = np.where(k < len(places), places[np.minimum(k, len(places) - 1)] - at, n_words + 1)
    return np.minimum(after, before)


def _around(keys: np.ndarray, place: int) -> int:
    """32 bits of a hash of the words before and after a place."""
    a, b = (int(keys[k]) if 0 <= k < len(keys) else 0 for k in (place - 1, place))
    return ((a * 0x9E3779B97F4A7C15 + b) % (1 << 64) >> 32) - (1 << 31)


def together(rows: DataFrame, terms: DataFrame, entities: DataFrame, total: int) -> DataFrame:
    """(_row, entity, term, near, around) for each row's entities and terms, without those that cannot disclose by their counts.

    near: the term's least distance to the entity in words times the entity's places in the text; around: a hash of the words beside its first one.
    As n_te is at most n_e, a share of DISCLOSURE asks for n_t <= n_e (total / n_e) ** (1 - DISCLOSURE).
    """
    known = rows.sparkSession.sparkContext.broadcast((Known(terms, "term", "n_t"), Known(entities, "entity", "n_e")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_t, n_e = known.value
        for batch in in_parts(batches):
            out, held = [], 0
            for row, text, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = _spans(base)
                words = term_places(text, spans)
                if not words:
                    continue
                keys, starts = np.array([w[0] for w in words], np.int64), np.array([w[1] for w in words])
                order = np.argsort(keys, kind="stable")
                own, first = np.unique(keys[order], return_index=True)
                least = n_t(own, 1)
                places: dict[int, list[int]] = {}
                for span in spans:
                    places.setdefault(entity_key(text, span), []).append(int(np.searchsorted(starts, span[1])))
                of = np.array(sorted(places), np.int64)
                for e, n in zip(of.tolist(), n_e(of, n_e.rest).tolist(), strict=True):
                    some = least <= n * (total / n) ** (1 - DISCLOSURE) * (1 + 1e-9)
                    at = np.array(sorted(places[e]))
                    near = np.minimum.reduceat(distances(len(keys), at)[order], first)[some] * len(at)
                    around = _around(keys, int(at[0]))
                    out.append((np.full(len(near), row), np.full(len(near), e), own[some], np.minimum(near, 2**31 - 1), np.full(len(near), around)))
                    held += len(near)
                if held > HELD_TERMS:
                    yield _met(out)
                    out, held = [], 0
            if out:
                yield _met(out)

    return rows.select("_row", "text", "_base").mapInArrow(run, "_row long, entity long, term long, near int, around int")


def _met(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kinds = {"_row": pa.int64(), "entity": pa.int64(), "term": pa.int64(), "near": pa.int32(), "around": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class Rarity:
    """Of terms as rare as one of n_t documents: their number, and how many of them a word is on average. By powers of two of n_t."""

    def __init__(self, terms: DataFrame, n_words: int):
        power = F.when(F.col("n_t") > 1, F.length(F.bin(F.col("n_t") - 1))).otherwise(0)  # 64 rows at most
        got = {r.k: (r.n, r.places) for r in terms.groupBy(power.alias("k")).agg(F.count("*").alias("n"), F.sum("n_t").alias("places")).collect()}
        self.number, self.rate = (np.cumsum([got.get(k, (0, 0))[j] for k in range(65)]).tolist() for j in (0, 1))
        self.rate = [min(1.0, x / max(1, n_words)) for x in self.rate]

    def expected(self, n_te: int, n_t: int, n_e: int, near: int, varied: bool, total: int, chance=None) -> float:
        """The terms as rare that are expected to stand as near by chance, or to share as many documents: the lesser of both."""
        k = (n_t - 1).bit_length()
        close = 2 * near * self.rate[k]
        return min(close, self.number[k] * (chance or by_chance)(n_te, n_t, n_e, total)) if varied and close > FALSE_TERMS else close


def disclosing(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, whole): the terms that give entities away; and together(). docs: (text), all; rows: those of found() with an entity."""
    total = max(1, docs.count())
    counted = stage(_document_counts(docs), "terms")
    terms = counted.where(F.col("term").isNotNull())
    entities = stage(rows.select(F.explode("_entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")), "entities")
    rarity = Rarity(terms, counted.where(F.col("term").isNull()).agg(F.sum("n_t")).first()[0] or 0)
    both = stage(together(rows, terms, entities, total), "together")
    varied = F.min("around") < F.max("around")
    x = both.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.max("near").alias("near"), varied.alias("varied"))
    x = x.join(size_bounded(entities, BROADCAST_TERMS), "entity").join(terms, "term")
    worth = -F.log2(F.col("n_e") / float(total))
    told = F.log2(F.col("n_te") * float(total) / (F.col("n_t") * F.col("n_e")))
    x = x.withColumn("share", F.when(worth > 0, told / worth).otherwise(0.0)).withColumn("whole", F.col("n_te") >= F.col("n_t"))
    x = x.where(F.col("share") >= DISCLOSURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = functools.lru_cache(100_000)(by_chance)
        for batch in batches:
            n = zip(*(batch.column(k).to_pylist() for k in range(3, 8)), strict=True)
            yield batch.select([0, 1, 2]).filter(pa.array([rarity.expected(*a, total, chance) <= FALSE_TERMS for a in n], pa.bool_()))

    told = x.select("entity", "term", "whole", "n_te", "n_t", "n_e", "near", "varied").mapInArrow(run, "entity long, term long, whole boolean")
    return told, both.select("_row", "entity", "term")


def counted_terms(n: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.int64()), pa.array(n.values(), pa.int64())], names=["term", "n"])


def _document_counts(docs: DataFrame) -> DataFrame:
    """(term, n_t): documents that hold each term; under null, the words of all documents."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        n_words = 0
        for batch in in_parts(batches):
            for text in batch.column(0).to_pylist():
                words = _WORD.findall(text or "")
                n_words += len(words)
                n.update({w.lower() for w in words})
                if len(n) > COUNTED_TERMS:
                    yield counted_terms(_by_key(n))
                    n.clear()
        yield counted_terms(_by_key(n) | {None: n_words})

    return docs.select("text").mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _by_key(n: Counter) -> dict[int, int]:
    return {_key(w): k for w, k in n.items()}


def protect(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs with _spans (all spans joined), _base_spans (base ones joined), n_<kind>, and text sanitised.

    Null or empty text: no span. Repeated rows: each on its own. Null doc_id and other columns pass through; columns of the results' names are replaced. Base
    spans become [EMAIL], [IP], [CARD], [PHONE]; a disclosing term goes, or becomes [TERM]. Where spans overlap, the first
    stands, of two that start together the longer. Long texts are searched whole. Terms tied in counts and distance are judged alike. Empty table: empty result. keep_text False: text stays unset, for callers that only want spans.
    """
    docs = docs.drop("_row", "_base", "_entities", "_terms", "_whole", "_base_spans", "_spans", *(f"n_{k}" for k in KINDS))
    rows = stage(found(docs, text_where_clean=keep_text), "personal")
    touched = rows.where(F.size("_entities") > 0)
    told, both = disclosing(docs, touched)
    by_row = both.join(size_bounded(stage(told, "disclosing"), BROADCAST_TERMS), ["entity", "term"])
    by_row = by_row.groupBy("_row").agg(F.collect_set("term").alias("_terms"), F.collect_set(F.when(F.col("whole"), F.col("term"))).alias("_whole"))
    more = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("_base_spans", T.StringType()), T.StructField("_spans", T.StringType())]
    schema = T.StructType([*docs.schema, *more])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            column = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            texts, out = column["text"].to_pylist(), {f.name: [] for f in more}
            for k, (base, terms, whole) in enumerate(zip(*(column[c].to_pylist() for c in ("_base", "_terms", "_whole")), strict=True)):
                spans = _spans(base)
                own = set(terms or ())
                added = [(t, a, b) for t, a, b in term_places(texts[k], spans) if t in own] if own else []
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                out["_base_spans"].append(joined(spans))
                out["_spans"].append(joined(spans + [("term", a, b) for _, a, b in added]))
                if spans and keep_text:
                    gone = set(whole or ())
                    marks = [(a, b, f"[{kind.upper()}]") for kind, a, b in spans] + [(a, b, "" if t in gone else "[TERM]") for t, a, b in added]
                    texts[k] = replaced(texts[k], marks)
            arrays = [pa.array(texts, batch.schema.field("text").type) if c == "text" else column[c] for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(out[f.name], pa.int64() if f.name[0] == "n" else pa.string()) for f in more)], names=[*names, *out])

    # Only rows with an entity meet the join; the others go by it.
    none = F.lit(None).cast("array<bigint>")
    clean = rows.where(F.size("_entities") == 0).select(*names, "_base", none.alias("_terms"), none.alias("_whole"))
    dirty = touched.join(by_row, "_row", "left").select(*names, "_base", "_terms", "_whole")
    return clean.unionByName(dirty).mapInArrow(run, schema)


def replaced(text: str, marks: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if a >= at:
            out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op7(spark, sf_dir: str) -> DataFrame:
    """Spans of all documents; nulls, empty and long texts and repeats as in protect()."""
    got = protect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return got.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("_base_spans", 256).alias("base_sha256"), F.col("_spans").alias("spans"))


def stage_pii(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with personal data and what discloses it replaced; n_chars follows the text.

    Null and empty texts stay as they are. Null doc_id, ties and repeated rows: each row on its own. Very long texts: whole. Empty table: empty
    result. All columns pass through, whatever their names.
    """
    inner, names = set_aside(docs, "text")
    got = protect(inner)
    out = {c: F.col(n) for c, n in names.items()}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("_spans") == "", out["n_chars"]).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*(x.alias(c) for c, x in out.items()))
