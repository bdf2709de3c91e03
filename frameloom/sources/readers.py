"""Readers: listings, keyed JSON, logs, transcripts, alignments, waveforms. Schemas are declared, never inferred."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import auto_log_pitch, reconciled, same_length

METRICS = "type string, step bigint, epoch bigint, lr double, losses map<string,double>, grad_ratios map<string,double>, name string, payload map<string,double>, wall double"


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, key, length): the files under root; key is the name without its suffix. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("key"), "length")


def partitioned_listing(spark: SparkSession, root: str, pattern: str, low: int, high: int) -> DataFrame:
    """(speaker, emotion, key, path) of root/<speaker>/<emotion>/<file>: speakers that are numbers within the bounds, emotions that don't begin with two underscores."""
    parts = [F.regexp_extract("path", r"/([^/]+)/([^/]+)/[^/]+$", k) for k in (1, 2)]
    x = listing(spark, root, pattern).select(parts[0].try_cast("int").alias("speaker"), parts[1].alias("emotion"), "key", "path")
    return x.where(F.col("speaker").between(low, high) & ~F.col("emotion").startswith("__"))


def features(df: DataFrame, strict: bool = False, log_pitch: bool = False) -> DataFrame:
    """Feature rows with the series cut to their least length, or an error where they differ if strict. df: (ema, pitch, loudness, ...), from Parquet or from files of arrays."""
    columns = [F.col(c) for c in ("ema", "pitch", "loudness")]
    if strict:
        df = df.withColumn("pitch", same_length(F.col("pitch").cast("array<double>"), F.col("ema"), F.col("loudness")))
    else:
        df = df.withColumns(dict(zip(("ema", "pitch", "loudness"), reconciled(*columns), strict=True)))
    return df.withColumn("pitch", auto_log_pitch(F.col("pitch").cast("array<double>"))) if log_pitch else df


def keyed_json(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(key, record) of JSON files that hold one map from key to record. record: a DDL type."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{record}>")).alias("key", "record"))


def metrics_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Relations step, epoch and audit of a JSON-lines log; broken lines are left out."""
    log = spark.read.schema(METRICS).option("mode", "DROPMALFORMED").json(path)
    return {k: log.where(F.col("type") == k) for k in ("step", "epoch", "audit")}


def transcripts(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """(utt_id, text, emotion) of tab-separated lines with `least` fields or more."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(fields) >= least)
    return rows.select(F.trim(fields[0]).alias("utt_id"), F.trim(fields[1]).alias("text"), F.trim(F.get(fields, F.lit(2))).alias("emotion"))


def intervals(text: Column, tier: str = "phones") -> Column:
    """array of (xmin, xmax, label) of the tier of that name in a TextGrid; empty without one."""
    body = F.regexp_extract(text, rf'(?s)name = "{tier}"(.*?)(?:item \[\d+\]|\z)', 1)
    pattern = r'xmin = ([0-9.]+)\s+xmax = ([0-9.]+)\s+text = "([^"]*)"'
    one = [F.regexp_extract_all(body, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    rows = F.arrays_zip(one[0].alias("a"), one[1].alias("b"), one[2].alias("c"))
    return F.transform(rows, lambda r: F.struct(r["a"].cast("double").alias("xmin"), r["b"].cast("double").alias("xmax"), r["c"].alias("label")))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """x at n places: its spectrum cut or filled with zeros. The part at half the lower rate is shared by two frequencies."""
    if n == len(x) or not len(x) or n < 1:
        return x[:n]
    both = min(n, len(x))
    spectrum = np.fft.rfft(x)[: both // 2 + 1]
    if both % 2 == 0:
        spectrum[both // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(spectrum, n) * (n / len(x))


#: Samples in WAV contents, by format tag (1 PCM, 3 IEEE float) and bits, and their full scale.
_SAMPLES = {(1, 16): ("<i2", 2**15), (1, 32): ("<i4", 2**31), (3, 32): ("<f4", 1), (3, 64): ("<f8", 1)}


def wav(content: bytes) -> tuple[np.ndarray, int]:
    """(samples in rows of channels, rate) of a WAV content: PCM of 16 or 32 bits by its full scale, IEEE floats as they are."""
    chunks, at = {}, 12
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        chunks.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE" or not {b"fmt ", b"data"} <= chunks.keys():
        raise ValueError("no WAV content")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
    if tag == 0xFFFE:  # extensible: the tag stands in the subformat
        tag = struct.unpack_from("<H", chunks[b"fmt "], 24)[0]
    if (tag, bits) not in _SAMPLES:
        raise ValueError(f"WAV format {tag} of {bits} bits")
    kind, full = _SAMPLES[tag, bits]
    width = channels * bits // 8
    x = np.frombuffer(chunks[b"data"][: len(chunks[b"data"]) // width * width], kind)
    return x.reshape(-1, channels) / full, rate


def waveforms(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """(path, samples) of WAV contents (path, content): mixed to mono and brought to the rate through its spectrum."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for content in pdf["content"]:
                x, own = wav(bytes(content))
                x = x.mean(axis=1)
                out.append(resampled(x, round(len(x) * rate / own)).tolist())
            yield pd.DataFrame({"path": pdf["path"], "samples": out})

    return files.select("path", "content").mapInPandas(run, T.StructType([T.StructField("path", T.StringType()), T.StructField("samples", T.ArrayType(T.DoubleType()))]))
