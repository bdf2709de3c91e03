"""Scalar functions: pitch and normal forms, label maps, text, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_RATE = 50
#: Special symbols of the vocabulary (fixed values).
SPECIAL = ("<pad>", "<bos>", "<eos>", "<sil>")
#: Valence and arousal bounds of the emotion rules (fixed values).
AROUSAL_LOW, AROUSAL_HIGH, VALENCE_HIGH, VALENCE_LOW = 0.35, 0.65, 0.55, 0.42


def log_pitch(hz: Column) -> Column:
    return F.log1p(hz)


def pitch_of_log(x: Column) -> Column:
    return F.expm1(x)


def voiced(hz: Column, above: float = 40.0) -> Column:
    return hz > above


def voicing_floor(hz: Column, floor: float = 30.0) -> Column:
    """0 below the floor."""
    return F.when(hz < floor, 0.0).otherwise(hz)


def z_score(x: Column, mean: Column, std: Column, eps: float = 0.0) -> Column:
    return (x - mean) / (std + eps)


def from_z(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def emotion_of(valence: Column, arousal: Column) -> Column:
    """Rules on valence and arousal; all bounds are strict, and what is between them is neutral."""
    by_valence = F.when(valence > VALENCE_HIGH, "happy").when(valence < VALENCE_LOW, "angry").otherwise("surprise")
    return F.when(arousal > AROUSAL_HIGH, by_valence).when(arousal < AROUSAL_LOW, "sad").otherwise("neutral")


def mapped(label: Column, to: dict[str, str | int], default: str | int) -> Column:
    """to[label], case and outer space aside; default for what it lacks and for null."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in to.items() for x in kv))[F.lower(F.trim(label))], F.lit(default))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("double"))


def knobs(index: Column, intensity: Column, n: int = 5) -> Column:
    """One-hot label and intensity; no label gives zeros and 0.5."""
    return F.when(index.isNull(), F.array(*[F.lit(0.0)] * n, F.lit(0.5))).otherwise(F.concat(one_hot(index, n), F.array(intensity)))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def padded_number(n: Column, width: int = 4) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def stripped(text: Column) -> Column:
    """Without outer white space of any kind (trim() takes spaces alone)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Split after . ! ? where white space follows."""
    return F.filter(F.transform(F.split(stripped(text), r"(?<=[.!?])\s+"), stripped), lambda s: s != "")


def merged_clauses(text: Column, most: int = 18) -> Column:
    """Sentences; one of more than `most` words is cut at commas and its clauses are joined again by ", " while they fit.

    Null: null. Empty text: no sentence. Clauses of white space alone are left out.
    """

    def n_words(s: Column) -> Column:
        return F.size(F.split(stripped(s), r"\s+"))

    def fold(state: Column, clause: Column) -> Column:
        held = F.concat_ws(", ", state["held"], clause)
        fits = (state["held"] != "") & (n_words(held) <= most)
        done = F.when(fits | (state["held"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["held"])))
        return F.struct(done.alias("done"), F.when(fits, held).otherwise(clause).alias("held"))

    def cut(sentence: Column) -> Column:
        clauses = F.filter(F.transform(F.split(sentence, r",\s*"), stripped), lambda c: c != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
        return F.when(n_words(sentence) <= most, F.array(sentence)).otherwise(F.aggregate(clauses, start, fold, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))))

    return F.flatten(F.transform(sentences(text), cut))


def gaps(text: Column, sentence_gap: float = 0.30, comma_gap: float = 0.12) -> Column:
    """Parts up to and with their delimiter: array of (part, gap seconds). What has no delimiter, the end of the text, has a sentence's gap."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?,;:—-]*[.!?,;:—-]?"), F.lit(0)), stripped), lambda p: p != "")
    gap = lambda p: F.when(p.rlike("[,;:—-]$"), comma_gap).otherwise(sentence_gap)
    return F.transform(parts, lambda p: F.struct(p.alias("part"), gap(p).alias("gap")))


#: Ends of sentences, and of phrases as well: fixed values.
SENTENCE, PHRASE = ".!?", ".!?,;:—–"


def sentences(text: Column, ends: str = SENTENCE) -> Column:
    """The parts of a text between white space that follows an end; ends stay with their parts."""
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), rf"(?<=[{ends}])\s+")


def blanks_silent(tokens: Column, silence: str = "<sil>") -> Column:
    """Symbols in which a blank is silence; other white space and empty tokens are left out."""
    kept = F.filter(tokens, lambda p: (p == " ") | ~p.rlike(r"^\s*$"))
    return F.transform(kept, lambda p: F.when(p == " ", silence).otherwise(p))


def silence_first(tokens: Column, silence: str = "<sil>") -> Column:
    """Silence, then the phonemes alone."""
    return F.concat(F.array(F.lit(silence)), F.filter(tokens, is_phoneme))


def silences_between(parts: Column, silence: str = "<sil>") -> Column:
    """The phonemes of an array of arrays of tokens with silence at the start, before each part but the first, and at the end. Parts without tokens are left out."""
    one = lambda p, i: F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.concat(F.when(i > 0, F.array(F.lit(silence))).otherwise(F.array().cast("array<string>")), F.filter(p, is_phoneme)))
    return F.concat(F.array(F.lit(silence)), F.flatten(F.transform(parts, one)), F.array(F.lit(silence)))


def is_phoneme(token: Column) -> Column:
    return token.rlike("^[A-Z]")


def is_special(symbol: Column) -> Column:
    return symbol.isin(*SPECIAL)


def rounded_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("long")


def learning_rate(step: Column, warm_up: int, total: int, floor: float = 0.0) -> Column:
    """Linear warm-up, then a cosine down to the floor, as shares of the top rate."""
    done = F.least(F.lit(1.0), (step - warm_up) / (total - warm_up))
    return F.when(step < warm_up, step / warm_up).otherwise(F.greatest(F.lit(floor), 0.5 * (1 + F.cos(done * math.pi))))


def guided(conditional: Column, unconditional: Column, scale: float) -> Column:
    return unconditional + scale * (conditional - unconditional)


def whole_duration(d: Column, scale: float = 1.0) -> Column:
    """At least 1; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(d * scale)).cast("int")


#: Word classes of the prosody presets: (duration scale, boost added to log pitch) (fixed values).
PROSODY = {
    "standard": {"content": (1.30, 0.05), "function": (0.70, -0.03), "other": (1.00, 0.0)},
    "charming": {"content": (1.40, 0.10), "function": (0.60, -0.05), "other": (1.00, 0.0)},
}
#: Parts of speech of the classes (fixed values).
CONTENT_TAGS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV", "NUM")
FUNCTION_TAGS = ("DET", "ADP", "AUX", "PRON", "CCONJ", "SCONJ", "PART")


def word_class(tag: Column) -> Column:
    return F.when(tag.isin(*CONTENT_TAGS), "content").when(tag.isin(*FUNCTION_TAGS), "function").otherwise("other")


def prosody(tag: Column, preset: str = "standard") -> Column:
    """(scale, boost) of a part of speech: the factor of its durations and what is added to its log pitch. Null tag: other."""
    kind, of = word_class(tag), PROSODY[preset]
    pick = lambda k: F.when(kind == "content", of["content"][k]).when(kind == "function", of["function"][k]).otherwise(of["other"][k])
    return F.struct(pick(0).alias("scale"), pick(1).alias("boost"))


def clock(seconds: Column) -> Column:
    """Hours and minutes, as 3h07m."""
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"), F.lpad(F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("string"), 2, "0"), F.lit("m"))
