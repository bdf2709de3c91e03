"""Order and samples, scalars, vector quantisation, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..operators import ordering as O
from ..operators import quantize as V
from .base import FRAMES, SEGS, frames, long, query, r6, segs, table

_HASH = "('0x' || substr(md5('{}:' || {}::VARCHAR), 1, 8))::BIGINT"


def _hash(seed: str, key: str) -> str:
    return _HASH.format(seed, key)


@query("ord_01_sorted_ids", "SELECT source, min(lang) AS first, (row_number() OVER (ORDER BY source))::INTEGER AS rn FROM documents GROUP BY source")
def sorted_ids(spark, d):
    from pyspark.sql import Window as W

    s = table(spark, d, "documents").groupBy("source").agg(F.min("lang").alias("first"))
    return s.withColumn("rn", F.row_number().over(W.orderBy("source")))  # a row for each source


@query("ord_02_descending", "SELECT n_nationkey, (row_number() OVER (ORDER BY n_name DESC))::INTEGER AS rn FROM nation")
def descending(spark, d):
    from pyspark.sql import Window as W

    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(W.orderBy(F.desc("n_name"))).alias("rn"))


@query("ord_03_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("ord_04_most_common", "SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def most_common(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("ord_05_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS i FROM embeddings")
def argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", A.argmax(F.col("embedding")).alias("i"))


_SCORED = f"""WITH {SEGS}, b AS (SELECT utt, pos, least(dur, 3) / greatest(dur, 3)::DOUBLE + 0.25 * (phone = 'view')::INTEGER AS score FROM segs)"""


def _scored(spark, d):
    s = F.least("dur", F.lit(3)) / F.greatest("dur", F.lit(3)) + 0.25 * (F.col("phone") == "view").cast("int")
    return segs(spark, d).select("utt", "pos", s.alias("score"))


@query("ord_06_best_match", _SCORED + " SELECT utt, pos, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY utt ORDER BY score DESC, pos) = 1")
def best_match(spark, d):
    return O.best_of(_scored(spark, d), "utt", "score", "pos").select("utt", "pos", r6("score").alias("score"))


@query("ord_07_top_k_ties", _SCORED + " SELECT utt, pos FROM b QUALIFY rank() OVER (PARTITION BY utt ORDER BY score DESC) <= 3")
def top_k_ties(spark, d):
    return O.top_k(_scored(spark, d), "utt", "score", 3, True, "pos").select("utt", "pos")


@query("ord_08_top_k", _SCORED + " SELECT utt, pos FROM b QUALIFY row_number() OVER (PARTITION BY utt ORDER BY score DESC, pos) <= 3")
def top_k(spark, d):
    return O.top_k(_scored(spark, d), "utt", "score", 3, False, "pos").select("utt", "pos")


@query(
    "ord_09_draw",
    _SCORED + f""", e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY utt)) / 0.7) AS e FROM b),
      c AS (SELECT *, sum(e) OVER (PARTITION BY utt ORDER BY pos) / sum(e) OVER (PARTITION BY utt) AS c FROM e)
      SELECT utt, pos FROM c WHERE c > {_hash('draw', 'utt')} / 4294967296.0 QUALIFY row_number() OVER (PARTITION BY utt ORDER BY pos) = 1""",
)
def draw(spark, d):
    return O.drawn(_scored(spark, d), "utt", "pos", "score", 0.7, "draw").select("utt", "pos")


@query("ord_10_sample", f"SELECT doc_id FROM documents ORDER BY {_hash('s', 'doc_id')}, doc_id LIMIT 50")
def sample(spark, d):
    return O.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, "s")


@query("ord_11_split", f"SELECT doc_id, CASE WHEN {_hash('42', 'doc_id')} < 429496729 THEN 'val' ELSE 'train' END AS split FROM documents")
def split(spark, d):
    return O.split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, "42")


@query(
    "ord_12_group_split",
    f"SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY {_hash('g', 'event_id')}, event_id) <= greatest(1, floor(count(*) OVER (PARTITION BY user_id) * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM events",
)
def group_split(spark, d):
    return O.group_split(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 0.1, "g").select("event_id", "split")


_BATCHES = "WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM documents)"


@query(
    "ord_13_length_batches",
    f"""{_BATCHES}, p AS (SELECT batch, row_number() OVER (ORDER BY {_hash('e1', 'batch')}, batch) - 1 AS place FROM (SELECT DISTINCT batch FROM b))
        SELECT doc_id, batch::BIGINT AS batch, place::BIGINT AS place FROM b JOIN p USING (batch)""",
)
def length_batches(spark, d):
    return O.batches(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 16, "e1").select("doc_id", "batch", "place")


@query(
    "ord_14_fixed_batch",
    f"""WITH s AS (SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_hash('b', 'event_id')}, event_id) <= 64),
        n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1)
        SELECT user_id, event_id, value FROM s UNION ALL SELECT user_id, NULL, 0.0 FROM (SELECT user_id, unnest(range(n, 64)) FROM n WHERE n < 64)""",
)
def fixed_batch(spark, d):
    """Some users have more than 64 events, some fewer."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return O.fixed_batch(e, "user_id", "event_id", 64, "b", {"value": F.lit(0.0)})


@query("ord_15_round_robin", "SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 4)::INTEGER AS slot FROM events")
def round_robin(spark, d):
    return O.round_robin(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 4).select("event_id", "slot")


@query("scl_01_split", "SELECT p_partkey, string_split(p_type, ' ')[1] AS first, len(string_split(p_type, ' '))::BIGINT AS n FROM part")
def split_text(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("first"), long(F.size(F.split("p_type", " "))).alias("n"))


@query("scl_02_strings", "SELECT n_nationkey, lower(trim(n_name)) AS name, lpad(n_nationkey::VARCHAR, 4, '0') AS number, starts_with(n_name, 'NATION_1') AS s, ends_with(n_name, '0') AS e FROM nation")
def strings(spark, d):
    n = F.col("n_name")
    return table(spark, d, "nation").select("n_nationkey", F.lower(F.trim(n)).alias("name"), S.padded_number(F.col("n_nationkey")).alias("number"), n.startswith("NATION_1").alias("s"), n.endswith("0").alias("e"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "scl_03_clauses",
    rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_STRIP.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ss FROM documents),
      p AS (SELECT doc_id, flatten(list_transform(ss, lambda s: CASE
          WHEN len(regexp_split_to_array(s, '\s+')) <= 18 THEN [s]
          WHEN len(list_filter(regexp_split_to_array(s, ',\s*'), lambda c: {_STRIP.format('c')} <> '')) = 0 THEN CAST([] AS VARCHAR[])
          ELSE list_reduce(list_transform(list_filter(list_transform(regexp_split_to_array(s, ',\s*'), lambda c: {_STRIP.format('c')}), lambda c: c <> ''), lambda c: [c]),
            lambda a, x: CASE WHEN len(regexp_split_to_array(a[len(a)] || ', ' || x[1], '\s+')) <= 18 THEN list_concat(a[1:len(a) - 1], [a[len(a)] || ', ' || x[1]]) ELSE list_concat(a, x) END) END)) AS cs FROM s)
      SELECT doc_id, (generate_subscripts(cs, 1) - 1)::INTEGER AS i, unnest(cs) AS clause FROM p""",
)
def clauses(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.merged_clauses(F.col("text"))).alias("i", "clause"))


@query(
    "scl_04_gaps",
    rf"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?,;:—-]*[.!?,;:—-]?'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')) AS part FROM documents)
      SELECT doc_id, count(*)::BIGINT AS parts, round(sum(CASE WHEN part[-1:] IN (',', ';', ':', '—', '-') THEN 0.12::DOUBLE ELSE 0.30::DOUBLE END), 6) AS seconds FROM p GROUP BY 1""",
)
def gaps(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.gaps(F.col("text"))).alias("i", "g")).groupBy("doc_id").agg(F.count("*").alias("parts"), r6(F.sum("g.gap")).alias("seconds"))


def _dialect(name: str, ends: str) -> str:
    """(doc_id, ps) by the silences between parts that end in one of `ends`."""
    return rf"""{name} AS (SELECT doc_id, list_concat(list_concat(['<sil>'], flatten(list_transform(parts, lambda p, i: CASE WHEN p = '' THEN []::VARCHAR[] ELSE
        list_concat(CASE WHEN i > 1 THEN ['<sil>'] ELSE []::VARCHAR[] END, list_filter(string_split(p, ' '), lambda x: regexp_matches(x, '^[A-Z]'))) END))), ['<sil>']) AS ps
      FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([{ends}])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents))"""


_COUNTED = "array_to_string(ps, ' ')"


@query(
    "scl_05_silences",
    rf"""WITH {_dialect('sentence', '.!?')}, {_dialect('phrase', '.!?,;:—–')},
        first AS (SELECT doc_id, list_concat(['<sil>'], list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[A-Z]'))) AS ps FROM documents),
        blank AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, ' |[^ ]+'), lambda x: x = ' ' OR NOT regexp_matches(x, '^\s*$')), lambda x: CASE WHEN x = ' ' THEN '<sil>' ELSE x END) AS ps FROM documents)
        SELECT doc_id, 'sentence' AS dialect, len(ps)::BIGINT AS n, md5({_COUNTED}) AS ps FROM sentence UNION ALL SELECT doc_id, 'phrase', len(ps)::BIGINT, md5({_COUNTED}) FROM phrase
        UNION ALL SELECT doc_id, 'first', len(ps)::BIGINT, md5({_COUNTED}) FROM first UNION ALL SELECT doc_id, 'blank', len(ps)::BIGINT, md5({_COUNTED}) FROM blank""",
)
def silences(spark, d):
    """Words that begin with a capital stand for phonemes."""
    docs = table(spark, d, "documents")
    tokens = lambda parts: F.transform(parts, lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, " ")))
    made = {
        "sentence": S.silences_between(tokens(S.sentences(F.col("text")))), "phrase": S.silences_between(tokens(S.sentences(F.col("text"), S.PHRASE))),
        "first": S.silence_first(F.split("text", " ")), "blank": S.blanks_silent(F.regexp_extract_all("text", F.lit(" |[^ ]+"), F.lit(0))),
    }
    rows = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("dialect"), ps.alias("ps")) for k, ps in made.items()))).alias("r"))
    return rows.select("doc_id", "r.dialect", long(F.size("r.ps")).alias("n"), F.md5(F.array_join("r.ps", " ")).alias("ps"))


@query("scl_06_regex", "SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def regex(spark, d):
    return table(spark, d, "pages").select("page_id", long(F.regexp_count("html", F.lit("<li>"))).alias("items"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query("scl_07_math", "SELECT event_id, round(sqrt(value), 6) AS a, round(1 / (1 + exp(-value / 100)), 6) AS b, round(tanh(value / 100), 6) AS c, floor(value / 7)::BIGINT AS e, round(greatest(least(value, 90), 10), 6) AS f FROM events")
def math_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r6(F.sqrt(v)).alias("a"), r6(1 / (1 + F.exp(-v / 100))).alias("b"), r6(F.tanh(v / 100)).alias("c"), F.floor(v / 7).alias("e"), r6(F.greatest(F.least(v, F.lit(90.0)), F.lit(10.0))).alias("f"))


@query("scl_08_schedule", "SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100.0 ELSE greatest(0.05, 0.5 * (1 + cos(pi() * least(1.0, (event_id - 100) / 900.0)))) END, 6) AS rate FROM events")
def schedule(spark, d):
    return table(spark, d, "events").select("event_id", r6(S.learning_rate(F.col("event_id"), 100, 1000, 0.05)).alias("rate"))


@query("scl_09_clock", "SELECT event_id, (event_id // 3600)::VARCHAR || 'h' || lpad(((event_id % 3600) // 60)::VARCHAR, 2, '0') || 'm' AS eta, epoch(date_trunc('second', ts))::BIGINT AS wall FROM events")
def clock(spark, d):
    return table(spark, d, "events").select("event_id", S.clock(F.col("event_id")).alias("eta"), F.unix_timestamp("ts").alias("wall"))


@query("scl_10_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("scl_11_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 ELSE 0 END AS v FROM events")
def map_functions(spark, d):
    return table(spark, d, "events").select("event_id", S.mapped(F.col("event_type"), {"click": 10, "view": 20}, 0).alias("v"))


@query("scl_12_round_up", "SELECT doc_id, (ceil(n_chars / 16.0) * 16)::BIGINT AS n16, (ceil(n_chars / 100.0) * 100)::BIGINT AS n100 FROM documents")
def round_up(spark, d):
    return table(spark, d, "documents").select("doc_id", S.rounded_up(F.col("n_chars"), 16).alias("n16"), S.rounded_up(F.col("n_chars"), 100).alias("n100"))


@query(
    "scl_13_prosody",
    """SELECT event_id, CASE WHEN tag IN ('NOUN', 'NUM') THEN 1.30 WHEN tag = 'DET' THEN 0.70 ELSE 1.00 END::DOUBLE AS scale, CASE WHEN tag IN ('NOUN', 'NUM') THEN 0.05 WHEN tag = 'DET' THEN -0.03 ELSE 0.0 END::DOUBLE AS boost,
              CASE WHEN tag IN ('NOUN', 'NUM') THEN 1.40 WHEN tag = 'DET' THEN 0.60 ELSE 1.00 END::DOUBLE AS charming_scale, CASE WHEN tag IN ('NOUN', 'NUM') THEN 0.10 WHEN tag = 'DET' THEN -0.05 ELSE 0.0 END::DOUBLE AS charming_boost
       FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'NOUN' WHEN 'purchase' THEN 'NUM' WHEN 'view' THEN 'DET' ELSE 'X' END AS tag FROM events)""",
)
def prosody(spark, d):
    tag = S.mapped(F.col("event_type"), {"click": "NOUN", "purchase": "NUM", "view": "DET"}, "X")
    p = table(spark, d, "events").select("event_id", S.prosody(tag).alias("p"), S.prosody(tag, "charming").alias("c"))
    return p.select("event_id", "p.scale", "p.boost", F.col("c.scale").alias("charming_scale"), F.col("c.boost").alias("charming_boost"))


@query("scl_14_guidance", "SELECT l_orderkey, l_linenumber, round(l_tax + 2.5 * (l_discount - l_tax), 6) AS g FROM lineitem")
def guidance(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(S.guided(F.col("l_discount"), F.col("l_tax"), 2.5)).alias("g"))


@query("scl_15_whole_duration", "SELECT event_id, greatest(1, round_even(value / 10, 0))::INTEGER AS d FROM events")
def whole_duration(spark, d):
    return table(spark, d, "events").select("event_id", S.whole_duration(F.col("value") / 10).alias("d"))


@query("scl_16_special", "SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 0.0 ELSE value END AS delta FROM events")
def special(spark, d):
    s = F.when(F.col("event_type").isin("view", "error"), "<sil>").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.when(S.is_special(s), 0.0).otherwise(F.col("value")).alias("delta"))


# Codebooks: the first 16 vectors, and the next 16 as a second level.
_BOOK = """book AS (SELECT vec_id::INTEGER AS code, embedding AS v FROM embeddings WHERE vec_id < 16), q AS (SELECT vec_id, embedding AS v, label FROM embeddings WHERE vec_id >= 32)"""
_DIST = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i]::DOUBLE - b.v[i]::DOUBLE) * (a.v[i]::DOUBLE - b.v[i]::DOUBLE)))"
_NEAREST = f"""n AS (SELECT vec_id, label, code, dist FROM (SELECT a.vec_id, a.label, b.code, {_DIST} AS dist FROM q a, book b) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1)"""


def _books(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("embedding", "v")
    first = e.where("vec_id < 16").select(F.col("vec_id").cast("int").alias("code"), "v")
    second = e.where("vec_id >= 16 and vec_id < 32").select((F.col("vec_id") - 16).cast("int").alias("code"), F.transform("v", lambda x: x * F.lit(0.5)).alias("v"))
    return e.where("vec_id >= 32"), first, second


@query("vq_01_nearest", f"WITH {_BOOK}, {_NEAREST} SELECT vec_id, code, round(dist, 6) AS dist FROM n")
def nearest(spark, d):
    q, book, _ = _books(spark, d)
    return V.assign(q, book).select("vec_id", "code", r6("dist").alias("dist"))


@query(
    "vq_02_residual",
    f"""WITH {_BOOK}, {_NEAREST}, second AS (SELECT (vec_id - 16)::INTEGER AS code, list_transform(embedding, lambda x: x::DOUBLE * 0.5) AS v FROM embeddings WHERE vec_id >= 16 AND vec_id < 32),
        r AS (SELECT q.vec_id, n.code AS c0, list_transform(range(1, 65), lambda i: q.v[i]::DOUBLE - book.v[i]::DOUBLE) AS v FROM q JOIN n USING (vec_id) JOIN book ON book.code = n.code)
        SELECT vec_id, c0, code AS c1, round(dist, 6) AS error FROM (SELECT a.vec_id, a.c0, b.code, {_DIST} AS dist FROM r a, second b) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1""",
)
def residual(spark, d):
    q, first, second = _books(spark, d)
    r = V.residual_assign(q, [first, second])
    return r.select("vec_id", F.col("codes")[0].alias("c0"), F.col("codes")[1].alias("c1"), r6("error").alias("error"))


@query(
    "vq_03_decode",
    f"WITH {_BOOK}, {_NEAREST} SELECT n.vec_id, round(book.v[1]::DOUBLE, 6) AS x0, round(book.v[64]::DOUBLE, 6) AS x63 FROM n JOIN book USING (code)",
)
def decode(spark, d):
    q, book, _ = _books(spark, d)
    got = V.decoded(V.assign(q, book).select("vec_id", F.array("code").alias("codes")), [book])
    return got.select("vec_id", r6(F.col("v")[0]).alias("x0"), r6(F.col("v")[63]).alias("x63"))


@query("vq_04_fit_codebook")
def fit_codebook(spark, d):
    q, _, _ = _books(spark, d)
    return V.fit_codebook(q, 8).select("code", long(F.size("v")).alias("n"))


@query(
    "vq_04_moved_codebook",
    f"""WITH {_BOOK}, {_NEAREST}, c AS (SELECT code, count(*) AS n, sum(q.v[1]::DOUBLE) AS s0, sum(q.v[64]::DOUBLE) AS s63 FROM n JOIN q USING (vec_id) GROUP BY 1),
        m AS (SELECT code, 0.99 * 1.85::DOUBLE + 0.01 * coalesce(c.n, 0) AS weight, 0.99 * 1.85 * b.v[1]::DOUBLE + 0.01 * coalesce(s0, 0) AS x0, 0.99 * 1.85 * b.v[64]::DOUBLE + 0.01 * coalesce(s63, 0) AS x63 FROM book b LEFT JOIN c USING (code)),
        d AS (SELECT *, CASE WHEN weight < 2 THEN row_number() OVER (PARTITION BY weight < 2 ORDER BY code) END AS k FROM m),
        f AS (SELECT v, row_number() OVER (ORDER BY md5('revive:' || vec_id::VARCHAR), vec_id) AS k FROM q)
        SELECT code, round(CASE WHEN k IS NULL THEN weight ELSE 2.0 END, 6) AS weight, round(CASE WHEN k IS NULL THEN x0 / weight ELSE f.v[1]::DOUBLE END, 6) AS x0, round(CASE WHEN k IS NULL THEN x63 / weight ELSE f.v[64]::DOUBLE END, 6) AS x63
        FROM d LEFT JOIN f USING (k)""",
)
def moved_codebook(spark, d):
    q, book, _ = _books(spark, d)
    got = V.moved_codebook(q.select(F.col("vec_id").alias("id"), "v"), book.withColumn("weight", F.lit(1.85)))
    return got.select("code", r6("weight").alias("weight"), r6(F.col("v")[0]).alias("x0"), r6(F.col("v")[63]).alias("x63"))


@query("vq_05_masked", f"WITH {_BOOK}, {_NEAREST} SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE code END AS code FROM n")
def masked(spark, d):
    q, book, _ = _books(spark, d)
    return V.assign(q, book).select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("code")).alias("code"))


@query("join_11_codebook_lookup", f"WITH {_BOOK}, {_NEAREST} SELECT n.vec_id, round(CASE WHEN label = 0 THEN 0.0 ELSE book.v[1]::DOUBLE END, 6) AS x0 FROM n JOIN book USING (code)")
def codebook_lookup(spark, d):
    q, book, _ = _books(spark, d)
    codes = V.assign(q, book).select("vec_id", F.array(F.when(F.col("label") == 0, -1).otherwise(F.col("code"))).alias("codes"))
    return V.decoded(codes, [book]).select("vec_id", r6(F.col("v")[0]).alias("x0"))


@query("join_15_nearest_label", f"WITH {_BOOK}, {_NEAREST} SELECT label, count(*)::BIGINT AS n, count(DISTINCT code)::BIGINT AS codes FROM n GROUP BY 1")
def nearest_label(spark, d):
    q, book, _ = _books(spark, d)
    return V.assign(q, book).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"))


@query("vq_06_quantize_stored", f"WITH {_BOOK}, {_NEAREST} SELECT code, count(*)::BIGINT AS n, round(avg(dist), 6) AS error FROM n GROUP BY 1")
def quantize_stored(spark, d):
    q, book, _ = _books(spark, d)
    return V.assign(q, book).groupBy("code").agg(F.count("*").alias("n"), r6(F.avg("dist")).alias("error"))


@query(
    "vq_08_soft_decode",
    f"""WITH {_BOOK}, l AS (SELECT a.vec_id, b.code, b.v[1]::DOUBLE AS x, list_sum(list_transform(range(1, 65), lambda i: a.v[i]::DOUBLE * b.v[i]::DOUBLE)) AS z FROM q a, book b)
        SELECT vec_id, round(sum(exp(z / 0.5) * x) / sum(exp(z / 0.5)), 6) AS x0 FROM l GROUP BY 1""",
)
def soft_decode(spark, d):
    q, book, _ = _books(spark, d)
    j = q.crossJoin(V.codebook_row(book)).withColumn("soft", V.soft_decoded(V.tied_logits(F.col("v"), F.col("cb"), 0.0), F.col("cb"), 0.5))
    return j.select("vec_id", r6(F.col("soft")[0]).alias("x0"))


@query(
    "vq_09_vector_distance",
    f"WITH {_BOOK}, {_NEAREST} SELECT label, round(avg(dist), 6) AS loss FROM n GROUP BY 1",
)
def vector_distance(spark, d):
    q, book, _ = _books(spark, d)
    got = V.decoded(V.assign(q, book).select("vec_id", "label", F.col("v").alias("w"), F.array("code").alias("codes")), [book])
    return got.groupBy("label").agg(r6(F.avg(A.squared_distance(F.col("v"), F.col("w")))).alias("loss"))


@query("vq_10_tied_logits", f"WITH {_BOOK}, l AS (SELECT a.vec_id, list_sum(list_transform(range(1, 65), lambda i: a.v[i]::DOUBLE * b.v[i]::DOUBLE)) * exp(0.3) AS z FROM q a, book b) SELECT vec_id, round(max(z), 6) AS top, round(sum(z), 6) AS total FROM l GROUP BY 1")
def tied_logits(spark, d):
    q, book, _ = _books(spark, d)
    z = q.crossJoin(V.codebook_row(book)).withColumn("z", V.tied_logits(F.col("v"), F.col("cb"), 0.3))
    return z.select("vec_id", r6(F.array_max("z")).alias("top"), r6(A.total(F.col("z"))).alias("total"))


@query(
    "vq_11_stale_codes",
    f"WITH {_BOOK}, {_NEAREST} SELECT count(*)::BIGINT AS n, round(avg((code = CASE WHEN vec_id % 20 = 0 THEN 0 ELSE code END)::INTEGER), 6) AS rate, avg((code = CASE WHEN vec_id % 20 = 0 THEN 0 ELSE code END)::INTEGER) < 0.99 AS stale FROM n",
)
def stale_codes(spark, d):
    q, book, _ = _books(spark, d)
    fresh = V.assign(q, book).select("vec_id", "code")
    stored = fresh.withColumn("code", F.when(F.col("vec_id") % 20 == 0, 0).otherwise(F.col("code")))
    return V.match_rate(fresh, stored, ["vec_id"], "code").select("n", r6("rate").alias("rate"), "stale")


@query("vq_12_mean_vector", "WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) SELECT label, round(sqrt(sum(m * m)), 6) AS norm FROM c GROUP BY 1")
def mean_vector(spark, d):
    from ..operators.stats import vector_mean

    return vector_mean(table(spark, d, "embeddings"), "label", "embedding").select("label", r6(A.norm(F.col("mean"))).alias("norm"))


_LOGITS = "x AS (SELECT l_orderkey, l_linenumber, [l_quantity / 50, l_discount * 10, l_tax * 10, 0.5::DOUBLE] AS z, (l_orderkey % 4)::INTEGER AS target, l_linenumber AS level FROM lineitem)"


def _logits(spark, d):
    z = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5))
    return table(spark, d, "lineitem").select("l_orderkey", z.alias("z"), (F.col("l_orderkey") % 4).cast("int").alias("target"), F.col("l_linenumber").alias("level"))


_MASKED = f"""{_LOGITS}, m AS (SELECT level, ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[target + 1] AS ce, (list_position(z, list_max(z)) - 1 = target)::INTEGER AS hit,
    CASE WHEN l_orderkey % 3 = 0 OR level = 7 THEN 0 ELSE 1 END AS mask FROM x),
  l AS (SELECT level, sum(ce * mask) / greatest(sum(mask), 1) AS ce, sum(hit * mask) / greatest(sum(mask), 1)::DOUBLE AS acc, CASE WHEN level <= 4 THEN power(0.5, level - 1) ELSE 0 END AS weight FROM m GROUP BY level)"""


@query("evl_01_cross_entropy", f"WITH {_MASKED} SELECT level, round(ce, 6) AS ce, round(acc, 6) AS acc, round(weight, 6) AS weight, round(sum(ce * weight) OVER (), 6) AS total FROM l")
def cross_entropy(spark, d):
    """The seventh level is masked whole; levels beyond the fourth have no weight."""
    x = _logits(spark, d).withColumn("mask", ((F.col("l_orderkey") % 3 != 0) & (F.col("level") != 7)).cast("int"))
    got = V.leveled_loss(x, "level", F.col("z"), F.col("target"), F.col("mask"), {1: 1.0, 2: 0.5, 3: 0.25, 4: 0.125})
    return got.select("level", *(r6(c).alias(c) for c in ("ce", "acc", "weight", "total")))


@query("evl_02_log_duration", f"WITH {SEGS} SELECT round(avg((ln(dur + 1) - ln(4)) * (ln(dur + 1) - ln(4))), 6) AS mse1, round(avg((ln(greatest(dur, 1)) - ln(3)) * (ln(greatest(dur, 1)) - ln(3))), 6) AS mse0 FROM segs")
def log_duration(spark, d):
    a, b = F.log1p("dur"), F.log(F.greatest("dur", F.lit(1)))
    return segs(spark, d).agg(r6(V.mean_squared(a, F.log1p(F.lit(3)))).alias("mse1"), r6(V.mean_squared(b, F.log(F.lit(3.0)))).alias("mse0"))


@query("evl_03_body_error", f"WITH {FRAMES}, n AS (SELECT utt, max(t) AS last FROM frames GROUP BY 1) SELECT round(avg((pitch - 50) * (pitch - 50)), 6) AS mse, count(*)::BIGINT AS n FROM frames JOIN n USING (utt) WHERE t > 0 AND t < last")
def body_error(spark, d):
    from pyspark.sql import Window as W

    f = frames(spark, d).withColumn("last", F.max("t").over(W.partitionBy("utt"))).where("t > 0 and t < last")
    return f.agg(r6(V.mean_squared(F.col("pitch"), F.lit(50.0))).alias("mse"), F.count("*").alias("n"))


@query("evl_04_bce", "SELECT round(avg(3.0 * toxic * (greatest(-x, 0.0) + ln(1 + exp(-abs(x)))) + (1 - toxic) * (greatest(x, 0.0) + ln(1 + exp(-abs(x))))), 6) AS bce FROM (SELECT toxic, (doc_id % 7) - 3.0::DOUBLE AS x FROM labels)")
def bce(spark, d):
    x = (F.col("doc_id") % 7) - F.lit(3.0)
    return table(spark, d, "labels").agg(r6(F.avg(V.bce_with_logits(x, F.col("toxic"), 3.0))).alias("bce"))


@query("evl_05_gaussian_nll", "SELECT event_type, round(avg(0.5 * (2.0 + (ln(value + 1) - 3) * (ln(value + 1) - 3) * exp(-2.0))), 6) AS nll FROM events GROUP BY 1")
def gaussian_nll(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.avg(V.gaussian_nll(F.log1p("value"), F.lit(3.0), F.lit(2.0)))).alias("nll"))


_REC = f"""{SEGS}, r AS (SELECT f.utt, f.t, f.phone, f.pitch, s.start, s.dur, a.pitch AS x, m.pitch AS y, e.pitch AS z, f.t - s.start AS i FROM runs f JOIN segs s ON s.utt = f.utt AND s.pos = f.pos
   JOIN frames a ON a.utt = s.utt AND a.t = s.start JOIN frames m ON m.utt = s.utt AND m.t = s.start + s.dur // 2 JOIN frames e ON e.utt = s.utt AND e.t = s.start + s.dur - 1),
   v AS (SELECT *, CASE WHEN dur = 1 THEN x ELSE x + (z - x) * i / greatest(dur - 1, 1) END AS line, CASE WHEN dur = 1 THEN y WHEN i = 0 THEN x WHEN i = dur - 1 THEN z ELSE y END AS plateau FROM r)"""


def _reconstructed(spark, d):
    from ..operators import segments as G
    from ..operators.signal import rendered
    from .base import with_runs

    a = G.anchors(segs(spark, d), with_runs(spark, d), "pitch").join(segs(spark, d).select("utt", "pos", "dur", "start", "phone"), ["utt", "pos"])
    args = F.col("start_x"), F.col("mid_x"), F.col("end_x"), F.col("dur")
    both = F.arrays_zip(rendered(*args, F.lit("line")).alias("line"), rendered(*args, F.lit("plateau")).alias("plateau"))
    r = a.select("utt", "phone", "start", F.posexplode(both).alias("i", "r")).select("utt", "phone", (F.col("start") + F.col("i")).alias("t"), "r.line", "r.plateau")
    return r.join(frames(spark, d).select("utt", "t", "pitch"), ["utt", "t"])


@query("evl_06_reconstruction", f"WITH {_REC} SELECT phone, round(avg((pitch - line) * (pitch - line)), 6) AS line, round(avg((pitch - plateau) * (pitch - plateau)), 6) AS plateau, count(*)::BIGINT AS n FROM v GROUP BY 1")
def reconstruction(spark, d):
    p = F.col("pitch")
    return _reconstructed(spark, d).groupBy("phone").agg(r6(V.mean_squared(p, F.col("line"))).alias("line"), r6(V.mean_squared(p, F.col("plateau"))).alias("plateau"), F.count("*").alias("n"))


@query("evl_07_round_trip", f"WITH {_REC} SELECT utt, round(avg((pitch - line) * (pitch - line)), 6) AS line, round(avg((pitch - plateau) * (pitch - plateau)), 6) AS plateau FROM v GROUP BY 1")
def round_trip(spark, d):
    p = F.col("pitch")
    return _reconstructed(spark, d).groupBy("utt").agg(r6(V.mean_squared(p, F.col("line"))).alias("line"), r6(V.mean_squared(p, F.col("plateau"))).alias("plateau"))


@query("evl_08_match_rate", "SELECT round(avg((quality = 1 - toxic)::INTEGER), 6) AS match, round(avg((quality - toxic) * (quality - toxic)), 6) AS mse FROM labels")
def match_rate(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, d, "labels").agg(r6(F.avg((q == 1 - t).cast("double"))).alias("match"), r6(V.mean_squared(q, t)).alias("mse"))


@query("evl_09_path_difference", f"WITH {_REC} SELECT round(avg(abs(line - plateau)), 6) AS mean, round(max(abs(line - plateau)), 6) AS most FROM v")
def path_difference(spark, d):
    x = F.abs(F.col("line") - F.col("plateau"))
    return _reconstructed(spark, d).agg(r6(F.avg(x)).alias("mean"), r6(F.max(x)).alias("most"))


@query("evl_11_perplexity", f"WITH {_LOGITS} SELECT round(exp(avg(ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[target + 1])), 6) AS perplexity FROM x")
def perplexity(spark, d):
    return _logits(spark, d).agg(r6(F.exp(F.avg(V.cross_entropy(F.col("z"), F.col("target"))))).alias("perplexity"))
