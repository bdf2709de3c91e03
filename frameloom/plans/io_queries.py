"""Sources, sinks, streams. Files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import quantize as V
from ..operators.ordering import numbered
from ..operators.staging import scratch, staged
from ..sources import files, readers, writers
from ..streaming import flush
from ..streaming import incremental as I
from ..streaming import monitor as M
from .base import RUNS, SQL, query, r6, table, with_runs
from .vector_queries import _books


@query("src_01_listing", "SELECT 'r' || s_nationkey || '/u' || s_suppkey || '.npz' AS path, 'u' || s_suppkey AS key, row_number() OVER (ORDER BY 'r' || s_nationkey || '/u' || s_suppkey || '.npz') - 1 AS place FROM supplier WHERE s_suppkey % 4 <> 2")
def listing(spark, d):
    """Files of one kind below a root, by path; a quarter of the files are of another kind."""
    path = scratch(spark, "listing")
    key = F.concat(F.lit("r"), F.col("s_nationkey").cast("string"), F.lit("/u"), F.col("s_suppkey").cast("string"))
    n = table(spark, d, "supplier").select("s_suppkey", key.alias("key"), F.array("s_acctbal").alias("x"))
    files.write_arrays(n.where("s_suppkey % 4 <> 2"), path)
    files.write_arrays(n.where("s_suppkey % 4 = 2"), path, suffix="npy")
    got = readers.listing(spark, path, "*.npz").select(F.regexp_extract("path", r"(r[0-9]+/[^/]+)$", 1).alias("path"), "key")
    return numbered(got, "path", name="place")


_WALK = """SELECT CASE WHEN s_suppkey % 9 = 3 THEN 'misc' ELSE (s_nationkey + 4)::VARCHAR END AS speaker, CASE WHEN s_suppkey % 6 = 1 THEN '__' ELSE '' END || 'e' || (s_suppkey % 4) AS emotion, s_suppkey FROM supplier"""


@query("src_02_partitioned_listing", f"SELECT speaker::INTEGER AS speaker, emotion, 'u' || s_suppkey AS key FROM ({_WALK}) WHERE speaker <> 'misc' AND try_cast(speaker AS INTEGER) BETWEEN 11 AND 20 AND emotion NOT LIKE '\\_\\_%' ESCAPE '\\'")
def partitioned_listing(spark, d):
    path = scratch(spark, "walk")
    speaker = F.when(F.col("s_suppkey") % 9 == 3, "misc").otherwise((F.col("s_nationkey") + 4).cast("string"))
    emotion = F.concat(F.when(F.col("s_suppkey") % 6 == 1, "__").otherwise(""), F.lit("e"), (F.col("s_suppkey") % 4).cast("string"))
    key = F.concat_ws("/", speaker, emotion, F.concat(F.lit("u"), F.col("s_suppkey").cast("string")))
    files.write_arrays(table(spark, d, "supplier").select(key.alias("key"), F.array("s_acctbal").alias("x")), path)
    return readers.partitioned_listing(spark, path, "*.npz", 11, 20).select("speaker", "emotion", "key")


_FEATURES = "SELECT user_id::VARCHAR AS utt_id, list(value ORDER BY event_id) AS pitch FROM events GROUP BY 1"


#: What is read of a feature file: of its four arrays one stays where it is.
_ARRAYS = "key string, ema array<array<float>>, pitch array<float>, loudness array<float>"


def _series(spark, d):
    """(key, ema, pitch, loudness, spk_emb): the events of a user as a feature record; loudness lacks the last frame."""
    e = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key"))
    xs = e.agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"].cast("float")).alias("pitch"))
    ema = F.transform("pitch", lambda x: F.array(x, -x))
    return xs.select("key", ema.alias("ema"), "pitch", F.slice("pitch", F.lit(1), F.size("pitch") - 1).alias("loudness"), F.array(F.lit(0.0).cast("float")).alias("spk_emb"))


def _npz(spark, rows):
    """Rows written as NPZ files and read back through the data source."""
    path = scratch(spark, "npz")
    files.write_arrays(rows, path)
    spark.dataSource.register(files.ArrayFiles)
    return spark.read.format("arrays").schema(_ARRAYS).load(path)


_NPZ = "list_slice(pitch, 1, len(pitch) - 1)"


@query("src_03_features", f"SELECT utt_id, (len(pitch) - 1)::BIGINT AS n, round(list_sum({_NPZ}), 2) AS pitch, round(-list_sum({_NPZ}), 2) AS ema, round(list_sum({_NPZ}), 2) AS loudness FROM ({_FEATURES})")
def features(spark, d):
    f = readers.features(_npz(spark, _series(spark, d)))
    total = lambda c: F.round(A.total(F.col(c)), 2).alias(c)
    ema = F.round(A.total(F.transform("ema", lambda x: x[1])), 2).alias("ema")
    return f.select(F.col("key").alias("utt_id"), F.size("pitch").cast("long").alias("n"), total("pitch"), ema, total("loudness"))


_STORED = f"""SELECT utt_id, {_NPZ} AS xs FROM (SELECT utt_id, list_transform(pitch, lambda x: (CASE WHEN utt_id::INTEGER % 3 = 0 THEN x::FLOAT::DOUBLE / 50 ELSE x END)::FLOAT::DOUBLE) AS pitch FROM ({_FEATURES}))"""


@query("src_04_auto_log_pitch", f"SELECT utt_id, i - 1 AS t, round(CASE WHEN list_max(xs) > 20 THEN ln(xs[i] + 1) ELSE xs[i] END, 4) AS pitch FROM (SELECT utt_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM ({_STORED}))")
def auto_log_pitch(spark, d):
    """A third of the series are not in Hz: their values stay."""
    low = F.transform("pitch", lambda x: F.when(F.col("key").cast("int") % 3 == 0, x / 50).otherwise(x).cast("float"))
    f = readers.features(_npz(spark, _series(spark, d).withColumn("pitch", low)), log_pitch=True)
    return f.select(F.col("key").alias("utt_id"), F.posexplode("pitch").alias("t", "pitch")).select("utt_id", F.col("t").cast("long").alias("t"), F.round("pitch", 4).alias("pitch"))


@query("src_05_strict_features", f"SELECT utt_id, len(pitch)::BIGINT AS n, round(list_sum(pitch), 2) AS total FROM ({_FEATURES})")
def strict_features(spark, d):
    f = readers.features(_npz(spark, _series(spark, d).withColumn("loudness", F.col("pitch"))), strict=True)
    return f.select(F.col("key").alias("utt_id"), F.size("pitch").cast("long").alias("n"), F.round(A.total(F.col("pitch")), 2).alias("total"))


@query("src_06_token_files", f"WITH {RUNS} SELECT utt::VARCHAR AS utt_id, t, pos AS code FROM runs")
def token_files(spark, d):
    """The run numbers of a user as a file of codes."""
    path = scratch(spark, "npy")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("t", "pos"))), lambda s: s["pos"])
    files.write_arrays(with_runs(spark, d).groupBy(F.col("utt").cast("string").alias("key")).agg(codes.alias("codes")), path, suffix="npy")
    spark.dataSource.register(files.ArrayFiles)
    got = spark.read.format("arrays").schema("key string, codes array<int>").option("partitionBytes", 4096).load(path)
    return got.select(F.col("key").alias("utt_id"), F.posexplode("codes").alias("t", "code"))


@query("flt_07_corrupt_skip", "SELECT p_brand AS brand, count(*)::BIGINT AS n, count_if(p_partkey % 7 = 0)::BIGINT AS skipped, sum(CASE WHEN p_partkey % 7 <> 0 THEN p_size ELSE 0 END)::BIGINT AS total FROM part WHERE p_size < 20 GROUP BY 1")
def corrupt_skip(spark, d):
    """A seventh of the files are cut off."""
    path = scratch(spark, "corrupt")
    p = table(spark, d, "part").where("p_size < 20").select(F.concat_ws("/", F.translate("p_brand", "#", "_"), F.col("p_partkey").cast("string")).alias("key"), F.array("p_size").alias("x"), "p_partkey")
    files.write_arrays(p.where("p_partkey % 7 <> 0"), path)
    broken = p.where("p_partkey % 7 = 0").select(F.concat("key", F.lit(".npz")).alias("key"), F.lit("PK cut off").cast("binary").alias("content"))
    sink = flush.StagedSink(spark, scratch(spark, "staging"), path, put=lambda uri, content, _: flush.write_checked(uri, content, 0))
    sink.add(broken, 0)
    sink.finish()
    spark.dataSource.register(files.ArrayFiles)
    got = spark.read.format("arrays").schema("path string, x array<float>, _error string").load(path)
    brand = F.translate(F.regexp_extract("path", "^([^/]+)/", 1), "_", "#")
    n_bad, total = F.count_if(F.col("_error").isNotNull()), F.sum(F.coalesce(F.get("x", F.lit(0)), F.lit(0)))
    return got.groupBy(brand.alias("brand")).agg(F.count("*").alias("n"), n_bad.alias("skipped"), total.cast("long").alias("total"))


@query("src_13_waveforms", "SELECT user_id::VARCHAR AS utt_id, (2 * count(*))::BIGINT AS n, round(avg(floor(value * 50)) / 32768, 4) AS mean FROM events GROUP BY 1")
def waveforms(spark, d):
    """Series as WAV contents of 8 kHz, read at 16 kHz: twice the samples, the same mean. Series beyond 16 bits are IEEE floats."""
    xs = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: F.floor(s["value"] * 50)).alias("xs"))

    def run(parts):
        import struct

        for pdf in parts:
            content = []
            for x in pdf["xs"]:
                fits = -32768 <= x.min() and x.max() <= 32767
                tag, bits, body = (1, 16, x.astype("<i2").tobytes()) if fits else (3, 64, (x / 32768).astype("<f8").tobytes())
                head = struct.pack("<IHHIIHH", 16, tag, 1, 8000, 1000 * bits, bits // 8, bits)
                content.append(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + head + b"data" + struct.pack("<I", len(body)) + body)
            yield pdf.assign(content=content)[["path", "content"]]

    read = readers.waveforms(xs.mapInPandas(run, "path string, content binary"))
    mean = F.round(A.mean(F.col("samples")), 12)  # without the spectrum's noise, which would decide ties
    return read.select(F.col("path").alias("utt_id"), F.size("samples").cast("long").alias("n"), F.round(mean, 4).alias("mean"))


@query("src_07_keyed_json", "SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey AS region FROM nation")
def keyed_json(spark, d):
    path = scratch(spark, "map")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    entries = F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("key"), F.struct("name", "region").alias("value")))
    n.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.text(path)
    return readers.keyed_json(spark, path, "struct<name:string,region:int>").select("key", "record.name", "record.region")


@query("src_08_metrics_log", "SELECT CASE event_type WHEN 'click' THEN 'step' WHEN 'view' THEN 'epoch' ELSE 'audit' END AS type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def metrics_log(spark, d):
    path = scratch(spark, "log")
    kind = F.when(F.col("event_type") == "click", "step").when(F.col("event_type") == "view", "epoch").otherwise("audit")
    writers.log(table(spark, d, "events").select(kind.alias("type"), F.col("event_id").alias("step"), F.col("value").alias("lr")), path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    parts = readers.metrics_log(spark, path)
    return parts["step"].union(parts["epoch"]).union(parts["audit"]).groupBy("type").agg(F.count("*").alias("n"))


@query("src_09_transcripts", "SELECT p_partkey::VARCHAR AS utt_id, p_name AS text, p_brand AS emotion FROM part WHERE p_size % 2 = 0")
def transcripts(spark, d):
    path = scratch(spark, "tsv")
    p = table(spark, d, "part")
    line = F.when(F.col("p_size") % 2 == 0, F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", "p_brand")).otherwise(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name"))
    p.select(line.alias("value")).write.text(path)
    return readers.transcripts(spark, path, 3)


@query("src_10_lax_transcripts", "SELECT count(*)::BIGINT AS n, count_if(p_size % 2 = 0)::BIGINT AS with_emotion FROM part")
def lax_transcripts(spark, d):
    path = scratch(spark, "tsv")
    p = table(spark, d, "part")
    p.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("value")).write.text(path)
    return readers.transcripts(spark, path, 2).agg(F.count("*").alias("n"), F.count("emotion").alias("with_emotion"))


@query("src_11_intervals", "SELECT n_nationkey AS id, 0::INTEGER AS i, 0.0::DOUBLE AS xmin, 0.5::DOUBLE AS xmax, n_name AS label FROM nation UNION ALL SELECT n_nationkey, 1, 0.5, 1.25, 'sp' FROM nation")
def intervals(spark, d):
    grid = F.concat(F.lit('item [1]:\n name = "words"\n xmin = 0\n xmax = 9\n text = "no"\nitem [2]:\n name = "phones"\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = "'), F.col("n_name"), F.lit('"\n intervals [2]:\n xmin = 0.5\n xmax = 1.25\n text = "sp"\n'))
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.posexplode(readers.intervals(grid)).alias("i", "s"))
    return t.select("id", "i", "s.xmin", "s.xmax", "s.label")


@query("src_12_first_existing", "SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'clean/' || n_nationkey WHEN n_nationkey % 3 = 0 THEN 'other/' || n_nationkey END AS path FROM nation")
def first_existing(spark, d):
    from ..operators.relational import first_existing as probe

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"))
    a = n.where("key % 2 = 0").select("key", F.concat(F.lit("clean/"), F.col("key").cast("string")).alias("path"), F.lit(0).alias("p"))
    b = n.where("key % 3 = 0").select("key", F.concat(F.lit("other/"), F.col("key").cast("string")).alias("path"), F.lit(1).alias("p"))
    return probe(n, a.union(b), "key", F.col("p"))


@query("src_14_styles", "SELECT source, count(DISTINCT lang)::BIGINT AS styles, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def styles(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("styles"), F.count("*").alias("n"))


_LINE = "CASE WHEN event_type = 'click' THEN 'Epoch ' || event_id || '/9: 5%' ELSE 'note ' || event_id || ' ' || event_type END"


@query("src_16_log_tail", f"WITH l AS (SELECT event_id, event_type, {_LINE} AS line FROM events) SELECT (SELECT line FROM l WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 1) AS line, least(16384, sum(length(line) + 1))::BIGINT AS read FROM l")
def log_tail(spark, d):
    path = scratch(spark, "log")
    e = table(spark, d, "events")
    id_ = F.col("event_id").cast("string")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("Epoch "), id_, F.lit("/9: 5%"))).otherwise(F.concat_ws(" ", F.lit("note"), id_, "event_type"))
    e.select("event_id", line.alias("line")).orderBy("event_id").coalesce(1).select("line").write.option("lineSep", "\r").text(path)
    return files.last_lines(readers.listing(spark, path, "*.txt"), r"Epoch .*/.*%").select("line", "read")


@query("src_17_done_set", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def done_set(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    done = docs.where("doc_id % 3 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".npz")).alias("file"))
    return I.remaining(docs, done.select(F.regexp_extract("file", r"^(\d+)\.npz$", 1).cast("long").alias("doc_id")), "doc_id")


@query("src_19_whole_text", "SELECT string_agg(n_name, ',' ORDER BY n_name) AS text FROM nation")
def whole_text(spark, d):
    path = scratch(spark, "text")
    table(spark, d, "nation").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("value")).write.text(path)
    return readers.whole_texts(spark, path).select(F.regexp_replace("text", "\n$", "").alias("text"))


@query("snk_01_features", f"SELECT utt_id, (len(pitch))::BIGINT AS n, round(list_max(pitch), 4) AS top FROM ({_FEATURES})")
def write_features(spark, d):
    path = scratch(spark, "features")
    writers.features(_series(spark, d), path)
    f = spark.read.parquet(path)
    return f.select(F.col("key").alias("utt_id"), F.size("pitch").cast("long").alias("n"), F.round(F.array_max("pitch").cast("double"), 4).alias("top"))


@query("snk_03_keyed_json", "SELECT r_regionkey::VARCHAR AS key, r_name FROM region")
def write_keyed_json(spark, d):
    path = scratch(spark, "json")
    writers.keyed_json(table(spark, d, "region"), "r_regionkey", path)
    lines = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<r_name:string>>")).alias("key", "v"))
    return lines.select("key", "v.r_name")


@query("snk_04_append_log", "SELECT 'epoch' AS type, s_suppkey::BIGINT AS step, s_name AS name, s_acctbal / 4 AS wall FROM supplier UNION ALL SELECT 'step', s_suppkey::BIGINT, s_name, s_acctbal / 2 FROM supplier WHERE s_nationkey > 9")
def append_log(spark, d):
    """Two writes to one log; the second adds to the first."""
    path = scratch(spark, "append")
    n = table(spark, d, "supplier")
    for kind, rows, by in (("epoch", n, 4), ("step", n.where("s_nationkey > 9"), 2)):
        writers.log(rows.select(F.lit(kind).alias("type"), F.col("s_suppkey").alias("step"), F.col("s_name").alias("name"), (F.col("s_acctbal") / by).alias("wall")), path)
    parts = readers.metrics_log(spark, path)
    return parts["step"].union(parts["epoch"]).select("type", "step", "name", "wall")


@query("snk_05_publish", "SELECT doc_id, source, doc_id % 2 = 0 AS early, md5(text) AS text FROM documents WHERE octet_length(encode(text)) >= 500")
def publish(spark, d):
    """Half of the rows are there when all come; rows under 500 bytes are not published, and no row is there twice."""
    path = scratch(spark, "publish")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    large = lambda df: df.where(F.octet_length("text") >= 500)
    writers.published(docs.where("doc_id % 2 = 0").withColumn("early", F.lit(True)), path, "doc_id", large)
    return writers.published(docs.withColumn("early", F.lit(False)), path, "doc_id", large).select("doc_id", "source", "early", F.md5("text").alias("text"))


@query(
    "snk_06_staged_flush",
    """SELECT 'f' || s_suppkey AS key, s_suppkey % 5 <> 4 AS published, (CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE 600 + s_nationkey END)::BIGINT AS bytes,
        s_suppkey % 5 = 4 OR s_suppkey % 5 = 0 AND s_suppkey % 7 = 3 AS retried FROM supplier""",
)
def staged_flush(spark, d):
    """Files of 600 bytes and more. Some that come first fail in the first four passes; a fifth, which come last, have 100 bytes and are never published."""
    root, source, out = scratch(spark, "staging"), scratch(spark, "rows"), scratch(spark, "files")
    size = F.when(F.col("s_suppkey") % 5 == 4, 100).otherwise(600 + F.col("s_nationkey"))
    rows = table(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("key"), F.repeat(F.lit("x"), size).cast("binary").alias("content"), "s_suppkey")
    for part in range(5):  # a file for each
        rows.where(F.col("s_suppkey") % 5 == part).drop("s_suppkey").coalesce(1).write.mode("append").parquet(source)

    def put(uri, content, number):
        key = int(uri.rpartition("/f")[2])
        if number <= 4 and key % 5 == 0 and key % 7 == 3:
            raise OSError("busy")
        flush.write_checked(uri, content)

    sink = flush.StagedSink(spark, root, out, 100, put)
    stream = spark.readStream.schema("key string, content binary").option("maxFilesPerTrigger", 1).parquet(source)
    sink.start(stream, f"{root}-ck").awaitTermination()
    sink.finish()
    tried = sink.manifest().groupBy("key").agg(F.max("ok").alias("published"), (F.count("*") > 1).alias("retried"))
    written = spark.read.format("binaryFile").load(out).select(F.regexp_extract("path", "([^/]+)$", 1).alias("key"), F.col("length").alias("bytes"))
    return tried.join(written, "key", "left").select("key", "published", F.coalesce("bytes", F.lit(0)).alias("bytes"), "retried")


@query("snk_08_best", "WITH e AS (SELECT user_id % 5 AS run, event_id, value FROM events) SELECT run, event_id, coalesce(value < min(value) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM e")
def best(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("run"), "event_id", "value")
    return writers.best_so_far(e, "run", "event_id", "value").select("run", "event_id", "is_best")


@query("snk_09_split", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS rows FROM documents GROUP BY 1")
def write_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    return writers.split(docs, scratch(spark, "split"))


@query("snk_10_alignment_corpus", "SELECT source AS spk, lang AS emotion, doc_id::VARCHAR AS utt_id, md5(text) AS text FROM documents")
def alignment_corpus(spark, d):
    path = scratch(spark, "corpus")
    docs = table(spark, d, "documents").select(F.col("source").alias("spk"), F.col("lang").alias("emotion"), F.col("doc_id").cast("string").alias("utt_id"), F.md5("text").alias("text"))
    writers.alignment_corpus(docs, path)
    line = F.split("value", "\t")
    return spark.read.text(path).select("spk", "emotion", line[0].alias("utt_id"), line[1].alias("text"))


@query("str_01_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resume(spark, d):
    return I.remaining(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("toxic = 0"), "doc_id")


@query("str_02_incremental", "SELECT count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events WHERE value > 40")
def incremental(spark, d):
    source, out, ck = (scratch(spark, k) for k in ("in", "out", "ck"))
    e = table(spark, d, "events").select("event_id", "value")
    for part in (0, 1):  # the second run takes what has come since
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        I.resumed(spark, source, "event_id long, value double", lambda s: s.where("value > 40"), out, ck).awaitTermination()
    return spark.read.schema("event_id long, value double").parquet(out).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "str_03_cadences",
    """WITH e AS (SELECT event_id AS step, event_id // 300 AS epoch, value AS loss FROM events)
        SELECT 'step' AS type, step, epoch, round(loss, 4) AS loss, CASE WHEN step % 200 = 0 THEN round(loss / 490, 6) END AS ratio FROM e WHERE step % 50 = 0
        UNION ALL SELECT 'epoch', max(step), epoch, round(avg(loss), 4), NULL FROM e GROUP BY epoch""",
)
def cadences(spark, d):
    """A record every 50 steps, with ratios every 200, and one for each epoch of 300 steps, appended as they come."""
    path = scratch(spark, "cadences")
    e = table(spark, d, "events").select(F.col("event_id").alias("step"), F.floor(F.col("event_id") / 300).alias("epoch"), F.struct(F.col("value").alias("ce")).alias("losses"))
    for part in (e.where("epoch % 2 = 0"), e.where("epoch % 2 = 1")):
        writers.log(writers.cadenced(part, "losses", {"share": F.col("losses.ce") / 490}), path)
    parts = readers.metrics_log(spark, path)
    rows = parts["step"].union(parts["epoch"])
    return rows.select("type", "step", "epoch", F.round(F.col("losses")["ce"], 4).alias("loss"), r6(F.col("grad_ratios")["share"]).alias("ratio"))


@query(
    "str_04_status",
    """WITH r AS (SELECT event_type AS run, event_id // 1000 AS epoch, value, value / 10 AS seconds FROM events),
        e AS (SELECT run, epoch, avg(value) AS value, sum(seconds) AS seconds FROM r GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS rn FROM e), b AS (SELECT run, min(value) AS best FROM r GROUP BY 1)
        SELECT run, max(epoch)::BIGINT AS epoch, round(max(CASE WHEN rn = 1 THEN value END), 6) AS value, round(avg(CASE WHEN rn <= 3 THEN value END), 6) AS recent,
          round(max(CASE WHEN rn = 1 THEN value END) - max(CASE WHEN rn = 2 THEN value END), 6) AS trend, avg(CASE WHEN rn <= 3 THEN value END) < 60 AS better,
          any_value(best) AS best, round((200 - max(epoch)) * avg(CASE WHEN rn <= 3 THEN seconds END), 4) AS eta_seconds FROM n JOIN b USING (run) GROUP BY run""",
)
def status(spark, d):
    """The log grows while it is watched: three parts, one after the other, the second and third with records of earlier epochs."""
    source, out = scratch(spark, "log"), scratch(spark, "status")
    log = table(spark, d, "events").select(F.col("event_type").alias("run"), F.floor(F.col("event_id") / 1000).alias("epoch"), "value", (F.col("value") / 10).alias("seconds"), "event_id")
    for part in range(3):
        log.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).drop("event_id").write.mode("append").json(source)
        stream = spark.readStream.schema("run string, epoch long, value double, seconds double").json(source)
        seen = M.monitored(stream, 60.0, 200)
        M.upserted(seen, out, f"{out}-ck").awaitTermination()
    s = M.latest(spark, out, seen.schema, "run")
    return s.select("run", "epoch", *(r6(c).alias(c) for c in ("value", "recent", "trend")), "better", "best", F.round("eta_seconds", 4).alias("eta_seconds"))


def _fed(df, *by):
    """A stream of the rows in three parts by a hash of `by`, one after the other. A part is a file for each core, and a batch."""
    spark, source = df.sparkSession, scratch(df.sparkSession, "fed")
    cores = spark.sparkContext.defaultParallelism
    for part in range(3):
        df.where(F.pmod(F.xxhash64(*by), F.lit(3)) == part).repartition(cores).write.mode("append").parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", cores).parquet(source)


@query(
    "str_05_state_machine",
    f"WITH {RUNS}, e AS (SELECT utt, t, coalesce(lead(pos) OVER (PARTITION BY utt ORDER BY t) <> pos, true)::INTEGER AS eop FROM runs), p AS (SELECT utt, t, (1 + coalesce(sum(eop) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS place FROM e) SELECT * FROM p WHERE place <= 20",
)
def state_machine(spark, d):
    from ..operators.segments import end_flags

    out = scratch(spark, "places")
    e = end_flags(with_runs(spark, d)).select("utt", "t", F.col("is_end").cast("int").alias("eop"), F.lit(20).alias("n"))
    # a millisecond for a row, as a day's wait must hold for the longest sequence
    e = staged(e.withColumn("ts", F.timestamp_millis(1_704_067_200_000 + F.col("t").cast("long"))), "ends")
    stream = _fed(e, "utt", "t")  # in no order of t
    q = I.places(stream, "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("utt long, t int, place int").parquet(out)


@query(
    "str_09_event_windows",
    """WITH w AS (SELECT date_trunc('day', ts) - to_days(unnest(range(2))::INTEGER) AS start, event_type, value FROM events)
        SELECT strftime(start, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""",
)
def event_windows(spark, d):
    """Windows of two days that begin every day, over a stream whose parts are not in order of time."""
    out = scratch(spark, "windows")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    stream = _fed(e, "event_id")
    w = I.windows(stream, "2 days", "1 day", "40 days", "event_type")
    M.upserted(w, out, f"{out}-ck").awaitTermination()
    got = M.latest(spark, out, w.schema, "start", "event_type")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("vq_07_tokenize_corpus", f"SELECT vec_id, c0, c1 FROM ({SQL['vq_02_residual']})")
def tokenize_corpus(spark, d):
    q, first, second = _books(spark, d)
    path = scratch(spark, "codes")
    writers.features(V.residual_assign(q, [first, second]).select("vec_id", "codes"), path)
    return spark.read.parquet(path).select("vec_id", F.col("codes")[0].alias("c0"), F.col("codes")[1].alias("c1"))


@query("udf_01_model_seam", "SELECT event_id, round(value * 2, 6) AS y FROM events")
def model_seam(spark, d):
    return I.model_seam(table(spark, d, "events").select("event_id", "value"), lambda: lambda pdf: pdf.assign(y=(pdf["value"] * 2).round(6))[["event_id", "y"]], "event_id long, y double")
