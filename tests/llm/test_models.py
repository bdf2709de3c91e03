"""Mixing, neighbours and the classifiers."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import ann, learning, mixing, quality, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


def mixed(spark, rows):
    return mixing.placed(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))).withColumn("taken", F.aggregate("_words", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))))


def test_mix_equals_its_sql_with_nulls_and_repeats(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "b", "ç", None, "big", "big", "big"]), " ".join("w" * 3 for _ in range(r.randint(0, 30)))) for k in range(300)]
    rows += [(5, "a", None), (None, "b", "x y"), (None, "b", "x y"), (7, "a", ""), (7, "a", "one two"), (8, "only", "")]
    got = mixed(spark, rows).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "taken", F.col("_place").alias("first_place"))
    documents = spark.createDataFrame(rows, "doc_id long, source string, text string").toArrow()  # noqa: F841  (DuckDB reads it)
    want = duckdb.sql(mixing.OP2_SQL).fetchall()
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_places_are_the_order_of_the_mix(spark):
    r = random.Random(3)
    rows = [(k, r.choice("ab"), " ".join(["w"] * r.randint(0, 9))) for k in range(200)]
    got = [x for x in mixed(spark, rows).collect() if x["_place"] is not None]
    parts = sorted((f, w) for x in got for f, w in zip(x["_finish"], x["_words"], strict=True) if w)
    assert min(x["_place"] for x in got) == 0 and len({x["_place"] for x in got}) == len(got)
    for x in got:
        before = sum(w for f, w in parts if f < x["_finish"][0])
        assert before <= x["_place"] <= sum(w for f, w in parts if f <= x["_finish"][0])


def test_stage_mix_cuts_at_the_target_and_passes_columns(spark):
    rows = [(k, "ab"[k % 2], f"t{k}  u\n v{k}" if k % 5 else None, k, "x") for k in range(60)] + [(None, None, "a b c", 1, "y")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long, _run string").withColumn("_size", F.lit("clash")).withColumn("_src", F.lit("clash"))
    got = mixing.stage_mix(spark, docs, "")
    assert got.columns == docs.columns
    whole = {x.doc_id: x.text for x in docs.collect()}
    out = got.collect()
    assert all(x["_size"] == "clash" and x["_run"] in "xy" for x in out)
    cut = [x for x in out if x.text != whole[x.doc_id]]
    assert len(cut) <= 3 and all(whole[x.doc_id].startswith(x.text) and x.n_chars == len(x.text) for x in cut)
    target = {x.source: x["_target"] for x in mixing.mix(docs.drop("_run")).collect()}
    for s in "ab":
        assert sum(len((x.text or "").split()) for x in out if x.source == s) == int(target[s])
    assert mixing.stage_mix(spark, docs.where("doc_id > 999"), "").count() == 0


def test_targets_fill_the_budget_and_stop_at_the_cap(spark):
    s = spark.createDataFrame([("a", False, 1), ("b", False, 50), ("c", False, 100), ("", True, 49)], "_src string, _src_null boolean, _source_size long")
    t = {(r["_src"], r["_src_null"]): r["_target"] for r in mixing.targets(s).collect()}
    assert t[("a", False)] == 3.0 and sum(t.values()) == pytest.approx(200)
    assert t[("b", False)] / 2 == pytest.approx(t[("c", False)]) and t[("", True)] == pytest.approx(123.125)


def test_each_source_comes_near_its_target(spark):
    r = random.Random(4)
    rows = [(k, r.choice("abcdef"), " ".join(["w"] * r.randint(1, 40))) for k in range(4000)] + [(9999, "one", "w " * 3000)]
    got = mixed(spark, rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("_target").alias("target")).collect()
    assert all(0 <= x.target - x.taken < 1 + 1e-6 for x in got)
    assert sum(x.taken for x in got) <= sum(len(t.split()) for _, _, t in rows)


def test_nearest_neighbours_reach_the_recall(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 16)) + 3 * r.normal(size=(12, 16))[r.integers(0, 12, 3000)]
    x[:400] = x[0]  # a third of a cluster is one vector
    rows = [(k, v.astype("float32").tolist()) for k, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (None, [1.0] * 16), (5004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = ann.search(df, df.where("vec_id % 50 = 0"), k=20).toPandas()
    x = np.vstack([x.astype("float32").astype(float), np.eye(1, 16)])  # the vector of one place, filled with zeros
    ids = np.array([*range(3000), 5004])
    found = 0
    for q in range(0, 3000, 50):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own["score"].tolist() == s[np.searchsorted(ids, own["vec_id"])].tolist()
        found += len(set(want) & set(own["vec_id"]))
        if q < 400:
            assert own["vec_id"].tolist() == want.tolist()
    assert found / (60 * 20) >= 0.9
    assert ann.search(df.where("vec_id < 0"), df).count() == 0


def test_leaves_stay_small_as_the_table_grows(spark, monkeypatch):
    for name, value in {"SAMPLE": 300, "SAMPLE_PER_LEAF": 6, "LEAF_ROWS": 12, "GROWN": 3, "LEAF_SAMPLE": 120}.items():
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(9)
    x = r.normal(size=(4000, 12)) + 4 * r.normal(size=(40, 12))[r.integers(0, 40, 4000)]
    x[:300] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.usable(df).where("vec_id >= 280")
    tree, index = ann.indexed(rows, rows.count(), float(np.sqrt((x**2).sum(axis=1)).max()))
    sizes = [n for _, n in index.groupBy("leaf").count().collect()]
    assert tree.leaves > 50 * 3 and sorted(sizes)[-2] < 3 * 12 and sum(sizes) == 3720
    got = ann.search(df, df.where("vec_id % 40 = 0"), k=10).toPandas()
    found = 0
    for q in range(0, 4000, 40):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        found += len(set(np.lexsort((np.arange(4000), -s))[:10]) & set(got[got.query_id == q]["vec_id"]))
    assert found / 1000 >= 0.9


def test_all_candidates_if_fewer(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id = 2")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(2, 1, 4, 9.0), (2, 2, 3, 7.0), (2, 3, 1, 3.0), (2, 4, 0, 1.0)]


def test_boosted_trees_and_isotonic():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(2000) < 0.05)).astype(float)
    p = learning.BoostedTrees().fit(x[:1500], y[:1500]).score(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.85
    iso = learning.Isotonic(p, y[1500:])
    assert (np.diff(iso(np.linspace(0, 1, 50))) >= 0).all()
    assert 0 <= iso(np.array([-1.0, 2.0])).min() <= iso(np.array([-1.0, 2.0])).max() <= 1
    assert learning.BoostedTrees().fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_toxic_terms_are_learned(spark):
    r = random.Random(7)
    words = ["".join(r.choice("aeioulnrst") for _ in range(6)) for _ in range(800)]
    rows, labels = [], []
    for k in range(900):
        t = [r.choice(words) for _ in range(80)]
        toxic = k % 6 == 0
        for _ in range(4 * toxic):
            t[r.randrange(80)] = r.choice(["Blargh", "blarghing", "fnord!"])
        rows.append((k, " ".join(t)))
        labels.append((k, int(toxic), None if k % 7 == 0 else int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.train(docs, spark.createDataFrame([(k, a) for k, _, a in labels], "doc_id long, toxic int"))
    got = {x.doc_id: x["_score"] for x in toxicity.score(docs, model).collect()}
    right = [(got[k] >= toxicity.THRESHOLD) == bool(t) for k, t, _ in labels]
    assert np.mean(right) > 0.98 and 0 <= got[None] <= 1 and got[5000] < 0.7
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).count() == 902


def test_second_person_is_counted_to_the_end():
    lexicon = toxicity.Lexicon({"vile": 2.0})
    text = "vile and " * 1500 + "vosotros vile"
    near = lexicon.features(text)[6]
    assert near == 3 / 1501  # the terms within five words of the pronoun


def test_byte_net_learns_and_reads_to_the_end():
    r = random.Random(3)
    good = [" ".join(r.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(r.randint(20, 200))) for _ in range(150)]
    bad = [" ".join(w + "%%%" for w in t.split()) for t in good]
    net = quality.ByteNet().fit(good[:100] + bad[:100], np.array([1] * 100 + [0] * 100), epochs=4)
    assert ((net.scores(good[100:] + bad[100:]) > 0.5) == np.array([True] * 50 + [False] * 50)).mean() > 0.95
    long = "lorem ipsum " * 50_000
    a, b = net.scores([long, long + "dolor%%% " * 5])
    assert a != b and 0 <= min(net.scores([None, "", "x"])) <= 1


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        c = quality.chunks("x" * n)
        held = {at for k, row in enumerate(c) for at in k * quality.STEP + np.flatnonzero(row)}
        assert held == set(range(n))


@needs_tables
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for score, label, held in ((toxicity, "toxic", learning.remainder(3) == 1), (quality, "quality", learning.remainder(5) == 0)):
        got = score.score(docs.select("doc_id", "text"), score.train(docs, labels)).join(labels, "doc_id").where(held).toPandas()
        assert ((got["_score"] >= score.THRESHOLD).astype(int) == got[label]).mean() > 0.9


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, step in p.STAGES:
        got = step(spark, docs, SF)
        if name != p.STAGES[-1][0]:
            assert got.columns == docs.columns
        got = p.stage(got, f"test-{name}")
        seen.append((docs, got))
        docs = got
    (raw, calm), (_, single), (_, safe), (_, mix), (_, packed) = seen
    assert 0.7 * raw.count() < calm.count() < raw.count()
    assert single.count() < calm.count() and single.select("doc_id").distinct().count() == single.count()
    assert safe.count() == single.count() and safe.where(F.col("text").rlike(r"[a-z0-9]@mail\d")).count() == 0
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    firsts = packed.where("start = 0")
    assert firsts.count() == mix.count() and packed.agg(F.sum("length")).first()[0] == firsts.agg(F.sum("doc_tokens")).first()[0]
