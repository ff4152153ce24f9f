"""Operators on small tables with known results."""

from __future__ import annotations

import pytest

from quorate.functions import text, vectors
from quorate.operators import evaluate, labels, replies, sampling, validate, windows
from quorate.sources import catalog, sinks
from quorate.streaming import files
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_measures(spark):
    d = spark.createDataFrame([("Hello world!",), ("",), (None,)], "t string")
    got = [tuple(r) for r in d.select(*[text.measure(n, "t") for n in ("char_count", "word_count", "sentence_count", "average_sentence_length", "punctuation_count", "punctuation_density")]).collect()]
    assert got == [(12, 2, 1, 2.0, 1, 1 / 12), (0, 0, 0, 0.0, 0, 0.0), (0, 0, 0, 0.0, 0, 0.0)]
    r = spark.createDataFrame([("Hello world.",)], "t string").select(text.grade("t"), text.reading_ease("t")).first()
    assert r[0] == pytest.approx(2.89) and r[1] == pytest.approx(77.905)
    with pytest.raises(KeyError):
        text.measure("none", "t")


def test_labels_ties_and_unanimity(spark):
    data = [("a", "keep")] * 2 + [("a", "remove")] * 2 + [("b", "keep")] * 2 + [("c", "remove")] * 3 + [("d", "keep")] * 2 + [("d", "remove")]
    d = spark.createDataFrame(data, "id string, decision string")
    assert rows(labels.modal(d, "id", []).select("id", "decision")) == [("a", "remove"), ("b", "keep"), ("c", "remove"), ("d", "keep")]
    assert rows(labels.unanimous(d, "id", []).select("id", "decision")) == [("c", "remove")]
    assert rows(labels.cells(d, "id", []).select("id", "cell")) == [("c", "unanimous_remove"), ("d", "majority_keep")]
    assert labels.modal(d.limit(0), "id", []).count() == 0


def test_reply_depths_chain_cycle_and_orphan(spark):
    edges = [(f"c{i}", f"c{i - 1}" if i else "post") for i in range(30)] + [("x", "y"), ("y", "x"), ("o", "gone"), ("n", None)]
    got = dict(replies.depth(spark.createDataFrame(edges, "id string, up string"), "id", "up").collect())
    assert got["c0"] == 0 and got["c7"] == 7 and got["c29"] == 20 and got["x"] == 20 and got["o"] == 0 and got["n"] == 0


def test_validators(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    for check in (lambda: validate.require_columns(d, ["q"]), lambda: validate.require_no_nulls(d, ["k"]), lambda: validate.require_domain(d, "k", ["b"]), lambda: validate.require_unique(d, ["k"]), lambda: validate.require_disjoint(d, d, "k")):
        with pytest.raises(ValueError):
            check()
    assert rows(validate.dependents(d.withColumn("v", F.col("v").cast("string")), "k", ["v"])) == [("a", 2)]


def test_windows_and_samples(spark):
    d = spark.range(23).withColumn("g", F.col("id") % 2)
    assert windows.batches(d, ["g"], ["id"], 5, whole_only=True).count() == 20
    assert windows.first_per_key(d, ["g"], ["id"]).count() == 2
    split = sampling.split(d.withColumn("id", F.col("id").cast("string")), "id", ["g"], [("train", 0.8), ("test", 0.2)])
    assert rows(split.groupBy("split").count()) == [("test", 6), ("train", 17)]
    assert sampling.share_per_class(d, "id", ["g"], 0.1).count() == 4


def test_ranking_against_pairs(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.5)]
    auc = sum((p > q) + 0.5 * (p == q) for g, p in data if g for h, q in data if not h) / 6
    r = evaluate.ranking(spark.createDataFrame(data, "gold int, p double"), "gold", "p").first()
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-6)


def test_vectors(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in d.select(vectors.cosine("a", "b")).collect()] == [0.707107, 0.0]
    assert len(d.select(vectors.dense_block("a", "b")).first()[0]) == 9


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "data_1736815102000_ab.csv").write_text('id,text\n1,"two\nlines ""quoted"""\n')
    (tmp_path / "data_1000000000000_cd.csv").write_text("id,text\n2,old\n")
    got = catalog.uploads_since(spark, str(tmp_path), "2025-01-01").collect()
    assert [(r["id"], r["text"]) for r in got] == [("1", 'two\nlines "quoted"')]
    (tmp_path / "x.json").write_text('{"id": "a", "score": 1}\nnot json\n{"other": 1}\n')
    assert [r["id"] for r in catalog.json_lines(spark, str(tmp_path / "x.json")).collect()] == ["a"]
    with pytest.raises(KeyError):
        catalog.Catalog({"a": "b"}).path("c")
    d = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write(d.limit(0), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["k", "v"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write(d, str(tmp_path / "out"))
    assert rows(sinks.upsert(d, spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), ["k"])) == [("a", 2), ("b", 3)]


def test_stream_takes_each_file_once(spark, tmp_path):
    src, done = tmp_path / "in", []
    d = spark.createDataFrame([("a", 1)], "k string, v int")
    for n in (1, 2):
        d.write.mode("append").parquet(str(src))
        stream = files.read_files(spark, str(src), d.schema)
        files.run_available(stream, str(tmp_path / "cp"), lambda b, i: done.append(b.count()))
        assert sum(done) == n
