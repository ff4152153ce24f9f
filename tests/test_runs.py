"""Sources, sinks and runs on small folders."""

from __future__ import annotations

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.operators import sampling, select, validate
from quorate.plans import registry
from quorate.sources import catalog, discover, sinks
from quorate.streaming import files, runs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_listing_and_latest(spark, tmp_path):
    for name in ("b/2.txt", "a/1.txt", "RC_2024-06.zst", "rs_2005-12.ZST", "RC_x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [k.rsplit("/", 1)[-1] for k in discover.keys(spark, str(tmp_path))] == ["RC_2024-06.zst", "RC_x.txt", "1.txt", "2.txt", "rs_2005-12.ZST"]
    assert [k[-5:] for k in discover.keys(spark, str(tmp_path), "a/")] == ["1.txt"] and discover.keys(spark, str(tmp_path / "none")) == []
    assert [p[-14:] for p in discover.inputs(spark, str(tmp_path), ["RC_2024"])] == ["RC_2024-06.zst"]
    assert discover.inputs(spark, str(tmp_path), ignored=["RC_2024-06"]) == []
    kinds = {r["name"]: (r["kind"], r["month"]) for r in discover.inventory(spark, str(tmp_path)).collect()}
    assert kinds["RC_2024-06.zst"] == ("comment_zst", "2024-06") and kinds["rs_2005-12.ZST"] == ("submission_zst", None) and kinds["1.txt"] == ("other", None)
    assert discover.latest_file(["a/x_2025_01_02-03:04:05.csv", "b/x_2025_01_03-00:00:00.csv", "c"]) == ("b/x_2025_01_03-00:00:00.csv", "2025_01_03-00:00:00")
    with pytest.raises(FileNotFoundError):
        discover.latest_file(["none"])
    with pytest.raises(ValueError):
        discover.month_path("x", "2024")
    assert discover.month_path("x/", "2024-01") == "x/month=2024-01"


def test_objects_are_written_whole(spark, tmp_path):
    path = str(tmp_path / "o.json")
    discover.write_object(spark, b"\x00\xff1", path)
    discover.write_object(spark, b"2", path)
    assert discover.read_object(spark, path) == b"2" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["o.json"]
    assert discover.content_type("a.CSV") == "text/csv" and discover.content_type("a.bin") == "application/octet-stream"


def test_manifests_and_json_folders(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps({"export_file": "e.csv"}))
    (tmp_path / "one" / "e.csv").write_text("id,t\n1,a\n")
    (tmp_path / "two" / "e.csv").write_text("id,u\n2,b\n")
    assert rows(discover.manifests(spark, str(tmp_path)).select("id", "t", "u", "integration")) == [("1", "a", None, "one"), ("2", None, "b", "two")]
    (tmp_path / "two" / "e.csv").unlink()
    with pytest.raises(FileNotFoundError):
        discover.manifests(spark, str(tmp_path))
    (tmp_path / "j").mkdir()
    with pytest.raises(ValueError):
        discover.json_folder(spark, str(tmp_path / "j"), "id string")
    (tmp_path / "j" / "metadata.json").write_text("{}")
    for i in (2, 1):
        (tmp_path / "j" / f"p{i}.json").write_text(json.dumps({"id": f"p{i}", "v": i}, indent=1))
    assert rows(discover.json_folder(spark, str(tmp_path / "j"), "id string, v long")) == [("p1", 1, "p1.json"), ("p2", 2, "p2.json")]
    assert sinks.compact(spark, str(tmp_path / "j"), str(tmp_path / "all"), "id string, v long", remove=True) == 2
    assert sorted(p.name for p in (tmp_path / "j").glob("*.json")) == ["metadata.json"]


def test_checked_predictions_and_payloads(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"id": "a", "y": 1}\n{"id": "b", "y": 0}\n')
    schema = spark.createDataFrame([], "id string, y long").schema
    assert rows(discover.predictions(spark, str(path), schema, "id")) == [("a", 1), ("b", 0)]
    path.write_text('{"id": "a", "y": 1}\n{"id": "a", "y": 0}\n')
    with pytest.raises(ValueError):
        discover.predictions(spark, str(path), schema, "id")
    path.write_text('{"id": "a"}\n')
    with pytest.raises(ValueError):
        discover.predictions(spark, str(path), schema, "id")
    d = spark.createDataFrame([('{"k": 1}',), (json.dumps('{"k": 2}'),), ("no",), (None,)], "c string")
    assert [r[0] for r in d.select(discover.payload(F.col("c"), "k long")["k"]).collect()] == [1, 2, None, None]


def test_odd_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Report\nmade today\n\nid,user_id,x\n1,u,a\n2,v,b\n")
    assert rows(discover.csv_after_preamble(spark, str(tmp_path / "r.csv"), "id,user_id,")) == [("1", "u", "a"), ("2", "v", "b")]
    t = "x \\begin{array}{lr}\\hline \\text{F1} & 0.5 \\\\ \\hline AUC & \\textbf{0.75} \\\\ \\end{array} y"
    assert spark.createDataFrame([(t,)], "t string").select(discover.latex_rows(F.col("t"))).first()[0] == [["F1", "0.5"], ["AUC", "0.75"]]
    import zstandard

    data = b'{"id": "a"}\n\n{"id": "b"}\n'
    (tmp_path / "RC_2020-01.zst").write_bytes(zstandard.ZstdCompressor().compress(data))
    assert [r["line"] for r in discover.archive_lines(spark, [str(tmp_path / "RC_2020-01.zst")]).collect()] == ['{"id": "a"}', '{"id": "b"}']
    buffer = io.BytesIO()
    np.save(buffer, np.eye(2))
    discover.write_object(spark, buffer.getvalue(), str(tmp_path / "m.npy"))
    assert rows(discover.matrix(spark, str(tmp_path / "m.npy"), ["a", "b"], 2)) == [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    with pytest.raises(ValueError):
        discover.matrix(spark, str(tmp_path / "m.npy"), ["a"], 2)
    d = spark.createDataFrame([("b", [2.0]), ("a", [1.0])], "id string, v array<double>")
    assert sinks.write_matrix(d, "id", "v", str(tmp_path / "run"), {"dim": 1}) == 2
    assert np.load(tmp_path / "run" / "vectors.npy").tolist() == [[1.0], [2.0]] and (tmp_path / "run" / "ids.txt").read_text() == "a\nb"


def test_key_values(spark, tmp_path):
    kv = discover.KeyValues(spark, str(tmp_path / "kv"), "k string, v long", "k")
    assert kv.get("a") is None and kv.scan().count() == 0
    kv.put(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"))
    kv.put(spark.createDataFrame([("a", 3)], "k string, v long"))
    assert kv.get("a")["v"] == 3 and rows(kv.scan()) == [("a", 3), ("b", 2)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("m1", "post", "keep")], "id string, t string, y string")
    sinks.write_chat(d, "id", "be fair", "t", "y", str(tmp_path / "chat"))
    lines = "".join(p.read_text() for p in (tmp_path / "chat").glob("part-*"))
    assert json.loads(lines) == {"message_id": "m1", "messages": [{"role": "system", "content": "be fair"}, {"role": "user", "content": "post"}, {"role": "assistant", "content": "keep"}]}
    assert sinks.export_lines(d, {"name": "id"}, str(tmp_path / "zst")) == 1
    assert [r["line"] for r in discover.archive_lines(spark, discover.keys(spark, str(tmp_path / "zst"))).collect()] == ['{"name":"m1"}']
    with pytest.raises(FileExistsError):
        sinks.export_lines(d, {"name": "id"}, str(tmp_path / "zst"))
    for _ in range(2):
        sinks.append(d, str(tmp_path / "csv"), "csv")
    assert catalog.csv(spark, str(tmp_path / "csv")).count() == 2
    path = str(tmp_path / "total.json")
    assert [sinks.write_metadata(spark, path, s, n)["total"] for s, n in (("a", 2), ("b", 3), ("a", 4))] == [2, 5, 7]
    t = spark.createDataFrame([("a|b", 0.5, None)], "k string, x double, n long")
    assert sinks.markdown(t).splitlines()[2] == "| a\\|b | 0.5000 | – |"
    assert sinks.between_marks("x <!-- t:begin -->old<!-- t:end --> y", "t", "new") == "x <!-- t:begin -->\nnew\n<!-- t:end --> y"
    with pytest.raises(ValueError):
        sinks.between_marks("x", "t", "new")
    g = spark.createDataFrame([("p", "a", 1), ("q", "b", 2)], "r string, c string, v long")
    assert sinks.grid(g, "r", "c", "v", ["a", "b"]) == "r  a  b\np  1  -\nq  -  2"


def test_retries_budget_and_rounds(spark, tmp_path):
    seen, slept = [], []

    def flaky(texts):
        seen.append(list(texts))
        if len(seen) == 1:
            raise OSError
        return [None if t == "bad" else t.upper() for t in texts]

    assert runs.with_retries(flaky, ["a", "bad"], sleep=slept.append) == (["A", None], 3) and seen[2] == ["bad"] and slept == [1.0, 2.0]
    assert runs.with_retries(lambda t: [None] * len(t), ["a"], each=False, sleep=slept.append)[0] == [None]
    d = spark.createDataFrame([("x",), (None,), ("no",)], "t string")
    got = runs.answered(d, "t", lambda ts: [None if t == "no" else t + "!" for t in ts], batch=2, wait=0.0)
    assert rows(got.select("t", "answer", "reason")) == [("no", None, "no_answer"), ("x", "x!", None), (None, "!", None)]
    b = runs.Budget(5)
    assert (b.grant(3), b.grant(3), b.exhausted, b.left) == (3, 2, True, 0)
    state = runs.bounded_run(spark, ["a.zst", "b.zst", "c.zst"], lambda p: 10, most_files=2)
    assert state == {"files": {"a": 10, "b": 10}, "total": 20, "stopped_reason": "files"}
    assert runs.bounded_run(spark, ["a.zst", "b.zst", "c.zst"], lambda p: 10, most_rows=20, state=state)["stopped_reason"] == "rows"
    assert runs.bounded_run(spark, ["a.zst", "c.zst"], lambda p: 1, state=state)["total"] == 21
    done = tmp_path / "done"
    spark.createDataFrame([], "k string").write.parquet(str(done))
    step = lambda missing, i: missing.orderBy("k").limit(2).select("k").write.mode("append").parquet(str(done))
    asked = spark.createDataFrame([(c,) for c in "abcde"], "k string")
    assert runs.covered(asked, "k", lambda: spark.read.parquet(str(done)), step, 2).count() == 1
    assert runs.covered(asked, "k", lambda: spark.read.parquet(str(done)), step).count() == 0


def test_windows_and_repeats_of_streams(spark, tmp_path):
    e = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 05:00:00")], "k string, s string").select("k", F.to_timestamp("s").alias("at"))
    e.write.parquet(str(tmp_path / "in"))
    stream = lambda: files.read_files(spark, str(tmp_path / "in"), e.schema)
    out = []
    files.run_available(files.once_per_key(stream(), "k", "at"), str(tmp_path / "c1"), lambda b, i: out.extend(r["k"] for r in b.collect()))
    assert sorted(out) == ["a", "b"]
    closed = []
    files.run_available(files.windowed(stream(), "at", ["k"]), str(tmp_path / "c2"), lambda b, i: closed.extend((r["k"], r["n"]) for r in b.collect()))
    assert ("a", 2) in closed
    allowed, rest = files.within_budget(spark.createDataFrame([(1,), (2,), (3,)], "i int"), ["i"], 1, 3)
    assert rows(allowed) == [(1,), (2,)] and rows(rest) == [(3, "budget_exhausted")]


def test_plans_of_calls(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(ValueError):
        select.require_answers(asked, asked.limit(1), "id")
    select.require_answers(asked, asked, "id")
    assert select.calls_cost(10, 1000, 500, (2.0, 8.0)) == pytest.approx(0.06)
    d = spark.createDataFrame([('["a", "b"]',), ('{"ids": ["c"]}',), ("no",)], "j string")
    assert [r[0] for r in d.select(select.excluded_ids(F.col("j"))).collect()] == [["a", "b"], ["c"], None]
    t = spark.createDataFrame([("moderation-trial", " 1 ", "x", None), ("moderation-trial", "two", "x", None), ("other", "1", "x", None)], "trial_type string, phase string, attitude_a string, empty string")
    p = select.pilot_trials(t)
    assert rows(select.without_empty_columns(p)) == [("moderation-trial", 1.0)]


def test_more_contracts(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 1), ("b", 0, 1)], "k string, y int, p int")
    validate.require_schema(d, {"k": "string", "y": "int"})
    validate.require_shares(d, "y", {1: 0.5, 0: 0.5}, 0.01)
    validate.require_measure(d, "y", "p", 0.5)
    validate.require_cover(d, [d.limit(0), d], "k")
    for check in (lambda: validate.require_schema(d, {"y": "string"}), lambda: validate.require_shares(d, "y", {1: 0.9}, 0.1), lambda: validate.require_shares(d.limit(0), "y", {1: 0.5}, 0.1), lambda: validate.require_measure(d, "y", "p", 0.9), lambda: validate.require_cover(d, [d, d], "k"), lambda: validate.require_cover(d, [d.where("k = 'a'")], "k")):
        with pytest.raises(ValueError):
            check()
    made = [sampling.frozen(spark, str(tmp_path / "f"), lambda: sampling.sample(d, "k", 1)) for _ in range(2)]
    assert [m for _, m in made] == [True, False] and rows(made[0][0]) == rows(made[1][0])
    assert list(registry.chosen(["modal_labels"])) == ["modal_labels"] and len(registry.chosen()) > 100
    with pytest.raises(KeyError):
        registry.chosen(["none"])


def test_catalog_of_the_study(spark, tmp_path):
    c = catalog.Catalog(catalog.STUDY, "/data/")
    assert c.path("flips") == "/data/flips.parquet" and c.names(kind="results") == ["trials"] and len(c.names()) == 8
    assert c.names("transformed", "dumps") == ["toxicity_scores"] and c.entry("trials").phase == "phase 2 part 2"
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    assert catalog.csv(spark, str(tmp_path / "x.csv"), lines=True, infer=True).dtypes == [("a", "int"), ("b", "string")]
