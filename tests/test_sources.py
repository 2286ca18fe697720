import json
import os

import pytest
from pyspark.sql import functions as F

from quillstone.plans import experiment, settings
from quillstone.session import clear, materialise, shared_dir
from quillstone.sources import jsonl, labels, scorer, stix, tables
from quillstone.streaming import resume


def put(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    ok = put(tmp_path / "a.jsonl", "﻿" + json.dumps({"input_id": "x", "n": 1}), "", {"input_id": "y", "n": None})
    assert sorted(tuple(r) for r in jsonl.read(spark, ok, "input_id string, n int").collect()) == [("x", 1), ("y", None)]
    with pytest.raises(jsonl.BadLines):
        jsonl.read(spark, put(tmp_path / "b.jsonl", {"input_id": "x", "n": 1}, "{broken"), "input_id string, n int")
    with pytest.raises(jsonl.RepeatedKeys):
        jsonl.read(spark, put(tmp_path / "c.jsonl", {"input_id": "x"}, {"input_id": "x"}), "input_id string")
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("x", 0.5, None)], "input_id string, b double, a string")
    jsonl.write(df, out)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        jsonl.write(df, out)
    jsonl.append(df.withColumn("input_id", F.lit("y")), out)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert lines == ['{"a":null,"b":0.5,"input_id":"x"}', '{"a":null,"b":0.5,"input_id":"y"}']
    with pytest.raises(ValueError):
        jsonl.write(df.withColumn("b", F.lit(float("nan"))), str(tmp_path / "bad"))


def test_kinds_and_labels(spark, tmp_path):
    p = put(tmp_path / "k.jsonl", {"sentences": {}, "evidence_spans": {}}, {"candidates": [], "rerank_metadata": {}}, {"other": 1})
    assert [r.kind for r in jsonl.infer_kind(spark.read.text(p)).collect()] == ["sentences", "reranking", None]
    df = spark.createDataFrame([("x", '["T1059.001", "bad"]'), ("x", "t1003, T1059.001"), ("y", None), ("z", "[]")], "input_id string, labels string")
    got = {r.input_id: r.labels for r in jsonl.union_labels(df).collect()}
    assert got == {"x": ["T1003", "T1059.001"], "y": [], "z": []}
    assert {r.input_id: r.labels for r in jsonl.union_labels(df, parent=True).collect()}["x"] == ["T1003", "T1059"]
    with pytest.raises(Exception, match="invalid label"):
        jsonl.union_labels(df, drop_invalid=False).collect()


def test_tables(spark, tmp_path):
    p = put(tmp_path / "x.csv", "no,CVE ID,Description,a,b", '1,CVE-2020-1,"two\nlines",0,1', "2,CVE-2020-2,other,1,1")
    df = tables.read_csv(spark, p)
    assert (tables.id_column(df), tables.text_column(df, "CVE ID"), tables.one_hot_columns(df, ("no", "CVE ID", "Description"))) == ("CVE ID", "Description", ["a", "b"])
    assert df.count() == 2 and df.where("Description = 'two\nlines'").count() == 1
    assert tables.decision_column(spark.createDataFrame([("x", "y")], "decision string, ai_decision string")) == "ai_decision"
    ids = tables.read_ids(spark, put(tmp_path / "i.txt", "b", "", "a"))
    assert [r.id for r in ids.orderBy("pos").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        tables.read_ids(spark, put(tmp_path / "j.txt", "a", "a"))
    assert [r.id for r in tables.read_ids(spark, put(tmp_path / "i.json", '["q", "p", "q"]')).orderBy("pos").collect()] == ["q", "p"]
    assert [r.id for r in tables.read_ids(spark, put(tmp_path / "i.jsonl", {"input_id": "m"}, {"cve_id": "n"})).orderBy("pos").collect()] == ["m", "n"]
    data = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "input_id string, n int")
    assert [r.n for r in tables.select_ids(data, ids).collect()] == [2, 1]
    with pytest.raises(ValueError):
        tables.select_ids(data.where("n > 1"), ids)
    left, right = spark.createDataFrame([("x",), ("y",)], "a string"), spark.createDataFrame([(1,), (2,)], "b int")
    assert [tuple(r) for r in tables.join_by_position(left, right).collect()] == [("x", 1), ("y", 2)]
    tables.write_report(spark.createDataFrame([("m", 0.5)], "method string, v double"), str(tmp_path / "rep"), {"v": 10})
    assert spark.read.csv(str(tmp_path / "rep"), header=True).first().v == "0.5000000000"
    changed = tables.immutable_columns_changed(spark.createDataFrame([("s", "x", "y")], "sample_id string, a string, b string"), spark.createDataFrame([("s", "x", "z")], "sample_id string, a string, b string"), ["a", "b"])
    assert [r.column for r in changed.collect()] == ["b"]


def bundle(tmp_path):
    ref = lambda i: [{"source_name": "mitre-attack", "external_id": i, "url": "u"}]
    objects = [
        {"type": "attack-pattern", "id": "ap1", "name": "Parent", "description": "See [x](http://y) &amp; z", "external_references": ref("T1000"), "kill_chain_phases": [{"kill_chain_name": "m", "phase_name": "execution"}], "x_mitre_platforms": ["b", "A", "a "]},
        {"type": "attack-pattern", "id": "ap2", "name": "Child", "external_references": ref("T1000.001"), "x_mitre_is_subtechnique": True},
        {"type": "attack-pattern", "id": "ap3", "name": "Old", "external_references": ref("T1001"), "revoked": True},
        {"type": "attack-pattern", "id": "ap4", "name": "Odd", "external_references": ref("X1")},
        {"type": "attack-pattern", "id": "ap5", "name": "None", "external_references": []},
        {"type": "relationship", "id": "r", "relationship_type": "subtechnique-of", "source_ref": "ap2", "target_ref": "ap1"},
        {"type": "x-mitre-tactic", "id": "t", "name": "Execution", "x_mitre_shortname": "execution"},
    ]
    return put(tmp_path / "b.json", {"type": "bundle", "objects": objects})


def test_stix(spark, tmp_path):
    o = stix.read_bundle(spark, bundle(tmp_path))
    i = {r.technique_id: r for r in stix.technique_index(o).collect()}
    assert set(i) == {"T1000", "T1000.001"} and i["T1000.001"].parent_technique_id == "T1000" and i["T1000"].description == "See x & z"
    assert i["T1000"].tactics == ["execution"] and len(i["T1000"].platforms) == 3
    assert {r.reason: r.n for r in stix.exclusions(o).collect()} == {"kept": 2, "revoked": 1, "malformed id": 1, "no id": 1}
    nodes, edges = stix.knowledge_graph(o, stix.technique_index(o))
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("T1000", "TACTIC::execution"), ("T1000.001", "T1000")] and nodes.count() == 3
    assert {r.technique_id: r.revoked for r in stix.status(o).collect()}["T1001"] is True
    merged = stix.merge_index(spark.createDataFrame([(1, "T1", "b"), (2, "T1", "a"), (3, "T1", "b"), (4, "T2", " ")], "pos int, technique_id string, text string"))
    assert [tuple(r) for r in merged.collect()] == [("T1", "b\na")]


def test_scorer(spark, tmp_path):
    s = put(tmp_path / "s.json", {"model": "m", "retries": 5})
    c = scorer.ScorerConfig.resolve(s, env={"SCORER_RETRIES": "7"})
    assert (c.model, c.retries, c.timeout) == ("m", 7, 300.0)

    def flaky(prompt, seed):
        if seed == 1 or prompt == "bad":
            raise RuntimeError("no")
        return f"{prompt}@{seed}"

    p = spark.createDataFrame([("x", "full", "ok", "h"), ("y", "full", "bad", "g")], "input_id string, mode string, prompt string, prompt_sha256 string")
    got = {r.input_id: r for r in scorer.call_scorer(p, flaky, seed=1, attempts=2, backoff=0).collect()}
    assert got["x"].response == "ok@2" and got["x"].attempt == 1 and got["y"].response is None and got["y"].error == "RuntimeError: no"


def test_resume(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    os.makedirs(src)
    put(tmp_path / "src" / "1.jsonl", {"input_id": "a"}, {"input_id": "b"})
    go = lambda: resume.run_available(spark, src, "input_id string", lambda d: d.withColumn("n", F.length("input_id")), sink, ck, "input_id")
    go()
    put(tmp_path / "src" / "2.jsonl", {"input_id": "b"}, {"input_id": "c"})
    go()
    go()
    assert sorted(r.input_id for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_materialise(spark):
    df = materialise(spark.range(3).withColumn("x", F.lit("y")))
    assert df.count() == 3 and df.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file://"))


def test_clear(spark):
    path = materialise(spark.range(1)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    clear()
    assert not os.path.exists(path)


def test_experiment(spark, tmp_path):
    say = ["A buffer overflow allows a remote attacker to send a crafted packet. This leads to remote code execution.", "Path traversal in the archive lets users read arbitrary files."]
    texts = spark.createDataFrame([(f"c{i}", say[i % 2]) for i in range(10)], "input_id string, text string")
    tech = spark.createDataFrame([("T1000", "Overflow", "buffer overflow code execution"), ("T1001", "Traversal", "path traversal files"), ("T1002", "Other", "nothing")], "technique_id string, name string, text string")
    gold = spark.createDataFrame([(f"c{i}", f"T100{i % 2}") for i in range(10)], "input_id string, technique_id string")
    llm = spark.createDataFrame([(f"c{i}", "T1002", 1.0, k) for i in range(10) for k in (1, 2)], "input_id string, technique_id string, llm_score double, seed int")
    work = str(tmp_path / "w")
    make = lambda scores=llm, **c: experiment.Experiment(spark, work, texts, tech, gold, scores, {"select_retrieval": {"lengths": [2, 3], "alphas": [0.5, 1.0]}, "select_beta": {"betas": [0.0, 1.0]}, "rerank": {"topk": 2, "modes": ["full", "generic"], "seeds": [1, 2], **c}})
    e = make()
    m = {(r.method, r.metric): (r.estimate, r.delta) for r in e.run().collect()}
    assert m["retrieval", "hit_1"] == (1.0, 0.0) and m["full", "hit_1"] == (1.0, 0.0) == m["generic", "hit_1"]  # beta 1 is chosen: the scores are of no use
    assert e.table("select_beta").first().beta == 1.0 and e.table("select_retrieval").first().topn == 2
    assert {r["count"] for r in e.table("rerank").groupBy("mode", "seed", "input_id").count().collect()} == {2} and e.table("split").where("split = 'development'").count() == 2
    assert make().run().count() == e.table("evaluate").count()
    with pytest.raises(ValueError, match="another configuration"):
        make(beta=0.0).run()
    with pytest.raises(ValueError, match="other inputs"):
        make(llm.where("input_id <> 'c1'")).run()
    with pytest.raises(ValueError, match="alpha"):
        experiment.Experiment(spark, work, texts, tech, gold, llm, {"retrieve": {"alpha": 2}})
    assert experiment.selected(through="graph") == ("segment", "extract", "graph") and len(e.plan()) == len(experiment.STAGES)


def test_settings(spark):
    assert settings.shares("0.5, 0,0.5,1") == [0.0, 0.5, 1.0] and settings.counts("5,1, 5") == [1, 5]
    assert settings.metric("Hit@5") == ("hit", 5) and settings.metric("mrr") == ("mrr", None)
    for f, bad in ((settings.shares, "1.5"), (settings.shares, " ,"), (settings.counts, "0"), (settings.metric, "hit@0"), (settings.metric, "f1")):
        with pytest.raises(ValueError):
            f(bad)
    assert settings.chosen([], [1, 2]) == [1, 2] and settings.chosen([2, 2], [1, 2]) == [2]
    with pytest.raises(ValueError):
        settings.chosen([3], [1, 2])
    ids = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "input_id string, split string")
    assert sorted(r.input_id for r in settings.first_ids(ids, "split", 1).collect()) == ["a", "c"] and settings.first_ids(ids, "split", 0).count() == 3
    some = ids.where("input_id < 'c'")
    assert settings.exactly(ids, some.select("input_id"), "subset").count() == 2
    with pytest.raises(ValueError):
        settings.exactly(ids, some.select("input_id"))


def test_label_files(spark):
    lines = ['{"input_id": " a ", "labels": ["t1000", "T1001.001", "bad", 7]}', '{"cve_id": "b", "gold": "T1000"}', '{"input_id": "a", "labels": "T1002; T1003"}', "", "{oops", '{"input_id": "c", "labels": []}', '{"input_id": "d"}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    load = lambda *a, **k: {r.input_id: r.labels for r in labels.load_labels(df, *a, **k).collect()}
    assert load() == {"a": ["T1000", "T1001.001", "T1002", "T1003"]}
    assert load("sweep", parent=True) == {"a": ["T1000", "T1001"], "b": ["T1000"], "c": [], "d": []}
    assert load("audit")["a"] == ["7", "T1001.001", "T1002; T1003", "bad", "t1000"] and load("audit")["c"] == []
    assert labels.label_report(df).first().texts_repaired == 1
    found = {tuple(r) for r in labels.label_problems(df, "audit").collect()}
    assert {("a", "invalid label"), ("a", "label is no text"), ("c", "no labels"), ("d", "no labels"), (None, "malformed line"), (None, "no id")} == found
    assert labels.run_specs(["m=a", "n=b", "m = c"]) == [("m", "a", 1), ("n", "b", 1), ("m", "c", 2)]
    with pytest.raises(ValueError):
        labels.run_specs(["x"])


def test_ranking_files(spark, tmp_path):
    c = lambda t, r, **k: {"technique_id": t, "retrieval_rank": r, **k}
    put(tmp_path / "a.jsonl", {"input_id": "x", "candidates": [c("T1001.001", 1, rerank_rank=2), c("T1001.002", 2, rerank_rank=1), c("T1000", 3)]}, {"input_id": "y", "candidates": [c("T1000", 2, final_score=0.1), c("T1001", 1, final_score=0.9, llm_score=3.0)]})
    put(tmp_path / "b.jsonl", {"input_id": "x", "candidates": [c("T1000", 1), c("T1000", 1), c("nope", 1)]}, {"input_id": "z", "candidates": []}, {"input_id": "x", "candidates": [c("T1000", 1)]})
    df = labels.ranking_lines(spark, [f"m={tmp_path}/a.jsonl", f"m={tmp_path}/b.jsonl"])
    got = {(r.run, r.input_id, r.technique_id): (r.rank, r.retrieval_rank) for r in labels.load_rankings(df).collect()}
    assert got[1, "x", "T1001.002"] == (1, 2) and got[1, "x", "T1000"] == (3, 3) and got[1, "y", "T1001"] == (1, 1) and got[1, "y", "T1000"] == (2, 2)
    up = {(r.run, r.input_id, r.technique_id): r.rank for r in labels.load_rankings(df, parent=True).collect()}
    assert up[1, "x", "T1001"] == 1 and up[1, "x", "T1000"] == 2
    found = {(r.run, r.input_id, r.problem) for r in labels.ranking_problems(df, 2).collect()}
    assert {(1, "x", "ranks not 1..n"), (1, "y", "score out of range"), (2, "x", "repeated id"), (2, "z", "no candidates"), (2, "x", "malformed technique id"), (2, "x", "repeated technique"), (2, "x", "list too short")} == found
    assert {r.input_id for r in labels.inconsistent_runs(df).collect()} == {"x", "y"}
