import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import session
from quillstone.operators import audit, contracts, dataset, explanation, extract, graph, metrics, rerank, retrieval, segment, significance
from quillstone.plans import ranking, records


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_idf_and_retrieval(spark):
    items = spark.createDataFrame([("T1", "alpha beta"), ("T2", "beta gamma"), ("T3", "delta delta")], "technique_id string, text string")
    idf = {r.token: r.idf for r in retrieval.idf(items).collect()}
    assert idf["alpha"] == pytest.approx(math.log(4 / 2) + 1)
    q = spark.createDataFrame([("q1", "alpha"), ("q2", "nothing here"), ("q3", None)], "query_id string, text string")
    got = rows(retrieval.retrieve(q, items, 2).select("query_id", "rank", "technique_id", "score"))
    assert [g[:3] for g in got] == [("q1", 1, "T1"), ("q1", 2, "T2"), ("q2", 1, "T1"), ("q2", 2, "T2"), ("q3", 1, "T1"), ("q3", 2, "T2")]
    assert got[0][3] > 0 and got[1][3] == 0
    assert got == rows(retrieval.retrieve(q, items, 2, dense_cells=0).select("query_id", "rank", "technique_id", "score"))  # too large for a matrix: by joins
    assert retrieval.retrieve(q.limit(0), items, 2).count() == 0 == retrieval.retrieve(q, items.limit(0), 2).count()
    fused = retrieval.fuse_views(spark.createDataFrame([("q", "T1.001", 0.4), ("q", "T1.002", 0.6)], "query_id string, technique_id string, score double"), spark.createDataFrame([("q", "T1.001", 1.0)], "query_id string, technique_id string, score double"), 0.5)
    parent = retrieval.collapse_to_parent(fused).first()
    assert (parent.technique_id, parent.representative_technique_id, parent.source_technique_ids, parent.score_fused) == ("T1", "T1.001", ["T1.001", "T1.002"], 0.7)


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([("m", 1, "x", t, i + 1) for i, t in enumerate("abcde")], "method string, run int, input_id string, technique_id string, rank int")
    g = spark.createDataFrame([("x", "a"), ("x", "c"), ("x", "z")], "input_id string, technique_id string")
    s = metrics.per_input(metrics.relevance(r, g), (1, 5)).first()
    assert s.ap_5 == pytest.approx((1 + 2 / 3) / 3) and s.recall_5 == pytest.approx(2 / 3) and s.precision_5 == 0.4 and s.mrr == 1.0
    twice = r.unionByName(r.withColumn("rank", F.col("rank") + 5))
    assert metrics.keep_first(twice).count() == 5


def test_significance_by_hand(spark):
    assert significance.sign_flip_p([1, 1, 1, 0]) == 0.25 and significance.sign_flip_p([0, 0]) == 1.0
    assert significance.quantile([1, 2, 10], 0.025) == pytest.approx(1.05)
    pairs = spark.createDataFrame([("a", "b", str(i), float(x), float(y)) for i, (x, y) in enumerate([(1, 0)] + [(0, 1)] * 5 + [(1, 1)] * 3)], "left_method string, right_method string, input_id string, left_value double, right_value double")
    assert significance.mcnemar(pairs).first().p_value == pytest.approx(0.21875)
    same = pairs.where("left_value = right_value")
    assert significance.mcnemar(same).first().p_value == 1.0
    assert significance.mcnemar(pairs.withColumn("left_value", F.lit(0.5))).first().p_value is None
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "m string, p_value double")
    assert {r.m: round(r.p_holm, 10) for r in significance.holm(p, "p_value", "m").collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}
    d = significance.differences(pairs).first()
    assert (d.wins, d.ties, d.losses) == (1, 3, 5)
    samples = spark.createDataFrame([("m", str(i), float(i % 3)) for i in range(30)], "method string, input_id string, v double")
    b = significance.bootstrap(samples, "v", 100).first()
    assert b.low <= b.estimate <= b.high
    big = [0.1 * (-1) ** i + 0.01 for i in range(40)]
    assert significance.sign_flip_p(big, 500, 1) == significance.sign_flip_p(big, 500, 1) <= 1


def test_resampling_draws_and_repetitions(spark, sf, monkeypatch):
    """Whole arrays draw what one number after the other does, and the queries draw as often as the reference: 20000 and 5000 times."""
    rng = random.Random(3)
    d = [rng.choice([-1.0, -0.5, 0.25, 1 / 3, 0.5]) for _ in range(75)]
    one, seen = random.Random(9), abs(sum(d) / len(d))
    hits = sum(abs(sum(x if one.random() < 0.5 else -x for x in d) / len(d)) >= seen - 1e-15 for _ in range(3000))
    assert significance.sign_flip_p(d, 3000, 9) == (hits + 1) / 3001
    one = random.Random(9)
    means = sorted(sum(d[one.randrange(75)] for _ in d) / 75 for _ in range(3000))
    assert significance.bootstrap_interval(d, 3000, 0.95, 9) == pytest.approx((significance.quantile(means, 0.025), significance.quantile(means, 0.975)), abs=1e-12)
    monkeypatch.setattr(significance, "CELLS", 100, raising=False)
    assert significance.sign_flip_p(d, 3000, 9) == (hits + 1) / 3001
    used = {}
    for name, f in (("sign_flip", significance.sign_flip), ("bootstrap", significance.bootstrap)):
        monkeypatch.setattr(significance, name, lambda *a, _n=name, _s=inspect.signature(f), **k: used.update({_n: (b := _s.bind(*a, **k)).apply_defaults() or b.arguments["repetitions"]}))
    ranking.queries()["sign_flip"](spark, sf), ranking.queries()["bootstrap_interval"](spark, sf)
    assert used == {"sign_flip": 20000, "bootstrap": 5000}
    assert inspect.signature(significance.stratified_bootstrap).parameters["repetitions"].default == 5000


def test_kappa_and_sample(spark):
    m = audit.confusion(spark.createDataFrame([("A", "A"), ("A", "A"), ("B", "B"), ("A", "B")], "x string, y string"), "x", "y")
    assert audit.kappa(m).first().kappa == pytest.approx(0.5)
    one = audit.confusion(spark.createDataFrame([("A", "A")], "x string, y string"), "x", "y")
    assert audit.kappa(one).first().kappa is None
    pairs = spark.createDataFrame([(f"i{i}", "T1" if i < 10 else "T2") for i in range(13)], "input_id string, technique_id string")
    s = audit.stratified_sample(pairs, 4, 1)
    assert rows(s.groupBy("technique_id").agg(F.count("*"), F.sum("analysis_weight"))) == [("T1", 4, 10.0), ("T2", 3, 3.0)]
    assert rows(s) == rows(audit.stratified_sample(pairs, 4, 1)) and s.first().sample_id.startswith("LSA-")
    r = audit.resolved(spark.createDataFrame([("a", "a", None), ("a", "b", "b"), ("a", None, None)], "d1 string, d2 string, d3 string"))
    assert [x.resolution for x in r.collect()] == ["agreement", "adjudicated", "open"]


def test_graph(spark):
    n = spark.createDataFrame(
        [("x", "EN1", "Entry", "alpha", ["E1", "E2"], 0.8), ("x", "B1", "Behavior", "beta", ["E2"], 0.6), ("x", "I1", "Impact", "gamma", ["E3"], None), ("y", "P1", "Precondition", "p", [], 0.5)],
        "input_id string, node_id string, type string, text string, evidence_ids array<string>, confidence double",
    )
    e = graph.layer_edges(n)
    assert rows(e.select("src", "dst", "type", "structural_score")) == [("B1", "I1", "causes", round(0.2 * 0.55, 6)), ("EN1", "B1", "enables", 0.415)]
    best = {r.input_id: (r.path, r.status) for r in graph.best_path(n, e).collect()}
    assert best == {"x": ("EN1>B1>I1", "complete")}
    assert graph.minimum_cover([["E1", "E2"], ["E2"], ["E3"]]) == ["E2", "E3"] == graph.minimum_cover([["E1", "E2"], ["E2"], ["E3"]], 0)
    assert graph.minimum_cover([["E1"], []]) is None and graph.minimum_cover([]) == [] and graph.minimum_cover([["E12"], ["E3"]], 0) == ["E3", "E12"]
    assert graph.dangling_edges(e, n.where("node_id <> 'B1'")).count() == 2
    x = explanation.explanations(n, e).first()
    assert x.status == "complete" and x.evidence_ids == ["E1", "E2", "E3"] and x.minimum_evidence == ["E2", "E3"]
    assert explanation.query_text(explanation.explanations(n, e), e).first().text == "entry alpha enables behavior beta causes impact gamma"
    ev = spark.createDataFrame([("x", "E2", "aka foo")], "input_id string, evidence_id string, text string")
    assert {r.node_id: r.evidence_ids for r in graph.drop_alias_evidence(n, ev).collect()}["EN1"] == ["E1"]
    assert {r.node_id: r.evidence_ids for r in graph.drop_alias_evidence(n, ev).collect()}["B1"] == ["E2"]


def test_best_paths_by_brute_force(spark):
    """Every simple path of random graphs, ranked one by one."""
    rng = random.Random(4)
    kinds, nodes, edges = ("Precondition", "Entry", "VulnType", "Behavior", "Impact"), [], []
    for r in range(60):
        n = rng.randrange(1, 7)
        many = 70 if r % 5 == 0 else 6
        for i in range(n):
            nodes.append((f"r{r}", f"N{i}", rng.choice(kinds), "t", [f"E{k}" for k in rng.sample(range(1, many), rng.randrange(0 if rng.random() < 0.2 else 1, 4))], rng.choice([0.2, 0.5, 0.9, None])))
        for _ in range(rng.randrange(0, 12)):
            edges.append((f"r{r}", f"N{rng.randrange(n)}", f"N{rng.randrange(n + 1)}", rng.choice(["enables", "causes"]), rng.choice([0.1, 0.5, 0.7]), rng.random() < 0.3))
    nd = spark.createDataFrame(nodes, "input_id string, node_id string, type string, text string, evidence_ids array<string>, confidence double")
    ed = spark.createDataFrame(edges, "input_id string, src string, dst string, type string, structural_score double, explicit boolean")
    got = {x.input_id: x for x in graph.best_paths(nd, ed).collect()}

    def core(types):
        at, found = -1, 0
        for t in graph.CORE:
            if t in types[at + 1 :]:
                at, found = types.index(t, at + 1), found + 1
        return found

    for r in {x[0] for x in nodes}:
        own = {x[1]: x for x in nodes if x[0] == r and x[4]}
        best = {}
        for x in edges:
            if x[0] == r and x[1] in own and x[2] in own:
                best[x[1], x[2]] = max(best.get((x[1], x[2]), (False, 0.0)), (x[5], x[4]))
        paths, step = [], [(i,) for i in own]
        while step and len(step[0]) <= 4:
            paths += step
            step = [(*p, b) for p in step for a, b in best if a == p[-1] and b not in p]

        def key(p):
            types = [own[i][2] for i in p]
            links = [best[e] for e in zip(p, p[1:])]
            shared = [len(set(own[a][4]) & set(own[b][4])) for a, b in zip(p, p[1:])]
            mean = lambda v: round(sum(v) / max(len(p) - 1, 1), 12)
            done = types[0] == "Entry" and types[-1] == "Impact" and "Behavior" in types
            sure = round(sum(0.5 if own[i][5] is None else own[i][5] for i in p) / len(p), 12)
            return (not done, -core(types), -mean([s > 0 for s in shared]), -mean(shared), -mean([x for x, _ in links]), len(p), len(graph.minimum_cover([own[i][4] for i in p])), -mean([s for _, s in links]), -sure, p)

        if not own:
            assert r not in got
            continue
        want = min(map(key, paths))
        x = got[r]
        assert tuple(x.path) == want[-1] and x.n_paths == len(paths) and (x.core_coverage, x.cover_size, x.complete) == (-want[1], want[6], not want[0])
    assert graph.best_paths(nd.limit(0), ed).count() == 0
    before = {x.input_id: x for x in explanation.explanations(nd, ed.withColumn("shared_evidence_ids", F.array().cast("array<string>"))).collect()}
    assert any(x.precondition for x in before.values()) and all(x.precondition not in x.chain for x in before.values() if x.precondition)


def test_layered_explanations(spark):
    """Explanations with layer edges made in the row equal those with joined edges, and these a choice of the precondition one by one."""
    rng = random.Random(11)
    kinds, nodes = ("Precondition", "Precondition", "Entry", "VulnType", "Behavior", "Impact", None), []
    for r in range(150):
        many = 90 if r % 50 == 0 else 7
        for i in range(40 if many == 90 else rng.randrange(1, 9)):
            ids = [f"E{k}" for k in rng.sample(range(1, many), rng.randrange(0 if rng.random() < 0.1 else 1, 4))]
            text = rng.choice(["Flag A part1", "flag b part1 x", "", None, "flag part2 part1"])
            nodes.append((None if r == 1 else f"r{r}", f"N{i}", rng.choice(kinds), text, ids, rng.choice([0.05, 0.15, 0.5, None])))
    nd = spark.createDataFrame(nodes, "input_id string, node_id string, type string, text string, evidence_ids array<string>, confidence double")
    ed = graph.layer_edges(nd)
    for limit in (20, 2):
        apart, row = explanation.explanations(nd, ed, 4, limit), explanation.layered_explanations(nd, 4, limit)
        want = {str(x.input_id): x for x in apart.collect()}
        assert want == {str(x.input_id): x for x in row.collect()} and len(want) > 100 and len({len(x.minimum_evidence) for x in want.values()}) > 2
        assert sorted(explanation.query_text(apart.where("input_id is not null"), ed).collect()) == sorted(explanation.layered_query_text(row.where("input_id is not null")).collect())
        links = [tuple(x) for x in ed.select("input_id", "src", "dst", "structural_score").collect()]
        for r, x in want.items():
            own = {i[1]: i for i in nodes if str(i[0]) == r and i[4]}
            cover = lambda *ids: graph.minimum_cover([own[i][4] for i in ids], limit)  # noqa: B023, E731
            options = []
            for a, src, dst, score in links:
                if str(a) == r and src in own and own[src][2] == "Precondition" and dst in x.chain and src not in x.chain:
                    sure = 0.5 if own[src][5] is None else own[src][5]
                    options.append((-len({*own[src][4]} & {*own[dst][4]}), -score, -sure, len(cover(src, *x.chain)), src))
            first = min(options)[-1] if options else None
            assert x.precondition == first and x.minimum_evidence == cover(*[first] * bool(first), *x.chain)
    ties = [0.0000005, 0.1234565, 0.1234575, -0.0000015, 0.55 / 3, 2.5e-7, 1.0000005, 0.2 * 0.15 + 0.25 * 0.5]
    x = spark.createDataFrame([(i, v) for i, v in enumerate(ties)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("v")).collect()
    assert [r.v for r in x] == graph._half_up(np.array(ties), 6).tolist()


@pytest.mark.parametrize("name", ["explanations", "explanation_queries"])
def test_explanations_in_one_shuffle(spark, sf, name):
    """Neither edges nor paths are shuffled or written, which took 39 times the input."""
    session.clear()
    plan = records.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and not session._MADE


def test_segmentation(spark):
    f = segment.evidence_units
    one = "Many affected systems. Remote attackers can read arbitrary files in this product."
    assert f(one) == [one]  # a bare ending in "ms." closes no sentence
    two = "The parser in version 5.0 fails to check lengths. Attackers may read memory of the process."
    assert f(two) == ["The parser in version 5.0 fails to check lengths.", "Attackers may read memory of the process."]
    assert len(f("A crafted request reaches the parser of the server which allows attackers to read memory", aggressive=True)) == 2
    long = " ".join(["word"] * 400)
    assert " ".join(f(long)) == long and all(len(u) <= 420 for u in f(long)) and len(f(long, max_chars=60, min_chars=5, max_evidence=3)) == 3
    assert f("") == []
    assert f("a " + "x" * 900 + " b") == ["a " + "x" * 900 + " b"]  # a word is never cut
    quoted = 'The manual says to "never do this." The next part of the text comes after it.'
    assert f(quoted) == ['The manual says to "never do this."', "The next part of the text comes after it."]
    halves = "the parser does not check lengths of fields; an attacker can read memory of it"
    assert f(halves) == [halves] and f(halves, aggressive=True) == ["the parser does not check lengths of fields;", "an attacker can read memory of it"]
    listed = "versions before the first one; 2.3; 4.5; 6.7; and all the others that nobody has counted"
    assert f(listed, aggressive=True) == [listed]
    with pytest.raises(ValueError):
        f("x", min_chars=30, max_chars=50)
    df = spark.createDataFrame([("a", two), ("b", None), ("c", "")], "input_id string, text string")
    s = rows(segment.spans(segment.segment(df, "input_id", "text"), "input_id").select("evidence_id", "start", "end"))
    assert s == [("E1", 0, 49), ("E2", 50, 91)]


def test_extraction(spark):
    e = spark.createDataFrame(
        [("x", 1, "E1", "A buffer overflow in the parser allows a remote attacker to send a crafted packet."), ("x", 2, "E2", "This leads to remote code execution."), ("y", 1, "E1", "nothing"), ("z", 1, "E1", "causes a crash with unknown impact"), ("z", 2, "E2", "a denial of service and privilege escalation")],
        "input_id string, ord int, evidence_id string, text string",
    )
    n = {r.node_id: r for r in extract.nodes(e).collect() if r.input_id == "x"}
    assert set(n) == {"PRECONDITION::P1", "ENTRY::EN1", "VULNTYPE::VT1", "BEHAVIOR::B1", "IMPACT::I1"}
    assert n["IMPACT::I1"].text == "code_execution" and n["IMPACT::I1"].evidence_ids == ["E2"] and n["BEHAVIOR::B1"].text.endswith("impact=code_execution")
    assert rows(extract.explicit_impacts(e).select("input_id", "impact", "evidence_ids", "ord")) == [("x", "code_execution", ["E2"], 1), ("z", "denial_of_service", ["E2"], 2), ("z", "privilege_escalation", ["E2"], 1)]
    v = spark.createDataFrame([("SQL Injection", ""), ("heap overflow", "Stack Based"), ("remote code execution", "x"), ("bypass", ""), ("Odd Thing", None)], "t string, s string")
    assert [tuple(r.v) for r in v.select(extract.vulnerability_type(F.col("t"), F.col("s")).alias("v")).collect()] == [("injection", "sql_injection"), ("memory_corruption", "stack_based"), ("unspecified", ""), ("auth_bypass", "auth_bypass"), ("odd_thing", "")]


def test_dataset(spark):
    r = spark.createDataFrame([("C1", "long text", ["b", "a"], "s1", 1, 1, "h1"), ("C1", "short", ["c"], "s2", 2, 1, "h2"), ("C2", None, None, "s1", 1, 2, "h3")], "base string, raw_text string, labels array<string>, source_name string, source_position int, source_record_order int, record_sha256 string")
    m = {x.base: x for x in dataset.merge_sources(r).collect()}
    assert m["C1"].raw_text == "long text" and m["C1"].labels == ["a", "b", "c"] and m["C1"].source_membership == ["s1", "s2"] and m["C2"].raw_text is None and m["C2"].labels == []
    recs = [(f"r{i}", ["A"] if i % 2 else ["B", "C"] if i % 3 else ["C"]) for i in range(30)] + [("solo", ["Z"])]
    part = dataset.stratified_split(recs, 6, 1)
    assert len(part) == 6 and part == dataset.stratified_split(recs, 6, 1)
    assert all(0 < sum(lab in ls for i, ls in recs if i in part) < sum(lab in ls for _, ls in recs) for lab in "ABC")
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("ab", "bc"))
    assert rows(dataset.id_alignment(a, b, "k")) == [("a", "left"), ("c", "right")] and rows(dataset.overlap(a, b, "k")) == [("b",)]
    f = dataset.fingerprint
    assert f(a).first() == f(a.orderBy(F.desc("k"))).first() != f(b).first()


def test_contracts(spark):
    good = spark.createDataFrame([("q", "T1000", 0.5, 0.5, 0.5, 1), ("q", "T1001", 0.4, 0.4, 0.4, 2)], "input_id string, technique_id string, score_fused double, score_text double, score_structure double, rank int")
    assert contracts.candidates(good, 0.6).count() == 0
    contracts.require_clean(contracts.candidates(good, 0.6))
    gap = good.withColumn("rank", F.col("rank") * 2 - 1)
    assert [r.problem for r in contracts.candidates(gap, 0.6).collect()] == ["ranks not 1..n"]
    wrong = good.withColumn("score_text", F.lit(0.9))
    assert {r.problem for r in contracts.candidates(wrong, 0.6).collect()} == {"fusion differs"}
    with pytest.raises(ValueError):
        contracts.require_clean(contracts.candidates(wrong, 0.6))
    s = spark.sql("select 'x' input_id, 'One. Two.' raw_text, map('E1', 'One.', 'E3', 'Two.') sentences, map('E1', named_struct('start', 0, 'end', 4, 'text_sha256', sha2('One.', 256)), 'E3', named_struct('start', 5, 'end', 99, 'text_sha256', 'x')) evidence_spans, named_struct('evidence_count', 2) segmentation")
    assert {r.problem for r in contracts.sentences(s).collect()} == {"evidence ids not contiguous", "span outside of the text", "span hash differs"}
    order = spark.createDataFrame([(["E10", "E2", "x", "E1"],)], "e array<string>")
    assert order.select(contracts.natural_order(F.col("e")).alias("e")).first().e == ["E1", "E2", "E10", "x"]


def test_rerank(spark):
    c = spark.createDataFrame([("x", "T1", 1, 0.9), ("x", "T2", 2, 0.1)], "input_id string, technique_id string, retrieval_rank int, retrieval_score double")
    s = spark.createDataFrame([("x", "T2", 1.0)], "input_id string, technique_id string, llm_score double")
    m = rerank.merge_scores(c, s, 0.4)
    assert rows(m.select("rerank_rank", "technique_id", "final_score")) == [(1, "T2", 0.64), (2, "T1", 0.36)]
    assert contracts.reranking(m, c, 0.4).count() == 0 and contracts.reranking(m.where("rerank_rank = 1"), c, 0.4).first().problem == "candidate was lost"
    caps = spark.createDataFrame([(0.9, "full", False, False, True), (0.9, "full", True, False, True), (0.9, "full", True, True, True), (0.9, "generic", False, False, True), (0.25, "full", False, False, True), (0.9, "evidence", True, False, True), (0.9, "structure", True, False, False)], "s double, m string, e boolean, p boolean, h boolean")
    assert [r.x for r in caps.select(F.round(rerank.capped(F.col("s"), F.col("m"), F.col("e"), F.col("p"), F.col("h")), 6).alias("x")).collect()] == [0.25, 0.54, 0.9, 0.9, 0.25, 0.9, 0.9]
    ev = spark.createDataFrame([("x", 1, "E1", "text")], "input_id string, ord int, evidence_id string, text string")
    cat = spark.createDataFrame([("T1", "n", "t"), ("T2", "n", None)], "technique_id string, name string, text string")
    p = rerank.prompts(c, ev, cat)
    answers = p.select("mode", "prompt_sha256", F.lit('{"T1": {"llm_score": 0.3, "reason": "r", "evidence_ids": ["E1"]}}').alias("response"))
    assert rows(rerank.replay(p, answers).select("technique_id", "llm_score")) == [("T1", 0.3)]
    old = spark.createDataFrame([("x", "T1", 1, None, 0.2, 0.1, 0.9, 1), ("x", "T2", 2, None, 0.5, 0.1, 0.8, 2)], "input_id string, technique_id string, retrieval_rank int, rerank_rank int, final_score double, llm_score double, retrieval_score double, position int")
    assert rows(rerank.evaluator_order(old).select("rank", "technique_id", "retrieval_order")) == [(1, "T2", 2), (2, "T1", 1)]
