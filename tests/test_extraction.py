"""Extractor output, its graph, contracts and reports on values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import contracts, explanation, extraction, graph, reports, retrieval

ITEM = "input_id string, field string, pos int, a string, b string, c string, evidence_ids array<string>, confidence double"
RELATION = "input_id string, pos int, src string, type string, dst string, evidence_ids array<string>, confidence double"
UNIT = "input_id string, ord int, evidence_id string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_extraction(spark):
    items = spark.createDataFrame([
        ("x", "behaviors", 1, "drop", "t", None, ["E9"], 0.5), ("x", "behaviors", 2, " run  it ", "null", "unspecified", ["E1", "E1", "E9"], 2.0),
        ("x", "behaviors", 3, "stop", "x", "denial of service", ["E2"], float("nan")), ("x", "impacts", 1, "odd", None, None, ["E2"], None), ("x", "entry", 1, "a request", "crash of data", None, ["E2"], 0.4),
        ("y", "impacts", 1, "leak", "d", None, ["E1"], 0.3), ("y", "impacts", 2, "odd", None, None, ["E1"], 0.3),
    ], ITEM)
    units = spark.createDataFrame([("x", 1, "E1", "allows remote code execution"), ("x", 2, "E2", "more"), ("y", 1, "E1", "unknown impact, a crash")], UNIT)
    kept = extraction.kept_items(items, units)
    assert rows(kept.where("field = 'behaviors'").select("no", "pos", "a", "b", "c", "evidence_ids", "confidence")) == [(1, 2, "run it", None, None, ["E1"], 1.0), (2, 3, "stop", "x", "denial_of_service", ["E2"], 0.8)]
    impacts = extraction.completed_impacts(kept, units)
    assert rows(impacts.select("input_id", "no", "type", "evidence_ids")) == [("x", 1, "code_execution", ["E1"]), ("x", 2, "denial_of_service", ["E2"]), ("y", 1, "information_disclosure", ["E1"]), ("y", 2, "unspecified", ["E1"])]
    behaviors = extraction.completed_behaviors(kept, units)
    assert rows(behaviors.select("no", "c")) == [(1, "code_execution"), (2, "denial_of_service")]
    told = spark.createDataFrame([
        ("x", 1, "BEHAVIOR::B3", "Causes", "impact_1", ["E2", "E8"], 0.9), ("x", 2, "B2", "causes", "I1", ["E2"], 0.1), ("x", 3, "B1", "related", "I1", ["E2"], 0.9),
        ("x", 4, "I1", "causes", "B1", ["E2"], 0.9), ("x", 5, "B1", "leads to", "I1", ["E9"], 0.9), ("x", 6, "Entry:1", "enables", "B1", ["E2"], None),
    ], RELATION)
    clean = extraction.kept_relations(told, kept, units)
    # B3 was the second behaviour kept, and so is B2; EN1 leads to B1
    assert rows(clean.select("src", "type", "dst", "evidence_ids", "confidence")) == [("B2", "causes", "I1", ["E2"], 0.9), ("EN1", "enables", "B1", ["E2"], 0.8)]
    every = extraction.completed_relations(clean, behaviors, impacts)
    assert rows(every.where("type = 'causes'").select("src", "dst", "evidence_ids")) == [("B1", "I1", ["E1"]), ("B2", "I1", ["E2"]), ("B2", "I2", ["E2"])]
    found = {tuple(r) for r in extraction.problems(items, told, units).collect()}
    assert {("x", "unknown evidence id"), ("x", "confidence out of range"), ("x", "layer rule broken")} <= found
    nodes = extraction.graph_nodes(behaviors.unionByName(kept.where("field = 'entry'")))
    assert rows(nodes.select("node_id", "text")) == [("BEHAVIOR::B1", "action=run it; impact=code_execution"), ("BEHAVIOR::B2", "action=stop; target=x; impact=denial_of_service"), ("ENTRY::EN1", "a request; crash of data")]
    e = extraction.all_edges(nodes, told)
    assert rows(e.select("src", "type", "dst", "explicit")) == [("ENTRY::EN1", "enables", "BEHAVIOR::B1", True), ("ENTRY::EN1", "enables", "BEHAVIOR::B2", False)]
    assert extraction.resolved_relations(told, nodes)[1].count() == 5
    none = items.limit(0)
    assert extraction.kept_items(none, units).count() == extraction.completed_impacts(extraction.kept_items(none, units.limit(0)), units.limit(0)).count() == 0


@pytest.mark.parametrize("ref,want", [("b01", "B1"), ("X::Behaviour_2", "B2"), ("Entry: 3", "EN3"), ("Vuln Type 4", "VT4"), ("P", None), ("", None), (None, None), ("I2x", None)])
def test_references(spark, ref, want):
    assert spark.createDataFrame([(ref,)], "r string").select(extraction.node_ref(F.col("r")).alias("x")).first().x == want


def test_contracts_of_graphs(spark):
    n = spark.createDataFrame([("x", "EN1", "Entry", "a", ["E1"], 0.8), ("x", "B1", "Behavior", "b", ["E2"], 0.6), ("x", "I1", "Impact", "c", ["E3"], 0.5), ("x", "P1", "Precondition", "p", ["E1", "E4"], 0.5)], "input_id string, node_id string, type string, text string, evidence_ids array<string>, confidence double")
    e = graph.layer_edges(n)
    x = explanation.explanations(n, e)
    assert contracts.explanations(x, n, e).count() == 0 and x.first().precondition == "P1" and x.first().compact_text.startswith("Precondition: p -> Entry: a")
    assert [r.problem for r in contracts.explanations(x, n, e.where("dst <> 'I1'")).collect()] == ["missing path edge"]
    assert {r.problem for r in contracts.explanations(x.withColumn("status", F.lit("partial")).withColumn("signature", F.lit("z")), n, e).collect()} == {"core chain not complete", "malformed hash"}
    assert {r.problem for r in contracts.explanations(x, n.where("node_id <> 'B1'"), e).collect()} == {"chain node not in graph", "evidence is not the nodes'"}
    t = graph.trace_edges(n)
    assert t.count() == 9
    support = t.where("type = 'supported_by'").select("input_id", F.col("src").alias("node_id"), F.substring_index("dst", "::", -1).alias("evidence_id"))
    assert contracts.support_edges(n, support).count() == 0 and contracts.support_edges(n, support.where("evidence_id <> 'E3'")).first().problem == "evidence without supporting edge"
    assert {r.problem for r in contracts.record_counts(spark.createDataFrame([("x", 4, 7)], "input_id string, n_nodes int, n_edges int"), n, e).collect()} == {"edge count differs"}
    s = spark.sql("select 'x' input_id, map('e2', ' b ', 'E1', 'a', 'E4', '', 'Q', 'c', ' E2', 'd') sentences union all select '', cast(null as map<string, string>)")
    got = {r.input_id: r for r in contracts.sentence_maps(s).collect()}
    assert got["x"].sentences == {"E1": "a", "E2": "b"} and got["x"].contiguous and sorted(got["x"].problems) == ["blank sentence", "malformed evidence id", "repeated evidence id"] and got[""].problems == ["no id", "no sentences"]
    one = spark.createDataFrame([("a",), ("a",)], "s string")
    assert contracts.signatures(one, "s").count() == 0 and contracts.signatures(one.unionByName(spark.createDataFrame([("b",)], "s string")), "s").count() == 2


def test_reports(spark):
    r = spark.createDataFrame([("m", k, i, t, n + 1) for k in (1, 2) for i in ("x", "y") for n, t in enumerate(["T1", "T2", "T3"][:: 1 if k == 1 else -1])], "method string, run int, input_id string, technique_id string, rank int")
    gold = spark.createDataFrame([("x", "T1"), ("y", "T2"), ("z", "T1")], "input_id string, technique_id string")
    assert rows(reports.evaluation_ids(r, gold)) == [("x",), ("y",)]
    assert reports.strict_id_problems(r.where("not (run = 2 and input_id = 'y')"), gold.where("input_id <> 'x'")).count() == 2
    from quillstone.operators import metrics

    s = metrics.per_input(metrics.relevance(r, gold))
    shares = {(x.method, x.bucket): x.share for x in reports.first_hit_shares(s).collect()}
    assert shares["m", "1"] == 0.25 and shares["m", "2-3"] == 0.75 and shares["m", "miss"] == 0 and len(shares) == 7
    out = reports.with_intervals(s, ["mrr"], 50)
    assert out.first().low <= out.first().estimate <= out.first().high


def test_matrix_and_join_agree(spark):
    """Retrieval on a broadcast matrix and on joined tokens gives equal lists, grids and scales."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice([f"word{i}" for i in range(25)], n))
    q = spark.createDataFrame([(f"q{i}", word(int(rng.integers(0, 12))), word(int(rng.integers(0, 5)))) for i in range(25)] + [("none", None, "zzz")], "query_id string, text string, structure string")
    t = spark.createDataFrame([(f"T{1000 + i // 2}" + (f".00{i % 2}" if i % 3 else ""), word(8)) for i in range(14)], "technique_id string, text string").dropDuplicates(["technique_id"])
    key = lambda df, *c: sorted((tuple(round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*c).collect()), key=repr)
    for f, cols in (
        (lambda n: retrieval.retrieve(q, t, 5, digits=6, dense_cells=n), ("query_id", "technique_id", "score", "rank")),
        (lambda n: retrieval.retrieve_grid(q, t, [0.0, 0.5, 1.0], 4, digits=6, dense_cells=n), ("query_id", "technique_id", "alpha", "rank", "score_text", "score_structure")),
        (lambda n: retrieval.retrieve_parents(q, t, 0.6, digits=6, dense_cells=n), ("query_id", "technique_id", "representative_technique_id", "source_technique_ids")),
        (lambda n: retrieval.retrieve_scaled(q, t, digits=6, dense_cells=n), ("query_id", "technique_id", "score", "scaled")),
    ):
        assert key(f(10**7), *cols) == key(f(0), *cols)


def test_no_swap_improves_the_split():
    """When the search ends by itself, no exchange of two records brings the labels nearer to their targets."""
    import random

    from quillstone.operators import dataset

    rng = random.Random(5)
    recs = [(f"r{i}", sorted(set(rng.choices("ABCDEFGH", weights=[30, 20, 10, 5, 3, 2, 1, 1], k=rng.randrange(1, 4))))) for i in range(80)]
    small = dataset.stratified_split(recs, 20, 7, passes=200)
    assert len(small) == 20 and small == dataset.stratified_split(recs[::-1], 20, 7, passes=200)
    labels = dict(recs)
    support = {x: sum(x in ls for ls in labels.values()) for x in "ABCDEFGH"}
    support = {k: n for k, n in support.items() if n}
    goal = dataset.split_targets(support, 20 / 80, 2)

    def cost(side):
        c = {k: sum(k in labels[i] for i in side) for k in support}
        return sum((c[k] - goal[k]) ** 2 / n + 1e6 * (n >= 2 and c[k] in (0, n)) for k, n in support.items())

    now = cost(small)
    assert all(cost(small - {a} | {b}) >= now - 1e-9 for a in small for b in labels if b not in small)


def test_partition_check(spark):
    from quillstone.operators import dataset

    a, b, c = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("abc", "ab", "bd"))
    assert rows(dataset.not_partitioned(a, [b, c], "k")) == [("b", "in several parts"), ("c", "in no part"), ("d", "not in the whole")]
    assert dataset.not_partitioned(a, [b, a.where("k = 'c'")], "k").count() == 0
    d = spark.createDataFrame([("x", ["A", "B"], "s"), ("y", ["A"], "l"), ("z", ["A"], "l")], "base string, labels array<string>, split string")
    assert rows(dataset.label_balance(d, 0.34, "s")) == [("A", 3, 1, 2, 1, 0), ("B", 1, 1, 0, 0, 1)]
