"""Boundary contracts: each check returns the violating rows as (input_id, problem); a clean table gives none.

Scalar rules become arrays of conditional messages, rules across rows anti-joins and group checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import LAYER_RULES

EVIDENCE_ID = "^E[1-9][0-9]*$"


def _problems(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in rules.items()]))
    return df.select(F.col(key).alias("input_id"), F.explode(found).alias("problem"))


def probability(c: Column) -> Column:
    """True where a value is no finite number in [0, 1]."""
    return c.isNull() | F.isnan(c) | (c < 0) | (c > 1)


def number(e: Column) -> Column:
    return F.regexp_extract(e, r"(\d+)$", 1).try_cast("int")


def natural_order(ids: Column) -> Column:
    """Evidence ids in natural order, others last."""
    key = lambda e: F.coalesce(number(e), F.lit(2**31 - 1))
    return F.array_sort(ids, lambda a, b: F.when(key(a) != key(b), F.when(key(a) < key(b), -1).otherwise(1)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def sentences(df: DataFrame) -> DataFrame:
    """Sentence records: ids E1..En without gaps, no blank unit, spans that point at their unit's text and hash, and a count that agrees."""
    ids = F.map_keys("sentences")
    spans = F.map_entries("evidence_spans")
    at = lambda e: F.substr(F.col("raw_text"), e.value.start + 1, e.value.end - e.value.start)
    return _problems(df, "input_id", {
        "blank input_id": F.trim(F.coalesce("input_id", F.lit(""))) == "",
        "no text": F.trim(F.coalesce("raw_text", F.lit(""))) == "",
        "no sentences": F.coalesce(F.size("sentences"), F.lit(0)) <= 0,
        "malformed evidence id": F.exists(ids, lambda e: ~e.rlike(EVIDENCE_ID)),
        "evidence ids not contiguous": F.array_sort(F.transform(ids, number)) != F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))),
        "blank sentence": F.exists(F.map_values("sentences"), lambda s: F.trim(s) == ""),
        "spans and sentences differ in ids": F.array_sort(ids) != F.array_sort(F.map_keys("evidence_spans")),
        "span outside of the text": F.exists(spans, lambda e: (e.value.start < 0) | (e.value.end <= e.value.start) | (e.value.end > F.length("raw_text"))),
        "span hash differs": F.exists(F.filter(spans, lambda e: (e.value.start >= 0) & (e.value.end > e.value.start)), lambda e: F.sha2(at(e), 256) != e.value.text_sha256),
        "count differs": F.col("segmentation.evidence_count") != F.size("sentences"),
    })


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """Node tables: known types, evidence ids well formed, distinct and in natural order, confidences in range, ids unique."""
    types = sorted({t for a, b, _ in LAYER_RULES for t in (a, b)})
    ids = F.col("evidence_ids")
    a = _problems(nodes, "input_id", {
        "unknown node type": ~F.col("type").isin(*types),
        "malformed evidence id": F.exists(ids, lambda e: ~e.rlike(EVIDENCE_ID)),
        "repeated evidence id": F.size(ids) != F.size(F.array_distinct(ids)),
        "evidence not in natural order": ids != natural_order(ids),
        "confidence out of range": probability(F.col("confidence")),
        "no evidence": F.size(ids) <= 0,
    })
    b = nodes.groupBy("input_id", "node_id").agg(F.count("*").alias("n")).where("n > 1").select("input_id", F.lit("repeated node id").alias("problem"))
    return a.unionByName(b)


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge tables: ends exist, the layer rule holds, no loops, scores in range."""
    n = nodes.select("input_id", "node_id", "type").dropDuplicates(["input_id", "node_id"])
    j = edges.join(n.select("input_id", F.col("node_id").alias("src"), F.col("type").alias("_a")), ["input_id", "src"], "left").join(n.select("input_id", F.col("node_id").alias("dst"), F.col("type").alias("_b")), ["input_id", "dst"], "left")
    rule = F.array_contains(F.array(*[F.lit(f"{a}>{b}>{r}") for a, b, r in LAYER_RULES]), F.concat_ws(">", "_a", "_b", "type"))
    return _problems(j, "input_id", {"dangling source": F.col("_a").isNull(), "dangling target": F.col("_b").isNull(), "layer rule broken": F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~rule, "loop": F.col("src") == F.col("dst"), "score out of range": probability(F.col("structural_score"))})


def support_edges(nodes: DataFrame, support: DataFrame) -> DataFrame:
    """Evidence of a node without a supporting edge, and supporting edges to evidence that the node doesn't name. ``support``: (input_id, node_id, evidence_id)."""
    named = nodes.select("input_id", "node_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    k = ["input_id", "node_id", "evidence_id"]
    a = named.join(support.select(*k), k, "left_anti").select("input_id", F.lit("evidence without supporting edge").alias("problem"))
    return a.unionByName(support.select(*k).join(named, k, "left_anti").select("input_id", F.lit("supporting edge to other evidence").alias("problem")))


def record_counts(stats: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Records whose stated numbers of nodes or edges are not those of the tables. ``stats``: (input_id, n_nodes, n_edges)."""
    n = nodes.groupBy("input_id").agg(F.count("*").alias("_n"))
    e = edges.groupBy("input_id").agg(F.count("*").alias("_e"))
    j = stats.join(n, "input_id", "left").join(e, "input_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _problems(j, "input_id", {"node count differs": zero("n_nodes") != zero("_n"), "edge count differs": zero("n_edges") != zero("_e")})


def explanations(explained: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Explanation tables: a known status that agrees with the chain, chain nodes and their types in the graph, neighbours linked, evidence that is the nodes', text and hash present."""
    n = nodes.select("input_id", "node_id", "type", "evidence_ids").dropDuplicates(["input_id", "node_id"])
    step = explained.select("input_id", F.posexplode("chain").alias("pos", "node_id"), "chain", "chain_types", "status")
    j = step.join(n.withColumnRenamed("type", "_t"), ["input_id", "node_id"], "left").withColumn("_said", F.get("chain_types", F.col("pos"))).withColumn("_next", F.get("chain", F.col("pos") + 1))
    link = edges.select("input_id", F.col("src").alias("node_id"), F.col("dst").alias("_next"), F.lit(True).alias("_ok")).distinct()
    j = j.join(link, ["input_id", "node_id", "_next"], "left")
    a = _problems(j, "input_id", {"chain node not in graph": F.col("_t").isNull(), "chain type differs": F.col("_t") != F.col("_said"), "missing path edge": F.col("_next").isNotNull() & F.col("_ok").isNull()})
    types = F.col("chain_types")
    en, b, i = (F.array_position(types, t) for t in ("Entry", "Behavior", "Impact"))
    core = (en > 0) & (F.array_position(F.slice(types, en.cast("int") + 1, F.size(types)), "Behavior") > 0) & (b > en) & (i > b)
    c = _problems(explained, "input_id", {
        "unknown status": ~F.coalesce(F.col("status").isin("complete", "partial", "empty"), F.lit(False)),
        "complete without core chain": (F.col("status") == "complete") & ~F.coalesce(core, F.lit(False)),
        "core chain not complete": (F.col("status") == "partial") & core & (F.element_at(types, 1) == "Entry") & (F.element_at(types, -1) == "Impact"),
        "empty chain": (F.col("status") != "empty") & (F.coalesce(F.size("chain"), F.lit(0)) <= 0),
        "no compact text": (F.col("status") != "empty") & (F.trim(F.coalesce("compact_text", F.lit(""))) == ""),
        "malformed hash": ~F.coalesce(F.col("signature").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "minimum not of the evidence": F.size(F.array_except("minimum_evidence", "evidence_ids")) > 0,
    })
    held = explained.select("input_id", F.explode(F.concat("chain", F.when(F.col("precondition").isNotNull(), F.array("precondition")).otherwise(F.array().cast("array<string>")))).alias("node_id")).join(n, ["input_id", "node_id"])
    of = held.select("input_id", F.explode("evidence_ids").alias("e")).groupBy("input_id").agg(F.array_sort(F.collect_set("e")).alias("_e"))
    d = _problems(explained.join(of, "input_id", "left"), "input_id", {"evidence is not the nodes'": F.array_sort("evidence_ids") != F.coalesce("_e", F.array().cast("array<string>"))})
    return a.unionByName(c).unionByName(d)


def catalogue(techniques: DataFrame) -> DataFrame:
    """Technique tables: valid and unique ids, name and description, and active sub-techniques whose parent is not there or not active."""
    t = techniques.withColumn("input_id", F.col("technique_id"))
    off = F.coalesce("revoked", F.lit(False)) | F.coalesce("deprecated", F.lit(False))
    up = t.where(~off).select(F.col("technique_id").alias("_p"), F.lit(True).alias("_active")).distinct()
    j = t.withColumn("_p", F.coalesce("parent_technique_id", F.element_at(F.split("technique_id", r"\."), 1))).join(up, "_p", "left")
    a = _problems(j, "input_id", {
        "malformed technique id": ~F.coalesce(F.col("technique_id").rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"), F.lit(False)),
        "no name": F.trim(F.coalesce("name", F.lit(""))) == "", "no description": F.trim(F.coalesce("description", F.lit(""))) == "",
        "parent not active": ~off & F.coalesce("is_subtechnique", F.lit(False)) & F.col("_active").isNull(),
    })
    return a.unionByName(t.groupBy("input_id").agg(F.count("*").alias("n")).where("n > 1").select("input_id", F.lit("repeated technique id").alias("problem")))


def sentence_maps(df: DataFrame) -> DataFrame:
    """(input_id, sentences, contiguous, problems): maps with upper-case ids and trimmed texts, in natural order; what is malformed, blank or repeated is left out and named."""
    entries = F.transform(F.map_entries(F.coalesce("sentences", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.upper(F.trim(e.key)).alias("id"), F.trim(F.coalesce(e.value, F.lit(""))).alias("text")))
    d = df.select(F.trim(F.coalesce("input_id", F.lit(""))).alias("input_id"), entries.alias("e"))
    good = F.filter("e", lambda x: x.id.rlike(EVIDENCE_ID) & (x.text != ""))
    order = lambda a, b: number(a.id) - number(b.id)
    once = F.filter(good, lambda x, i: F.array_position(F.transform(good, lambda y: y.id), x.id) == i + 1)
    kept = F.array_sort(once, order)
    say = lambda c, m: F.when(c, F.lit(m))
    problems = F.array_compact(F.array(
        say(F.col("input_id") == "", "no id"), say(F.size("e") == 0, "no sentences"), say(F.exists("e", lambda x: ~x.id.rlike(EVIDENCE_ID)), "malformed evidence id"),
        say(F.exists("e", lambda x: x.id.rlike(EVIDENCE_ID) & (x.text == "")), "blank sentence"), say(F.size(once) < F.size(good), "repeated evidence id"),
    ))
    run = F.transform(kept, lambda x, i: number(x.id) == i + 1)
    return d.select("input_id", F.map_from_entries(kept).alias("sentences"), F.forall(run, lambda x: x).alias("contiguous"), problems.alias("problems"))


def signatures(df: DataFrame, column: str) -> DataFrame:
    """(signature, n), if a table has rows of more than one signature."""
    per = df.groupBy(F.col(column).alias("signature")).agg(F.count("*").alias("n"))
    several = per.agg(F.count("*").alias("k")).scalar() > 1
    return per.where(several)


def candidates(ranked: DataFrame, alpha: float, tolerance: float = 5e-10) -> DataFrame:
    """Candidate tables (input_id, technique_id, score_fused, score_text, score_structure, rank): the fusion formula, ranges, ranks 1..n in score order, ids unique."""
    w = Window.partitionBy("input_id").orderBy("rank")
    r = ranked.withColumn("_before", F.lag("score_fused").over(w))
    a = _problems(r, "input_id", {
        "malformed technique id": ~F.col("technique_id").rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"),
        "score out of range": probability(F.col("score_fused")) | probability(F.col("score_text")) | probability(F.col("score_structure")),
        "fusion differs": F.abs(F.col("score_fused") - (alpha * F.col("score_text") + (1 - alpha) * F.col("score_structure"))) > tolerance,
        "not in score order": F.col("_before") < F.col("score_fused"),
    })
    g = ranked.groupBy("input_id").agg(F.count("*").alias("n"), F.count_distinct("technique_id").alias("ids"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    b = _problems(g, "input_id", {"repeated technique": F.col("n") != F.col("ids"), "ranks not 1..n": (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("ranks") != F.col("n"))})
    return a.unionByName(b)


def reranking(reranked: DataFrame, retrieved: DataFrame, beta: float, tolerance: float = 5e-10) -> DataFrame:
    """Reranked tables keep the retrieved candidates, blend the two scores by ``beta`` and rank 1..n."""
    a = _problems(reranked, "input_id", {"final score differs": F.abs(F.col("final_score") - (beta * F.col("retrieval_score") + (1 - beta) * F.col("llm_score"))) > tolerance, "llm score out of range": probability(F.col("llm_score"))})
    k = ["input_id", "technique_id"]
    extra = reranked.join(retrieved.select(*k), k, "left_anti").select("input_id", F.lit("candidate was not retrieved").alias("problem"))
    lost = retrieved.join(reranked.select("input_id").distinct(), "input_id", "left_semi").join(reranked.select(*k), k, "left_anti").select("input_id", F.lit("candidate was lost").alias("problem"))
    return a.unionByName(extra).unionByName(lost)


def labels(df: DataFrame) -> DataFrame:
    """Label lists: present, valid ids, sorted and distinct."""
    ls = F.col("labels")
    return _problems(df, "input_id", {
        "no labels": F.coalesce(F.size(ls), F.lit(0)) <= 0,
        "invalid label": F.exists(ls, lambda x: ~F.coalesce(x, F.lit("")).rlike(r"^T[0-9]{4}(\.[0-9]{3})?$")),
        "not sorted and distinct": ls != F.array_sort(F.array_distinct(ls)),
    })


def counts(problems: DataFrame) -> DataFrame:
    return problems.groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("input_id").alias("inputs"))


def require_clean(problems: DataFrame) -> None:
    """Raise with a few examples if there is any violation."""
    if some := problems.limit(5).collect():
        raise ValueError("contract broken: " + "; ".join(f"{r.input_id}: {r.problem}" for r in some))
