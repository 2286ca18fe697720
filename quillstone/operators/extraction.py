"""Extractor output as tables: cleaning items and relations, completing impacts, and the graph made of them.

Items are rows (input_id, field, pos, a, b, c, evidence_ids, confidence), ``pos`` their place in the field's list. What a, b and c are
is in FIELDS. Relations are rows (input_id, pos, src, type, dst, evidence_ids, confidence) whose ends are references such as ``B1`` or
``Entry:2``; evidence is (input_id, ord, evidence_id, text). Everything is a join or window within a record.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import confidence
from ..functions.text import canonical, evidence_ids, jaccard, short_phrase, snake, text_or_null, token_set
from . import extract, graph

#: The lists of an extraction, the prefix of their references, their node type and node ids, and what a, b, c are.
FIELDS = {
    "preconditions": ("P", "Precondition", "PRECONDITION::P", ("condition", "text", None)),
    "entry": ("EN", "Entry", "ENTRY::EN", ("vector", "detail", None)),
    "vuln_type": ("VT", "VulnType", "VULNTYPE::VT", ("type", "subtype", None)),
    "behaviors": ("B", "Behavior", "BEHAVIOR::B", ("action", "target", "impact")),
    "impacts": ("I", "Impact", "IMPACT::I", ("type", "detail", None)),
}
#: The long names that references may use.
LONG_NAMES = {"PRECONDITION": "P", "VULNTYPE": "VT", "BEHAVIOR": "B", "BEHAVIOUR": "B", "IMPACT": "I", "ENTRY": "EN"}
#: The relation types that an extractor may name.
RELATIONS = ("enables", "characterized_by", "causes", "leads_to")
PAIRS = {(p, q): r for a, b, r in graph.LAYER_RULES for p, t, *_ in FIELDS.values() for q, u, *_ in FIELDS.values() if (t, u) == (a, b)}


def by_field(column: Column, of: dict[str, str | Column]) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v) if isinstance(v, str) else v) for k, v in of.items()])


def node_ref(c: Column) -> Column:
    """A reference as prefix and number (``BEHAVIOR::B01`` is B1), or null."""
    t = F.upper(F.trim(c))
    t = F.regexp_replace(F.regexp_replace(t, r"^.*::", ""), r"[\s_:-]+", "")
    short = F.coalesce(*[F.when(t.startswith(k), F.concat(F.lit(v), F.substr(t, F.lit(len(k) + 1)))) for k, v in LONG_NAMES.items()], t)
    ok = F.regexp_extract(short, r"^(P|EN|VT|B|I)0*(\d+)$", 1)
    number = F.regexp_extract(short, r"^(P|EN|VT|B|I)0*(\d+)$", 2)
    return F.when(ok != "", F.concat(ok, number))


def ref_prefix(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"^([A-Z]+)\d+$", 1), F.lit(""))


def _clamped(c: str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(c), F.lit(0.8)), F.lit(0.8))))


def _known(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("input_id").agg(F.collect_set("evidence_id").alias("_known"))  # the units of one record


def _cited(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows with their evidence ids that exist, in order and once; rows without any are dropped."""
    j = df.join(_known(evidence), "input_id")
    return j.withColumn("evidence_ids", F.array_distinct(F.filter("evidence_ids", lambda e: F.array_contains("_known", e)))).drop("_known").where(F.size("evidence_ids") > 0)


def kept_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Items that cite existing evidence, their confidence clamped (0.8 if missing), their fields in canonical form, and ``no``, their place among the kept ones."""
    d = _cited(items, evidence).withColumn("confidence", _clamped("confidence"))
    vuln = extract.vulnerability_type(F.col("a"), F.col("b"))
    impact = extract.primary_impact(F.col("a"))
    own = text_or_null(F.col("c"))
    filled = F.when(own.isNotNull(), F.nullif(extract.primary_impact(own), F.lit("unspecified")))
    d = d.select(
        "input_id", "field", "pos",
        by_field(F.col("field"), {"preconditions": F.col("a"), "entry": short_phrase(F.col("a")), "vuln_type": vuln["type"], "behaviors": canonical(F.col("a")), "impacts": impact}).alias("a"),
        by_field(F.col("field"), {"preconditions": F.col("b"), "entry": canonical(F.col("b")), "vuln_type": vuln["subtype"], "behaviors": text_or_null(F.col("b")), "impacts": F.col("b")}).alias("b"),
        F.when(F.col("field") == "behaviors", filled).alias("c"), "evidence_ids", "confidence",
    )
    return d.withColumn("no", F.row_number().over(Window.partitionBy("input_id", "field").orderBy("pos")))


def kept_relations(relations: DataFrame, kept: DataFrame, evidence: DataFrame) -> DataFrame:
    """(input_id, src, type, dst, evidence_ids, confidence): relations between kept items that a layer rule allows, under its name, the first of each.

    A reference counts kept items; a number beyond them is the item's place before cleaning.
    """
    prefix = by_field(F.col("field"), {k: v[0] for k, v in FIELDS.items()})
    k = kept.select("input_id", F.concat(prefix, F.col("pos").cast("string")).alias("old"), F.concat(prefix, F.col("no").cast("string")).alias("new"))
    now, before = k.select("input_id", F.col("new").alias("ref"), F.lit(0).alias("p"), "new"), k.select("input_id", F.col("old").alias("ref"), F.lit(1).alias("p"), "new")
    alias = now.unionByName(before).groupBy("input_id", "ref").agg(F.min_by("new", "p").alias("new"))
    r = _cited(relations, evidence).where(snake(F.coalesce("type", F.lit(""))).isin(*RELATIONS)).withColumn("confidence", _clamped("confidence"))
    for end in ("src", "dst"):
        r = r.withColumn(end, node_ref(F.col(end))).join(alias.select("input_id", F.col("ref").alias(end), F.col("new").alias(f"_{end}")), ["input_id", end])
    rule = F.coalesce(*[F.when((ref_prefix(F.col("_src")) == a) & (ref_prefix(F.col("_dst")) == b), F.lit(t)) for (a, b), t in PAIRS.items()])
    r = r.select("input_id", F.col("_src").alias("src"), rule.alias("type"), F.col("_dst").alias("dst"), "pos", "evidence_ids", "confidence").where("type is not null")
    best = r.groupBy("input_id", "src", "type", "dst").agg(F.min_by(F.struct("evidence_ids", "confidence"), "pos").alias("x"))
    return best.select("input_id", "src", "type", "dst", "x.evidence_ids", "x.confidence")


def completed_impacts(kept: DataFrame, evidence: DataFrame) -> DataFrame:
    """(input_id, no, type, detail, evidence_ids, confidence): the kept impacts, without unspecified ones if there is nothing else, and those that evidence, behaviours or entries state.

    A type that is there isn't added again. Order: kept ones, stated outright by first mention, of behaviours, of entries; of one text by precedence.
    """
    own = kept.where("field = 'impacts'")
    told = own.withColumn("_any", F.max(F.col("a") != "unspecified").over(Window.partitionBy("input_id"))).where("_any or a <> 'unspecified'")
    none = F.lit(None).cast("string")
    order = lambda step, *more: F.struct(F.lit(step).alias("s"), *more).alias("k")
    zero = F.lit(0).alias("z")
    first = told.select("input_id", F.col("a").alias("type"), F.col("b").alias("detail"), "evidence_ids", "confidence", order(0, F.col("no").alias("n"), zero))
    said = extract.explicit_impacts(evidence).select("input_id", F.col("impact").alias("type"), none.alias("detail"), "evidence_ids", F.lit(0.95).alias("confidence"), order(1, F.col("ord").alias("n"), zero))
    hints = []
    places = F.array(*map(F.lit, extract.IMPACT_WORDS))
    for step, field, texts in ((2, "behaviors", ("c", "a", "b")), (3, "entry", ("b",))):
        hit = functools.reduce(F.array_union, [extract.impact_types(F.col(t)) for t in texts])
        d = kept.where(F.col("field") == field).select("input_id", F.explode(hit).alias("type"), "evidence_ids", F.col("no").alias("n"))
        rank = order(step, F.col("n"), F.array_position(places, F.col("type")).cast("int").alias("z"))
        hints.append(d.select("input_id", "type", none.alias("detail"), "evidence_ids", F.lit(0.95).alias("confidence"), rank))
    new = functools.reduce(DataFrame.unionByName, [said, *hints])
    new = new.groupBy("input_id", "type").agg(F.min_by(F.struct("detail", "evidence_ids", "confidence", "k"), "k").alias("x")).select("input_id", "type", "x.*")
    new = new.join(first.select("input_id", "type").distinct(), ["input_id", "type"], "left_anti")
    every = first.unionByName(new.select(*first.columns))
    return every.select("input_id", F.row_number().over(Window.partitionBy("input_id").orderBy("k")).alias("no"), "type", "detail", "evidence_ids", "confidence")


def completed_behaviors(kept: DataFrame, evidence: DataFrame) -> DataFrame:
    """The kept behaviours, an impact that is missing taken from the first one stated outright in a unit they cite."""
    said = extract.explicit_impacts(evidence).select("input_id", "impact", F.col("ord").alias("_o"), F.explode("evidence_ids").alias("e"))
    b = kept.where("field = 'behaviors'")
    open_ = b.where("c is null").select("input_id", "no", F.explode("evidence_ids").alias("e")).join(said, ["input_id", "e"]).groupBy("input_id", "no").agg(F.min_by("impact", "_o").alias("_stated"))
    return b.join(open_, ["input_id", "no"], "left").withColumn("c", F.coalesce("c", "_stated")).drop("_stated")


def completed_relations(relations: DataFrame, behaviors: DataFrame, impacts: DataFrame) -> DataFrame:
    """The kept relations and a ``causes`` from every behaviour to every impact that cites a unit of it, where there is none."""
    b = behaviors.select("input_id", F.concat(F.lit("B"), "no").alias("src"), F.col("evidence_ids").alias("eb"), F.col("confidence").alias("cb"), F.explode("evidence_ids").alias("e"))
    i = impacts.select("input_id", F.concat(F.lit("I"), "no").alias("dst"), F.col("evidence_ids").alias("ei"), F.col("confidence").alias("ci"), F.explode("evidence_ids").alias("e"))
    j = b.join(i, ["input_id", "e"]).groupBy("input_id", "src", "dst").agg(F.first(F.array_intersect("eb", "ei")).alias("evidence_ids"), F.first(F.least("cb", "ci")).alias("confidence"))
    new = j.select("input_id", "src", F.lit("causes").alias("type"), "dst", "evidence_ids", "confidence").join(relations.select("input_id", "src", "type", "dst"), ["input_id", "src", "type", "dst"], "left_anti")
    return relations.unionByName(new)


def node_text(field: Column, a: Column, b: Column, c: Column) -> Column:
    """The text of a node: its parts, blank and repeated ones left out."""
    parts = lambda sep, *xs: F.array_join(F.array_distinct(F.filter(F.array(*[F.trim(x) for x in xs]), lambda x: x != "")), sep)
    named = F.concat_ws("; ", *[F.when(F.trim(x) != "", F.concat(F.lit(f"{n}="), F.trim(x))) for n, x in (("action", a), ("target", b), ("impact", c))])
    return by_field(field, {k: named if k == "behaviors" else parts(": " if k == "vuln_type" else "; ", a, b) for k in FIELDS})


def graph_nodes(items: DataFrame) -> DataFrame:
    """Items (with their place ``no``) as graph nodes."""
    f = F.col("field")
    node = F.concat(by_field(f, {k: v[2] for k, v in FIELDS.items()}), F.col("no").cast("string"))
    return items.select("input_id", node.alias("node_id"), by_field(f, {k: v[1] for k, v in FIELDS.items()}).alias("type"), node_text(f, F.col("a"), F.col("b"), F.col("c")).alias("text"), evidence_ids(F.col("evidence_ids")).alias("evidence_ids"), confidence(F.col("confidence")).alias("confidence"))


def resolved_relations(relations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): relations with their ends as node ids. A node is known by its id and four other names, whatever the case."""
    short = by_field(F.col("type"), {v[1]: v[0] for v in FIELDS.values()})
    n = F.regexp_extract("node_id", r"(\d+)$", 1)
    names = F.array("node_id", F.concat(short, n), F.concat("type", F.lit(":"), n), F.concat("type", F.lit("_"), n), F.concat("type", n))
    alias = nodes.select("input_id", "node_id", F.explode(names).alias("name")).select("input_id", F.upper("name").alias("name"), "node_id").distinct()
    r = relations
    for end in ("src", "dst"):
        r = r.withColumn("name", F.upper(F.trim(end))).join(alias.withColumnRenamed("node_id", f"{end}_id"), ["input_id", "name"], "left").drop("name")
    kind = F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("related_to"))
    ok = F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()
    edges = r.where(ok).select("input_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), kind.alias("type"), "evidence_ids", "confidence", "pos")
    return edges, r.where(~ok).select("input_id", "pos", "src", "dst", kind.alias("type"))


def all_edges(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Rule edges and extractor edges of a record in one form; of one source, target and type the extractor's wins, the first of several.

    Scores of extractor edges are those of their ends, like rule edges'; ``explicit`` tells them.
    """
    rule = graph.layer_edges(nodes).withColumn("explicit", F.lit(False)).withColumn("pos", F.lit(0))
    e, _ = resolved_relations(relations, nodes)
    side = lambda s: nodes.select("input_id", F.col("node_id").alias(s), F.col("text").alias(f"{s}_t"), F.col("evidence_ids").alias(f"{s}_e"), F.coalesce("confidence", F.lit(0.5)).alias(f"{s}_c"))
    j = e.join(side("src"), ["input_id", "src"]).join(side("dst"), ["input_id", "dst"])
    said = j.select(
        "input_id", "src", "dst", "type", F.array_intersect("src_e", "dst_e").alias("shared_evidence_ids"), jaccard(F.col("src_e"), F.col("dst_e")).alias("evidence_jaccard"),
        jaccard(token_set(F.col("src_t")), token_set(F.col("dst_t"))).alias("lexical_jaccard"), ((F.col("src_c") + F.col("dst_c")) / 2).alias("confidence_mean"),
        F.round(F.coalesce("confidence", F.lit(0.5)), 6).alias("structural_score"), F.lit(True).alias("explicit"), "pos",
    )
    return graph.dedupe_edges(rule.unionByName(said.select(rule.columns)), F.desc("explicit"), "pos").drop("pos")


def problems(items: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(input_id, problem) of an extraction: blank parts, unknown, malformed or missing evidence, confidences out of range, references to nothing, relations that no layer rule allows, repeated relations."""
    from .contracts import EVIDENCE_ID, _problems, probability

    known = _known(evidence)
    cites = {
        "no evidence": F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "malformed evidence id": F.exists("evidence_ids", lambda e: ~e.rlike(EVIDENCE_ID)),
        "unknown evidence id": F.exists("evidence_ids", lambda e: ~F.coalesce(F.array_contains("_known", e), F.lit(False))), "confidence out of range": probability(F.col("confidence")),
    }
    a = _problems(items.join(known, "input_id", "left"), "input_id", {"unknown field": ~F.col("field").isin(*FIELDS), "blank item": F.trim(F.coalesce("a", F.lit(""))) == "", **cites})
    prefix = by_field(F.col("field"), {k: v[0] for k, v in FIELDS.items()})
    ids = items.select("input_id", F.concat(prefix, F.row_number().over(Window.partitionBy("input_id", "field").orderBy("pos")).cast("string")).alias("_ref"))
    r = relations.withColumn("_s", node_ref(F.col("src"))).withColumn("_d", node_ref(F.col("dst")))
    for end in ("_s", "_d"):
        r = r.join(ids.select("input_id", F.col("_ref").alias(end), F.lit(True).alias(f"{end}ok")), ["input_id", end], "left")
    rule = F.coalesce(*[F.when((ref_prefix(F.col("_s")) == x) & (ref_prefix(F.col("_d")) == y), F.lit(t)) for (x, y), t in PAIRS.items()])
    n = F.count("*").over(Window.partitionBy("input_id", "_s", "_d", "type"))
    r = r.withColumn("_n", n).join(known, "input_id", "left")
    b = _problems(r, "input_id", {"reference to nothing": F.col("_sok").isNull() | F.col("_dok").isNull(), "layer rule broken": F.col("_s").isNotNull() & F.col("_d").isNotNull() & F.coalesce(rule != F.col("type"), F.lit(True)), "repeated relation": F.col("_n") > 1, **cites})
    return a.unionByName(b)
