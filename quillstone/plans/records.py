"""Queries over records, evidence units, graphs and audits, with the SQL each equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.scores import confidence, split_target, token_budget
from ..functions.text import canonical, evidence_ids, file_name, jaccard, label_parts, short_phrase, snake, text_or_null, token_set, truncated, without_markup
from ..operators import audit, contracts, dataset, explanation, extract, extraction, graph, metrics, rerank, segment
from ..sources import labels as label_files
from ..streaming.resume import windowed_counts
from ..session import table
from . import sqltext as S


def nodes(s: SparkSession, d: str) -> DataFrame:
    """Order lines as typed nodes of their order."""
    from pyspark.sql import Window

    w = Window.partitionBy("input_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    kinds = F.array(*map(F.lit, ("Precondition", "Entry", "VulnType", "Behavior", "Impact")))
    ev = F.array_sort(F.array_distinct(F.array(F.concat(F.lit("E"), F.col("l_suppkey") % 12 + 1), F.concat(F.lit("E"), F.col("l_partkey") % 12 + 1))))
    numbered = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "input_id").withColumn("_k", F.row_number().over(w))  # lines are shuffled as they are, and by the id that later steps group by
    return numbered.select(
        "input_id", F.concat(F.lit("N"), "_k").alias("node_id"), F.element_at(kinds, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("type"),
        F.concat_ws(" ", F.lit("flag"), "l_returnflag", "l_linestatus", F.concat(F.lit("part"), F.col("l_partkey") % 7)).alias("text"), ev.alias("evidence_ids"), F.round(F.col("l_discount") * 10, 6).alias("confidence"),
    )


def edges(s: SparkSession, d: str) -> DataFrame:
    return graph.layer_edges(nodes(s, d))


def units(s: SparkSession, d: str, **how) -> DataFrame:
    return segment.segment(table(s, d, "documents").withColumnRenamed("doc_id", "input_id"), "input_id", "text", **how)


def items(s: SparkSession, d: str) -> DataFrame:
    """Order lines as extractor items: the ship date's day tells the field, evidence may be unknown, confidences missing or out of range."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    fields = F.array(*map(F.lit, extraction.FIELDS))
    texts = F.array(*map(F.lit, ITEM_TEXTS))
    at = lambda n, c: F.element_at(texts, (F.col(c) % n + 1).cast("int"))
    ev = F.array(F.concat(F.lit("E"), F.col("l_suppkey") % 9 + 1), F.concat(F.lit("E"), F.col("l_partkey") % 9 + 1), F.lit("E77"))
    conf = F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).otherwise(F.col("l_discount") * 20 - 0.3)
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("input_id"), F.element_at(fields, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("field"), F.row_number().over(w).alias("pos"),
        at(len(ITEM_TEXTS), "l_partkey").alias("a"), at(len(ITEM_TEXTS), "l_suppkey").alias("b"), at(len(ITEM_TEXTS), "l_quantity").alias("c"), ev.alias("evidence_ids"), conf.cast("double").alias("confidence"),
    )


ITEM_TEXTS = ("Remote Code Execution", "null", "", "SQL injection", "a crafted request", "buffer overflow", "denial of service", " leak of  data ", "bypass")
UNIT_TEXTS = ("allows remote code execution", "causes a crash", "the impact is unknown and causes a hang", "nothing to see", "privilege escalation and denial of service")


def item_evidence(s: SparkSession, d: str) -> DataFrame:
    """Units E1 to E6 of every order, with texts by key."""
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("input_id")).distinct().select("input_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("ord"))
    return o.select("input_id", "ord", F.concat(F.lit("E"), "ord").alias("evidence_id"), F.element_at(F.array(*map(F.lit, UNIT_TEXTS)), ((F.col("input_id") + F.col("ord")) % len(UNIT_TEXTS) + 1).cast("int")).alias("text"))


def item_relations(s: SparkSession, d: str) -> DataFrame:
    """Order lines as relations between items, their references in several spellings."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    names = F.array(*map(F.lit, REFERENCES))
    pick = lambda c: F.element_at(names, (F.col(c) % len(REFERENCES) + 1).cast("int"))
    kinds = F.array(*map(F.lit, ("enables", "Causes", "characterized by", "related", "leads-to")))
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("input_id"), F.row_number().over(w).alias("pos"), pick("l_partkey").alias("src"), F.element_at(kinds, (F.col("l_quantity") % 5 + 1).cast("int")).alias("type"), pick("l_suppkey").alias("dst"),
        F.array(F.concat(F.lit("E"), F.col("l_partkey") % 8 + 1)).alias("evidence_ids"), F.col("l_discount").alias("confidence"),
    )


REFERENCES = ("B1", "I1", "EN1", "behavior_1", "IMPACT::I01", "P1", "Entry: 2", "vt2", "x9", "Behaviour-2", "I2", "B3")


def label_lines(s: SparkSession, d: str) -> DataFrame:
    """Records as lines of label files: lists, other keys, and texts."""
    r = table(s, d, "records").select("record_id", "input_id", "labels")
    k = F.col("record_id") % 3
    line = F.when(k == 0, F.to_json(F.struct("input_id", "labels"))).when(k == 1, F.to_json(F.struct(F.col("input_id").alias("cve_id"), F.col("labels").alias("gold"))))
    return r.select(line.otherwise(F.to_json(F.struct("input_id", F.array_join("labels", ", ").alias("labels")))).alias("line"))


def run_lines(s: SparkSession, d: str) -> DataFrame:
    """Two runs as lines of ranking files; records with an id of even length have no rerank ranks."""
    from pyspark.sql import Window

    from .ranking import rankings

    r = rankings(s, d).where("method in ('text', 'llm')")
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    g = r.groupBy("run", "input_id", "technique_id").agg(of("text", "rank").alias("retrieval_rank"), F.round(of("text", "score"), 6).alias("score_fused"), F.round(of("llm", "score"), 6).alias("llm_score"))
    g = g.withColumn("final_score", F.round(F.coalesce("llm_score", F.lit(0.0)) / 100, 6))
    w = Window.partitionBy("run", "input_id").orderBy(F.desc("final_score"), "technique_id")
    g = g.withColumn("rerank_rank", F.when(F.length("input_id") % 2 == 1, F.row_number().over(w)))
    c = F.sort_array(F.collect_list(F.struct("technique_id", "retrieval_rank", "score_fused", "final_score", "llm_score", "rerank_rank")))  # one record's candidates
    return g.groupBy("run", "input_id").agg(c.alias("candidates")).select(F.lit("m").alias("method"), "run", F.to_json(F.struct("input_id", "candidates")).alias("line"))


def stop_units(s: SparkSession, d: str) -> DataFrame:
    """Documents cut after every period and blank: units that SQL can make too."""
    u = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("input_id"), F.posexplode(F.split("text", r"\. ")).alias("p", "text"))
    return u.select("input_id", (F.col("p") + 1).alias("ord"), F.concat(F.lit("E"), F.col("p") + 1).alias("evidence_id"), "text")


def based(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, name).withColumn("base", N.base_id(F.col("input_id"))).where("base is not null")


def rows(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "source_rows")
    base = F.coalesce(N.base_id(F.col("base_input_id")), N.base_id(F.col("source_id")))
    return r.withColumn("base", base).withColumn("augmentation", dataset.augmentation_index(F.col("source_id"))).where("base is not null")


def reviews(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audit_reviews")
    read = lambda c: F.when(audit.clean_enum(F.col(c)).isin(*audit.DECISIONS), audit.clean_enum(F.col(c)))
    return a.select("form_id", "sample_id", N.base_id(F.col("cve_id")).alias("input_id"), "technique_id", "round_no", read("reviewer_1_decision").alias("d1"), read("reviewer_2_decision").alias("d2"), read("adjudicated_decision").alias("d3"))


def final_decisions(s: SparkSession, d: str) -> DataFrame:
    """The last round's resolved decision per pair of record and technique."""
    r = audit.resolved(reviews(s, d)).where("final_decision is not null and input_id is not null")
    return r.groupBy("input_id", "technique_id").agg(F.max_by("final_decision", F.struct("round_no", "form_id")).alias("decision"))


def gold(s: SparkSession, d: str) -> DataFrame:
    from .ranking import gold as g

    return g(s, d)


def ranked_candidates(s: SparkSession, d: str) -> DataFrame:
    from .ranking import rankings

    r = rankings(s, d).where("method = 'text' and run = 1")
    return r.select("input_id", "technique_id", "rank", F.col("score").alias("text_score"))


def rerank_result(s: SparkSession, d: str) -> DataFrame:
    from .ranking import rankings

    top = rerank.top_candidates(ranked_candidates(s, d), 5)
    sc = ranked_candidates(s, d).select("input_id", "technique_id", F.round(F.least(F.lit(1.0), F.coalesce("text_score", F.lit(0.0)) / 30), 6).alias("retrieval_score"))
    llm = rankings(s, d).where("method = 'llm' and run = 1").select("input_id", "technique_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)) / 100)), 6).alias("llm_score"))
    return rerank.merge_scores(top.join(sc, ["input_id", "technique_id"]), llm, 0.4, 8)


def queries() -> dict:
    def weighted(s, d):
        p = gold(s, d)
        return audit.stratified_sample(p, 8, 20260805)

    def rates(s, d, *by):
        w = weighted(s, d).join(final_decisions(s, d), ["input_id", "technique_id"])
        x = audit.decision_rates(w, "decision", "analysis_weight", *by)
        return x.withColumn("raw_rate", F.round("raw_rate", 6)).withColumn("weighted_rate", F.round("weighted_rate", 6))

    def pairs(s, d):
        return audit.confusion(reviews(s, d).where("d1 is not null and d2 is not null"), "d1", "d2")

    def kappa(s, d):
        return audit.kappa(pairs(s, d)).select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])

    def doc(s, d):
        return table(s, d, "documents")

    def iterative(s, d):
        m = dataset.merge_sources(based(s, d, "records")).select("base", "labels").orderBy("base").collect()  # one labelled evaluation set
        small = dataset.stratified_split([(r.base, list(r.labels)) for r in m], max(1, len(m) // 5), 20260805)
        return s.createDataFrame([(r.base, list(r.labels), "development" if r.base in small else "test") for r in m], "base string, labels array<string>, split string")

    def numbered_items(s, d):
        from pyspark.sql import Window

        return items(s, d).withColumn("no", F.row_number().over(Window.partitionBy("input_id", "field").orderBy("pos")))

    def links(s, d):
        k, e = extraction.kept_items(items(s, d), item_evidence(s, d)), item_evidence(s, d)
        r = extraction.completed_relations(extraction.kept_relations(item_relations(s, d), k, e), extraction.completed_behaviors(k, e), extraction.completed_impacts(k, e))
        return r.select("input_id", "src", "type", "dst", "evidence_ids", F.round("confidence", 6).alias("confidence"))

    def subset_labels(s, d):
        return audit.label_subsets(gold(s, d), final_decisions(s, d))

    def subset_metrics(s, d):
        from .ranking import rankings, rounded

        return rounded(metrics.by_subset(rankings(s, d), subset_labels(s, d), (1, 5), 2))

    return {
        "canonical_text": lambda s, d: doc(s, d).select("doc_id", canonical(F.col("text")).alias("canonical")),
        "clean_markup": lambda s, d: doc(s, d).select("doc_id", without_markup(F.col("text")).alias("cleaned"), truncated(F.coalesce("text", F.lit("")), 80).alias("head")),
        "id_normalise": lambda s, d: table(s, d, "source_rows").select("row_id", N.input_id(F.col("source_id")).alias("input_id"), N.base_id(F.col("source_id")).alias("base_id"), dataset.augmentation_index(F.col("source_id")).alias("augmentation")),
        "name_normalise": lambda s, d: table(s, d, "techniques").select("technique_id", snake(F.col("name")).alias("snake"), file_name(F.col("name")).alias("file_name"), short_phrase(F.col("text")).alias("phrase"), text_or_null(F.col("description")).alias("description"), F.col("technique_id").alias("t")).drop("t"),
        "evidence_id_lists": lambda s, d: nodes(s, d).select("input_id", "node_id", evidence_ids(F.array(F.array_join("evidence_ids", " ; "), F.lit("e11, x3 E2"))).alias("ids")),
        "confidence_clamp": lambda s, d: table(s, d, "rerank").select(N.base_id(F.col("input_id")).alias("input_id"), "technique_id", confidence(F.col("score_text")).alias("confidence")),
        "label_splitter": lambda s, d: table(s, d, "records").select("record_id", label_parts(F.array_join("labels", ", ")).alias("parts")),
        "token_budget": lambda s, d: based(s, d, "rerank").groupBy("base").agg(F.count("*").alias("n")).select("base", token_budget(F.lit(1800), F.col("n"), F.lit(1)).alias("budget")),
        "collapse_rows": lambda s, d: dataset.collapse_rows(rows(s, d)),
        "merge_sources": lambda s, d: dataset.merge_sources(based(s, d, "records")),
        "split_targets": lambda s, d: gold(s, d).groupBy("technique_id").agg(F.count("*").alias("support")).select("technique_id", "support", split_target(F.col("support"), 1, 5).alias("target")),
        "split_overlap": lambda s, d: dataset.overlap(rows(s, d).where(N.split_name(F.col("split")) == "train"), rows(s, d).where(N.split_name(F.col("split")) == "test"), "base"),
        "id_alignment": lambda s, d: dataset.id_alignment(rows(s, d), based(s, d, "rerank"), "base"),
        "duplicate_keys": lambda s, d: dataset.duplicate_keys(based(s, d, "records"), "base", "source_name"),
        "remaining_ids": lambda s, d: dataset.remaining(rows(s, d), based(s, d, "records"), "base").select("row_id", "base"),
        "label_resolution": lambda s, d: dataset.resolve_labels(table(s, d, "records").select(F.explode("labels").alias("label")).unionByName(table(s, d, "techniques").select(F.lower("name").alias("label"))), table(s, d, "techniques")),
        "onehot_to_long": lambda s, d: dataset.onehot_to_long(table(s, d, "techniques").select("technique_id", F.col("is_subtechnique").cast("int").alias("sub"), F.col("revoked").cast("int").alias("revoked"), F.col("deprecated").cast("int").alias("deprecated")), "technique_id", ["sub", "revoked", "deprecated"]),
        "source_counts": lambda s, d: dataset.merge_sources(based(s, d, "records")).select(F.explode("source_membership").alias("source_name")).groupBy("source_name").agg(F.count("*").alias("n")),
        "iterative_split": lambda s, d: iterative(s, d).select("base", "split"),
        "split_balance": lambda s, d: dataset.label_balance(iterative(s, d), 0.2, "development"),
        "split_union": lambda s, d: dataset.not_partitioned(based(s, d, "records"), [based(s, d, "records").where(F.col("source_position") % 3 == k).select("base").distinct() for k in (0, 1)], "base"),
        "segment_documents": units,
        "segment_clauses": lambda s, d: units(s, d, aggressive=True),
        "evidence_spans": lambda s, d: segment.spans(units(s, d), "input_id"),
        "evidence_count_distribution": lambda s, d: units(s, d).groupBy("input_id").agg(F.count("*").alias("units")).groupBy("units").agg(F.count("*").alias("records")),
        "layer_edges": lambda s, d: edges(s, d).select("input_id", "src", "dst", "type", F.array_sort("shared_evidence_ids").alias("shared"), F.round("evidence_jaccard", 6).alias("evidence_jaccard"), F.round("lexical_jaccard", 6).alias("lexical_jaccard"), F.round("structural_score", 5).alias("structural_score")),
        "graph_stats": lambda s, d: graph.stats(nodes(s, d)),
        "support_map": lambda s, d: graph.support_map(nodes(s, d)),
        "dedupe_edges": lambda s, d: graph.dedupe_edges(edges(s, d).select("input_id", F.substring("src", 1, 2).alias("src"), F.substring("dst", 1, 2).alias("dst"), "type", F.round("structural_score", 5).alias("score")), F.desc("score")),
        "dangling_edges": lambda s, d: graph.dangling_edges(edges(s, d).select("input_id", F.concat("src", F.when(F.col("input_id") % 7 == 0, "x").otherwise("")).alias("src"), "dst", "type"), nodes(s, d)),
        "simple_paths": lambda s, d: graph.simple_paths(nodes(s, d), edges(s, d)).select("input_id", F.array_join("path", ">").alias("path"), F.round("score_sum", 5).alias("score_sum"), "shared_sum", "continuous"),
        "best_path": lambda s, d: graph.best_path(nodes(s, d), edges(s, d)),
        "evidence_cover": lambda s, d: graph.evidence_cover(nodes(s, d)),
        "rule_nodes": lambda s, d: extract.nodes(units(s, d)),
        "rule_graph_edges": lambda s, d: graph.layer_edges(extract.nodes(units(s, d))),
        "explicit_impacts": lambda s, d: extract.explicit_impacts(stop_units(s, d)).select("input_id", "impact", "evidence_ids", "ord"),
        "impact_keywords": lambda s, d: doc(s, d).select("doc_id", F.array_sort(extract.impact_types(F.col("text"))).alias("impacts"), extract.primary_impact(F.col("text")).alias("impact")),
        "vulnerability_types": lambda s, d: table(s, d, "techniques").select("technique_id", extract.vulnerability_type(F.col("text"), F.col("name")).alias("v")).select("technique_id", "v.type", "v.subtype"),
        "stratified_sample": lambda s, d: weighted(s, d).select("sample_id", "input_id", "technique_id", "stratum_size", "sampled", F.round("selection_probability", 6).alias("selection_probability"), F.round("analysis_weight", 6).alias("analysis_weight")),
        "reviewer_order": lambda s, d: audit.display_order(weighted(s, d).select("sample_id"), "reviewer_1", 7),
        "confusion": pairs,
        "kappa": kappa,
        "decision_rates": rates,
        "decision_rates_by_technique": lambda s, d: rates(s, d, "technique_id"),
        "resolved_decisions": lambda s, d: audit.resolved(reviews(s, d)).groupBy("resolution", "final_decision").agg(F.count("*").alias("n")),
        "label_subsets": subset_labels,
        "subset_metrics": subset_metrics,
        "extraction_items": lambda s, d: extraction.kept_items(items(s, d), item_evidence(s, d)).select("input_id", "field", "no", "a", "b", "c", "evidence_ids", F.round("confidence", 6).alias("confidence")),
        "extraction_relations": lambda s, d: extraction.kept_relations(item_relations(s, d), extraction.kept_items(items(s, d), item_evidence(s, d)), item_evidence(s, d)),
        "extraction_impacts": lambda s, d: extraction.completed_impacts(extraction.kept_items(items(s, d), item_evidence(s, d)), item_evidence(s, d)).select("input_id", "no", "type", "evidence_ids", F.round("confidence", 6).alias("confidence")),
        "extraction_behaviors": lambda s, d: extraction.completed_behaviors(extraction.kept_items(items(s, d), item_evidence(s, d)), item_evidence(s, d)).select("input_id", "no", F.col("c").alias("impact")),
        "extraction_links": links,
        "extraction_problems": lambda s, d: contracts.counts(extraction.problems(items(s, d), item_relations(s, d), item_evidence(s, d))),
        "node_texts": lambda s, d: extraction.graph_nodes(items(s, d).withColumnRenamed("pos", "no")).select("input_id", "node_id", "type", "text", "evidence_ids"),
        "node_references": lambda s, d: item_relations(s, d).select("src").distinct().select("src", extraction.node_ref(F.col("src")).alias("ref")),
        "resolved_relations": lambda s, d: extraction.resolved_relations(item_relations(s, d), extraction.graph_nodes(numbered_items(s, d)))[0].select("input_id", "pos", "src", "dst", "type"),
        "unresolved_relations": lambda s, d: extraction.resolved_relations(item_relations(s, d), extraction.graph_nodes(numbered_items(s, d)))[1].select("input_id", "pos", "src", "dst"),
        "extractor_edges": lambda s, d: extraction.all_edges(extraction.graph_nodes(numbered_items(s, d)), item_relations(s, d)).select("input_id", "src", "dst", "type", "explicit", F.round("structural_score", 5).alias("structural_score")),
        "labels_evaluation": lambda s, d: label_files.load_labels(label_lines(s, d), "evaluation"),
        "labels_sweep": lambda s, d: label_files.load_labels(label_lines(s, d), "sweep", parent=True),
        "labels_audit": lambda s, d: label_files.load_labels(label_lines(s, d), "audit"),
        "label_report": lambda s, d: label_files.label_report(label_lines(s, d), "sweep"),
        "label_problems": lambda s, d: contracts.counts(label_files.label_problems(label_lines(s, d), "audit")),
        "ranking_runs": lambda s, d: label_files.load_rankings(run_lines(s, d)),
        "ranking_problems": lambda s, d: contracts.counts(label_files.ranking_problems(run_lines(s, d), 20).drop("method", "run")),
        "ranking_lengths": lambda s, d: label_files.length_histogram(run_lines(s, d)),
        "unknown_candidates": lambda s, d: label_files.unknown_candidates(run_lines(s, d), table(s, d, "techniques").where("not coalesce(is_subtechnique, false)")),
        "inconsistent_runs": lambda s, d: label_files.inconsistent_runs(run_lines(s, d)),
        "contract_sentences": lambda s, d: contracts.counts(contracts.sentences(table(s, d, "sentences").dropDuplicates(["input_id"]))),
        "contract_labels": lambda s, d: contracts.counts(contracts.labels(table(s, d, "records").withColumn("input_id", F.col("record_id").cast("string")))),
        "contract_nodes": lambda s, d: contracts.counts(contracts.graph_nodes(nodes(s, d))),
        "contract_catalogue": lambda s, d: contracts.counts(contracts.catalogue(table(s, d, "techniques"))),
        "contract_support": lambda s, d: contracts.counts(contracts.support_edges(nodes(s, d), graph.support_map(nodes(s, d).where("type <> 'Impact'")).select("input_id", "evidence_id", F.explode("node_ids").alias("node_id")))),
        "contract_explanations": lambda s, d: contracts.counts(contracts.explanations(explanation.explanations(nodes(s, d), edges(s, d)), nodes(s, d), edges(s, d).where("type <> 'causes'"))),
        "contract_counts": lambda s, d: contracts.counts(contracts.record_counts(graph.stats(nodes(s, d)).select("input_id", (F.col("n_nodes") + F.col("n_impact") % 2).alias("n_nodes"), F.lit(0).alias("n_edges")), nodes(s, d), edges(s, d))),
        "sentence_maps": lambda s, d: contracts.sentence_maps(table(s, d, "sentences").dropDuplicates(["input_id"])).select("input_id", F.size("sentences").alias("n"), "contiguous", "problems"),
        "trace_edges": lambda s, d: graph.trace_edges(nodes(s, d), nodes(s, d).where("type = 'Impact'")),
        "contract_edges": lambda s, d: contracts.counts(contracts.graph_edges(edges(s, d), nodes(s, d).where("node_id <> 'N3'"))),
        "rerank_topk": lambda s, d: rerank.top_candidates(ranked_candidates(s, d), 3, exact=True),
        "rerank_merge": lambda s, d: rerank_result(s, d),
        "citation_caps": lambda s, d: based(s, d, "rerank").select("base", "technique_id", F.round(rerank.capped(F.col("score_text") / 20, F.col("mode"), F.col("retrieval_rank") % 2 == 0, F.col("retrieval_rank") % 4 == 0, F.col("retrieval_rank") % 3 > 0), 6).alias("capped")).where("capped is not null and not isnan(capped)"),
        "explanations": lambda s, d: explanation.layered_explanations(nodes(s, d)).select("input_id", "status", "chain", "chain_types", "evidence_ids", "minimum_evidence", "compact_text"),
        "explanation_queries": lambda s, d: explanation.layered_query_text(explanation.layered_explanations(nodes(s, d))),
        "rerank_prompts": lambda s, d: rerank.prompts(rerank.top_candidates(ranked_candidates(s, d), 5), segment.segment(based(s, d, "records").groupBy("base").agg(F.max("raw_text").alias("t")).withColumnRenamed("base", "input_id"), "input_id", "t"), table(s, d, "techniques")),
        "event_windows": lambda s, d: windowed_counts(table(s, d, "events"), "ts", "event_type").select("window_start", "event_type", "n", F.round("total", 4).alias("total")),
        "event_props": lambda s, d: table(s, d, "events").select("event_id", F.size(F.json_object_keys("props")).alias("n_keys")),
        "token_jaccard": lambda s, d: table(s, d, "techniques").select("technique_id", F.round(jaccard(token_set(F.col("name")), token_set(F.col("text"))), 6).alias("overlap")),
    }


def oracle_sql() -> dict[str, str]:
    ws = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
    squash = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{ws}', ' ', 'g'))"
    snaked = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    nid = "regexp_replace(regexp_replace(upper({0}), '[^\\p{{L}}\\p{{Nd}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
    nd = """nd as (select l_orderkey input_id, 'N' || row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) node_id,
        (['Precondition', 'Entry', 'VulnType', 'Behavior', 'Impact'])[l_linenumber % 5 + 1] as type, 'flag ' || l_returnflag || ' ' || l_linestatus || ' part' || (l_partkey % 7) as text,
        list_sort(list_distinct(['E' || (l_suppkey % 12 + 1), 'E' || (l_partkey % 12 + 1)])) ev, round(l_discount * 10, 6) conf from lineitem)"""
    from .ranking import valid_sql

    ranked = f"rk as (select input_id, technique_id, row_number() over (partition by input_id order by score desc nulls last, technique_id) rank from (select {S.base('input_id')} input_id, technique_id, max({valid_sql()['text']}) score from rerank group by 1, 2))"
    ranks = "rk2 as (select *, row_number() over (partition by method, run, input_id order by score desc nulls last, technique_id) rank from (" + " union all ".join(
        f"select '{m}' as method, {k} as run, {S.base('input_id')} input_id, technique_id, {agg}({v}) score from rerank group by 3, 4" for m, v in valid_sql().items() for k, agg in ((1, "max"), (2, "min"))
    ) + "))"
    toks = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 1))"
    jac = "coalesce(len(list_intersect({0}, {1}))::double / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0)"
    rules = ", ".join(f"('{a}', '{b}', '{r}')" for a, b, r in graph.LAYER_RULES)
    ed = f"""ed as (select a.input_id, a.node_id src, b.node_id dst, r.t as type, list_sort(list_intersect(a.ev, b.ev)) shared, {jac.format('a.ev', 'b.ev')} ej, {jac.format(toks.format('a.text'), toks.format('b.text'))} lj,
        round(0.55 * {jac.format('a.ev', 'b.ev')} + 0.25 * {jac.format(toks.format('a.text'), toks.format('b.text'))} + 0.20 * (a.conf + b.conf) / 2, 6) score
        from nd a join (values {rules}) r(x, y, t) on a.type = r.x join nd b on a.input_id = b.input_id and b.type = r.y)"""
    paths = f"""with {nd}, {ed}, e2 as (select input_id, src, dst, max(score) score, max(len(shared)) shared from ed group by 1, 2, 3),
        p1 as (select input_id, [node_id] path, [type] types, 0::double score_sum, 0 shared_sum, 0 continuous, conf conf_sum, node_id last, [ev] evs from nd),
        """ + ", ".join(f"p{k + 1} as (select p.input_id, list_append(path, dst) path, list_append(types, n.type) types, score_sum + score score_sum, shared_sum + shared shared_sum, continuous + cast(shared > 0 as int) continuous, conf_sum + n.conf conf_sum, dst as last, list_append(evs, n.ev) evs from p{k} p join e2 e on e.input_id = p.input_id and e.src = p.last and not list_contains(path, dst) join nd n on n.input_id = e.input_id and n.node_id = dst)" for k in (1, 2, 3)) + ", pa as (select * from p1 union all select * from p2 union all select * from p3 union all select * from p4)"
    # the order of core types: each is looked for after the last one found
    after = {"en": "list_position(types, 'Entry')", "be": "list_position(types[coalesce(en, 0) + 1:], 'Behavior') + coalesce(en, 0)", "im": "list_position(types[greatest(coalesce(en, 0), coalesce(be, 0)) + 1:], 'Impact')"}
    meet = lambda *k: "len(" + "".join("list_intersect(" for _ in k[1:]) + f"evs[{k[0]}]" + "".join(f", evs[{x}])" for x in k[1:]) + ") > 0"
    two = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    any_of = lambda *c: "(" + " or ".join(c) + ")"
    cover = f"""case len(path) when 1 then 1 when 2 then case when {meet(1, 2)} then 1 else 2 end
        when 3 then case when {meet(1, 2, 3)} then 1 when {any_of(*[meet(*k) for k in two if 4 not in k])} then 2 else 3 end
        else case when {meet(1, 2, 3, 4)} then 1 when {any_of(meet(1, 2, 3), meet(1, 2, 4), meet(1, 3, 4), meet(2, 3, 4), *[f"({meet(*k)} and {meet(*sorted({1, 2, 3, 4} - set(k)))})" for k in two[:3]])} then 2 when {any_of(*[meet(*k) for k in two])} then 3 else 4 end end"""
    rank_path = paths + f""", pe as (select *, {after['en']} en from pa), pb as (select *, {after['be']} be from pe), pi as (select *, {after['im']} im from pb),
        pk as (select *, types[1] = 'Entry' and types[-1] = 'Impact' and list_contains(types, 'Behavior') complete, cast(en is not null as int) + cast(be is not null as int) + cast(im is not null as int) core,
            greatest(len(path) - 1, 1) hops, {cover} cover_size from pi),
        po as (select *, round(score_sum / hops, 9) mean_score, row_number() over (partition by input_id order by complete desc, core desc, round(continuous::double / hops, 9) desc, round(shared_sum::double / hops, 9) desc, len(path), cover_size, round(score_sum / hops, 9) desc, round(conf_sum / len(path), 9) desc, path) n from pk)"""
    lab = "(select base, list_sort(list(distinct l)) labels from (select base, unnest(labels) l from {0}) where l is not null group by 1)"
    rec = f"rc as (select *, {S.base('input_id')} base from records where {S.base('input_id')} is not null)"
    srw = f"sr as (select *, coalesce({S.base('base_input_id')}, {S.base('source_id')}) base, try_cast(nullif(regexp_extract({nid.format('source_id')}, '_AUGU?MENTED_(\\d+)$', 1), '') as int) aug from source_rows), sq as (select * from sr where base is not null)"
    enum = "case when translate(lower(trim({0})), '- ', '__') in ('directly_supported', 'inferential_or_plausible', 'insufficient_text', 'unsupported') then translate(lower(trim({0})), '- ', '__') end"
    rev = f"rv as (select form_id, sample_id, {S.base('cve_id')} input_id, technique_id, round_no, {enum.format('reviewer_1_decision')} d1, {enum.format('reviewer_2_decision')} d2, {enum.format('adjudicated_decision')} d3 from audit_reviews)"
    fin = f"""{rev}, fd as (select *, case when d1 = d2 then d1 else d3 end f from rv), de as (select input_id, technique_id, first(f order by round_no desc, form_id desc) decision from fd where f is not null and input_id is not null group by 1, 2)"""
    go = f"gold as (select distinct {S.base('input_id')} input_id, upper(trim(l)) technique_id from (select input_id, unnest(labels) l from records) where {S.base('input_id')} is not null and upper(trim(l)) in (select technique_id from techniques))"
    smp = f"""{go}, hs as (select *, sha256('20260805' || chr(31) || input_id || chr(31) || technique_id) h from gold), hk as (select *, row_number() over (partition by technique_id order by h, input_id) k, count(*) over (partition by technique_id) stratum_size from hs),
        sa as (select 'LSA-' || upper(substr(h, 1, 12)) sample_id, input_id, technique_id, stratum_size, least(stratum_size, 8) sampled from hk where k <= 8)"""
    rate = "select {0} decision, n, round(n::double / sum(n) over ({1}), 6) as raw_rate, round(w / sum(w) over ({1}), 6) as weighted_rate from (select {0} decision, count(*) n, sum(stratum_size::double / sampled) w from sa join de using (input_id, technique_id) group by {0} decision)"
    imp = " ".join(f"case when regexp_matches(lower(trim(regexp_replace(coalesce(text, ''), '{ws}', ' ', 'g'))), '{'|'.join(w)}') then '{k}' end," for k, w in extract.IMPACT_WORDS.items()).rstrip(",")
    lst = lambda v: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]"
    line_no = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
    texts = lambda c: f"({lst(ITEM_TEXTS)})[{c} % {len(ITEM_TEXTS)} + 1]"
    it = f"""it as (select l_orderkey input_id, ({lst(extraction.FIELDS)})[l_linenumber % 5 + 1] field, {line_no} pos, {texts('l_partkey')} a, {texts('l_suppkey')} b, {texts('cast(l_quantity as int)')} c,
        l_suppkey % 9 + 1 e1, l_partkey % 9 + 1 e2, case when l_linenumber % 4 = 0 then null else l_discount * 20 - 0.3 end conf from lineitem)"""
    impact_of = lambda c: "list_filter([" + ", ".join(f"case when regexp_matches(lower({squash(c)}), '{'|'.join(w)}') then '{k}' end" for k, w in extract.IMPACT_WORDS.items()) + "], lambda x: x is not null)"
    weakness = lambda pick: "case " + " ".join(f"when regexp_matches(lower({squash('a')}) || chr(10) || lower({squash('b')}), '{p}') then {pick(a, k, e)}" for p, (a, k), e in extract.weakness_patterns())
    nonnull = lambda c: f"case when lower(trim({c}, ' ')) not in ('', 'null', 'none', 'n/a') then trim({c}, ' ') end"
    kt = f"""{it}, ke as (select *, case when e1 <= 6 and e2 <= 6 and e1 <> e2 then ['E' || e1, 'E' || e2] when e1 <= 6 then ['E' || e1] when e2 <= 6 then ['E' || e2] end ev from it),
        kt as (select input_id, field, pos, ev, least(1, greatest(0, coalesce(conf, 0.8))) conf, row_number() over (partition by input_id, field order by pos) no,
            case field when 'preconditions' then a when 'entry' then trim(a, ' ') when 'vuln_type' then {weakness(lambda a, k, e: f"'{a}'")} else coalesce(nullif({snaked.format(squash('a'))}, ''), 'unspecified') end
                when 'behaviors' then {squash('a')} else coalesce(({impact_of('a')})[1], 'unspecified') end a,
            case field when 'entry' then {squash('b')} when 'vuln_type' then {weakness(lambda a, k, e: f"coalesce(nullif({snaked.format(squash('b'))}, ''), '{e}')" if k == "" else f"'{k or ''}'")} else {snaked.format(squash('b'))} end
                when 'behaviors' then {nonnull('b')} else b end b,
            case when field = 'behaviors' then ({impact_of(nonnull('c'))})[1] end c from ke where ev is not null)"""
    prefix_of = "case field " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in extraction.FIELDS.items()) + " end"
    # what the references mean, written out
    plain_refs = dict(zip(REFERENCES, ("B1", "I1", "EN1", "B1", "I1", "P1", "EN2", "VT2", None, "B2", "I2", "B3")))
    meant = lambda c: "case " + c + " " + " ".join(f"when '{k}' then '{v}'" for k, v in plain_refs.items() if v) + " end"
    rl = f"""rl as (select l_orderkey input_id, {line_no} pos, ({lst(REFERENCES)})[l_partkey % {len(REFERENCES)} + 1] src, (['enables', 'Causes', 'characterized by', 'related', 'leads-to'])[cast(l_quantity as int) % 5 + 1] typ,
        ({lst(REFERENCES)})[l_suppkey % {len(REFERENCES)} + 1] dst, l_partkey % 8 + 1 e, l_discount conf from lineitem)"""
    pair_type = "case " + " ".join(f"when {{0}} = '{a}' and {{1}} = '{b}' then '{t}'" for (a, b), t in extraction.PAIRS.items()) + " end"
    kr = f"""{kt}, {rl}, kp as (select input_id, {prefix_of} p, pos, no from kt),
        al as (select input_id, p || ref ref, p || coalesce(min(case when ref = no then no end), min(no)) new from (select input_id, p, no ref, no from kp union all select input_id, p, pos, no from kp) group by 1, p, ref),
        kx as (select r.input_id, r.pos, s.new src, d.new dst, e, conf from rl r join al s on s.input_id = r.input_id and s.ref = {meant('src')} join al d on d.input_id = r.input_id and d.ref = {meant('dst')} where e <= 6 and typ <> 'related'),
        ky as (select *, {pair_type.format("regexp_extract(src, '^[A-Z]+')", "regexp_extract(dst, '^[A-Z]+')")} typ from kx),
        kr as (select input_id, src, typ as type, dst, ['E' || first(e order by pos)] evidence_ids, first(conf order by pos) confidence from ky where typ is not null group by 1, 2, 3, 4)"""
    eu = f"""eu as (select input_id, ord, ({lst(UNIT_TEXTS)})[(input_id + ord) % {len(UNIT_TEXTS)} + 1] text from (select distinct l_orderkey input_id from lineitem) cross join (select unnest(range(1, 7)) ord)),
        eh as (""" + " union all ".join(f"select input_id, ord, {n} no, '{k}' impact from eu where not regexp_matches(text, '(?i){extract.UNKNOWN_IMPACT}') and regexp_matches(text, '(?i){p}')" for n, (k, p) in enumerate(extract.EXPLICIT_IMPACTS)) + """),
        es as (select input_id, impact, list_transform(list_sort(list(ord)), lambda o: 'E' || o) ev, min(ord * 100 + no) f from eh group by 1, 2), eo as (select *, row_number() over (partition by input_id order by f) n from es)"""
    words = lst(extract.IMPACT_WORDS)
    ki = f"""{kr}, {eu}, own as (select *, max(a <> 'unspecified') over (partition by input_id) told from kt where field = 'impacts'),
        i0 as (select input_id, a t, ev, conf, 0 s, no n, 0 z from own where told or a <> 'unspecified'),
        i1 as (select input_id, impact t, ev, 0.95 conf, 1 s, n, 0 z from eo),
        i2 as (select input_id, unnest(list_distinct(list_concat({impact_of('c')}, list_concat({impact_of('a')}, {impact_of('b')})))) t, ev, no n from kt where field = 'behaviors'),
        i3 as (select input_id, unnest({impact_of('b')}) t, ev, no n from kt where field = 'entry'),
        i4 as (select * from i1 union all select input_id, t, ev, 0.95, 2, n, list_position({words}, t) from i2 union all select input_id, t, ev, 0.95, 3, n, list_position({words}, t) from i3),
        i5 as (select * from i4 where not exists (select 1 from i0 where i0.input_id = i4.input_id and i0.t = i4.t) qualify row_number() over (partition by input_id, t order by s, n, z) = 1),
        ki as (select *, row_number() over (partition by input_id order by s, n, z) no from (select * from i0 union all select * from i5))"""
    strip = lambda c: f"regexp_replace({c}, '^{ws}|{ws}$', '', 'g')"
    tid = "^T[0-9]{4}(\\.[0-9]{3})?$".replace("\\\\", "\\")
    ln = "ln as (select record_id, record_id % 3 k, nullif(trim(input_id, ' '), '') i, labels, array_to_string(labels, ', ') j from records)"
    lr = "lr as (select *, row_number() over (partition by run, input_id order by final desc, technique_id) rr, row_number() over (partition by run, input_id order by technique_id) p from (select run, input_id, technique_id, max(rank) filter (where method = 'text') t, round(max(score) filter (where method = 'text'), 6) ts, round(max(score) filter (where method = 'llm'), 6) l, round(coalesce(round(max(score) filter (where method = 'llm'), 6), 0) / 100, 6) final from rk2 where method in ('text', 'llm') group by 1, 2, 3))"
    return {
        "extraction_items": f"with {kt} select input_id, field, cast(no as int) as no, a, b, c, ev as evidence_ids, round(conf, 6) as confidence from kt",
        "extraction_relations": f"with {kr} select * from kr",
        "extraction_impacts": f"with {ki} select input_id, cast(no as int) as no, t as type, ev as evidence_ids, round(conf, 6) as confidence from ki",
        "extraction_behaviors": f"with {kt}, {eu}, m as (select kt.input_id, kt.no, first(impact order by n) i from kt join eo on eo.input_id = kt.input_id and len(list_intersect(eo.ev, kt.ev)) > 0 where field = 'behaviors' and c is null group by 1, 2) select input_id, cast(no as int) as no, coalesce(c, i) as impact from kt left join m using (input_id, no) where field = 'behaviors'",
        "extraction_links": f"with {ki}, b as (select * from kt where field = 'behaviors'), n as (select b.input_id, 'B' || b.no src, 'I' || i.no dst, list_filter(b.ev, lambda x: list_contains(i.ev, x)) evidence_ids, least(b.conf, i.conf) confidence from b join ki i on i.input_id = b.input_id and len(list_intersect(b.ev, i.ev)) > 0) "
            "select input_id, src, type, dst, evidence_ids, round(confidence, 6) as confidence from kr union all select input_id, src, 'causes', dst, evidence_ids, round(confidence, 6) from n where not exists (select 1 from kr where kr.input_id = n.input_id and kr.src = n.src and kr.dst = n.dst and kr.type = 'causes')",
        "node_references": f"with {rl} select distinct src, {meant('src')} as ref from rl",
        "node_texts": f"with {it}, t as (select *, nullif(trim(a, ' '), '') x, nullif(trim(b, ' '), '') y, nullif(trim(c, ' '), '') z from it) select input_id, case field " + " ".join(f"when '{k}' then '{v[2]}'" for k, v in extraction.FIELDS.items()) + " end || pos as node_id, case field " + " ".join(f"when '{k}' then '{v[1]}'" for k, v in extraction.FIELDS.items()) + " end as type, "
            "case when field = 'behaviors' then concat_ws('; ', 'action=' || x, 'target=' || y, 'impact=' || z) else concat_ws(case when field = 'vuln_type' then ': ' else '; ' end, x, case when y is distinct from x then y end) end as text, "
            "list_transform(list_sort(list_distinct([e1, e2, 77])), lambda e: 'E' || e) as evidence_ids from t",
        "resolved_relations": f"with {it}, {rl}, n as (select input_id, field, row_number() over (partition by input_id, field order by pos) no from it), f as (" + " union all ".join(f"select input_id, unnest(['{v[2]}' || no, '{v[0]}' || no, upper('{v[1]}') || ':' || no, upper('{v[1]}') || '_' || no, upper('{v[1]}') || no]) name, '{v[2]}' || no node from n where field = '{k}'" for k, v in extraction.FIELDS.items()) + ") "
            "select r.input_id, cast(r.pos as int) as pos, s.node as src, d.node as dst, typ as type from rl r join f s on s.input_id = r.input_id and s.name = upper(r.src) join f d on d.input_id = r.input_id and d.name = upper(r.dst)",
        "unresolved_relations": f"with {it}, {rl}, n as (select input_id, field, row_number() over (partition by input_id, field order by pos) no from it), f as (" + " union all ".join(f"select input_id, unnest(['{v[2]}' || no, '{v[0]}' || no, upper('{v[1]}') || ':' || no, upper('{v[1]}') || '_' || no, upper('{v[1]}') || no]) name from n where field = '{k}'" for k, v in extraction.FIELDS.items()) + ") "
            "select input_id, cast(pos as int) as pos, src, dst from rl r where not exists (select 1 from f where f.input_id = r.input_id and name = upper(r.src)) or not exists (select 1 from f where f.input_id = r.input_id and name = upper(r.dst))",
        "labels_evaluation": f"with {ln}, e as (select i, unnest(case when k = 0 then labels else regexp_split_to_array(j, '[,;\\s]+') end) l from ln where k <> 1 and i is not null) select i as input_id, list_sort(list(distinct upper(trim(l, ' ')))) as labels from e where regexp_full_match(upper(trim(l, ' ')), '{tid[1:-1]}') group by 1",
        "labels_sweep": f"with {ln}, e as (select i, unnest(coalesce(case when k = 2 then [j] else labels end, [])) l from ln where i is not null), v as (select i, split_part(upper(trim(l, ' ')), '.', 1) t from e) select ids.i as input_id, list_sort(coalesce(list(distinct t) filter (where regexp_full_match(t, 'T[0-9]{{4}}')), [])) as labels from (select distinct i from ln where i is not null) ids left join v on v.i = ids.i group by 1",
        "labels_audit": f"with {ln}, e as (select i, unnest(coalesce(case when k = 2 then [j] else labels end, [])) l from ln where i is not null and k <> 1) select ids.i as input_id, list_sort(coalesce(list(distinct trim(l, ' ')) filter (where trim(l, ' ') <> ''), [])) as labels from (select distinct i from ln where i is not null and k <> 1) ids left join e on e.i = ids.i group by 1",
        "label_report": f"with {ln}, e as (select *, case when k <> 2 then coalesce(labels, []) when j is null then [] else [j] end v from ln), b as (select *, len(list_filter(v, lambda x: not coalesce(regexp_full_match(upper(trim(x, ' ')), '{tid[1:-1]}'), false))) bad from e) select count(*) as rows, count(distinct i) as ids, count(*) - count(distinct i) as duplicate_rows, cast(count(*) filter (where k = 2 and j is not null) as bigint) as texts_repaired, cast(sum(bad) as bigint) as labels_dropped, cast(count(*) filter (where bad = len(v)) as bigint) as rows_without_label from b",
        "ranking_runs": f"with {ranks}, {lr}, o as (select *, row_number() over (partition by run, input_id order by case when length(input_id) % 2 = 1 then rr end, final desc, coalesce(l, 0) desc, case when length(input_id) % 2 = 0 then coalesce(ts, 0) end desc, p) rank from lr) select 'm' as method, run, input_id, technique_id, cast(rank as int) as rank, cast(row_number() over (partition by run, input_id order by t, -coalesce(ts, 0), technique_id) as int) as retrieval_rank from o",
        "ranking_lengths": f"with {ranks}, {lr}, c as (select run, input_id, count(*) length from lr group by 1, 2) select 'm' as method, run, length, count(*) as inputs from c group by 1, 2, 3",
        "unknown_candidates": f"with {ranks}, {lr} select technique_id, count(*) as n from lr where technique_id not in (select technique_id from techniques where not coalesce(is_subtechnique, false)) group by 1",
        "inconsistent_runs": f"with {ranks}, {lr}, x as (select run, input_id, list(technique_id order by t, technique_id) ids, list(struct_pack(a := t, b := technique_id, c := ts) order by t, technique_id) r from lr group by 1, 2) select input_id, count(distinct ids) as candidates, count(distinct r) as retrievals, count(*) as n from x group by 1 having count(distinct ids) > 1 or count(distinct r) > 1 or count(*) < 2",
        "canonical_text": f"select doc_id, trim(regexp_replace(coalesce(text, ''), '{ws}', ' ', 'g')) as canonical from documents",
        "id_normalise": f"select row_id, {nid.format('source_id')} as input_id, {S.base('source_id')} as base_id, try_cast(nullif(regexp_extract({nid.format('source_id')}, '_AUGU?MENTED_(\\d+)$', 1), '') as int) as augmentation from source_rows",
        "evidence_id_lists": f"with {nd} select input_id, node_id, list_transform(list_sort(list_transform(list_distinct(list_concat(ev, ['E11', 'E2'])), lambda e: cast(substr(e, 2) as int))), lambda i: 'E' || i) as ids from nd",
        "confidence_clamp": f"select {S.base('input_id')} as input_id, technique_id, case when score_text is not null and not isnan(score_text) then round(least(1, greatest(0, score_text)), 6) end as confidence from rerank",
        "token_budget": f"select {S.base('input_id')} as base, least(6000, cast(ceil(greatest(1800, 1000 + 70 * count(*)) * 1.25) as int)) as budget from rerank group by 1",
        "collapse_rows": f"""with {srw}, tx as (select base, first(text order by coalesce(aug, -1), source_row, source_id, row_id) as text from sq where text is not null group by 1)
            select base, count(*) as n_rows, count(aug) as n_augmented, any_value(tx.text) as text, coalesce(any_value(lb.labels), []) as labels from sq left join tx using (base) left join {lab.format('sq')} lb using (base) group by 1""",
        "merge_sources": f"""with {rec}, tx as (select base, first(raw_text order by -length(raw_text), source_position, source_record_order, record_sha256) as raw_text, first(record_sha256 order by -length(raw_text), source_position, source_record_order, record_sha256) as record_sha256 from rc where raw_text is not null group by 1)
            select base, list_sort(list(distinct source_name)) as source_membership, any_value(tx.raw_text) as raw_text, any_value(tx.record_sha256) as record_sha256, coalesce(any_value(lb.labels), []) as labels from rc left join tx using (base) left join {lab.format('rc')} lb using (base) group by 1""",
        "split_targets": f"with {go} select technique_id, count(*) as support, case when count(*) >= 2 then cast(greatest(1, least(count(*) - 1, round_even(count(*)::double / 5, 0))) as int) else 0 end as target from gold group by 1",
        "split_overlap": f"with {srw} select distinct base from sq where lower(trim(split)) in ('train', 'training') and base in (select base from sq where lower(trim(split)) = 'test')",
        "id_alignment": f"with {srw}, rr as (select distinct {S.base('input_id')} base from rerank) select distinct base, 'left' as side from sq where base not in (select base from rr) union all select base, 'right' from rr where base not in (select base from sq)",
        "split_union": f"with {rec}, h as (select base, count(distinct source_position % 3) filter (where source_position % 3 < 2) n from rc group by 1) select base, case when n = 0 then 'in no part' else 'in several parts' end as problem from h where n <> 1",
        "duplicate_keys": f"with {rec} select base, source_name, count(*) as n from rc group by 1, 2 having count(*) > 1",
        "remaining_ids": f"with {srw}, {rec} select row_id, base from sq where base not in (select base from rc)",
        "onehot_to_long": "select technique_id, 'sub' as label from techniques where is_subtechnique union all select technique_id, 'revoked' from techniques where revoked union all select technique_id, 'deprecated' from techniques where deprecated",
        "source_counts": f"with {rec} select source_name, count(distinct base) as n from rc group by 1",
        "layer_edges": f"with {nd}, {ed} select input_id, src, dst, type, shared, round(ej, 6) as evidence_jaccard, round(lj, 6) as lexical_jaccard, round(score, 5) as structural_score from ed",
        "graph_stats": f"with {nd} select input_id, count(*) as n_nodes, {', '.join(f'''cast(count(*) filter (where type = '{t}') as bigint) as n_{t.lower()}''' for t in ('Precondition', 'Entry', 'VulnType', 'Behavior', 'Impact'))}, count(*) filter (where type = 'Entry') > 0 and count(*) filter (where type = 'Behavior') > 0 and count(*) filter (where type = 'Impact') > 0 as complete_core from nd group by 1",
        "support_map": f"with {nd} select input_id, evidence_id, list_sort(list(distinct node_id)) as node_ids from (select input_id, node_id, unnest(ev) evidence_id from nd) group by 1, 2",
        "dedupe_edges": f"with {nd}, {ed} select input_id, substr(src, 1, 2) as src, substr(dst, 1, 2) as dst, type, max(round(score, 5)) as score from ed group by 1, 2, 3, 4",
        "dangling_edges": f"with {nd}, {ed} select input_id, src || 'x' as src, dst, type, 'src' as missing from ed where input_id % 7 = 0",
        "simple_paths": paths + " select input_id, array_to_string(path, '>') as path, round(score_sum, 5) as score_sum, cast(shared_sum as int) as shared_sum, cast(continuous as int) as continuous from pa",
        "best_path": rank_path + " select input_id, array_to_string(path, '>') as path, array_to_string(types, '>') as types, core as core_coverage, mean_score, cover_size, round(continuous::double / hops, 9) as continuity, cast(0 as double) as explicit_ratio, case when complete then 'complete' when core > 0 then 'partial' else 'empty' end as status from po where n = 1",
        "impact_keywords": f"select doc_id, list_sort(list_filter([{imp}], lambda x: x is not null)) as impacts, coalesce(list_filter([{imp}], lambda x: x is not null)[1], 'unspecified') as impact from documents",
        "explicit_impacts": "with l as (select doc_id input_id, string_split(text, '. ') u from documents where text is not null), e as (select input_id, unnest(u) text, generate_subscripts(u, 1) ord from l), "
            "k as (select * from e where not regexp_matches(text, '(?i)" + extract.UNKNOWN_IMPACT + "')), h as (" + " union all ".join(f"select input_id, ord, {n} no, '{k}' impact from k where regexp_matches(text, '(?i){p}')" for n, (k, p) in enumerate(extract.EXPLICIT_IMPACTS)) + "), "
            "g as (select input_id, impact, list_transform(list_sort(list(ord)), lambda o: 'E' || o) evidence_ids, min({'ord': ord, 'no': no}) f from h group by 1, 2) "
            "select input_id, impact, evidence_ids, cast(row_number() over (partition by input_id order by f) as int) as ord from g",
        "vulnerability_types": "with x as (select technique_id, lower(" + squash("text") + ") t, lower(" + squash("name") + ") s from techniques), "
            "y as (select *, t || chr(10) || s b, " + snaked.format("t") + " st, " + snaked.format("s") + " ss from x) select technique_id, case "
            + " ".join(f"when regexp_matches(b, '{p}') then '{a}'" for p, (a, _), _ in extract.weakness_patterns()) + " else coalesce(nullif(st, ''), 'unspecified') end as type, case "
            + " ".join(f"when regexp_matches(b, '{p}') then " + (f"coalesce(nullif(ss, ''), '{e}')" if k == "" else f"'{k or ''}'") for p, (_, k), e in extract.weakness_patterns()) + " else ss end as subtype from y",
        "name_normalise": "select technique_id, " + snaked.format("lower(trim(name, ' '))") + " as snake, regexp_replace(trim(name, ' '), '[^A-Za-z0-9._-]+', '_', 'g') as file_name, "
            "case when length(c) > 48 then array_to_string((regexp_split_to_array(c, '[ \t\n\x0B\f\r]+'))[1:8], ' ') else c end as phrase, case when lower(trim(description, ' ')) not in ('', 'null', 'none', 'n/a') then trim(description, ' ') end as description "
            "from (select *, trim(regexp_split_to_array(trim(text, ' '), '[.;。；]')[1], ' ') c from techniques)",
        "stratified_sample": f"with {smp} select sample_id, input_id, technique_id, stratum_size, cast(sampled as bigint) as sampled, round(sampled::double / stratum_size, 6) as selection_probability, round(stratum_size::double / sampled, 6) as analysis_weight from sa",
        "reviewer_order": f"with {smp} select sample_id, cast(row_number() over (order by sha256('7' || chr(31) || 'reviewer_1' || chr(31) || sample_id), sample_id) as int) as display_order from sa",
        "confusion": f"with {rev} select d1 as first, d2 as second, count(*) as n from rv where d1 is not null and d2 is not null group by 1, 2",
        "kappa": f"""with {rev}, p as (select d1, d2 from rv where d1 is not null and d2 is not null), po as (select count(*) n, avg(cast(d1 = d2 as double)) o from p),
            pe as (select sum(a.n * b.n)::double e from (select d1 c, count(*) n from p group by 1) a join (select d2 c, count(*) n from p group by 1) b using (c))
            select n, round(o, 6) as observed, round(e / (n::double * n), 6) as expected, round((o - e / (n::double * n)) / (1 - e / (n::double * n)), 6) as kappa from po, pe""",
        "decision_rates": f"with {smp}, {fin} " + rate.format("", ""),
        "decision_rates_by_technique": f"with {smp}, {fin} " + rate.format("technique_id,", "partition by technique_id"),
        "resolved_decisions": f"with {rev} select case when d1 = d2 then 'agreement' when d3 is not null then 'adjudicated' else 'open' end as resolution, case when d1 = d2 then d1 else d3 end as final_decision, count(*) as n from rv group by 1, 2",
        "label_subsets": f"""with {go}, {fin}, j as (select g.*, decision from gold g left join de using (input_id, technique_id)),
            u as (select 'original' subset, * from j union all select 'direct_only', * from j where decision = 'directly_supported' union all select 'direct_or_inferential', * from j where decision in ('directly_supported', 'inferential_or_plausible'))
            select subset, input_id, list_sort(list(distinct technique_id)) as labels from u group by 1, 2""",
        "clean_markup": "select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\(Citation:[^)]*\\)', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as cleaned, case when length(coalesce(text, '')) > 80 then rtrim(substr(text, 1, 77), ' ') || '...' else coalesce(text, '') end as head from documents",
        "label_splitter": "select record_id, list_filter(regexp_split_to_array(array_to_string(labels, ', '), '[,;\\s]+'), lambda x: x <> '') as parts from records",
        "subset_metrics": f"""with {go}, {fin}, {ranks}, j as (select g.*, decision from gold g left join de using (input_id, technique_id)),
            u as (select 'original' subset, * from j union all select 'direct_only', * from j where decision = 'directly_supported' union all select 'direct_or_inferential', * from j where decision in ('directly_supported', 'inferential_or_plausible')),
            ng as (select subset, input_id, count(*) n_gold from u group by 1, 2),
            re as (select n.subset, k.*, n_gold, cast(u.technique_id is not null as int) rel from rk2 k join ng n using (input_id) left join u on u.subset = n.subset and u.input_id = k.input_id and u.technique_id = k.technique_id),
            rs as (select *, sum(rel) over (partition by subset, method, run, input_id order by rank) seen from re),
            pi as (select subset, method, run, input_id, max(n_gold) ngd, coalesce(1.0::double / min(rank) filter (where rel = 1), 0) mrr, {', '.join(f"coalesce(sum(rel) filter (where rank <= {k}), 0) h{k}, coalesce(sum(seen::double / rank) filter (where rank <= {k} and rel = 1), 0) / least(max(n_gold), {k}) ap_{k}" for k in (1, 5))} from rs group by 1, 2, 3, 4),
            pr as (select subset, method, run, count(*) n, avg(mrr) mrr, {', '.join(f"avg(cast(h{k} > 0 as double)) hit_{k}, avg(h{k}::double / ngd) recall_{k}, avg(ap_{k}) ap_{k}" for k in (1, 5))} from pi group by 1, 2, 3)
            select subset, method, max(n) as n_inputs, round(avg(mrr), 6) as mrr, {', '.join(f"round(avg({x}_{k}), 6) as {x}_{k}" for x in ("hit", "recall", "ap") for k in (1, 5))} from pr group by 1, 2 having max(n) >= 2""",
        "rerank_topk": f"with {ranked} select input_id, technique_id, cast(rank as int) as retrieval_rank from rk where rank <= 3 and input_id in (select input_id from rk where rank = 3)",
        "citation_caps": f"""with x as (select {S.base('input_id')} base, technique_id, mode, score_text / 20 s, retrieval_rank r from rerank),
            y as (select *, case when mode <> 'generic' and r % 2 <> 0 and s > 0.25 then 0.25 else s end f from x),
            z as (select *, case when mode in ('structure', 'full') and r % 3 > 0 and r % 4 <> 0 and f >= 0.55 then 0.54 else f end c from y)
            select base, technique_id, round(c, 6) as capped from z where c is not null and not isnan(c)""",
        "contract_labels": """with x as (select 'no labels' problem, record_id from records where coalesce(len(labels), 0) <= 0 union all select 'invalid label', record_id from records where len(list_filter(labels, lambda x: not regexp_full_match(coalesce(x, ''), 'T[0-9]{4}(\\.[0-9]{3})?'))) > 0
            union all select 'not sorted and distinct', record_id from records where labels is not null and labels <> list_sort(list_distinct(labels))) select problem, count(*) as n, count(distinct record_id) as inputs from x group by 1""",
        "contract_catalogue": """with off as (select *, coalesce(revoked, false) or coalesce(deprecated, false) x from techniques), pr as (
            select 'no name' problem, technique_id from off where trim(coalesce(name, '')) = '' union all select 'no description', technique_id from off where trim(coalesce(description, '')) = ''
            union all select 'malformed technique id', technique_id from off where not coalesce(regexp_full_match(technique_id, 'T[0-9]{4}(\\.[0-9]{3})?'), false)
            union all select 'parent not active', technique_id from off where not x and coalesce(is_subtechnique, false) and coalesce(parent_technique_id, split_part(technique_id, '.', 1)) not in (select technique_id from off where not x)
            union all select 'repeated technique id', technique_id from off group by technique_id having count(*) > 1) select problem, count(*) as n, count(distinct technique_id) as inputs from pr group by 1""",
        "contract_support": f"with {nd} select 'evidence without supporting edge' as problem, cast(sum(len(ev)) as bigint) as n, count(distinct input_id) as inputs from nd where type = 'Impact'",
        "contract_counts": f"with {nd}, {ed}, a as (select input_id, count(*) filter (where type = 'Impact') % 2 o from nd group by 1), b as (select distinct input_id from ed) select 'node count differs' as problem, count(*) as n, count(distinct input_id) as inputs from a where o = 1 union all select 'edge count differs', count(*), count(*) from b",
        "trace_edges": f"with {nd} select input_id, 'CVE::' || input_id as src, node_id as dst, 'mentions' as type from nd where type = 'Impact' union all select input_id, node_id, 'EVIDENCE::' || unnest(ev), 'supported_by' from nd where type = 'Impact'",
        "sentence_maps": """with s0 as (select * from sentences qualify row_number() over (partition by input_id) = 1), e as (select input_id, unnest(map_entries(sentences)) e from s0 where sentences is not null),
            f as (select input_id, upper(trim(e.key)) id, trim(coalesce(e.value, '')) t from e), g as (select *, regexp_full_match(id, 'E[1-9][0-9]*') ok from f),
            h as (select input_id, count(*) n, count(*) filter (where not ok) bad, count(*) filter (where ok and t = '') blank, count(*) filter (where ok and t <> '') good, count(distinct id) filter (where ok and t <> '') once, max(cast(substr(id, 2) as int)) filter (where ok and t <> '') top from g group by 1)
            select s0.input_id, cast(coalesce(once, 0) as int) as n, coalesce(top, 0) = coalesce(once, 0) as contiguous, list_filter([case when n is null then 'no sentences' end, case when bad > 0 then 'malformed evidence id' end, case when blank > 0 then 'blank sentence' end, case when once < good then 'repeated evidence id' end], lambda x: x is not null) as problems from s0 left join h using (input_id)""",
        "contract_edges": f"""with {nd}, {ed}, n2 as (select * from nd where node_id <> 'N3'), x as (select ed.input_id, case when src = 'N3' then 'dangling source' end a, case when dst = 'N3' then 'dangling target' end b from ed), y as (select input_id, a problem from x where a is not null union all select input_id, b from x where b is not null)
            select problem, count(*) as n, count(distinct input_id) as inputs from y group by 1""",
        "event_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
        "event_props": "select event_id, cast(len(json_keys(props)) as int) as n_keys from events",
        "token_jaccard": f"select technique_id, round({jac.format(toks.format('name'), toks.format('''coalesce(text, '')'''))}, 6) as overlap from techniques",
    }
