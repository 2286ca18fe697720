"""The minimal explanatory path of a record as a table row, and the query text made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: The words that link two nodes of a path in a query text.
LINK_WORDS = {"enables": "enables", "characterized_by": "characterized by", "causes": "causes"}


def explanations(nodes: DataFrame, edges: DataFrame, max_nodes: int = 4, exact_limit: int = 20) -> DataFrame:
    """One row per record with a path that covers any core type.

    Status, chain and types, the precondition that leads into it, all evidence of its nodes, the least evidence that covers them (with
    the precondition), the compact text, what the path was chosen by, and a signature. A chain of one node is a partial result.
    """
    return _rows(graph.records(nodes, edges, "text"), max_nodes, exact_limit)


def layered_explanations(nodes: DataFrame, max_nodes: int = 4, exact_limit: int = 20) -> DataFrame:
    """``explanations`` of nodes and their layer edges, with one shuffle of the nodes and none of edges or paths."""
    return _rows(graph.layered_records(nodes, "text"), max_nodes, exact_limit)


def _rows(records: DataFrame, max_nodes: int, exact_limit: int) -> DataFrame:
    best = graph.explained(records, max_nodes, exact_limit)
    number = lambda e: F.regexp_extract(e, r"(\d+)$", 1).try_cast("int")
    ids = F.transform(F.array_sort(F.transform(F.array_distinct(F.flatten("said")), lambda e, i: F.struct(number(e).alias("k"), i.alias("i"), e.alias("e")))), lambda s: s.e)
    objective = F.struct("complete", "core_coverage", "continuity", "mean_shared", "explicit_ratio", "mean_score", "mean_confidence", F.size("path").alias("n_nodes"), "cover_size", "n_paths")
    row = best.select(
        "input_id", graph.status(F.col("complete"), F.col("core_coverage")).alias("status"), F.col("path").alias("chain"), F.col("types").alias("chain_types"), "texts", "precondition",
        "precondition_text", ids.alias("evidence_ids"), objective.alias("objective"), "minimum_evidence",
    )
    part = F.array_join(F.zip_with("chain_types", "texts", lambda t, x: F.concat(t, F.lit(": "), x)), " -> ")
    compact = F.concat(F.coalesce(F.concat(F.lit("Precondition: "), "precondition_text", F.lit(" -> ")), F.lit("")), part)
    out = row.withColumn("compact_text", compact)
    signed = F.concat_ws("|", F.coalesce("precondition", F.lit("")), F.array_join("chain", ","), F.array_join("evidence_ids", ","), "compact_text")
    return out.withColumn("signature", F.sha2(signed, 256))


def query_text(explained: DataFrame, edges: DataFrame) -> DataFrame:
    """(input_id, text): the chain's texts with the words of the link between neighbours."""
    e = edges.groupBy("input_id", "src", "dst").agg(F.min("type").alias("type"))
    step = explained.select("input_id", F.posexplode(F.arrays_zip("chain", "chain_types", "texts")).alias("pos", "s"), "chain").select("input_id", "pos", F.col("s.chain").alias("dst"), F.concat(F.lower("s.chain_types"), F.lit(" "), "s.texts").alias("t"), F.when(F.col("pos") > 0, F.get("chain", F.col("pos") - 1)).alias("src"))
    j = step.join(e, ["input_id", "src", "dst"], "left")
    return j.groupBy("input_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(" ", _words(F.col("type")), "t").alias("t")))), lambda s: s.t), " ").alias("text"))


def layered_query_text(explained: DataFrame) -> DataFrame:
    """``query_text`` of explanations whose edges are the layer edges: the types of neighbours tell their link."""
    types = F.col("chain_types")
    step = lambda t, i: F.concat_ws(" ", F.when(i > 0, _words(graph.layer_rule(F.get(types, i - 1), t))), F.concat(F.lower(t), F.lit(" "), F.get("texts", i)))
    return explained.select("input_id", F.array_join(F.transform(types, step), " ").alias("text"))


def _words(link: Column) -> Column:
    return F.coalesce(*[F.when(link == k, F.lit(v)) for k, v in LINK_WORDS.items()])
