"""Reranking of retrieved candidates by an external scorer: prompts, response parsing with citation caps, fusion, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncated

MODES = ("full", "structure", "evidence", "generic")


def top_candidates(ranked: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """The first k distinct candidates of every input; with ``exact``, only inputs that have k."""
    best = ranked.groupBy("input_id", "technique_id").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy("input_id").orderBy("_r", "technique_id")
    top = best.withColumn("retrieval_rank", F.row_number().over(w)).where(F.col("retrieval_rank") <= k).drop("_r")
    if exact:
        top = top.join(top.groupBy("input_id").agg(F.count("*").alias("_n")).where(F.col("_n") == k), "input_id").drop("_n")
    return top


def capped(score: Column, mode: Column, cites_evidence: Column, cites_path: Column, has_path: Column, citation: float = 0.25, strong: float = 0.55) -> Column:
    """Scores after the citation rules.

    Without any valid citation a score is at most ``citation`` (all modes but generic). A strong score stays just below ``strong``
    in the modes that show the path (structure, full) if the path has evidence and none of it is cited.
    """
    first = F.when((mode != "generic") & ~cites_evidence & (score > citation), citation).otherwise(score)
    return F.when(mode.isin("structure", "full") & has_path & ~cites_path & (first >= strong), strong - 0.01).otherwise(first)


def parse_response(raw: Column) -> Column:
    """A response ``{id: {llm_score, reason, evidence_ids}}`` as a map; null if it is no such object."""
    return F.from_json(raw, "map<string, struct<llm_score: double, reason: string, evidence_ids: array<string>>>")


def merge_scores(candidates: DataFrame, scores: DataFrame, beta: float, digits: int = 12) -> DataFrame:
    """Candidates (input_id, technique_id, retrieval_rank, retrieval_score) with the scorer's value (0 if missing), fused and ranked."""
    j = candidates.join(scores.select("input_id", "technique_id", "llm_score"), ["input_id", "technique_id"], "left").withColumn("llm_score", F.bround(F.coalesce(F.nanvl("llm_score", F.lit(0.0)), F.lit(0.0)), digits))
    j = j.withColumn("final_score", F.bround(beta * F.col("retrieval_score") + (1 - beta) * F.col("llm_score"), digits))
    w = Window.partitionBy("input_id").orderBy(F.desc("final_score"), F.desc("llm_score"), F.desc("retrieval_score"), "retrieval_rank", "technique_id")
    return j.withColumn("rerank_rank", F.row_number().over(w))


def evaluator_order(candidates: DataFrame) -> DataFrame:
    """Both orders of a run as the evaluator rebuilds them: by rerank rank where any is given (missing ones last), else by scores."""
    per = Window.partitionBy("input_id")
    given = F.max("rerank_rank").over(per).isNotNull()
    at = F.coalesce(F.nullif("retrieval_rank", F.lit(0)), F.nullif("position", F.lit(0)))
    first = F.when(given, F.coalesce(F.nullif("rerank_rank", F.lit(0)), F.lit(10**9)).cast("double")).otherwise(-F.col("final_score"))
    c = candidates.withColumn("_at", at).withColumn("_first", first)
    return c.withColumn("rank", F.row_number().over(per.orderBy("_first", F.desc("final_score"), F.desc("llm_score"), "_at", "technique_id"))).withColumn("retrieval_order", F.row_number().over(per.orderBy("_at", F.desc("retrieval_score"), "technique_id"))).drop("_at", "_first")


def prompts(candidates: DataFrame, evidence: DataFrame, catalogue: DataFrame, mode: str = "full", text_chars: int = 600) -> DataFrame:
    """(input_id, mode, prompt, prompt_sha256): evidence in order, then the candidates in retrieval order."""
    ev = evidence.groupBy("input_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "evidence_id", "text"))), lambda x: F.concat(F.lit("["), x.evidence_id, F.lit("] "), x.text)), "\n").alias("e"))  # one record's units
    t = catalogue.select("technique_id", F.coalesce("name", F.lit("")).alias("_n"), truncated(F.coalesce("text", F.lit("")), text_chars).alias("_t"))
    c = candidates.join(t, "technique_id").groupBy("input_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("retrieval_rank", "technique_id", "_n", "_t"))), lambda x: F.concat_ws(" | ", x.technique_id, x["_n"], x["_t"])), "\n").alias("c"))  # k candidates
    shown = F.lit("") if mode == "generic" else F.coalesce("e", F.lit(""))
    p = c.join(ev, "input_id", "left").select("input_id", F.lit(mode).alias("mode"), F.concat_ws("\n\n", F.lit(f"mode: {mode}"), shown, F.col("c")).alias("prompt"))
    return p.withColumn("prompt_sha256", F.sha2("prompt", 256))


def replay(prompted: DataFrame, responses: DataFrame) -> DataFrame:
    """(input_id, technique_id, llm_score, reason, evidence_ids) from recorded responses, found by mode and prompt hash."""
    j = prompted.join(responses, ["mode", "prompt_sha256"]).select("input_id", F.explode(parse_response(F.col("response"))).alias("technique_id", "r"))
    return j.select("input_id", "technique_id", "r.llm_score", "r.reason", "r.evidence_ids")
