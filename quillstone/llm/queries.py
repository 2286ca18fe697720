"""Queries of the training-data operators: problem N's are named pN_..."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table as t
from . import annotators, bytepair, leakage, mixture, rankfusion, sentences, spans, splits, survivorship


def queries():
    return {
        "p1_found": lambda s, d: survivorship.dominant_contents(t(s, d, "records"), t(s, d, "source_specs")),
        "p1_survivors": lambda s, d: survivorship.merged_records(t(s, d, "records"), t(s, d, "source_specs")),
        "p2_found": lambda s, d: rankfusion.unanimous_winners(t(s, d, "rerank")),
        "p2_ranking": lambda s, d: rankfusion.fused_ranking(rankfusion.latest_candidates(t(s, d, "rerank"))).select("input_id", "technique_id", F.round("stationary", 9).alias("stationary"), "fused_rank"),
        "p3_found": lambda s, d: sentences.segment(t(s, d, "sentences")).select("input_id", "sent_start", "sent_end"),
        "p3_units": lambda s, d: sentences.units(t(s, d, "sentences")),
        "p4_found": lambda s, d: annotators.clear_majorities(t(s, d, "audit_reviews")),
        "p4_consensus": lambda s, d: annotators.consensus(t(s, d, "audit_reviews")).where("is_consensus").select("sample_id", "decision", "votes", "n_votes", F.round("posterior", 6).alias("posterior")),
        "p4_reliability": lambda s, d: annotators.reliability(t(s, d, "audit_reviews")),
        "p4_agreement": lambda s, d: annotators.krippendorff(t(s, d, "audit_reviews")).withColumn("alpha", F.round("alpha", 9)),
        "p5_found": lambda s, d: leakage.overlapping_pairs(t(s, d, "source_rows"), t(s, d, "records")),
        "p5_report": lambda s, d: leakage.report(t(s, d, "source_rows"), t(s, d, "records")),
        "p6_found": lambda s, d: splits.linked_rows(t(s, d, "source_rows")),
        "p6_split": lambda s, d: splits.allocate(t(s, d, "source_rows")),
        "p6_shares": lambda s, d: splits.reached(t(s, d, "source_rows")).select("assigned_split", "wanted_rows", "n_rows", "n_parted"),
        "p6_balance": lambda s, d: splits.reached(t(s, d, "source_rows")),
        "p7_ids": lambda s, d: bytepair.encode_texts(t(s, d, "documents").select("doc_id", "text")),
        "p8_found": lambda s, d: mixture.short_sources(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p8_report": lambda s, d: mixture.report(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p8_mixture": lambda s, d: mixture.mixture(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_found": lambda s, d: spans.sharing_pairs(t(s, d, "documents")),
        "p9_spans": lambda s, d: spans.shared_spans(t(s, d, "documents")),
        "p9_amount": lambda s, d: spans.shared_amount(t(s, d, "documents")),
        "p9_lines": lambda s, d: spans.unit_dedup(t(s, d, "documents")),
    }
