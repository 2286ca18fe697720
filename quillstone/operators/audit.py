"""Label audits: stratified samples, reviewer order, agreement, weighted rates, label subsets, gold and candidate coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The decisions of the audit, and which of them each label subset keeps.
DECISIONS = ("directly_supported", "inferential_or_plausible", "insufficient_text", "unsupported")
SUBSETS = {"original": DECISIONS, "direct_only": DECISIONS[:1], "direct_or_inferential": DECISIONS[:2]}


def stable_hash(seed: int, *parts: Column) -> Column:
    """SHA-256 of the seed and parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def stratified_sample(pairs: DataFrame, per_stratum: int, seed: int, stratum: str = "technique_id", key: str = "input_id") -> DataFrame:
    """At most ``per_stratum`` pairs of each stratum by hash order, with sample id, the stratum's sizes, probability and weight."""
    h = stable_hash(seed, F.col(key), F.col(stratum))
    size = pairs.groupBy(stratum).agg(F.count("*").alias("stratum_size"))
    w = Window.partitionBy(stratum).orderBy("_h", key)
    s = pairs.withColumn("_h", h).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_stratum).join(size, stratum)
    n = F.least("stratum_size", F.lit(per_stratum))
    return s.select(F.concat(F.lit("LSA-"), F.upper(F.substring("_h", 1, 12))).alias("sample_id"), key, stratum, "stratum_size", n.alias("sampled"), (n / F.col("stratum_size")).alias("selection_probability"), (F.col("stratum_size") / n).alias("analysis_weight"))


def display_order(sample: DataFrame, reviewer: str, seed: int) -> DataFrame:
    """The order in which a reviewer sees the samples: by hash (a drawn sample, so one window is enough)."""
    return sample.withColumn("display_order", F.row_number().over(Window.orderBy(stable_hash(seed, F.lit(reviewer), F.col("sample_id")), "sample_id")))


def clean_enum(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(first, second, n) for pairs of decisions of two reviewers."""
    return pairs.groupBy(F.col(a).alias("first"), F.col(b).alias("second")).agg(F.count("*").alias("n"))


def kappa(matrix: DataFrame) -> DataFrame:
    """Cohen's kappa of a confusion matrix: one row; null where chance agreement is complete."""
    total = matrix.groupBy().agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first") == F.col("second"), F.col("n")).otherwise(0)).alias("same"))
    rows = matrix.groupBy(F.col("first").alias("c")).agg(F.sum("n").alias("r"))
    cols = matrix.groupBy(F.col("second").alias("c")).agg(F.sum("n").alias("s"))
    by_chance = rows.join(cols, "c").agg(F.coalesce(F.sum(F.col("r") * F.col("s")), F.lit(0)).alias("rs"))
    po, pe = F.col("same") / F.col("n"), F.col("rs") / (F.col("n") * F.col("n"))
    return total.withColumn("rs", by_chance.scalar()).select("n", po.alias("observed"), pe.alias("expected"), F.when(1 - pe >= 1e-15, (po - pe) / (1 - pe)).alias("kappa"))


def resolved(df: DataFrame) -> DataFrame:
    """The final decision: what both reviewers agree on, else the adjudicator's."""
    both = F.when(F.col("d1") == F.col("d2"), F.col("d1"))
    return df.withColumn("final_decision", F.coalesce(both, F.col("d3"))).withColumn("resolution", F.when(both.isNotNull(), "agreement").when(F.col("d3").isNotNull(), "adjudicated").otherwise("open"))


def decision_rates(df: DataFrame, decision: str, weight: str, *by: str) -> DataFrame:
    """Raw and weighted share of each decision, per group."""
    per = df.where(F.col(decision).isNotNull()).groupBy(*by, decision).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    g = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return per.select(*by, F.col(decision).alias("decision"), "n", (F.col("n") / F.sum("n").over(g)).alias("raw_rate"), (F.col("w") / F.sum("w").over(g)).alias("weighted_rate"))


def label_subsets(gold: DataFrame, decisions: DataFrame) -> DataFrame:
    """(subset, input_id, labels) for the label subsets by audit decision; unaudited pairs are in the original only."""
    d = gold.join(decisions, ["input_id", "technique_id"], "left")
    keep = F.array_compact(F.array(F.lit("original"), *[F.when(F.col("decision").isin(*v), F.lit(k)) for k, v in SUBSETS.items() if k != "original"]))
    return d.select(F.explode(keep).alias("subset"), "input_id", "technique_id").groupBy("subset", "input_id").agg(F.array_sort(F.collect_set("technique_id")).alias("labels"))


def gold_index_status(gold: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Whether each gold technique is in the index, and why not: malformed, revoked, deprecated, only its parent, or missing."""
    c = catalogue.select(F.col("technique_id").alias("_id"), "revoked", "deprecated")
    active = catalogue.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False))).select(F.col("technique_id").alias("_parent")).distinct()
    g = gold.select("technique_id").distinct().withColumn("_up", F.element_at(F.split("technique_id", r"\."), 1))
    j = g.join(c, g.technique_id == c._id, "left").join(active, g._up == active._parent, "left")
    s = (
        F.when(~F.col("technique_id").rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"), "malformed").when(F.col("_id").isNotNull() & F.coalesce("revoked", F.lit(False)), "revoked")
        .when(F.col("_id").isNotNull() & F.coalesce("deprecated", F.lit(False)), "deprecated").when(F.col("_id").isNotNull(), "indexed")
        .when(F.col("_parent").isNotNull(), "parent_only").otherwise("missing")
    )
    return j.select("technique_id", s.alias("status"))


def coverage_status(gold: DataFrame, rankings: DataFrame, indexed: DataFrame, ks: tuple[int, ...], records: DataFrame | None = None) -> DataFrame:
    """(input_id, k, first_hit, status) for every input with gold, in order of precedence.

    No gold in the index, no candidate record, an empty list of candidates, absent, covered, beyond k. ``records``: the inputs that have a
    candidate record; by default those with a candidate.
    """
    g = gold.join(indexed.select("technique_id", F.lit(1).alias("_in")), "technique_id", "left")
    per = g.groupBy("input_id").agg(F.max(F.coalesce("_in", F.lit(0))).alias("any_indexed"))
    n = rankings.groupBy("input_id").agg(F.count("*").alias("n_candidates"))
    held = (rankings if records is None else records).select("input_id").distinct().withColumn("_held", F.lit(True))
    first = rankings.join(gold, ["input_id", "technique_id"], "left_semi").groupBy("input_id").agg(F.min("rank").alias("first_hit"))
    j = per.join(n, "input_id", "left").join(held, "input_id", "left").join(first, "input_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    s = (
        F.when(F.col("any_indexed") == 0, "gold_not_indexed").when(F.col("_held").isNull(), "no_candidates").when(F.col("n_candidates").isNull(), "no_candidate_in_list")
        .when(F.col("first_hit").isNull(), "absent").when(F.col("first_hit") <= F.col("k"), "covered").otherwise("beyond_k")
    )
    return j.select("input_id", "k", "first_hit", s.alias("status"))


def technique_parent(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    """The parent of each id: that of the index, else its own prefix if that is active, else itself."""
    c = catalogue.select(F.col("technique_id").alias("_i"), "parent_technique_id")
    active = catalogue.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False))).select(F.col("technique_id").alias("_p")).distinct()
    j = ids.select("technique_id").distinct().withColumn("_up", F.element_at(F.split("technique_id", r"\."), 1))
    j = j.join(c, j.technique_id == c._i, "left").join(active, j._up == active._p, "left")
    return j.select("technique_id", F.coalesce("parent_technique_id", "_p", "technique_id").alias("parent_id"))
