"""Reports over rankings and coverage: long tables made of the metric operators."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import hit_bucket
from . import audit, metrics, significance

#: Where the first hit can stand.
BUCKETS = ("1", "2-3", "4-5", "6-10", "11-20", ">20", "miss")


def first_hit_shares(samples: DataFrame) -> DataFrame:
    """(method, bucket, share): the part of inputs by where the first hit stands, runs weighted equally, buckets without any at 0."""
    per = samples.groupBy("method", "run").agg(*[F.avg((hit_bucket(F.col("first_hit")) == b).cast("double")).alias(f"b{k}") for k, b in enumerate(BUCKETS)])
    mean = per.groupBy("method").agg(*[F.avg(f"b{k}").alias(f"b{k}") for k in range(len(BUCKETS))])
    return mean.select("method", F.inline(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"b{k}").alias("share")) for k, b in enumerate(BUCKETS)])))


def summary(samples: DataFrame, technique_rows: DataFrame, reference: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(method, averaging, metric, estimate, run_sd, n_inputs, delta): per input, per label and per technique, with the difference to a reference method."""
    names = ["mrr", *[f"{m}_{k}" for m in ("hit", "precision", "recall", "ap") for k in ks]]
    a = metrics.macro(samples, *names).select("method", F.lit("input").alias("averaging"), "metric", "estimate", F.col("sd_runs").alias("run_sd"), "n_inputs")
    m = metrics.micro(samples, ks)
    of = [f"micro_{x}_{k}" for x in ("precision", "recall") for k in ks]
    none = F.lit(None).cast("double")
    b = m.select("method", F.inline(F.array(*[F.struct(F.lit("label").alias("averaging"), F.lit(c).alias("metric"), F.col(c).alias("estimate")) for c in of])))
    t = technique_rows.groupBy("method").agg(F.avg("recall").alias("estimate")).select("method", F.lit("technique").alias("averaging"), F.lit("technique_recall").alias("metric"), "estimate")
    n = a.groupBy("method").agg(F.max("n_inputs").alias("n_inputs"))
    more = b.unionByName(t).join(n, "method").select("method", "averaging", "metric", "estimate", none.alias("run_sd"), "n_inputs")
    rows = a.unionByName(more)
    base = F.max(F.when(F.col("method") == reference, F.col("estimate"))).over(Window.partitionBy("averaging", "metric"))
    return rows.withColumn("delta", F.col("estimate") - base)


def with_intervals(samples: DataFrame, names: list[str], repetitions: int = 5000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(method, metric, n_inputs, estimate, sd_inputs, n_runs, sd_runs, low, high): the macro table with bootstrap intervals."""
    over = metrics.over_runs(samples, *names)
    ci = [significance.bootstrap(over, m, repetitions, confidence, seed).select("method", F.lit(m).alias("metric"), "low", "high") for m in names]
    return metrics.macro(samples, *names).join(functools.reduce(DataFrame.unionAll, ci), ["method", "metric"])


def retrieval_baseline(rankings: DataFrame, retrieval: DataFrame, name: str) -> DataFrame:
    """The rankings and, as one more method with one run, the order in which candidates were retrieved."""
    first = retrieval.where("run = 1").select(F.lit(name).alias("method"), "run", "input_id", "technique_id", "rank")
    return rankings.select("method", "run", "input_id", "technique_id", "rank").unionByName(first)


def evaluation_ids(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """Inputs that have gold and a ranking in every run: the intersection policy."""
    runs = rankings.select("method", "run").distinct().agg(F.count("*").alias("n")).scalar()
    per = rankings.select("method", "run", "input_id").distinct().groupBy("input_id").agg(F.count("*").alias("n"))
    return per.where(F.col("n") == runs).select("input_id").join(gold.select("input_id").distinct(), "input_id", "left_semi")


def strict_id_problems(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """(input_id, problem): inputs that some run lacks, and evaluated inputs without gold: what the strict policy refuses."""
    runs = rankings.select("method", "run").distinct().agg(F.count("*").alias("n")).scalar()
    per = rankings.select("method", "run", "input_id").distinct().groupBy("input_id").agg(F.count("*").alias("n"))
    g = gold.select("input_id", F.lit(True).alias("_g")).distinct()
    j = per.join(g, "input_id", "left")
    found = F.array_compact(F.array(F.when(F.col("n") < runs, "missing in a run"), F.when(F.col("_g").isNull(), "no gold")))
    return j.select("input_id", F.explode(found).alias("problem"))


def both_views(gold: DataFrame, rankings: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold and rankings under (view, input_id, ...): exact ids, and their parents with each parent at its best rank."""
    ids = gold.select("technique_id").unionByName(rankings.select("technique_id"))
    up = audit.technique_parent(catalogue, ids)
    g, r = gold.join(up, "technique_id"), rankings.join(up, "technique_id")
    view = lambda df, name: df.select(F.lit(name).alias("view"), "*")
    golds = view(gold.select("input_id", "technique_id"), "exact").unionByName(view(g.select("input_id", F.col("parent_id").alias("technique_id")).distinct(), "parent"))
    best = r.groupBy("input_id", F.col("parent_id").alias("technique_id")).agg(F.min("rank").alias("_r"))
    w = Window.partitionBy("input_id").orderBy("_r")
    parents = best.withColumn("rank", F.row_number().over(w)).drop("_r")
    return golds, view(rankings.select("input_id", "technique_id", "rank"), "exact").unionByName(view(parents, "parent"))


def coverage_by_view(gold: DataFrame, rankings: DataFrame, records: DataFrame, catalogue: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(view, input_id, k, first_hit, status) for exact and parent ids. ``records``: inputs that have a candidate record, if an empty one."""
    golds, ranks = both_views(gold, rankings, catalogue)
    active = catalogue.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False))).select("technique_id").distinct()
    key = F.struct("view", "input_id")
    tag = lambda df: df.withColumn("input_id", key).drop("view")
    views = F.explode(F.array(F.lit("exact"), F.lit("parent"))).alias("view")
    held = records.select("input_id").distinct().select(views, "input_id")
    s = audit.coverage_status(tag(golds), tag(ranks), active, ks, tag(held))
    return s.select("input_id.view", "input_id.input_id", "k", "first_hit", "status")


def technique_coverage(gold: DataFrame, rankings: DataFrame, catalogue: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per gold technique: its inputs, and in how many it, or its parent, is among the first k."""
    up = audit.technique_parent(catalogue, gold.select("technique_id").unionByName(rankings.select("technique_id")))
    _, ranks = both_views(gold, rankings, catalogue)
    g = gold.select("input_id", "technique_id").distinct().join(up, "technique_id")
    e = ranks.where("view = 'exact'").select("input_id", "technique_id", F.col("rank").alias("e"))
    p = ranks.where("view = 'parent'").select("input_id", F.col("technique_id").alias("parent_id"), F.col("rank").alias("p"))
    j = g.join(e, ["input_id", "technique_id"], "left").join(p, ["input_id", "parent_id"], "left")
    n = lambda c, k: F.sum(F.coalesce((F.col(c) <= k).cast("int"), F.lit(0)))
    return j.groupBy("technique_id", "parent_id").agg(F.count("*").alias("support"), *[n("e", k).alias(f"exact_{k}") for k in ks], *[n("p", k).alias(f"parent_{k}") for k in ks])
