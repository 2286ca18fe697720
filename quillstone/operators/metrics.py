"""Ranking metrics. Rankings are long tables (method, run, input_id, technique_id, rank); gold is (input_id, technique_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import hit_bucket, support_bucket

RUN = ["method", "run"]


def keep_first(rankings: DataFrame) -> DataFrame:
    """One row per technique of a ranking, at its best rank, with ranks renumbered."""
    best = rankings.groupBy(*RUN, "input_id", "technique_id").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy(*RUN, "input_id").orderBy("_r", "technique_id")
    return best.withColumn("rank", F.row_number().over(w)).drop("_r")


def relevance(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """Rankings of inputs that have gold, with ``rel`` (0 or 1), relevant so far, and the size of the gold set."""
    g = gold.select("input_id", "technique_id").distinct()
    size = g.groupBy("input_id").agg(F.count("*").alias("n_gold"))
    r = rankings.join(size, "input_id").join(g.withColumn("_g", F.lit(1)), ["input_id", "technique_id"], "left").withColumn("rel", F.coalesce("_g", F.lit(0))).drop("_g")
    w = Window.partitionBy(*RUN, "input_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.withColumn("seen", F.sum("rel").over(w))


def per_input(rel: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per ranking: hit, precision, recall and average precision at every k, and the reciprocal rank of the first hit."""
    aggs = [F.max("n_gold").alias("n_gold"), F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit")]
    for k in ks:
        at = F.col("rank") <= k
        hits = F.sum(F.when(at, F.col("rel")).otherwise(0))
        aggs += [hits.alias(f"hits_{k}"), F.sum(F.when(at & (F.col("rel") == 1), F.col("seen") / F.col("rank")).otherwise(0.0)).alias(f"_ap_{k}")]
    g = rel.groupBy(*RUN, "input_id").agg(*aggs)
    out = ["method", "run", "input_id", "n_gold", "mrr", "first_hit"]
    for k in ks:
        h = F.col(f"hits_{k}")
        out += [h.alias(f"hits_{k}"), (h > 0).cast("double").alias(f"hit_{k}"), (h / k).alias(f"precision_{k}"), (h / F.col("n_gold")).alias(f"recall_{k}"), (F.col(f"_ap_{k}") / F.least("n_gold", F.lit(k))).alias(f"ap_{k}")]
    return g.select(*out)


def per_input_sweep(rankings: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5,)) -> DataFrame:
    """The variant of the retrieval sweep at every k: precision over the list's length and average precision over the gold's size.

    A ranking is reduced to its length and the ranks of its hits where its rows stand, so long lists cost no shuffle; ranks are 1..n.
    """
    g = gold.select("input_id", "technique_id").distinct()
    size = g.groupBy("input_id").agg(F.count("*").alias("n_gold"))
    j = rankings.join(g.withColumn("_g", F.lit(True)), ["input_id", "technique_id"], "left")
    lists = j.groupBy(*RUN, "input_id").agg(F.max("rank").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_g"), F.col("rank")))).alias("hits"))  # at most the gold of one input
    r = lists.join(size, "input_id")

    def at(k: int) -> list[Column]:
        hits = F.filter("hits", lambda x: x <= k)
        h = F.size(hits)
        gained = F.aggregate(F.transform(hits, lambda x, i: (i + 1) / x), F.lit(0.0), lambda a, x: a + x)
        values = {"coverage": (h > 0).cast("double"), "macro_recall": h / F.col("n_gold"), "precision": h / F.least("n", F.lit(k)), "map": gained / F.col("n_gold"), "mrr": F.coalesce(1 / F.try_element_at(hits, F.lit(1)), F.lit(0.0))}
        return [c.alias(f"{name}_{k}") for name, c in values.items()]

    return r.select(*RUN, "input_id", *[c for k in ks for c in at(k)])


def over_runs(samples: DataFrame, *metrics: str) -> DataFrame:
    """Mean over a method's runs per input."""
    return samples.groupBy("method", "input_id").agg(*[F.avg(m).alias(m) for m in metrics])


def macro(samples: DataFrame, *metrics: str) -> DataFrame:
    """Per method and metric: mean over inputs of the mean over runs, its sample deviation, and the deviation of the runs' means (0 for one)."""
    per_run = samples.groupBy(*RUN).agg(*[F.avg(m).alias(m) for m in metrics])
    long = lambda df, *key: df.select(*key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    a = long(over_runs(samples, *metrics), "method", "input_id").groupBy("method", "metric").agg(F.count("*").alias("n_inputs"), F.avg("v").alias("estimate"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd_inputs"))
    b = long(per_run, "method", "run").groupBy("method", "metric").agg(F.count("*").alias("n_runs"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd_runs"))
    return a.join(b, ["method", "metric"])


def micro(samples: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per method: micro precision and recall at every k over all runs."""
    n, g = F.count("*"), F.sum("n_gold")
    return samples.groupBy("method").agg(*[x for k in ks for x in ((F.sum(f"hits_{k}") / (n * k)).alias(f"micro_precision_{k}"), (F.sum(f"hits_{k}") / g).alias(f"micro_recall_{k}"))])


def coverage(samples: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per method: the part of inputs with a hit within k, and anywhere."""
    return samples.groupBy("method").agg(*[F.avg((F.coalesce("first_hit", F.lit(10**9)) <= k).cast("double")).alias(f"coverage_{k}") for k in ks], F.avg(F.col("first_hit").isNotNull().cast("double")).alias("coverage_all"))


def first_hits(samples: DataFrame) -> DataFrame:
    """Per method and run: the part of inputs by where the first hit stands."""
    n = Window.partitionBy("method", "run")
    per = samples.withColumn("bucket", hit_bucket(F.col("first_hit"))).groupBy(*RUN, "bucket").agg(F.count("*").alias("n"))
    return per.select(*RUN, "bucket", "n", (F.col("n") / F.sum("n").over(n)).alias("share"))


def per_technique(rel: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per method and technique: support, and recall at k over the runs with the runs' deviation."""
    support = gold.select("input_id", "technique_id").distinct().groupBy("technique_id").agg(F.count("*").alias("support"))
    runs = rel.agg(F.collect_set(F.struct(*RUN)).alias("x"))  # one row: the runs of a report
    hit = rel.where((F.col("rel") == 1) & (F.col("rank") <= k)).groupBy(*RUN, "technique_id").agg(F.count("*").alias("h"))
    pairs = support.select("technique_id", "support", F.inline(runs.scalar()))  # runs x catalogue
    r = pairs.join(hit, [*RUN, "technique_id"], "left").withColumn("recall", F.coalesce("h", F.lit(0)) / F.col("support"))
    return r.groupBy("method", "technique_id").agg(F.max("support").alias("support"), F.avg("recall").alias("recall"), F.coalesce(F.stddev_samp("recall"), F.lit(0.0)).alias("sd_runs"))


def long_tail(technique_rows: DataFrame) -> DataFrame:
    """Per method and support bucket: techniques, support and mean recall."""
    return technique_rows.withColumn("bucket", support_bucket(F.col("support"))).groupBy("method", "bucket").agg(F.count("*").alias("techniques"), F.sum("support").alias("support"), F.avg("recall").alias("macro_recall"))


def signatures(rankings: DataFrame) -> DataFrame:
    """Per ranking: a hash of its order and one of its set (the candidates of one input)."""
    g = rankings.groupBy(*RUN, "input_id").agg(F.sort_array(F.collect_list(F.struct("rank", "technique_id"))).alias("x"))
    ids = F.transform("x", lambda s: s.technique_id)
    return g.select(*RUN, "input_id", F.sha2(F.array_join(ids, ","), 256).alias("order_hash"), F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("set_hash"))


def unfair_inputs(sigs: DataFrame) -> DataFrame:
    """Inputs whose candidate set differs between rankings."""
    return sigs.groupBy("input_id").agg(F.count("*").alias("rankings"), F.count_distinct("set_hash").alias("sets")).where("sets > 1")


def missing_inputs(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """(input_id, side): inputs with gold but no ranking, or the reverse."""
    a, b = gold.select("input_id").distinct(), rankings.select("input_id").distinct()
    return a.join(b, "input_id", "left_anti").withColumn("side", F.lit("no_ranking")).unionByName(b.join(a, "input_id", "left_anti").withColumn("side", F.lit("no_gold")))


def by_subset(rankings: DataFrame, subsets: DataFrame, ks: tuple[int, ...] = (1, 3, 5), least: int = 1) -> DataFrame:
    """Per label subset and method: inputs, hit, recall and average precision at every k, and mrr; subsets of under ``least`` inputs are left out.

    ``subsets``: (subset, input_id, labels). The subset is part of the input's key, so one pass evaluates all.
    """
    key = F.concat_ws("\x1f", "subset", "input_id")
    g = subsets.select(key.alias("input_id"), F.explode("labels").alias("technique_id"))
    names = subsets.select("subset", "input_id").distinct()
    r = rankings.join(names, "input_id").withColumn("input_id", key).select(*RUN, "input_id", "technique_id", "rank")
    m = per_input(relevance(r, g), ks).withColumn("subset", F.element_at(F.split("input_id", "\x1f"), 1))
    cols = ["mrr", *[f"{x}_{k}" for x in ("hit", "recall", "ap") for k in ks]]
    per = m.groupBy("subset", *RUN).agg(F.count("*").alias("n_inputs"), *[F.avg(c).alias(c) for c in cols])
    return per.groupBy("subset", "method").agg(F.max("n_inputs").alias("n_inputs"), *[F.avg(c).alias(c) for c in cols]).where(F.col("n_inputs") >= least)
