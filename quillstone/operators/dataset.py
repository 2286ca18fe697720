"""Building and checking datasets: merging rows of one id, label resolution, split construction, alignment checks."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N


def augmentation_index(c: Column) -> Column:
    """The number of an augmented variant; null for originals."""
    d = F.regexp_extract(N.input_id(c), r"_AUGU?MENTED_(\d+)$", 1)
    return F.when(d != "", d.cast("int"))


def union_of_labels(c: str) -> Column:
    """Distinct sorted labels of all rows of a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))


def collapse_rows(rows: DataFrame, base: str = "base", row: str = "row_id") -> DataFrame:
    """One record per base id: labels of all rows, text of the original (else the lowest augmentation), the earliest row."""
    best = F.min_by("text", F.struct(F.coalesce("augmentation", F.lit(-1)), F.col("source_row"), F.col("source_id"), F.col(row)))
    labels = rows.select(base, F.explode_outer("labels").alias("label")).groupBy(base).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    text = rows.where("text is not null").groupBy(base).agg(best.alias("text"))
    return rows.groupBy(base).agg(F.count("*").alias("n_rows"), F.sum(F.col("augmentation").isNotNull().cast("int")).alias("n_augmented")).join(text, base, "left").join(labels, base)


def merge_sources(records: DataFrame, base: str = "base") -> DataFrame:
    """One record per base id over sources: the longest text, then source position, order and hash; labels and sources of all."""
    key = F.struct(-F.length("raw_text"), F.col("source_position"), F.col("source_record_order"), F.col("record_sha256"))
    text = records.where("raw_text is not null").groupBy(base).agg(F.min_by("raw_text", key).alias("raw_text"), F.min_by("record_sha256", key).alias("record_sha256"))
    labels = records.select(base, F.explode_outer("labels").alias("label")).groupBy(base).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return records.groupBy(base).agg(F.array_sort(F.collect_set("source_name")).alias("source_membership")).join(text, base, "left").join(labels, base)


def label_frequency(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("support"))


def onehot_to_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, label) for the cells of one-hot columns that are 1."""
    return df.unpivot(key, columns, "label", "value").where(F.col("value").try_cast("double") == 1).select(key, "label")


def resolve_labels(labels: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(label, technique_id, problem): ids as they are if active, names if just one active technique has it."""
    ok = catalogue.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))
    ids = ok.select(F.col("technique_id").alias("by_id")).distinct()
    names = ok.groupBy(F.lower(N.squeeze(F.col("name"))).alias("_name")).agg(F.min("technique_id").alias("by_name"), F.count_distinct("technique_id").alias("n"))
    x = labels.select("label").distinct().withColumn("_u", F.upper(F.trim("label"))).withColumn("_l", F.lower(N.squeeze(F.col("label"))))
    j = x.join(ids, x._u == ids.by_id, "left").join(names, x._l == names._name, "left")
    hit = F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_name")))
    return j.select("label", hit.alias("technique_id"), F.when(hit.isNull(), F.when(F.col("n") > 1, "ambiguous").otherwise("unmapped")).alias("problem"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both sides (empty if the splits are apart)."""
    return a.select(key).distinct().join(b.select(key).distinct(), key)


def id_alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) for keys that only one side has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet: what a resumed job has to do."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash of a table: one row."""
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("xor"), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))).alias("sum"))


def split_targets(support: dict[str, int], part: float, least: int) -> dict[str, int]:
    """How many holders of each label the smaller side should get: half-even rounding, at least one and not all; none of rarer labels."""
    return {k: (max(1, min(n - 1, round(n * part))) if n >= least else 0) for k, n in support.items()}


def _tie(seed: int, *parts: str) -> str:
    return hashlib.sha256("\x1f".join([str(seed), *parts]).encode()).hexdigest()


def stratified_split(records: list[tuple[str, list[str]]], part: int, seed: int, least: int = 2, passes: int = 20, pool: int = 256) -> set[str]:
    """Ids of the smaller side: rarest open label first, then swaps that lower the deviation from the labels' targets.

    A search over one labelled evaluation set (thousands of records) whose every step depends on the last, so it runs on the driver; corpora
    are split by the operator for related records instead. Equal choices go by a hash of seed and ids.
    """
    ids = sorted(i for i, _ in records)
    at = {i: k for k, i in enumerate(ids)}
    names = sorted({x for _, ls in records for x in ls})
    has = np.zeros((len(ids), len(names)), bool)
    column = {x: k for k, x in enumerate(names)}
    for i, ls in records:
        has[at[i], [column[x] for x in ls]] = True
    side = _rarest_first(ids, names, has, part, seed)
    support = has.sum(axis=0)
    goal = np.array([split_targets({x: int(n)}, part / len(ids), least)[x] for x, n in zip(names, support)], float)

    def cost(c: np.ndarray) -> np.ndarray:
        """Per label: squared deviation over support, and a million where one side would lack a label that both should have."""
        return (c - goal) ** 2 / np.maximum(support, 1) + 1e6 * ((support >= least) & ((c == 0) | (c == support)))

    for _ in range(passes):
        c = has[side].sum(axis=0).astype(float)
        if (c == goal).all():
            break
        use = has @ ((c - goal) / np.maximum(support, 1))  # what the deviation loses when a record leaves
        best = lambda rows, sign, word: sorted(rows, key=lambda k: (-sign * use[k], _tie(seed, word, ids[k]), ids[k]))[:pool]
        out, new = best(np.flatnonzero(side), 1, "swap-out"), best(np.flatnonzero(~side), -1, "swap-in")
        a, b = has[out].astype(float), has[new].astype(float)
        gain = (a * (cost(c - 1) - cost(c))) @ (1 - b).T + (1 - a) @ (b * (cost(c + 1) - cost(c))).T
        if not gain.size or gain.min() >= -1e-12:
            break
        near = np.argwhere(gain <= gain.min() + 1e-12)
        i, j = min(((out[x], new[y]) for x, y in near), key=lambda p: (_tie(seed, "swap", ids[p[0]], ids[p[1]]), ids[p[0]], ids[p[1]]))
        side[i], side[j] = False, True
    return {ids[k] for k in np.flatnonzero(side)}


def _rarest_first(ids: list[str], names: list[str], has: np.ndarray, part: int, seed: int) -> np.ndarray:
    """True for the records of the smaller side: the label with the fewest open holders gives its next one to the side that wants it most."""
    n = len(ids)
    order = [sorted(np.flatnonzero(has[:, k]), key=lambda i, x=x: (_tie(seed, "iterative-sample", x, ids[i]), ids[i])) for k, x in enumerate(names)]
    bare = sorted(np.flatnonzero(~has.any(axis=1)), key=lambda i: (_tie(seed, "unlabelled", ids[i]), ids[i]))
    capacity = np.array([part, n - part])  # the smaller side first
    want = has.sum(axis=0)[None, :] * (capacity / n)[:, None]
    open_, taken = has.sum(axis=0).astype(float), np.zeros(n, bool)
    next_, side = [0] * len(names), np.zeros(n, bool)
    for _ in range(n):
        k = int(np.argmin(np.where(open_ > 0, open_, np.inf))) if (open_ > 0).any() else None
        queue = bare if k is None else order[k]
        at = 0 if k is None else next_[k]
        while taken[queue[at]]:
            at += 1
        i = queue[at]
        if k is not None:
            next_[k] = at + 1
        able = [s for s in (0, 1) if capacity[s] > 0]
        s = max(able, key=lambda s: (want[s, k] if k is not None else 0.0, capacity[s], -s))
        taken[i], side[i] = True, s == 0
        capacity[s] -= 1
        want[s, has[i]] -= 1.0
        open_[has[i]] -= 1
    return side


def label_balance(assigned: DataFrame, part: float, small: str, least: int = 2) -> DataFrame:
    """Per label of (base, labels, split): support, holders on either side, the target of the smaller side and the error."""
    per = assigned.select("split", F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("support"), F.sum((F.col("split") == small).cast("int")).alias("n_small"))
    want = F.when(F.col("support") >= least, F.greatest(F.lit(1), F.least(F.col("support") - 1, F.bround(F.col("support") * part, 0).cast("long")))).otherwise(0).cast("long")
    return per.select("label", "support", "n_small", (F.col("support") - F.col("n_small")).alias("n_large"), want.alias("target"), (F.col("n_small") - want).alias("error"))


def not_partitioned(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """(key, problem): keys of the whole that no part has or that two have, and keys of parts that the whole lacks. Empty if the parts make up the whole."""
    held = functools.reduce(DataFrame.unionAll, [p.select(key) for p in parts]).groupBy(key).agg(F.count("*").alias("n"))
    j = whole.select(key).distinct().withColumn("_in", F.lit(True)).join(held, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "in no part").when(F.col("_in").isNull(), "not in the whole").when(F.col("n") > 1, "in several parts")
    return j.select(key, problem.alias("problem")).where("problem is not null")
