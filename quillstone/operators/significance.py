"""Paired comparisons of methods: differences, exact McNemar, sign-flip, Holm, bootstrap intervals."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-15
CELLS = 1_000_000


def paired(samples: DataFrame, metric: str, reference: str | None = None) -> DataFrame:
    """(left_method, right_method, input_id, left_value, right_value): every pair of methods, or all against one, per input."""
    s = samples.select("method", "input_id", F.col(metric).cast("double").alias("v"))
    a = s.select(F.col("method").alias("left_method"), "input_id", F.col("v").alias("left_value"))
    b = s.select(F.col("method").alias("right_method"), "input_id", F.col("v").alias("right_value"))
    keep = F.col("left_method") < F.col("right_method") if reference is None else (F.col("left_method") == reference) & (F.col("right_method") != reference)
    return a.join(b, "input_id").where(keep)


def differences(pairs: DataFrame) -> DataFrame:
    """Per pair: inputs, mean of both, mean difference, wins, ties and losses of the left method."""
    d = F.col("left_value") - F.col("right_value")
    return pairs.groupBy("left_method", "right_method").agg(
        F.count("*").alias("n_inputs"), F.avg("left_value").alias("left_mean"), F.avg("right_value").alias("right_mean"), F.avg(d).alias("difference"),
        F.sum((d > TIE).cast("int")).alias("wins"), F.sum((F.abs(d) <= TIE).cast("int")).alias("ties"), F.sum((d < -TIE).cast("int")).alias("losses"),
    )


def binomial_two_sided(b: Column, c: Column) -> Column:
    """min(1, 2 P[X <= min(b, c)]) for X binomial(b + c, 1/2), summed in logarithms; 1 if b + c is 0."""
    n, m = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    step = lambda acc, i: F.struct((acc.t + F.log((n - i + 1) / i)).alias("t"), (acc.s + F.exp(acc.t + F.log((n - i + 1) / i))).alias("s"))
    ids = F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    return F.when(b + c == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(ids, start, step, lambda acc: acc.s)))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Exact McNemar p-value per pair; null unless all values are 0 or 1."""
    lo, hi = F.col("left_value"), F.col("right_value")
    g = pairs.groupBy("left_method", "right_method").agg(
        F.sum(((lo == 1) & (hi == 0)).cast("int")).alias("left_only"), F.sum(((lo == 0) & (hi == 1)).cast("int")).alias("right_only"),
        F.min((lo.isin(0.0, 1.0) & hi.isin(0.0, 1.0)).cast("int")).alias("binary"),
    )
    return g.select("left_method", "right_method", "left_only", "right_only", F.when(F.col("binary") == 1, binomial_two_sided(F.col("left_only"), F.col("right_only"))).alias("p_value"))


def holm(df: DataFrame, p: str = "p_value", *tie_break: str) -> DataFrame:
    """Holm-adjusted p-values over all rows of one report (its rows are pairs and metrics, not data)."""
    w = Window.orderBy(p, *tie_break)
    n = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("_m"))
    ranked = df.where(F.col(p).isNotNull()).withColumn("_m", n.scalar()).withColumn("_r", F.row_number().over(w))
    return ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_m", "_r")


def stream(seed: int) -> np.random.RandomState:
    """The generator of ``random.Random(seed)`` for whole arrays: the same numbers in the same order."""
    _, state, _ = random.Random(seed).getstate()
    rng = np.random.RandomState()
    rng.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    return rng


def sign_flip_p(differences: list[float], repetitions: int = 20000, seed: int = 0) -> float:
    """Two-sided sign-flip p-value over the non-zero differences: all sign vectors up to twenty, else sampled."""
    d = [x for x in differences if abs(x) > TIE]
    if not d:
        return 1.0
    observed = abs(sum(d) / len(d))
    if len(d) <= 20:
        hits = sum(abs(sum(s * x for s, x in zip(signs, d)) / len(d)) >= observed - TIE for signs in itertools.product((1, -1), repeat=len(d)))
        return hits / 2 ** len(d)
    rng, hits, v = stream(seed), 0, np.array(d)
    for at in range(0, repetitions, step := max(1, CELLS // len(d))):
        kept = rng.random_sample((min(step, repetitions - at), len(d))) < 0.5
        means = np.abs(2 * (kept @ v) - v.sum()) / len(d)
        near = np.abs(means - observed) <= 1e-9  # rounding may decide these: summed as ``observed`` is
        hits += int((means[~near] > observed).sum()) + sum(abs(sum(np.where(k, v, -v).tolist()) / len(d)) >= observed - TIE for k in kept[near])
    return (hits + 1) / (repetitions + 1)


def sign_flip(pairs: DataFrame, repetitions: int = 20000, seed: int = 0) -> DataFrame:
    """Sign-flip p-value per pair of methods; a group is one value per evaluated input."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("input_id")
        return pd.DataFrame({"left_method": [key[0]], "right_method": [key[1]], "p_value": [sign_flip_p(list(pdf["left_value"] - pdf["right_value"]), repetitions, seed)]})

    return pairs.groupBy("left_method", "right_method").applyInPandas(run, "left_method string, right_method string, p_value double")


def quantile(sorted_values: list[float], p: float) -> float:
    """Linear interpolation at (n - 1) p."""
    at = (len(sorted_values) - 1) * p
    lo = int(at)
    hi = min(lo + 1, len(sorted_values) - 1)
    return sorted_values[lo] + (sorted_values[hi] - sorted_values[lo]) * (at - lo)


def bootstrap_interval(values: list[float], repetitions: int, confidence: float, seed: int) -> tuple[float, float]:
    """Percentile interval of the mean; the point itself for a single value or no repetitions."""
    n = len(values)
    if n == 0:
        return float("nan"), float("nan")
    mean = sum(values) / n
    if n == 1 or repetitions <= 0:
        return mean, mean
    rng, v, bits = stream(seed), np.array(values), n.bit_length()
    means, spare = [], np.zeros(0, np.uint32)
    while len(means) < repetitions:
        rows = min(max(1, CELLS // n), repetitions - len(means))
        while len(spare) < rows * n:  # randrange(n): the upper bits of a word, drawn again where these are n or more
            drawn = rng.randint(0, 1 << 32, max(rows * n - len(spare), 1024), np.uint32) >> np.uint32(32 - bits)
            spare = np.r_[spare, drawn[drawn < n]]
        means += v[spare[: rows * n]].reshape(rows, n).mean(axis=1).tolist()
        spare = spare[rows * n :]
    means.sort()
    tail = (1 - confidence) / 2
    return quantile(means, tail), quantile(means, 1 - tail)


def bootstrap(samples: DataFrame, metric: str, repetitions: int = 5000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Per method: mean of ``metric`` over inputs with its bootstrap interval; draws follow the order of input ids."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = [float(x) for x in pdf.sort_values("input_id")[metric]]
        lo, hi = bootstrap_interval(v, repetitions, confidence, seed)
        return pd.DataFrame({"method": [key[0]], "estimate": [sum(v) / len(v)], "low": [lo], "high": [hi]})

    return samples.select("method", "input_id", metric).groupBy("method").applyInPandas(run, "method string, estimate double, low double, high double")


def bootstrap_differences(pairs: DataFrame, repetitions: int = 5000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Per pair of methods: the mean difference over inputs with its bootstrap interval; draws follow the order of input ids."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("input_id")
        d = (pdf["left_value"] - pdf["right_value"]).astype(float).tolist()
        lo, hi = bootstrap_interval(d, repetitions, confidence, seed)
        return pd.DataFrame({"left_method": [key[0]], "right_method": [key[1]], "difference": [sum(d) / len(d)], "low": [lo], "high": [hi]})

    return pairs.groupBy("left_method", "right_method").applyInPandas(run, "left_method string, right_method string, difference double, low double, high double")


def stratified_bootstrap(rows: DataFrame, stratum: str, value: str, weight: str, order: str, repetitions: int = 5000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Weighted mean of ``value`` with an interval from resampling within strata: one row. The input is a drawn sample, not a corpus."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        strata = [(g[value].to_numpy(float), g[weight].to_numpy(float)) for _, g in pdf.sort_values([stratum, order]).groupby(stratum)]
        v, w = (np.concatenate([s[k] for s in strata]) for k in (0, 1))
        sizes = np.array([len(s[0]) for s in strata])
        start, n = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
        rng, draws = random.Random(seed), np.empty(repetitions)
        for i in range(repetitions):  # one generator over strata in order; a draw is one array
            at = start + np.fromiter(map(rng.randrange, n.tolist()), np.int64, len(n))
            draws[i] = (v[at] * w[at]).sum() / w[at].sum()
        draws = np.sort(draws).tolist()
        tail = (1 - confidence) / 2
        return pd.DataFrame({"n": [len(pdf)], "estimate": [float((v * w).sum() / w.sum())], "low": [quantile(draws, tail)], "high": [quantile(draws, 1 - tail)]})

    return rows.select(stratum, value, weight, order).groupBy(F.lit(1)).applyInPandas(run, "n long, estimate double, low double, high double")


def percentile_interval(df: DataFrame, by: str, value: str, confidence: float = 0.95) -> DataFrame:
    """Quantiles of a column per group by linear interpolation."""
    tail = (1 - confidence) / 2
    return df.groupBy(by).agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.percentile(value, F.lit(0.5)).alias("median"))
