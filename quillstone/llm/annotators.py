"""Problem 4: consensus labels, agreement and annotator reliability from disagreeing reviews.

Method: the mean-field variational form of the confusion-matrix model. Classes have a Dirichlet prior, and so has every
row (true class) of every annotator's confusion matrix. A round computes the expected log-parameters from expected counts
(digamma), each sample's class posterior from these, and the counts again by a group-by over (annotator, decision).
Rounds end when the evidence lower bound, which never falls, grows by less than ``tol`` a sample.

Votes are shuffled once, to a row per sample with the list of its annotators' decisions (one vote an annotator). A round
reads these rows where they stand; what moves are partial counts, at most annotators x 16 numbers a task, and the parameters, which go
to the tasks as one array if there are at most ``DENSE`` annotators (128 bytes each; counted first). With more annotators
the parameters stay a table that is joined with the votes; the results are the same.

Defined cases: decisions that are null, blank, unreadable or name two labels, and votes without annotator or sample id are
unusable; of an annotator's votes on a sample the latest counts (null time is oldest, then the greater form id, then the
adjudicator's, then the second reviewer's); repeated forms change nothing; no usable vote gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..session import discard, materialise

#: The four decisions.
DECISIONS = ("directly_supported", "inferential_or_plausible", "insufficient_text", "unsupported")
K = len(DECISIONS)
DENSE = 1 << 20


def read_decision(c: Column) -> Column:
    """One of the four decisions from any spelling up to two letters off; null if none or more than one fits."""
    s = F.regexp_replace(F.lower(c), r"^\s*[(\[]?\d+[)\]]?\s*[-.:)]*\s*", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\p{L}]+", "_"), r"^_+|_+$", "")
    near = F.array_compact(F.array(*[F.when(F.levenshtein(s, F.lit(d)) <= 2, F.lit(d)) for d in DECISIONS]))
    return F.when(F.size(near) == 1, F.element_at(near, 1))


def votes(reviews: DataFrame) -> DataFrame:
    """The decision that counts of each annotator on each sample."""
    roles = [("reviewer_1_id", "reviewer_1_decision"), ("reviewer_2_id", "reviewer_2_decision"), ("adjudicator_id", "adjudicated_decision")]
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("role"), N.squeeze(F.col(i)).alias("annotator"), read_decision(F.col(d)).alias("decision")) for k, (i, d) in enumerate(roles)]))
    v = reviews.select("sample_id", "submitted_at", "form_id", each)
    v = v.where(F.col("decision").isNotNull() & N.usable(F.col("annotator")) & N.usable(F.col("sample_id")))
    return v.groupBy("sample_id", "annotator").agg(F.max(F.struct("submitted_at", "form_id", "role", "decision")).alias("x")).select("sample_id", "annotator", F.col("x.decision").alias("decision"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers: six recurrence steps, then the asymptotic series (error below 1e-10)."""
    y = x + 6.0
    i = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132)))) - sum(1.0 / (x + j) for j in range(6))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of gamma for positive numbers, by Stirling's series at x + 8."""
    y = x + 8.0
    i = 1.0 / (y * y)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - sum(np.log(x + j) for j in range(8))


def _dirichlet(a: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected log-probabilities, divergence from the prior) of Dirichlet distributions along the last axis."""
    total = a.sum(axis=-1, keepdims=True)
    e = digamma(a) - digamma(total)
    p = np.broadcast_to(prior, a.shape)
    kl = log_gamma(total[..., 0]) - log_gamma(a).sum(axis=-1) - log_gamma(p.sum(axis=-1)) + log_gamma(p).sum(axis=-1) + ((a - p) * e).sum(axis=-1)
    return e, kl


def _rows_prior(diagonal: float, off: float) -> np.ndarray:
    """Prior of the confusion rows: [class, decision]."""
    return np.full((K, K), off) + np.eye(K) * (diagonal - off)


def _posterior(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class probabilities, log of the sum) of log-scores [sample, class]."""
    top = score.max(axis=1, keepdims=True)
    x = np.exp(score - top)
    z = x.sum(axis=1, keepdims=True)
    return x / z, (np.log(z) + top)[:, 0]


def by_sample(v: DataFrame) -> DataFrame:
    """A row per sample: the annotators who voted on it and their decisions by number. An annotator has one vote on a sample."""
    code = (F.array_position(F.array(*map(F.lit, DECISIONS)), F.col("decision")) - 1).cast("int")
    g = v.groupBy("sample_id").agg(F.collect_list(F.struct("annotator", code.alias("d"))).alias("x"))
    return g.select("sample_id", F.col("x.annotator").alias("who"), F.col("x.d").alias("d"))


def variational(v: DataFrame, tol: float = 1e-6, max_rounds: int = 500, diagonal: float = 4.0, off: float = 1.0, class_prior: float = 1.0, dense: int = DENSE) -> tuple[DataFrame, DataFrame, list[float]]:
    """(posterior, params, bounds). ``bounds`` is the evidence lower bound of every round; fails if ``max_rounds`` do not suffice.

    ``posterior``: sample_id, n_votes, n_<class> (votes) and q_<class>. ``params``: annotator, decision number d,
    and per class a_<class>, the parameter of d given the class, and b_<class>, the sum of the class's row.
    """
    base = materialise(by_sample(v), "votes")
    people = base.select(F.explode("who").alias("annotator")).distinct()
    few = people.count() <= dense
    return (_dense if few else _joined)(base, people, tol, max_rounds, _rows_prior(diagonal, off), np.full(K, class_prior))


def _settled(bounds: list[float], samples: float, tol: float, max_rounds: int) -> bool:
    if len(bounds) > 1 and bounds[-1] - bounds[-2] <= tol * samples:
        return True
    if len(bounds) >= max_rounds:
        raise RuntimeError(f"the bound still grows after {max_rounds} rounds")
    return False


def _flat(b: pa.RecordBatch, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first vote of each sample, annotator by number, decision) of a batch; every sample has a vote."""
    who, d = b.column("w"), b.column("d").flatten().to_numpy(zero_copy_only=False)
    n = np.asarray(who.value_lengths(), np.int64)
    return np.r_[0, np.cumsum(n)][:-1], np.searchsorted(hashes, who.flatten().to_numpy(zero_copy_only=False)), d


def _dense(base: DataFrame, people: DataFrame, tol: float, max_rounds: int, prior: np.ndarray, class_prior: np.ndarray):
    spark = base.sparkSession
    names = people.select("annotator", F.xxhash64("annotator").alias("w")).orderBy("w").toPandas()  # at most ``dense`` rows
    hashes = names["w"].to_numpy(np.int64)
    if len(np.unique(hashes)) < len(hashes):
        return _joined(base, people, tol, max_rounds, prior, class_prior)
    rows = base.select("sample_id", F.transform("who", lambda a: F.xxhash64(a)).alias("w"), "d")

    def counted(shared) -> DataFrame:
        """Expected counts per (annotator, decision), and in row -1 those of the classes, the bound's part and the samples."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, e, w = shared.value
            total, classes, bound, samples = np.zeros((len(hashes) * K, K)), np.zeros(K), 0.0, 0
            for b in batches:
                if not b.num_rows:
                    continue
                first, who, d = _flat(b, hashes)
                n = np.diff(np.r_[first, len(who)])
                if e is None:  # the first round starts from the votes' shares
                    q = np.add.reduceat(np.eye(K)[d], first, axis=0) / n[:, None]
                else:
                    q, z = _posterior(w + np.add.reduceat(e[who, d], first, axis=0))
                    bound += z.sum()
                each = np.repeat(q, n, axis=0)
                for c in range(K):
                    total[:, c] += np.bincount(who * K + d, each[:, c], minlength=len(total))
                classes += q.sum(axis=0)
                samples += len(q)
            at = np.flatnonzero(total.any(axis=1))
            cols = [np.r_[at, -1], *(np.r_[total[at, c], classes[c]] for c in range(K)), np.r_[np.zeros(len(at)), bound], np.r_[np.zeros(len(at), np.int64), samples]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["cell", *[f"c{i}" for i in range(K)], "bound", "samples"])

        part = rows.select("w", "d").mapInArrow(run, "cell long, " + ", ".join(f"c{i} double" for i in range(K)) + ", bound double, samples long")
        return part.groupBy("cell").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(K)], F.sum("bound").alias("bound"), F.sum("samples").alias("samples"))

    e = w = alpha = None
    bounds: list[float] = []
    while True:
        shared = spark.sparkContext.broadcast((hashes, e, w))
        got = counted(shared).toPandas()  # 4 rows an annotator and one
        shared.unpersist()
        whole = got[got["cell"] < 0]
        if not len(whole) or not int(whole["samples"].iloc[0]):
            alpha = np.zeros((0, K, K))
            break
        if alpha is not None:
            bounds.append(float(whole["bound"].iloc[0]) - penalty)
            if _settled(bounds, float(whole["samples"].iloc[0]), tol, max_rounds):
                break
        part = got[got["cell"] >= 0]
        counts = np.zeros((len(hashes) * K, K))
        counts[part["cell"].to_numpy()] = part[[f"c{i}" for i in range(K)]].to_numpy()
        alpha = counts.reshape(-1, K, K).transpose(0, 2, 1) + prior  # [annotator, class, decision]
        logs, kl = _dirichlet(alpha, prior)
        e = np.ascontiguousarray(logs.transpose(0, 2, 1))  # [annotator, decision, class]
        w, kl_classes = _dirichlet(whole[[f"c{i}" for i in range(K)]].to_numpy()[0] + class_prior, class_prior)
        penalty = float(kl.sum() + kl_classes)
    last = spark.sparkContext.broadcast((hashes, e, w))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, e, w = last.value
        for b in batches:
            if not b.num_rows:
                continue
            first, who, d = _flat(b, hashes)
            q, _ = _posterior(w + np.add.reduceat(e[who, d], first, axis=0))
            n = np.add.reduceat(np.eye(K, dtype=np.int64)[d], first, axis=0)
            cols = [b.column("sample_id"), pa.array(n.sum(axis=1)), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(K)), *(pa.array(np.ascontiguousarray(q[:, i])) for i in range(K))]
            yield pa.RecordBatch.from_arrays(cols, names=["sample_id", "n_votes", *[f"n{i}" for i in range(K)], *[f"q{i}" for i in range(K)]])

    kinds = ", ".join([*(f"n{i} long" for i in range(K)), *(f"q{i} double" for i in range(K))])
    posterior = rows.mapInArrow(final, f"sample_id string, n_votes long, {kinds}")
    flat = [(str(a), d, *map(float, alpha[i, :, d]), *map(float, alpha[i].sum(axis=1))) for i, a in enumerate(names["annotator"][: len(alpha)]) for d in range(K)]
    params = spark.createDataFrame(flat, "annotator string, d int, " + ", ".join([*(f"a{i} double" for i in range(K)), *(f"b{i} double" for i in range(K))]))
    return posterior, params, bounds


def _joined(base: DataFrame, people: DataFrame, tol: float, max_rounds: int, prior: np.ndarray, class_prior: np.ndarray):
    """The same rounds with the parameters as a table: any number of annotators."""
    one = Window.partitionBy("sample_id")
    held = [F.size(F.filter("d", (lambda i: lambda x: x == i)(i))).alias(f"n{i}") for i in range(K)]
    zipped = base.select("sample_id", F.size("who").alias("n"), *held, F.inline(F.arrays_zip(F.col("who").alias("annotator"), "d")))
    votes_ = materialise(zipped, "exploded")
    voted = votes_.select("*", *[(F.col(f"n{i}") / F.col("n")).alias(f"q{i}") for i in range(K)], F.lit(0.0).alias("z"))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([b.column(f"c{d}_{c}").to_numpy() for c in range(K) for d in range(K)], axis=1).reshape(-1, K, K)
            alpha = counts + prior
            logs, kl = _dirichlet(alpha, prior)
            for d in range(K):
                cols = [b.column("annotator"), pa.array(np.full(b.num_rows, d, np.int32)), *(pa.array(np.ascontiguousarray(alpha[:, c, d])) for c in range(K)), *(pa.array(alpha[:, c].sum(axis=1)) for c in range(K)), *(pa.array(np.ascontiguousarray(logs[:, c, d])) for c in range(K)), pa.array(kl.sum(axis=1) if d == 0 else np.zeros(b.num_rows))]
                yield pa.RecordBatch.from_arrays(cols, names=["annotator", "d", *[f"{x}{i}" for x in "abe" for i in range(K)], "kl"])

    schema = "annotator string, d int, " + ", ".join(f"{x}{i} double" for x in "abe" for i in range(K)) + ", kl double"
    bounds: list[float] = []
    params = None
    while True:
        share = 1 / F.col("n")
        whole = voted.agg(*[F.coalesce(F.sum(F.col(f"q{i}") * share), F.lit(0.0)).alias(f"t{i}") for i in range(K)], F.sum(F.col("z") * share).alias("z"), F.sum(share).alias("samples")).first()
        if not whole["samples"]:
            break
        if params is not None:
            bounds.append(whole["z"] - penalty)
            if _settled(bounds, whole["samples"], tol, max_rounds):
                break
            discard(params)
        counts = voted.groupBy("annotator").agg(*[F.sum(F.when(F.col("d") == d, F.col(f"q{c}")).otherwise(0.0)).alias(f"c{d}_{c}") for c in range(K) for d in range(K)])
        params = materialise(counts.mapInArrow(expect, schema), "confusion")
        w, kl = _dirichlet(np.array([whole[f"t{i}"] for i in range(K)]) + class_prior, class_prior)
        penalty = params.agg(F.sum("kl")).first()[0] + float(kl)
        j = votes_.join(params.select("annotator", "d", *[f"e{i}" for i in range(K)]), ["annotator", "d"])
        j = j.select(*votes_.columns, *[(F.sum(f"e{i}").over(one) + float(w[i])).alias(f"l{i}") for i in range(K)])
        top = F.greatest(*[F.col(f"l{i}") for i in range(K)])
        z = sum((F.exp(F.col(f"l{i}") - top) for i in range(K)), F.lit(0.0))
        old = voted
        voted = materialise(j.select(*votes_.columns, *[(F.exp(F.col(f"l{i}") - top) / z).alias(f"q{i}") for i in range(K)], (F.log(z) + top).alias("z")), "voted")
        if len(bounds):
            discard(old)
    posterior = voted.groupBy("sample_id").agg(F.count("*").alias("n_votes"), *[F.first(f"n{i}").cast("long").alias(f"n{i}") for i in range(K)], *[F.first(f"q{i}").alias(f"q{i}") for i in range(K)])
    if params is None:
        params = base.sparkSession.createDataFrame([], schema)
    return posterior, params.select("annotator", "d", *[f"{x}{i}" for x in "ab" for i in range(K)]), bounds


def consensus(reviews: DataFrame, **how) -> DataFrame:
    """One row per sample and decision with its posterior and votes; ``is_consensus`` marks the most probable decision."""
    post, _, _ = variational(votes(reviews), **how)
    rows = F.inline(F.array(*[F.struct(F.lit(d).alias("decision"), F.col(f"n{i}").alias("votes"), F.col(f"q{i}").alias("posterior")) for i, d in enumerate(DECISIONS)]))
    best = F.greatest(*[F.col(f"q{i}") for i in range(K)])
    pick = F.coalesce(*[F.when(F.col(f"q{i}") == best, F.lit(d)) for i, d in enumerate(DECISIONS)])
    out = post.select("sample_id", "n_votes", pick.alias("pick"), rows)
    return out.select("sample_id", "decision", "votes", "n_votes", "posterior", (F.col("decision") == F.col("pick")).alias("is_consensus"))


def clear_majorities(reviews: DataFrame) -> DataFrame:
    """Decisions of the consensus table that more than half of at least three annotators gave.

    The model may prefer another decision where the majority is unreliable, so ``is_consensus`` isn't asked for: that would lose such cases.
    """
    return consensus(reviews).where((F.col("n_votes") >= 3) & (F.col("votes") * 2 > F.col("n_votes"))).select("sample_id", "decision")


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that a Beta(a, b) variable is at most x: the continued fraction of the incomplete beta function."""
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    f = d.copy()
    for m in range(1, 400):
        for t in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f *= c * d
        if np.abs(c * d - 1).max(initial=0) < 1e-14:
            break
    return np.where(flip, 1 - front * f, front * f)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The p-quantile of Beta(a, b), by bisection."""
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(55):
        mid = (lo + hi) / 2
        less = beta_below(mid, a, b) < p
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (lo + hi) / 2


def reliability(reviews: DataFrame, **how) -> DataFrame:
    """Posterior mean, per annotator and true class, of the probability of the right decision, with its 95 % interval: the quantiles of the Beta marginal."""
    _, params, _ = variational(votes(reviews), **how)
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("decision"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i, d in enumerate(DECISIONS)]))

    def interval(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b = f["a"].to_numpy(float), f["b"].to_numpy(float)
            yield pd.DataFrame({"annotator": f["annotator"], "decision": f["decision"], "reliability": a / b, "low": beta_quantile(0.025, a, b - a), "high": beta_quantile(0.975, a, b - a), "pseudo_count": b})

    r = params.select("annotator", "d", rows).where("d = i").select("annotator", "decision", "a", "b")
    return r.mapInPandas(interval, "annotator string, decision string, reliability double, low double, high double, pseudo_count double")


def krippendorff(reviews: DataFrame) -> DataFrame:
    """Nominal Krippendorff alpha over samples with two or more votes: one row (null alpha if all such votes agree on one label)."""
    v = votes(reviews)
    per = v.groupBy("sample_id", "decision").agg(F.count("*").alias("c")).groupBy("sample_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    pair = per.where("m >= 2")
    observed = pair.agg(F.sum((F.col("m") * F.col("m") - F.col("cc")) / (F.col("m") - 1)).alias("do"), F.sum("m").alias("n"), F.count("*").alias("samples"))
    kept = v.join(pair.select("sample_id"), "sample_id", "left_semi").groupBy("decision").agg(F.count("*").alias("c"))
    expected = kept.agg(F.sum("c").alias("tot"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    de = (F.col("tot") * F.col("tot") - F.col("sq")) / (F.col("tot") - 1)
    return observed.withColumn("x", expected.select(F.struct("tot", "sq")).scalar()).select("*", "x.*").select(F.col("samples").alias("n_samples"), F.col("n").cast("long").alias("n_votes"), F.when(de > 0, 1 - F.col("do") / de).alias("alpha"))
