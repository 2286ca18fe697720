"""Problem 8: mixing sources to target weights.

Method: subset-sum budget fitting. Documents are counted by source and exact token length. A source's budget is its
share of the tokens of all documents with a source. It is used as often as the budget and its cap allow as a whole; the
rest of the budget is fitted by choosing how many documents of each length are used once more: most of it is filled with
the same fraction of every length, and the rest goes through a bounded-knapsack table over token sums, whose part grows
until the sum is proven the largest possible (see ``fit``). The chosen number of documents of every length is then taken
in hashed order.

Only (source, length, count) rows reach the fitting task of a source; the documents themselves never do. A length shared
by a third of the corpus (empty texts) is numbered in slices of the hash.

Defined cases: null and empty texts have no tokens, count as documents of length 0 and are never repeated; documents with
a null source or one not among the targets are not used, but those with any source count in the total; a source without
documents gets a row with zeros; a null share or cap is 0; of targets with one name the one of the largest share, then of the largest cap counts; target shares are
taken as given.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..session import materialise
from .bytepair import count_tokens

SLICES = 256


def _table(lengths: np.ndarray, avail: np.ndarray, rest: int) -> tuple[np.ndarray, int]:
    """(take, sum): the largest sum of at most ``rest`` with at most ``avail`` of each length, by a bounded-knapsack table.

    Counts enter in binary parts; the table keeps for every reachable sum the part it was first reached with.
    """
    take = np.zeros(len(lengths), np.int64)
    via = np.full(rest + 1, -1, np.int32)
    via[0] = 0
    parts: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(-lengths, kind="stable"):
        n, part = min(int(avail[i]), rest // int(lengths[i])), 1
        while n > 0 and via[rest] < 0:
            c = min(part, n)
            step = c * int(lengths[i])
            fresh = np.flatnonzero((via[: rest + 1 - step] >= 0) & (via[step:] < 0)) + step
            via[fresh] = len(parts)
            parts.append((int(i), c))
            n -= c
            part *= 2
        if via[rest] >= 0:
            break
    at = top = int(np.flatnonzero(via >= 0)[-1])
    while at:
        i, c = parts[via[at]]
        take[i] += c
        at -= c * int(lengths[i])
    return take, top


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (> 0, distinct) to take so that their sum is as large as possible, at most ``budget``.

    The largest part of the budget is filled with the same fraction of every length and only the rest goes through the
    table. If the table does not fill it to the last multiple of the lengths' common divisor, which proves the sum the
    largest, its part is made 16 times as large. By the proximity theorem for integer programs with one row some best choice differs from
    filling the budget length by length by at most 2 x the longest length + 1 documents, so a table over that many of them is final.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    whole = int((lengths * counts).sum())
    if budget <= 0 or whole == 0:
        return np.zeros(len(lengths), np.int64)
    if whole <= budget:
        return counts.copy()
    longest = int(lengths.max())
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    most = budget // unit * unit
    part, last = 4 * longest + 65536, (2 * longest + 1) * longest
    while True:
        final = part >= min(most, last)
        base = _filled(lengths, counts, max(most - part, 0)) if not final else _in_turn(lengths, counts, most, 2 * longest + 1)
        avail = counts - base
        if final:
            avail = np.minimum(avail, 4 * longest + 2)
        rest = most - int((base * lengths).sum())
        take, reached = _table(lengths, avail, rest)
        if final or reached == rest:
            return base + take
        part *= 16


def _filled(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The same fraction of every length, rounded down, and then documents from the shortest length on, up to ``budget`` at most."""
    take = (counts * (budget / int((lengths * counts).sum()))).astype(np.int64)
    while (over := int((take * lengths).sum()) - budget) > 0:
        i = int(np.flatnonzero(take)[-1])
        take[i] -= min(int(take[i]), -(-over // int(lengths[i])))
    for i in np.argsort(lengths, kind="stable"):
        more = min(int(counts[i] - take[i]), (budget - int((take * lengths).sum())) // int(lengths[i]))
        take[i] += more
    return take


def _in_turn(lengths: np.ndarray, counts: np.ndarray, budget: int, spare: int) -> np.ndarray:
    """Documents length by length up to ``budget``, less ``spare`` of each length that has so many."""
    take, left = np.zeros(len(lengths), np.int64), budget
    for i in range(len(lengths)):
        take[i] = min(int(counts[i]), left // int(lengths[i]))
        left -= int(take[i] * lengths[i])
    return np.maximum(take - spare, 0)


FIT = "source string, n_tokens long, docs long, repeats long, extra long, budget double, own_tokens long, max_repeats int, target_share double"


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source and token length: whole repeats of every document, and how many documents are used once more."""
    hist = sized.where("source is not null").groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))
    total = hist.agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("total"))
    named = targets.select(N.key_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    goal = named.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = goal.join(hist, "source", "left").withColumn("total", total.scalar()).select("source", "target_share", "max_repeats", zero("n_tokens"), zero("docs"), zero("total"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens").reset_index(drop=True)
        lengths, counts = pdf["n_tokens"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64)
        share, cap = (0 if pd.isna(pdf[c].iloc[0]) else pdf[c].iloc[0] for c in ("target_share", "max_repeats"))
        share, cap = float(share), int(cap)
        own = int((lengths * counts).sum())
        wanted = share * int(pdf["total"].iloc[0])
        budget = int(np.floor(wanted + 1e-9))
        times = min(cap, budget // own) if own else 0
        extra = np.zeros(len(pdf), np.int64)
        if own and times < cap:
            some = lengths > 0
            extra[some] = fit(lengths[some], counts[some], budget - times * own)
        return pd.DataFrame({"source": pdf["source"], "n_tokens": lengths, "docs": counts, "repeats": times, "extra": extra, "budget": wanted, "own_tokens": own, "max_repeats": cap, "target_share": share})

    return joined.groupBy("source").applyInPandas(one, FIT)


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source (normalised) and n_tokens of every document."""
    return count_tokens(documents.select("doc_id", N.key_name(F.col("source")).alias("source"), "text"), path=path)


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens and times_used of every document that the mixture uses."""
    sized = materialise(sized_documents(documents, path), "sized")
    p = plan(sized, targets).select("source", "n_tokens", "repeats", "extra")
    d = sized.where("source is not null").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("slice", F.pmod(F.shiftright("h", 32), F.lit(SLICES)))
    per = d.groupBy("source", "n_tokens", "slice").agg(F.count("*").alias("n"))
    before = per.select("source", "n_tokens", "slice", (F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("slice")) - F.col("n")).alias("before"))
    cut = before.join(p, ["source", "n_tokens"])
    w = Window.partitionBy("source", "n_tokens", "slice").orderBy("h", "doc_id")
    numbered = d.withColumn("k", F.row_number().over(w)).join(cut, ["source", "n_tokens", "slice"])
    used = F.col("repeats") + (F.col("k") + F.col("before") <= F.col("extra")).cast("long")
    return numbered.select("doc_id", "source", "n_tokens", used.alias("times_used")).where("times_used > 0")


def report(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """Per source of the targets, spelt as there: documents, tokens, budget, tokens used, the shares wanted and reached, and whether the cap binds."""
    p = plan(sized_documents(documents, path), targets)
    per = p.groupBy("source").agg(
        F.sum("docs").alias("docs"), F.max("own_tokens").alias("own_tokens"), F.max("budget").alias("budget_tokens"),
        F.sum(F.col("n_tokens") * (F.col("docs") * F.col("repeats") + F.col("extra"))).alias("used_tokens"),
        F.max("max_repeats").alias("max_repeats"), F.max("target_share").alias("target_share"),
    )
    total = per.agg(F.sum("used_tokens").alias("all_used"))
    names = targets.select(F.col("source").alias("name"), N.key_name(F.col("source")).alias("source"))
    r = per.join(names, "source").withColumn("all_used", total.scalar())
    short = F.col("own_tokens") * F.col("max_repeats") < F.col("budget_tokens")
    return r.select(F.col("name").alias("source"), "docs", "own_tokens", "max_repeats", "budget_tokens", "used_tokens", "target_share", (F.col("used_tokens") / F.col("all_used")).alias("actual_share"), short.alias("short"))


def short_sources(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """Sources of the targets whose documents cannot fill their budget however often they may be used."""
    return report(documents, targets, path).where("short").select("source")


