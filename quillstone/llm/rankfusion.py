"""Problem 2: one ranking per record from several scores on unlike scales.

Method: a rank-walk Markov chain. From a candidate the walk picks a score at random and jumps uniformly to the
candidates strictly better in it or stays; with probability ``1 - damping`` it restarts anywhere in the record. Only
ranks enter, so no score dominates by its range. The stationary share is found by power iteration; the mass a candidate
receives from all worse ones is a suffix sum over the sorted score, so a step costs O(n) after one sort.

The candidates of a record are distinct techniques, so a record's list is bounded by the technique catalogue however
many rows it has: rows are first reduced to the latest of each candidate with map-side combining.

Defined cases: a null, NaN, infinite or out-of-range score is missing and ranks below all present ones, equal among
missing; equal scores do not jump to each other; a null ``scored_at`` is oldest; rows tied on it resolve to the greatest
scores; unreadable record ids and null techniques take no part; equal stationary shares are ordered by technique id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N

SCORES = ("score_text", "mean_edge_score", "llm_score", "path_cost")
#: The range of llm_score in each mode.
LLM_RANGES = {"full": (0.0, 1.0), "structure": (0.0, 100.0), "evidence": (-10.0, 10.0), "generic": (-10.0, 10.0)}


def latest_candidates(rerank: DataFrame) -> DataFrame:
    """The latest row of every candidate, with four scores of which more is better (null where missing)."""

    def within(c, lo, hi, open_end=False):
        ok = c.isNotNull() & ~F.isnan(c) & (c >= lo) & ((c < hi) if open_end else (c <= hi)) & (F.abs(c) < float("inf"))
        return F.when(ok, c)

    llm = F.lit(None).cast("double")
    for mode, (lo, hi) in LLM_RANGES.items():
        llm = F.when(F.lower(N.squeeze(F.col("mode"))) == mode, within(F.col("llm_score"), lo, hi)).otherwise(llm)
    r = rerank.select(
        N.base_id(F.col("input_id")).alias("input_id"), "technique_id", "scored_at",
        within(F.col("score_text"), 0.0, float("inf")).alias("score_text"),
        within(F.col("mean_edge_score"), 0.0, 1.0).alias("mean_edge_score"), llm.alias("llm_score"),
        (-within(F.col("path_cost"), 0.0, 1e6, True)).alias("path_cost"),
    ).where("input_id is not null and technique_id is not null")
    last = r.groupBy("input_id", "technique_id").agg(F.max(F.struct("scored_at", *SCORES)).alias("x"))
    return last.select("input_id", "technique_id", *[F.col(f"x.{s}").alias(s) for s in SCORES])


def stationary(group: np.ndarray, scores: list[np.ndarray], damping: float = 0.85, tol: float = 1e-13, rounds: int = 500):
    """Stationary share of every item of every group, and for each score how many of its group better it and equal it.

    ``group`` is sorted; a score of -inf is missing.
    """
    n = len(group)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    gid = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1 if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    gstart, gsize = first[gid], size[gid]
    plans = []
    for s in scores:
        order = np.lexsort((-s, gid))
        ss, sg = s[order], gid[order]
        new = np.r_[True, (ss[1:] != ss[:-1]) | (sg[1:] != sg[:-1])] if n else np.zeros(0, bool)
        run = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, int)  # first of the ties
        starts = np.flatnonzero(new)
        end = np.r_[starts[1:], n][np.cumsum(new) - 1] if n else np.zeros(0, int)  # after the last of the ties
        better = run - gstart[order]
        plans.append((order, better, end, np.r_[first[1:], n][sg] if n else end, end - run - 1))
    pi = 1.0 / gsize if n else np.zeros(0)
    restart = (1.0 - damping) / gsize if n else pi
    for _ in range(rounds if n else 0):
        out = np.zeros(n)
        for order, better, end, gend, _ties in plans:
            x = pi[order] / (better + 1)
            total = np.r_[0.0, np.cumsum(x)]
            got = x + (total[gend] - total[end])
            out[order] += got
        new = restart + damping * out / len(plans)
        new /= np.add.reduceat(new, first)[gid]
        moved = np.abs(new - pi).max()
        pi = new
        if moved < tol:
            break
    counts = []
    for order, better, _end, _gend, ties in plans:
        b, t = np.empty(n, np.int32), np.empty(n, np.int32)
        b[order], t[order] = better, ties
        counts.append((b, t))
    return pi, counts, gid, first


OUT = "input_id string, technique_id string, stationary double, fused_rank int, firsts int, seconds int, present int"


def fused_ranking(candidates: DataFrame, damping: float = 0.85) -> DataFrame:
    """Every candidate with its stationary share and rank in its record.

    Also how many scores it is strictly first in, how many present ones at most one candidate betters, and how many are present.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("technique_id")
            lengths = np.asarray(lists.value_lengths())
            rows = np.repeat(np.arange(b.num_rows), lengths)
            cols = [np.asarray(b.column(s).flatten().to_numpy(zero_copy_only=False), float) for s in SCORES]
            cols = [np.where(np.isnan(c), -np.inf, c) for c in cols]
            tech = lists.flatten()
            pi, counts, gid, first = stationary(rows, cols, damping)
            names = np.asarray(tech.to_pylist(), object)
            rank_of = np.argsort(np.argsort(names.astype(str), kind="stable"), kind="stable") if len(names) else np.zeros(0, int)
            order = np.lexsort((rank_of, -np.round(pi, 12), gid))
            rank = np.empty(len(pi), np.int32)
            rank[order] = (np.arange(len(pi)) - first[gid[order]] + 1) if len(pi) else 0
            there = [c > -np.inf for c in cols]
            firsts = sum(((x == 0) & (t == 0) & h).astype(np.int32) for (x, t), h in zip(counts, there))
            seconds = sum(((x <= 1) & h).astype(np.int32) for (x, t), h in zip(counts, there))
            yield pa.RecordBatch.from_arrays(
                [b.column("input_id").take(pa.array(rows)), tech, pa.array(pi), pa.array(rank), pa.array(firsts), pa.array(seconds), pa.array(sum(h.astype(np.int32) for h in there))],
                names=["input_id", "technique_id", "stationary", "fused_rank", "firsts", "seconds", "present"],
            )

    # a null must keep its place in the parallel lists, so the lists hold NaN for it
    item = F.struct("technique_id", *[F.coalesce(F.col(s), F.lit(float("nan"))).alias(s) for s in SCORES])
    lists = candidates.groupBy("input_id").agg(F.collect_list(item).alias("x"))
    return lists.select("input_id", *[F.col(f"x.{c}").alias(c) for c in ("technique_id", *SCORES)]).mapInArrow(walk, OUT)


def unanimous_winners(rerank: DataFrame) -> DataFrame:
    """Candidates of the fused ranking that are strictly first in all scores, or in all but one where at most one candidate betters them (the exact check)."""
    r = fused_ranking(latest_candidates(rerank))
    return r.where((F.col("firsts") == 4) | ((F.col("firsts") == 3) & (F.col("seconds") == 4))).select("input_id", "technique_id")
