"""Problem 6: splits that keep related rows together.

Groups are the connected components of rows through base id and real advisory, found by alternating large-star and
small-star steps over edges of row ids; a step only takes minima (combined map-side) and joins them back, so a hot id is
split by adaptive execution, and every step is written to the shared folder.

Method of the allocation: min-cost flow. Components are bundled by identical size and label profile.

1. Quotas. From the number of components of every size alone, largest first, it is decided how many of each size a split
   takes: the numbers nearest to the split's share of all rows seen so far, never above its quota where that can be helped.
   Then components are moved and exchanged between splits while that brings the rows nearer to the quotas.
2. Flow. Within a size every component weighs the same, so the numbers of step 1 are hard, integral capacities of a
   transport from bundles to splits, with the squared deviation from a bundle's fair share as the cost. A bundle's
   whole shares are given in Spark; what is left (fewer components than splits) is bundled by rarest label, and successive
   shortest paths over the splits give the integral optimum, one task a size.
3. Members of a bundle are taken by hash.

The driver holds the histogram of sizes only (at most sqrt(2 x rows) entries). A task of step 2 holds a row per label bin.
Step 2 is optimal. Step 1 is a subset-sum problem over vectors, which is NP-hard; where small components are not lacking
it meets the quotas to the row, and the tests compare it with exhaustive search.

Defined cases: rows without base id (none readable in base_input_id and source_id) and advisory are groups of their own;
stand-ins, pending and all-zero advisories join nothing; null label lists count as no label; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..session import discard, materialise

NAMES = ("train", "validation", "test")
#: Labels are told apart by a hash of this many values, so that a task's bundles have a bound.
LABEL_BINS = 1 << 16


def links(source_rows: DataFrame) -> DataFrame:
    """row_id with its base id and advisory, either null."""
    base = F.coalesce(N.base_id(F.col("base_input_id")), N.base_id(F.col("source_id")))
    return source_rows.select("row_id", base.alias("base"), N.advisory_id(F.col("advisory_id")).alias("advisory"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (u, v): root is the least node of its component.

    The root itself has no row. Fails rather than return unfinished components if ``max_rounds`` do not suffice.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
        small = large.join(low, "u").select(F.explode(pairs).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        done, e = e, materialise(small.where("u <> v").distinct(), "edges")
        discard(done)
        new = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum("v").alias("s")).first()
        if state is not None and tuple(new) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(new)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def groups(source_rows: DataFrame) -> DataFrame:
    """(row_id, group_row_id): the least row id of the group of every row."""
    r = links(source_rows)
    # all rows of a base id stand together: the least row id represents it
    lead = r.where("base is not null").groupBy("base").agg(F.min("row_id").alias("lead"))
    r = materialise(r.join(lead, "base", "left").select("row_id", F.coalesce("lead", "row_id").alias("lead"), "advisory"), "rows")
    tie = r.where("advisory is not null").select("advisory", "lead").distinct()
    first = tie.groupBy("advisory").agg(F.min("lead").alias("v"))
    root = components(tie.join(first, "advisory").select(F.col("lead").alias("u"), "v"))
    return r.join(root, r.lead == root.node, "left").select("row_id", F.coalesce("root", "lead").alias("group_row_id"))


def linked_rows(source_rows: DataFrame) -> DataFrame:
    """Every row but the first of its group, with that first row."""
    return groups(source_rows).where("row_id <> group_row_id").select("group_row_id", "row_id")


def quotas(rows: int, shares: Sequence[float]) -> list[int]:
    """Whole rows for each split that add up to ``rows``: rounded down, the rest by largest fraction, then by order."""
    exact = [rows * s / sum(shares) for s in shares]
    out = [int(x + 1e-9) for x in exact]
    for s in sorted(range(len(out)), key=lambda s: (out[s] - exact[s], s))[: rows - sum(out)]:
        out[s] += 1
    return out


def _nearest(w: int, n: int, target: list[float], cap: list[int]) -> list[int]:
    """Whole numbers up to ``cap``, adding up to n, for which w times them is nearest to ``target`` (least squares)."""
    k = len(cap)
    lo, hi = min(target) / w - max(cap) - 1, max(target) / w + 1
    for _ in range(80):  # of the numbers before rounding, all that are not at a bound lie equally far from their targets
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(max(t / w - mid, 0), c) for t, c in zip(target, cap)) > n else (lo, mid)
    out = [int(min(max(t / w - hi, 0), c) + 1e-9) for t, c in zip(target, cap)]
    cost = lambda s, x: (target[s] - w * x) ** 2
    while (short := n - sum(out)) != 0:
        step = 1 if short > 0 else -1
        able = [s for s in range(k) if 0 <= out[s] + step <= cap[s]]
        s = min(able, key=lambda s: (cost(s, out[s] + step) - cost(s, out[s]), s))
        out[s] += step
    while True:
        moves = [
            (cost(s, out[s] - 1) - cost(s, out[s]) + cost(t, out[t] + 1) - cost(t, out[t]), s, t)
            for s in range(k) for t in range(k) if s != t and out[s] > 0 and out[t] < cap[t]
        ]
        if not moves or min(moves)[0] >= -1e-6:
            return out
        _, s, t = min(moves)
        out[s], out[t] = out[s] - 1, out[t] + 1


def size_plan(sizes: np.ndarray, counts: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """plan[i, s]: how many of the ``counts[i]`` components of ``sizes[i]`` rows (distinct) split s takes."""
    k = len(shares)
    plan = np.zeros((len(sizes), k), np.int64)
    share = [s / sum(shares) for s in shares]
    quota = quotas(int((sizes * counts).sum()), shares)
    held, seen = [0] * k, 0
    for i in np.argsort(-sizes, kind="stable"):
        w, n = int(sizes[i]), int(counts[i])
        seen += w * n
        room = [q - h for q, h in zip(quota, held)]
        cap = [max(r, 0) // w for r in room]
        over = sorted(range(k), key=lambda s: (w * (cap[s] + 1) - max(room[s], 0), -room[s], s))
        for s in over[: max(n - sum(cap), 0)]:  # fewer than k components fit nowhere: where they exceed least
            cap[s] += 1
        plan[i] = _nearest(w, n, [share[s] * seen - held[s] for s in range(k)], cap)
        held = [h + w * int(x) for h, x in zip(held, plan[i])]
    return _exchanged(sizes, plan, np.array(quota) - np.array(held))


def _exchanged(sizes: np.ndarray, plan: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The plan after moves of one component, and exchanges of one for another or for none, for as long as they bring the rows nearer to the quotas."""
    k = plan.shape[1]
    order = np.argsort(sizes, kind="stable")
    while True:
        best = (0, None)
        for s in range(k):
            for t in range(k):
                gap = int(room[t] - room[s])  # what s has too much against t
                if s == t or gap <= 0:
                    continue
                give = order[plan[order, s] > 0]
                take = order[plan[order, t] > 0]
                back = np.r_[0, sizes[take]]
                if not len(give):
                    continue
                at = np.searchsorted(back, sizes[give] - gap / 2).clip(0, len(back) - 1)
                for near in (at, np.maximum(at - 1, 0)):
                    d = sizes[give] - back[near]
                    gain = np.where(d > 0, d * gap - d * d, 0)  # half of what the squares lose
                    x = int(np.argmax(gain))
                    if gain[x] > best[0]:
                        best = (int(gain[x]), (s, t, int(give[x]), int(take[near[x] - 1]) if near[x] else None, int(d[x])))
        if best[1] is None:
            return plan
        s, t, i, j, d = best[1]
        plan[i, s], plan[i, t] = plan[i, s] - 1, plan[i, t] + 1
        if j is not None:
            plan[j, t], plan[j, s] = plan[j, t] - 1, plan[j, s] + 1
        room[s], room[t] = room[s] + d, room[t] - d


def transport(fair: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Integral flow[b, s] of least squared deviation from ``fair``, with the rows' sums of ``fair`` and the columns' sums ``demand``.

    Every bundle starts at its own optimum; while a split has too much, a unit goes along the cheapest path over splits
    (each step moves a component of one bundle) to a split that lacks one. Costs are convex and the start has no
    cycle that pays, so the flow is optimal when all demands are met.
    """
    n, k = fair.shape
    flow = np.floor(fair + 1e-9).astype(np.int64)
    rest = np.rint(fair.sum(axis=1)).astype(np.int64) - flow.sum(axis=1)
    rank = np.argsort(np.argsort(flow - fair, axis=1, kind="stable"), axis=1, kind="stable")
    flow += rank < rest[:, None]
    over = flow.sum(axis=0) - demand
    while (over > 0).any():
        off = flow - fair
        less, more = np.where(flow > 0, 1 - 2 * off, np.inf), 1 + 2 * off
        cost, via = np.full((k, k), np.inf), np.zeros((k, k), int)
        for s in range(k):
            for t in range(k):
                if s != t:
                    via[s, t] = int(np.argmin(less[:, s] + more[:, t]))
                    cost[s, t] = less[via[s, t], s] + more[via[s, t], t]
        far = np.where(over > 0, 0.0, np.inf)
        before = np.full(k, -1)
        for _ in range(k):
            for s in range(k):
                for t in range(k):
                    if far[s] + cost[s, t] < far[t] - 1e-9:
                        far[t], before[t] = far[s] + cost[s, t], s
        t = int(np.argmin(np.where(over < 0, far, np.inf)))
        over[t] += 1
        while before[t] >= 0:
            s = int(before[t])
            flow[via[s, t], s] -= 1
            flow[via[s, t], t] += 1
            t = s
        over[t] -= 1
    return flow


def described(source_rows: DataFrame, g: DataFrame, seed: int) -> DataFrame:
    """(group_row_id, size, profile, rare, h) of every component: its rows, a hash of its labels, the bin of the rarest of them, its place by hash."""
    labels = source_rows.select("row_id", F.explode("labels").alias("label")).where(N.usable(F.col("label")))
    support = labels.groupBy("label").agg(F.count("*").alias("support"))
    of_group = labels.join(g, "row_id").select("group_row_id", "label").distinct().join(support, "label")
    profile = of_group.groupBy("group_row_id").agg(
        F.min(F.struct("support", "label")).alias("rare"), F.bit_xor(F.xxhash64("label")).alias("x"), F.count("*").alias("n_labels")
    )
    size = g.groupBy("group_row_id").agg(F.count("*").alias("size"))
    return size.join(profile, "group_row_id", "left").select(
        "group_row_id", "size", F.xxhash64(F.coalesce("x", F.lit(0)), F.coalesce("n_labels", F.lit(0))).alias("profile"),
        F.coalesce(F.pmod(F.xxhash64("rare.label"), F.lit(LABEL_BINS)), F.lit(-1)).alias("rare"), F.xxhash64(F.lit(seed), "group_row_id").alias("h"),
    )


def allocate(source_rows: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 13) -> DataFrame:
    """(row_id, group_row_id, assigned_split) for every row."""
    spark, k = source_rows.sparkSession, len(shares)
    g = materialise(groups(source_rows), "groups")
    comp = materialise(described(source_rows, g, seed), "bundles")
    table = comp.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").toPandas()  # distinct sizes: at most sqrt(2 x rows)
    counts = table["n"].to_numpy(np.int64)
    plan = size_plan(table["size"].to_numpy(np.int64), counts, shares)
    each = range(k)
    schema = "size long, n_size long, " + ", ".join(f"t{s} long" for s in each)
    of_size = spark.createDataFrame([(int(w), int(n), *map(int, p)) for w, n, p in zip(table["size"], counts, plan)], schema)
    # whole shares of every bundle, in whole numbers
    whole = [F.expr(f"cast(n as decimal(19,0)) * cast(t{s} as decimal(19,0)) div n_size").alias(f"w{s}") for s in each]
    part = [(F.col("n") / F.col("n_size") * F.col(f"t{s}") - F.col(f"w{s}")).alias(f"f{s}") for s in each]
    key = ["size", "profile", "rare"]
    bundle = comp.groupBy(*key).agg(F.count("*").alias("n")).join(of_size, "size").select("*", *whole).select(*key, "n", *[f"w{s}" for s in each], *part)
    bundle = materialise(bundle, "whole")
    left = bundle.groupBy("size", "rare").agg(*[F.sum(f"f{s}").alias(f"f{s}") for s in each])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rare").reset_index(drop=True)
        fair = pdf[[f"f{s}" for s in each]].to_numpy(float)
        flow = transport(fair, np.rint(fair.sum(axis=0)).astype(np.int64))
        return pd.concat([pdf[["size", "rare"]], pd.DataFrame(np.cumsum(flow, axis=1), columns=[f"u{s}" for s in each])], axis=1)

    given = left.groupBy("size").applyInPandas(solve, "size long, rare long, " + ", ".join(f"u{s} long" for s in each))
    numbered = materialise(_numbered(comp, key).join(bundle.select(*key, *[f"w{s}" for s in each]), key), "numbered")
    split, upper = F.lit(None).cast("int"), F.lit(0).cast("long")
    for s in each:
        lower, upper = upper, upper + F.col(f"w{s}")
        split = F.when((F.col("no") > lower) & (F.col("no") <= upper), F.lit(s)).otherwise(split)
    numbered = numbered.select("group_row_id", "size", "rare", "h", split.alias("split"))
    rest = numbered.where("split is null").select("group_row_id", "size", "rare", "h")
    picked = _numbered(rest, ["size", "rare"]).join(given, ["size", "rare"])
    to = F.coalesce(*[F.when(F.col("no") <= F.col(f"u{s}"), F.lit(s)) for s in each])
    both = numbered.where("split is not null").select("group_row_id", "split").unionByName(picked.select("group_row_id", to.alias("split")))
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("split") + 1)
    return g.join(both, "group_row_id").select("row_id", "group_row_id", name.alias("assigned_split"))


def _numbered(df: DataFrame, key: list[str], slices: int = 512) -> DataFrame:
    """``no``: 1, 2, ... within ``key`` by hash, numbered per slice of the hash plus the rows of earlier slices."""
    d = df.withColumn("_slice", F.pmod(F.shiftright("h", 40), F.lit(slices)))
    per = d.groupBy(*key, "_slice").agg(F.count("*").alias("_n"))
    before = per.select(*key, "_slice", (F.sum("_n").over(Window.partitionBy(*key).orderBy("_slice")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy(*key, "_slice").orderBy("h", "group_row_id")
    numbered = d.withColumn("_k", F.row_number().over(w)).join(before, [*key, "_slice"])
    return numbered.withColumn("no", F.col("_k") + F.col("_before")).drop("_slice", "_k", "_before")


def reached(source_rows: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 13) -> DataFrame:
    """Per split: rows wanted and given, components, components that other splits hold rows of as well, and how far labels are off.

    ``label_deviation``: the sum over labels of the difference to the split's share of the label's rows, over all labelled rows.
    """
    a = materialise(allocate(source_rows, shares, seed), "allocated")
    total = a.count()
    wanted = source_rows.sparkSession.createDataFrame(list(zip(NAMES, quotas(total, shares), [float(s) / sum(shares) for s in shares])), "assigned_split string, wanted_rows long, share double")
    held = a.groupBy("assigned_split", "group_row_id").agg(F.count("*").alias("n"))
    parted = held.groupBy("group_row_id").agg(F.count("*").alias("splits")).where("splits > 1").select("group_row_id", F.lit(1).alias("parted"))
    per = held.join(parted, "group_row_id", "left").groupBy("assigned_split").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count("parted").alias("n_parted")
    )
    labels = source_rows.select("row_id", F.explode("labels").alias("label")).where(N.usable(F.col("label")))
    of = labels.join(a, "row_id").groupBy("label").agg(F.count("*").alias("m"), *[F.sum((F.col("assigned_split") == n).cast("long")).alias(f"c{i}") for i, n in enumerate(NAMES[: len(shares)])])
    off = [F.sum(F.abs(F.col(f"c{i}") - F.col("m") * float(s) / float(sum(shares)))) / F.sum("m") for i, s in enumerate(shares)]
    dev = of.agg(F.array(*off).alias("d")).scalar()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    place = F.array_position(F.array(*map(F.lit, NAMES)), F.col("assigned_split")).cast("int")
    out = wanted.join(per, "assigned_split", "left").withColumn("d", dev)
    return out.select("assigned_split", "wanted_rows", zero("n_rows"), zero("n_groups"), zero("n_parted"), F.coalesce(F.element_at("d", place), F.lit(0.0)).alias("label_deviation"))
