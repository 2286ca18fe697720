"""Problems 1, 2, 4 and 6 on small tables: defined cases and brute force."""

import datetime as dt
import itertools
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import annotators, rankfusion, splits, survivorship

RECORDS = "input_id string, source_name string, raw_text string, labels array<string>, provenance string, record_sha256 string, trust int, p string"
SPECS = "source_name string, source_position int, trust int"


def record(i, source, text, labels, sha, **prov):
    return (i, source, text, labels, json.dumps(prov) if prov else None, sha, 99, "clash")


def specs(spark):
    return spark.createDataFrame([("high", 1, 5), ("low", 2, 1), ("high2", 3, 5)], SPECS)


def test_survivorship(spark):
    rows = [
        record("CVE-2020-1", "high", "n/a", ["T1"], "a", severity="high", affected=["x"], updated_at="2087-01-01T00:00:00Z"),
        record("cve_2020_1_augmented_2", "low", "text", None, "b", severity=None, affected=[""], updated_at=3704257080),
        record("CVE_2020_2", "high", "text", ["T1"], "c", severity="high", affected=["x"], updated_at="2087/01/01 00:00:00"),
        record("CVE_2020_2", "high", "text", ["T1"], "c", severity="high", affected=["x"], updated_at="2087/01/01 00:00:00"),
        record("CVE_2020_2", "high2", "other", [""], "d", updated_at="unknown"),
        record("CVE_2020_3", "high", "same", ["T1"], "e", updated_at="20 May 2087 08:18 UTC"),
        record("CVE_2020_3", "high2", "same", ["T2"], "f", updated_at="2087-05-20T08:18:00Z"),
        record("CVE_2020_4", "nowhere", "only", ["T1"], "g"),
        record(None, "high", "x", ["T1"], "h"), record("no id", "high", "x", ["T1"], "i"), record("CVE_2020_5", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    m = {r.base_input_id: r for r in survivorship.merged_records(df, specs(spark)).collect()}
    assert set(m) == {f"CVE_2020_{i}" for i in range(1, 6)}
    one = m["CVE_2020_1"]
    assert (one.raw_text, one.raw_text_from, one.labels, one.labels_from, one.severity, one.affected) == ("text", "b", ["T1"], "a", "high", ["x"])
    assert m["CVE_2020_5"].raw_text is None and m["CVE_2020_5"].raw_text_from is None and m["CVE_2020_4"].raw_text_source == "nowhere"
    assert json.loads(one.provenance) == {"severity": "high", "affected": '["x"]', "updated_at": "2087-01-01T00:00:00Z"} and set(one.provenance_from.values()) == {"a"}
    assert m["CVE_2020_4"].provenance is None and one.sentences is None
    told = df.withColumn("sentences", F.create_map(F.lit("E1"), F.col("raw_text")))
    assert {r.base_input_id: r.sentences for r in survivorship.merged_records(told, specs(spark)).collect()}["CVE_2020_1"] == {"E1": "text"}
    got = {tuple(r) for r in survivorship.dominant_contents(df, specs(spark)).collect()}
    assert got == {("CVE_2020_2", "c"), ("CVE_2020_3", "e"), ("CVE_2020_3", "f")}
    assert survivorship.dominant_contents(df.limit(0), specs(spark)).count() == 0 == survivorship.merged_records(df.limit(0), specs(spark).limit(0)).count()


RERANK = "input_id string, technique_id string, mode string, retrieval_rank int, score_text double, mean_edge_score double, llm_score double, path_cost double, scored_at timestamp, stationary int"


def test_rank_walk(spark):
    t0, t1 = dt.datetime(2080, 1, 1), dt.datetime(2081, 1, 1)
    nan, inf = float("nan"), float("inf")
    rows = [
        ("CVE_2020_1", "T1", "full", 1, 9.0, 0.9, 0.9, 5.0, t1, 0), ("CVE_2020_1", "T2", "full", 1, 8.0, 0.8, 0.8, 1.0, t1, 0), ("CVE_2020_1", "T3", "full", 1, 7.0, 0.7, 7.0, 9.0, t1, 0),
        ("CVE_2020_1", "T3", "full", 1, 99.0, 0.99, 0.99, 0.0, t0, 0), ("cve-2020-1", "T1", "full", 1, 9.0, 0.9, 0.9, 5.0, t1, 0),
        ("CVE_2020_2", "T1", "generic", 1, 9.0, nan, -3.0, inf, None, 0), ("CVE_2020_2", "T2", "generic", 1, None, 2.0, -20.0, 5.0, t1, 0),
        ("CVE_2020_3", "T9", "structure", 1, 1.0, 0.5, 50.0, 5.0, t1, 0), ("CVE_2020_4", "T1", None, None, None, None, None, None, None, 0), (None, "T1", "full", 1, 1.0, 0.1, 0.1, 1.0, t1, 0),
        ("CVE_2020_5", "T1", "full", 1, 1.0, 0.1, 0.1, 1.0, t1, 0), ("CVE_2020_5", "T2", "full", 1, 1.0, 0.1, 0.1, 1.0, t1, 0),
    ]
    df = spark.createDataFrame(rows, RERANK)
    r = {(x.input_id, x.technique_id): x for x in rankfusion.fused_ranking(rankfusion.latest_candidates(df)).collect()}
    assert len(r) == 9 and [r["CVE_2020_1", f"T{i}"].fused_rank for i in (1, 2, 3)] == [1, 2, 3]
    assert r["CVE_2020_5", "T1"].fused_rank == 1 and r["CVE_2020_5", "T1"].stationary == pytest.approx(0.5) == r["CVE_2020_5", "T2"].stationary
    assert r["CVE_2020_4", "T1"].present == 0 and r["CVE_2020_4", "T1"].fused_rank == 1 and r["CVE_2020_2", "T1"].present == 2
    assert {tuple(x) for x in rankfusion.unanimous_winners(df).collect()} == {("CVE_2020_1", "T1"), ("CVE_2020_3", "T9")}
    assert rankfusion.unanimous_winners(df.limit(0)).count() == 0


def test_stationary_against_matrix():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(1, 30))
        scores = [np.where(rng.random(n) < 0.2, -np.inf, np.round(rng.random(n), 1)) for _ in range(4)]
        pi, counts, _, _ = rankfusion.stationary(np.zeros(n, int), scores)
        m = np.zeros((n, n))
        for s in scores:
            for i in range(n):
                to = [j for j in range(n) if s[j] > s[i]] + [i]
                m[i, to] += 1 / (4 * len(to))
        m = 0.85 * m + 0.15 / n
        want = np.full(n, 1 / n)
        for _ in range(2000):
            want = want @ m
        assert np.allclose(pi, want, atol=1e-9)
        assert all((b == [(s > x).sum() for x in s]).all() and (t == [(s == x).sum() - 1 for x in s]).all() for (b, t), s in zip(counts, scores))


REVIEWS = "form_id long, sample_id string, reviewer_1_id string, reviewer_1_decision string, reviewer_2_id string, reviewer_2_decision string, adjudicator_id string, adjudicated_decision string, submitted_at timestamp, annotator int, d int"


def test_annotators(spark):
    t = [dt.datetime(2080, 1, i) for i in range(1, 6)]
    rows = [
        (1, "A", "r1", "Directly Supported ", "r2", "1 - directly supported", "r3", "unsuported", t[0], 0, 0), (2, "A", "r1", "directly_supported", "r2", "directly-supported", "r3", "unsupported.", t[0], 0, 0),
        (3, "B", "r1", "unsupported", "r2", "unsupported", None, "unsupported", t[0], 0, 0), (4, "C", "r1", "directly_supported / unsupported", " ", "unsupported", "r3", None, t[0], 0, 0),
        (5, "D", "r1", "insuficient_text", "r2", "unsupported", "r3", "unsupported", t[1], 0, 0), (6, "D", "r3", "insufficient text", "r4", "insufficient  text", None, None, t[2], 0, 0),
        (7, None, "r1", "unsupported", "r2", "unsupported", "r3", "unsupported", t[0], 0, 0), (8, "E", "r1", "unsupported", None, None, None, None, None, 0, 0), (9, "E", "r1", "directly_supported", "?", "?", None, "", t[0], 0, 0),
    ]
    df = spark.createDataFrame(rows, REVIEWS)
    v = {(r.sample_id, r.annotator): r.decision for r in annotators.votes(df).collect()}
    assert v["A", "r3"] == "unsupported" and v["D", "r3"] == "insufficient_text" and v["E", "r1"] == "directly_supported" and ("C", "r1") not in v and len(v) == 10
    assert {tuple(r) for r in annotators.clear_majorities(df).collect()} == {("A", "directly_supported"), ("D", "insufficient_text")}
    assert annotators.clear_majorities(df.limit(0)).count() == 0
    per = defaultdict(float)
    for r in annotators.consensus(df).collect():
        per[r.sample_id] += r.posterior
    assert all(abs(x - 1) < 1e-9 for x in per.values()) and set(per) == {"A", "B", "D", "E"}


def test_annotator_reliability(spark):
    """A careless annotator gets the lowest reliability, and the posterior finds the truth better than chance ties do."""
    rng = random.Random(3)
    truth, rows = {}, []
    for i in range(150):
        truth[f"s{i}"] = c = rng.choice(annotators.DECISIONS)
        say = lambda good: c if rng.random() < good else rng.choice(annotators.DECISIONS)
        rows.append((i, f"s{i}", "good", say(0.95), "fair", say(0.8), "bad", say(0.1), dt.datetime(2080, 1, 1), 0, 0))
    df = spark.createDataFrame(rows, REVIEWS)
    rel = defaultdict(float)
    for r in annotators.reliability(df).collect():
        assert 0 <= r.low <= r.reliability <= r.high <= 1
        rel[r.annotator] += r.reliability / 4
    assert rel["good"] > rel["fair"] > rel["bad"]
    picked = {r.sample_id: r.decision for r in annotators.consensus(df).where("is_consensus").collect()}
    expected = 0.0  # of a plurality vote that breaks ties by chance
    for r in rows:
        n = Counter(r[3:8:2])
        best = [x for x in n if n[x] == max(n.values())]
        expected += (truth[r[1]] in best) / len(best)
    assert sum(picked[s] == c for s, c in truth.items()) > expected
    a = annotators.krippendorff(df).first()
    units = [[x for x in r[3:8:2]] for r in rows]
    n = sum(map(len, units))
    do = sum(sum(x != y for x in u for y in u) / (len(u) - 1) for u in units) / n
    tot = Counter(x for u in units for x in u)
    de = sum(tot[x] * tot[y] for x in tot for y in tot if x != y) / (n * (n - 1))
    assert a.alpha == pytest.approx(1 - do / de)


def test_rounds_of_both_kinds(spark):
    """Parameters as an array and as a table give the same, and the bound never falls."""
    rng = random.Random(5)
    rows = [(f"s{i}", f"a{k}", rng.choice(annotators.DECISIONS if rng.random() < 0.3 else annotators.DECISIONS[i % 4 : i % 4 + 1])) for i in range(60) for k in range(rng.randrange(1, 6))]
    v = spark.createDataFrame(rows, "sample_id string, annotator string, decision string")
    (p, a, bounds), (q, b, other) = (annotators.variational(v, dense=d) for d in (annotators.DENSE, 0))
    assert bounds == pytest.approx(other) and all(y >= x - 1e-9 for x, y in zip(bounds, bounds[1:])) and bounds[-1] - bounds[-2] <= 1e-6 * 60
    table = lambda df, *key: {tuple(r[k] for k in key): tuple(r) for r in df.collect()}
    for x, y, key in ((p, q, ("sample_id",)), (a, b, ("annotator", "d"))):
        x, y = table(x, *key), table(y.select(x.columns), *key)
        assert x.keys() == y.keys() and all(x[k][len(key) :] == pytest.approx(y[k][len(key) :]) for k in x)
    for d in (annotators.DENSE, 0):
        p, a, bounds = annotators.variational(v.limit(0), dense=d)
        assert p.count() == a.count() == len(bounds) == 0


def test_functions_of_the_model():
    assert annotators.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-9)
    assert annotators.log_gamma(np.array([0.5, 1.0, 7.0, 200.5])) == pytest.approx([math.lgamma(x) for x in (0.5, 1.0, 7.0, 200.5)], abs=1e-9)
    for a, b in ((1.0, 1.0), (2.0, 1.0), (1.0, 4.0), (50.0, 7.0), (4.0, 300.0)):
        x = (np.arange(200_000) + 0.5) / 200_000
        mass = np.cumsum(x ** (a - 1) * (1 - x) ** (b - 1))
        for p in (0.025, 0.5, 0.975):
            got = annotators.beta_quantile(p, np.array([a]), np.array([b]))[0]
            assert got == pytest.approx(np.interp(p, mass / mass[-1], x), abs=1e-4)


ROWS = "row_id long, source_id string, base_input_id string, advisory_id string, labels array<string>, node int, lead int"


def brute_groups(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for r, b, a in rows:
        for k in (b, a):
            if k:
                up[find(("r", r))] = find(k)
    groups = defaultdict(list)
    for r, _, _ in rows:
        groups[find(("r", r))].append(r)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_groups(spark):
    rng = random.Random(4)
    plain, rows = [], []
    for i in range(400):
        base = None if rng.random() < 0.05 else rng.randrange(1, 200)
        adv = rng.choice([None, rng.randrange(1, 120), rng.randrange(1, 120)])
        plain.append((i, base and ("b", base), adv and ("a", adv)))
        wrong = rng.choice([None, "ADV-PENDING", "ADV-000000", "n/a", "ADV-00000000"])
        rows.append((i, f"CVE-2020-{base}_augmented_1" if base else "odd", rng.choice([None, f"cve_2020_{base} "]) if base else None, f"adv {adv:08d} " if adv else wrong, rng.choice([None, [], ["L1"], ["L1", "L2"], ["n/a"]]), 0, 0))
    chain = [(1000 + i, ("b", 1000 + i // 2), ("a", 1000 + (i + 1) // 2)) for i in range(80)]
    plain += chain
    rows += [(r, f"CVE_2020_{b[1]}", None, f"ADV-{a[1]:08d}", ["L3"], 0, 0) for r, b, a in chain]
    df = spark.createDataFrame(rows, ROWS)
    assert {tuple(r) for r in splits.linked_rows(df).collect()} == brute_groups(plain)
    out = splits.allocate(df, (0.7, 0.2, 0.1)).collect()
    assert sorted(r.row_id for r in out) == sorted(r[0] for r in rows)
    side = defaultdict(set)
    for r in out:
        side[r.group_row_id].add(r.assigned_split)
    assert all(len(s) == 1 for s in side.values())
    assert splits.linked_rows(df.limit(0)).count() == 0 == splits.allocate(df.limit(0)).count()


def test_split_shares(spark):
    rng = random.Random(8)
    rows = []
    for g in range(600):
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((len(rows), f"CVE_2020_{g}", None, None, [f"L{g % 5}"], 0, 0))
    out = splits.allocate(spark.createDataFrame(rows, ROWS))
    got = {r.assigned_split: r["count"] / len(rows) for r in out.groupBy("assigned_split").count().collect()}
    assert got["train"] == pytest.approx(0.8, abs=0.01) and got["test"] == pytest.approx(0.1, abs=0.01)
    lab = out.join(spark.createDataFrame([(r[0], r[4][0]) for r in rows], "row_id long, l string"), "row_id").where("assigned_split = 'train'").groupBy("l").count().collect()
    whole = Counter(r[4][0] for r in rows)
    assert all(r["count"] / whole[r.l] == pytest.approx(0.8, abs=0.04) for r in lab)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in splits.allocate(spark.createDataFrame(rows[::-1], ROWS)).collect()}


def test_flow_is_optimal():
    """The flow against every integral flow of small transports."""
    rng = np.random.default_rng(2)
    for _ in range(150):
        n, k = int(rng.integers(1, 5)), int(rng.integers(2, 4))
        left = rng.integers(0, 4, n)
        fair = np.array([m * rng.dirichlet(np.ones(k)) for m in left])
        demand = np.bincount(rng.integers(0, k, left.sum()), minlength=k)
        flow = splits.transport(fair, demand.copy())
        assert (flow >= 0).all() and (flow.sum(axis=1) == left).all() and (flow.sum(axis=0) == demand).all()
        rows = [[c for c in itertools.product(range(m + 1), repeat=k) if sum(c) == m] for m in left]
        best = min(((np.array(c) - fair) ** 2).sum() for c in itertools.product(*rows) if (np.array(c).sum(axis=0) == demand).all())
        assert ((flow - fair) ** 2).sum() == pytest.approx(best)


def test_size_plan():
    """Quotas are met to the row where single rows abound; else no split is off by more than half the largest component more than must be."""
    assert splits.size_plan(np.array([1, 500]), np.array([500, 1]), (0.8, 0.1, 0.1)).tolist() == [[300, 100, 100], [1, 0, 0]]
    assert splits.size_plan(np.array([1, 900]), np.array([100, 1]), (0.8, 0.1, 0.1)).tolist() == [[0, 50, 50], [1, 0, 0]]
    rng, best = np.random.default_rng(1), 0
    for _ in range(100):
        sizes = np.sort(rng.choice(np.arange(1, 40), int(rng.integers(1, 4)), replace=False))
        counts = rng.integers(1, 8, len(sizes))
        plan = splits.size_plan(sizes, counts, (0.8, 0.1, 0.1))
        total = int((sizes * counts).sum())
        want = np.array(splits.quotas(total, (0.8, 0.1, 0.1)))
        assert (plan >= 0).all() and (plan.sum(axis=1) == counts).all() and want.sum() == total
        reach = {(0, 0)}
        for w, n in zip(sizes, counts):
            reach = {(a + i * w, b + j * w) for a, b in reach for i in range(n + 1) for j in range(n - i + 1)}
        least = min(sum((np.array([a, b, total - a - b]) - want) ** 2) for a, b in reach)
        off = sizes @ plan - want
        best += (off**2).sum() == least
        assert np.abs(off).max() <= math.sqrt(least) + sizes.max() / 2
    assert best >= 75
    big = splits.size_plan(np.array([1, 2, 3, 50, 333]), np.array([4000, 900, 300, 40, 3]), (0.8, 0.1, 0.1))
    assert (np.array([1, 2, 3, 50, 333]) @ big).tolist() == splits.quotas(4000 + 1800 + 900 + 2000 + 999, (0.8, 0.1, 0.1))


def test_quotas_with_a_giant(spark):
    """Half of all rows in one group: the others make up for it, to the row, and stay similar in labels."""
    rows = [(i, "CVE_2020_1" if i < 500 else f"CVE_2020_{i}", None, None, [f"L{i % 4}"], 0, 0) for i in range(1000)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.assigned_split: r for r in splits.reached(df).collect()}
    assert {k: (r.wanted_rows, r.n_rows, r.n_parted) for k, r in got.items()} == {"train": (800, 800, 0), "validation": (100, 100, 0), "test": (100, 100, 0)}
    assert all(r.label_deviation < 0.02 for r in got.values())
    assert [tuple(r)[1:] for r in splits.reached(df.limit(0)).collect()] == [(0, 0, 0, 0, 0.0)] * 3
