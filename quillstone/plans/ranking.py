"""Queries over retrieval, ranking metrics and their comparison, with the SQL each equals.

Inputs: records merged per base id are the queries, techniques the catalogue, the records' valid labels the gold, and the
scored candidates of ``rerank`` four methods (one per score) with two runs (best and worst row of a candidate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.scores import min_max, within
from ..functions.text import technique_id, tokens
from ..operators import audit, dataset, metrics, reports, retrieval, significance
from ..session import materialise, table
from . import sqltext as S

METHODS = ("edge", "llm", "path", "text")
#: The grids of the reference's experiment, and the length of a candidate list.
ALPHAS = [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0]
LENGTHS = (5, 10, 15, 20, 30, 50)
BETAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
TOP = 20
#: Scores are rounded to fewer digits than by default (12), for sums in another order to give equal texts in SQL.
DIGITS = 6


#: The range of llm_score in each mode.
LLM_RANGES = {"full": (0.0, 1.0), "structure": (0.0, 100.0), "evidence": (-10.0, 10.0), "generic": (-10.0, 10.0)}


def valid_scores() -> dict[str, Column]:
    """The score of each method, more being better; null where it is outside of its range."""
    llm = F.coalesce(*[F.when(F.lower(N.squeeze(F.col("mode"))) == m, within(F.col("llm_score"), lo, hi)) for m, (lo, hi) in LLM_RANGES.items()])
    return {"edge": within(F.col("mean_edge_score"), 0.0, 1.0), "llm": llm, "path": -within(F.col("path_cost"), 0.0, 1e6, True), "text": within(F.col("score_text"), 0.0, float("inf"))}


def valid_sql() -> dict[str, str]:
    llm = " or ".join(f"mode = '{m}' and llm_score between {lo} and {hi}" for m, (lo, hi) in LLM_RANGES.items())
    return {
        "edge": "case when mean_edge_score between 0 and 1 then mean_edge_score end", "llm": f"case when {llm} then llm_score end",
        "path": "case when path_cost >= 0 and path_cost < 1000000 then -path_cost end", "text": "case when score_text >= 0 and isfinite(score_text) then score_text end",
    }


def merged(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "records").withColumn("base", N.base_id(F.col("input_id"))).where("base is not null")
    view = r.groupBy("base").agg(F.max(F.get_json_object("provenance", "$.affected")).alias("structure"))
    return dataset.merge_sources(r).join(view, "base").withColumnRenamed("base", "query_id")


def catalogue(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "techniques").where("text is not null")


def gold(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "records").select(N.base_id(F.col("input_id")).alias("input_id"), F.explode("labels").alias("l"))
    ids = table(s, d, "techniques").select("technique_id")
    return r.select("input_id", technique_id(F.col("l")).alias("technique_id")).where("input_id is not null").join(ids, "technique_id", "left_semi").select("input_id", "technique_id").distinct()


def rankings(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "rerank").withColumn("input_id", N.base_id(F.col("input_id")))
    value = valid_scores()
    g = r.groupBy("input_id", "technique_id").agg(*[x for m, v in value.items() for x in (F.max(v).alias(f"{m}1"), F.min(v).alias(f"{m}2"))])
    long = g.select("input_id", "technique_id", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("run"), F.col(f"{m}{k}").alias("score")) for m in METHODS for k in (1, 2)])))
    from pyspark.sql import Window

    w = Window.partitionBy("method", "run", "input_id").orderBy(F.desc_nulls_last("score"), "technique_id")
    return long.withColumn("rank", F.row_number().over(w))


def samples(s: SparkSession, d: str) -> DataFrame:
    return metrics.per_input(metrics.relevance(rankings(s, d), gold(s, d)))


def views(s: SparkSession, d: str) -> DataFrame:
    return merged(s, d).select("query_id", F.col("raw_text").alias("text"), "structure")


def sweep(s: SparkSession, d: str) -> DataFrame:
    """Means of every alpha and list length. Lists are ranked once, to the greatest length, and measured at every length in one pass."""
    g = retrieval.retrieve_grid(views(s, d), catalogue(s, d), ALPHAS, LENGTHS[-1], digits=DIGITS).withColumnRenamed("query_id", "input_id")
    g = g.select(F.col("alpha").cast("string").alias("method"), F.lit(0).alias("run"), "input_id", "technique_id", "rank")
    names = ("coverage", "macro_recall", "precision", "map", "mrr")
    rel = metrics.per_input_sweep(g, materialise(gold(s, d), "gold"), LENGTHS)  # its size in files decides how it is joined
    per = rel.groupBy("method").agg(F.count("*").alias("n"), *[F.round(F.avg(f"{m}_{k}"), 6).alias(f"{m}_{k}") for k in LENGTHS for m in names])
    return per.select("method", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("run"), *[F.col(f"{m}_{k}").alias(m) for m in names]) for k in LENGTHS])))


def winner(table_of_runs: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Within tolerance of the best coverage: the shortest list, then coverage, mrr, recall, the middle alpha."""
    from pyspark.sql import Window

    best = F.max("coverage").over(Window.partitionBy())
    near = table_of_runs.withColumn("_b", best).where(F.col("coverage") >= F.col("_b") - tolerance - 1e-12).drop("_b")
    a = F.col("method").cast("double")
    return near.orderBy("run", F.desc("coverage"), F.desc("mrr"), F.desc("macro_recall"), F.abs(a - 0.5), a).limit(1)


def beta_grid(s: SparkSession, d: str, betas: tuple[float, ...] = BETAS) -> DataFrame:
    """Rankings per beta: beta of the text score and the rest of the llm score, both scaled within a record."""
    r = rankings(s, d).where("method in ('text', 'llm')").withColumn("v", F.coalesce("score", F.lit(0.0)))
    g = r.groupBy("run", "input_id", "technique_id").agg(F.max(F.when(F.col("method") == "text", F.col("v"))).alias("t"), F.max(F.when(F.col("method") == "llm", F.col("v"))).alias("l"))
    g = g.withColumn("t", F.round(min_max(F.col("t"), "run", "input_id"), 9)).withColumn("l", F.round(min_max(F.col("l"), "run", "input_id"), 9))
    g = g.withColumn("beta", F.explode(F.array(*map(F.lit, betas))))
    from pyspark.sql import Window

    g = g.withColumn("final", F.round(F.col("beta") * F.col("t") + (1 - F.col("beta")) * F.col("l"), 7))
    w = Window.partitionBy("beta", "run", "input_id").orderBy(F.desc("final"), F.desc("l"), F.desc("t"), "technique_id")
    return g.select(F.col("beta").cast("string").alias("method"), "run", "input_id", "technique_id", F.row_number().over(w).alias("rank"))


def beta_table(s: SparkSession, d: str) -> DataFrame:
    m = metrics.per_input(metrics.relevance(beta_grid(s, d), gold(s, d)))
    per = m.groupBy("method", "run").agg(F.avg("hit_1").alias("h"), F.avg("mrr").alias("m"))
    return per.groupBy("method").agg(F.round(F.avg("h"), 6).alias("hit_1"), F.round(F.avg("m"), 6).alias("mrr"), F.round(F.coalesce(F.stddev_samp("h"), F.lit(0.0)), 6).alias("sd_runs"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def queries() -> dict:
    def rel(s, d):
        return metrics.relevance(rankings(s, d), gold(s, d))

    def pairs(s, d, m="mrr", run=None):
        x = samples(s, d)
        x = metrics.over_runs(x, m) if run is None else x.where(F.col("run") == run)
        return significance.paired(x, m)

    def holm(s, d):
        p = significance.mcnemar(pairs(s, d, "hit_1", 1)).select("left_method", "right_method", F.round("p_value", 6).alias("p_value"))
        return significance.holm(p, "p_value", "left_method", "right_method")

    def scored_only(s, d):
        """One run whose lists hold scored candidates only, so that some records have an empty list."""
        return rankings(s, d).where("method = 'llm' and run = 2 and score is not null")

    def by_text(s, d):
        return catalogue(s, d)

    def top_fused(s, d):
        return retrieval.retrieve_grid(views(s, d), by_text(s, d), [0.6], TOP, digits=DIGITS).drop("alpha")

    def best_beta(s, d):
        return beta_table(s, d).orderBy(F.desc("hit_1"), F.desc("mrr"), "sd_runs", F.col("method").cast("double").desc()).limit(1)

    return {
        "token_stats": lambda s, d: table(s, d, "documents").select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct")),
        "idf_table": lambda s, d: rounded(retrieval.idf(by_text(s, d))),
        "tf_weights": lambda s, d: rounded(retrieval.weights(by_text(s, d), retrieval.idf(by_text(s, d)), "technique_id", "text")),
        "retrieve_topn": lambda s, d: retrieval.retrieve(views(s, d), by_text(s, d), TOP, digits=DIGITS),
        "retrieve_fused": top_fused,
        "parent_collapse": lambda s, d: retrieval.retrieve_parents(views(s, d), by_text(s, d), 0.6, digits=DIGITS),
        "score_minmax": lambda s, d: rounded(retrieval.retrieve_scaled(views(s, d), by_text(s, d), digits=DIGITS)),
        "alpha_topn_sweep": sweep,
        "sweep_winner": lambda s, d: winner(sweep(s, d)),
        "rank_metrics": lambda s, d: rounded(samples(s, d)),
        "metrics_macro": lambda s, d: rounded(metrics.macro(samples(s, d), "mrr", "hit_1", "precision_3", "recall_5", "ap_5")),
        "metrics_micro": lambda s, d: rounded(metrics.micro(samples(s, d))),
        "candidate_coverage": lambda s, d: rounded(metrics.coverage(samples(s, d))),
        "first_hit_distribution": lambda s, d: rounded(metrics.first_hits(samples(s, d))),
        "per_technique_recall": lambda s, d: rounded(metrics.per_technique(rel(s, d), gold(s, d))),
        "long_tail": lambda s, d: rounded(metrics.long_tail(metrics.per_technique(rel(s, d), gold(s, d)))),
        "candidate_signatures": lambda s, d: metrics.signatures(rankings(s, d)),
        "unfair_inputs": lambda s, d: metrics.unfair_inputs(metrics.signatures(rankings(s, d).where("score is not null"))),
        "missing_inputs": lambda s, d: metrics.missing_inputs(rankings(s, d), gold(s, d)),
        "parent_rankings": lambda s, d: metrics.keep_first(rankings(s, d).withColumn("technique_id", F.element_at(F.split("technique_id", r"\."), 1))),
        "pairwise_differences": lambda s, d: rounded(significance.differences(pairs(s, d))),
        "mcnemar_exact": lambda s, d: rounded(significance.mcnemar(pairs(s, d, "hit_1", 1))),
        "holm_adjusted": lambda s, d: rounded(holm(s, d)),
        "quantile_interval": lambda s, d: rounded(significance.percentile_interval(metrics.over_runs(samples(s, d), "mrr"), "method", "mrr")),
        "sign_flip": lambda s, d: significance.sign_flip(pairs(s, d), 20000),
        "bootstrap_interval": lambda s, d: significance.bootstrap(metrics.over_runs(samples(s, d), "mrr"), "mrr", 5000),
        "beta_sweep": beta_table,
        "beta_winner": best_beta,
        "first_hit_shares": lambda s, d: rounded(reports.first_hit_shares(samples(s, d))),
        "metric_summary": lambda s, d: rounded(reports.summary(samples(s, d), metrics.per_technique(rel(s, d), gold(s, d)), "text")),
        "metrics_intervals": lambda s, d: reports.with_intervals(samples(s, d), ["mrr", "hit_1"]),
        "bootstrap_difference": lambda s, d: significance.bootstrap_differences(pairs(s, d)),
        "retrieval_baseline": lambda s, d: reports.retrieval_baseline(rankings(s, d).where("method = 'llm'"), rankings(s, d).where("method = 'text'"), "retrieved"),
        "evaluation_ids": lambda s, d: reports.evaluation_ids(rankings(s, d).where("score is not null"), gold(s, d)),
        "strict_id_problems": lambda s, d: reports.strict_id_problems(rankings(s, d).where("score is not null"), gold(s, d)),
        "coverage_by_view": lambda s, d: reports.coverage_by_view(gold(s, d), scored_only(s, d), rankings(s, d), table(s, d, "techniques"), (1, 3, 5)),
        "coverage_reasons": lambda s, d: reports.coverage_by_view(gold(s, d), scored_only(s, d), rankings(s, d), table(s, d, "techniques"), (1, 3, 5)).groupBy("view", "k", "status").agg(F.count("*").alias("n")),
        "technique_coverage": lambda s, d: reports.technique_coverage(gold(s, d), scored_only(s, d), table(s, d, "techniques"), (1, 3, 5)),
        "gold_index_status": lambda s, d: audit.gold_index_status(gold(s, d), table(s, d, "techniques")),
        "coverage_status": lambda s, d: audit.coverage_status(gold(s, d), rankings(s, d).where("method = 'text' and run = 1"), by_text(s, d), (1, 3, 5)),
        "coverage_by_k": lambda s, d: audit.coverage_status(gold(s, d), rankings(s, d).where("method = 'text' and run = 1"), by_text(s, d), (1, 3, 5)).groupBy("k", "status").agg(F.count("*").alias("n")),
        "technique_parents": lambda s, d: audit.technique_parent(table(s, d, "techniques"), gold(s, d)),
        "label_frequency": lambda s, d: gold(s, d).groupBy("technique_id").agg(F.count("*").alias("support")),
    }


def oracle_sql() -> dict[str, str]:
    tok = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: length(w) > 2 and not (regexp_full_match(w, '[0-9]+') and length(w) <= 3))"
    merged_ = f"""r0 as (select *, {S.base('input_id')} base from records), r1 as (select * from r0 where base is not null),
        m as (select base query_id, max(provenance ->> '$.affected') structure, first(raw_text order by -length(raw_text), source_position, source_record_order, record_sha256) filter (where raw_text is not null) raw_text from r1 group by base)"""
    cat = "it as (select technique_id, text from techniques where text is not null)"
    vocab = f"""tt as (select technique_id, unnest({tok.format('text')}) token from it), tc as (select technique_id, token, count(*) tf from tt group by 1, 2),
        vo as (select token, count(*) df, ln(((select count(*) from it) + 1) / cast(count(*) + 1 as double)) + 1 idf from tc group by 1),
        tw as (select technique_id, token, (1 + ln(tf)) * idf w from tc join vo using (token)), tn as (select technique_id, sqrt(sum(w * w)) nb from tw group by 1)"""

    def view(name: str, col: str) -> str:
        return f"""q{name} as (select query_id, token, count(*) tf from (select query_id, unnest({tok.format(col)}) token from m) group by 1, 2),
        w{name} as (select query_id, token, (1 + ln(tf)) * idf w from q{name} join vo using (token)), n{name} as (select query_id, sqrt(sum(w * w)) na from w{name} group by 1),
        s{name} as (select query_id, technique_id, round(greatest(0, least(1, dot / (na * nb))), 6) score from (select query_id, technique_id, sum(a.w * b.w) dot from w{name} a join tw b using (token) group by 1, 2) join n{name} using (query_id) join tn using (technique_id))"""

    both = f"with {merged_}, {cat}, {vocab}, {view('t', 'raw_text')}, {view('s', 'structure')}"
    every = "(select query_id from m) cross join (select technique_id from it)"
    fu = both + f", f as (select query_id, technique_id, round_even(0.6::double * coalesce(a.score, 0) + 0.4::double * coalesce(b.score, 0), 6) score_fused, coalesce(a.score, 0) score_text, coalesce(b.score, 0) score_structure from {every} left join st a using (query_id, technique_id) left join ss b using (query_id, technique_id))"
    go = f"gold as (select distinct {S.base('input_id')} input_id, upper(trim(l)) technique_id from (select input_id, unnest(labels) l from records) where {S.base('input_id')} is not null and upper(trim(l)) in (select technique_id from techniques))"
    ra = "rk as (select *, row_number() over (partition by method, run, input_id order by score desc nulls last, technique_id) rank from (" + " union all ".join(
        f"select '{m}' as method, {k} as run, {S.base('input_id')} input_id, technique_id, {agg}({v}) score from rerank group by 3, 4" for m, v in valid_sql().items() for k, agg in ((1, "max"), (2, "min"))
    ) + "))"

    def met(src: str = "rk") -> str:
        return f"""ng as (select input_id, count(*) n_gold from gold group by 1),
        re as (select k.*, n_gold, cast(g.technique_id is not null as int) rel from {src} k join ng using (input_id) left join gold g on g.input_id = k.input_id and g.technique_id = k.technique_id),
        rs as (select *, sum(rel) over (partition by method, run, input_id order by rank) seen from re),
        pi as (select method, run, input_id, max(n_gold) n_gold, coalesce(1.0::double / min(rank) filter (where rel = 1), 0) mrr, min(rank) filter (where rel = 1) first_hit,
            {', '.join(f"cast(coalesce(sum(rel) filter (where rank <= {k}), 0) as bigint) hits_{k}, coalesce(sum(seen::double / rank) filter (where rank <= {k} and rel = 1), 0) / least(max(n_gold), {k}) ap_{k}" for k in (1, 3, 5))} from rs group by 1, 2, 3),
        pm as (select *, {', '.join(f"cast(hits_{k} > 0 as double) hit_{k}, hits_{k}::double / {k} precision_{k}, hits_{k}::double / n_gold recall_{k}" for k in (1, 3, 5))} from pi)"""

    mm = f"with {go}, {ra}, {met()}"
    names = ["mrr", "hit_1", "precision_3", "recall_5", "ap_5"]
    over = mm + ", ov as (select method, input_id, " + ", ".join(f"avg({x}) {x}" for x in names) + " from pm group by 1, 2)"
    pairs = ", pr as (select a.method left_method, b.method right_method, a.input_id, a.{0} lv, b.{0} rv from {1} a join {1} b on a.input_id = b.input_id and a.method < b.method)"
    mcn = mm + ", r1_ as (select * from pm where run = 1)" + pairs.format("hit_1", "r1_") + """, bc as (select left_method, right_method, cast(sum(cast(lv = 1 and rv = 0 as int)) as bigint) left_only, cast(sum(cast(lv = 0 and rv = 1 as int)) as bigint) right_only from pr group by 1, 2),
        mc as (select *, case when left_only + right_only = 0 then 1.0::double else least(1.0::double, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from (select left_only + right_only n), generate_series(0, least(left_only, right_only)) g(i))) end p from bc)"""
    tech = mm + """, su as (select technique_id, count(*) support from gold group by 1), ru as (select distinct method, run from re),
        hi as (select method, run, technique_id, count(*) h from re where rel = 1 and rank <= 5 group by 1, 2, 3),
        pt as (select method, technique_id, max(support) support, avg(coalesce(h, 0)::double / support) recall, coalesce(stddev_samp(coalesce(h, 0)::double / support), 0) sd_runs from ru cross join su left join hi using (method, run, technique_id) group by 1, 2)"""
    every_metric = ["mrr", *[f"{m}_{k}" for m in ("hit", "precision", "recall", "ap") for k in (1, 3, 5)]]
    views_ = f"""with {go}, {ra}, up as (select distinct technique_id, coalesce(parent_technique_id, case when split_part(technique_id, '.', 1) in (select technique_id from techniques where not coalesce(revoked, false) and not coalesce(deprecated, false)) then split_part(technique_id, '.', 1) end, technique_id) parent_id from techniques),
        gp as (select * from gold join up using (technique_id)), r1 as (select * from rk where method = 'llm' and run = 2), r2 as (select * from r1 where score is not null),
        golds as (select 'exact' as view, input_id, technique_id from gold union all select distinct 'parent', input_id, parent_id from gp),
        ranks as (select 'exact' as view, input_id, technique_id, rank from r2 union all select 'parent', input_id, parent_id, row_number() over (partition by input_id order by r) from (select input_id, parent_id, min(rank) r from r2 join up using (technique_id) group by 1, 2)),
        act as (select distinct technique_id from techniques where not coalesce(revoked, false) and not coalesce(deprecated, false)),
        pv as (select view, input_id, max(cast(technique_id in (select technique_id from act) as int)) ai from golds group by 1, 2),
        nv as (select view, input_id, count(*) n from ranks group by 1, 2), fv as (select view, input_id, min(rank) first_hit from ranks join golds using (view, input_id, technique_id) group by 1, 2),
        st as (select view, input_id, k, first_hit, case when ai = 0 then 'gold_not_indexed' when input_id not in (select input_id from rk) then 'no_candidates' when n is null then 'no_candidate_in_list' when first_hit is null then 'absent' when first_hit <= k then 'covered' else 'beyond_k' end status
            from pv left join nv using (view, input_id) left join fv using (view, input_id) cross join (select unnest([1, 3, 5]) k))"""
    bucket = "case when first_hit is null then 'miss' when first_hit = 1 then '1' when first_hit <= 3 then '2-3' when first_hit <= 5 then '4-5' when first_hit <= 10 then '6-10' when first_hit <= 20 then '11-20' else '>20' end"
    cov = f"""with {go}, {ra}, t1 as (select * from rk where method = 'text' and run = 1), {cat},
        pe as (select input_id, max(cast(it.technique_id is not null as int)) ai from gold left join it using (technique_id) group by 1),
        nc as (select input_id, count(*) n from t1 group by 1), fh as (select input_id, min(rank) first_hit from t1 join gold using (input_id, technique_id) group by 1),
        cs as (select input_id, k, first_hit, case when ai = 0 then 'gold_not_indexed' when n is null then 'no_candidates' when first_hit is null then 'absent' when first_hit <= k then 'covered' else 'beyond_k' end status
            from pe left join nc using (input_id) left join fh using (input_id) cross join (select unnest([1, 3, 5]) k))"""
    doubles = lambda v: "[" + ", ".join(f"{x}::double" for x in v) + "]"
    grid = fu + f""", {go}, g0 as (select cast(alpha as varchar) method, query_id input_id, technique_id, row_number() over (partition by alpha, query_id order by round_even(alpha * score_text + (1 - alpha) * score_structure, 6) desc, score_text desc, score_structure desc, technique_id) rank
            from f cross join (select unnest({doubles(ALPHAS)}) alpha)),
        g1 as (select method, run, input_id, technique_id, rank from g0 cross join (select unnest({list(LENGTHS)}) run) where rank <= run),
        ng as (select input_id, count(*) n_gold from gold group by 1),
        re as (select k.*, n_gold, cast(g.technique_id is not null as int) rel from g1 k join ng using (input_id) left join gold g on g.input_id = k.input_id and g.technique_id = k.technique_id),
        rs as (select *, sum(rel) over (partition by method, run, input_id order by rank) seen from re),
        pi as (select method, run, input_id, max(n_gold) ngd, sum(rel) h, count(*) n, coalesce(sum(seen::double / rank) filter (where rel = 1), 0) a, coalesce(1.0::double / min(rank) filter (where rel = 1), 0) mr from rs group by 1, 2, 3),
        sw as (select method, run, count(*) as n, round(avg(cast(h > 0 as double)), 6) coverage, round(avg(h::double / ngd), 6) macro_recall, round(avg(h::double / n), 6) as precision, round(avg(a / ngd), 6) as map, round(avg(mr), 6) mrr from pi group by 1, 2)"""
    beta = f"""with {go}, {ra}, b0 as (select run, input_id, technique_id, max(coalesce(score, 0)) filter (where method = 'text') t, max(coalesce(score, 0)) filter (where method = 'llm') l from rk where method in ('text', 'llm') group by 1, 2, 3),
        b1 as (select run, input_id, technique_id, {', '.join(f"round(case when abs(max({x}) over w - min({x}) over w) <= 1e-15 then 0 else ({x} - min({x}) over w) / (max({x}) over w - min({x}) over w) end, 9) {x}" for x in 'tl')} from b0 window w as (partition by run, input_id)),
        b2 as (select cast(beta as varchar) method, run, input_id, technique_id, row_number() over (partition by beta, run, input_id order by round(beta * t + (1 - beta) * l, 7) desc, l desc, t desc, technique_id) rank
            from b1 cross join (select unnest({doubles(BETAS)}) beta)), {met('b2')},
        bp as (select method, run, avg(hit_1) h, avg(mrr) m from pm group by 1, 2),
        bt as (select method, round(avg(h), 6) hit_1, round(avg(m), 6) mrr, round(coalesce(stddev_samp(h), 0), 6) sd_runs from bp group by 1)"""
    fill = f"""with {merged_}, {cat}, {vocab}, {view('t', 'raw_text')},
        a0 as (select query_id, technique_id, coalesce(score, 0) score from (select query_id from m) cross join (select technique_id from it) left join st using (query_id, technique_id)),
        a1 as (select *, row_number() over (partition by query_id order by score desc, technique_id) rank from a0)"""
    return {
        "token_stats": f"select doc_id, cast(len({tok.format('text')}) as int) as n_tokens, cast(len(list_distinct({tok.format('text')})) as int) as n_distinct from documents",
        "idf_table": f"with {cat}, {vocab} select token, df, round(idf, 6) as idf from vo",
        "tf_weights": f"with {cat}, {vocab} select technique_id, token, round(w, 6) as w from tw",
        "retrieve_topn": fill + " select query_id, technique_id, score, cast(rank as int) as rank from a1 where rank <= 20",
        "retrieve_fused": fu + " select query_id, technique_id, score_fused, score_text, score_structure, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score_fused desc, score_text desc, score_structure desc, technique_id) rank from f) where rank <= 20",
        "parent_collapse": fu + """, pc as (select *, split_part(technique_id, '.', 1) p, row_number() over (partition by query_id, split_part(technique_id, '.', 1) order by score_fused desc, score_text desc, score_structure desc, technique_id) n from f)
            select query_id, p as technique_id, max(score_fused) filter (where n = 1) as score_fused, max(score_text) filter (where n = 1) as score_text, max(score_structure) filter (where n = 1) as score_structure,
            max(technique_id) filter (where n = 1) as representative_technique_id, list_sort(list(distinct technique_id)) as source_technique_ids from pc group by 1, 2""",
        "score_minmax": fill + " select query_id, technique_id, score, round(case when abs(max(score) over w - min(score) over w) <= 1e-15 then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 6) as scaled from a0 window w as (partition by query_id)",
        "alpha_topn_sweep": grid + " select * from sw",
        "sweep_winner": grid + " select * from sw where coverage >= (select max(coverage) from sw) - 0.005 - 1e-12 order by run, coverage desc, mrr desc, macro_recall desc, abs(cast(method as double) - 0.5), cast(method as double) limit 1",
        "rank_metrics": mm + " select method, run, input_id, n_gold, round(mrr, 6) as mrr, first_hit, " + ", ".join(f"hits_{k}, round(hit_{k}, 6) as hit_{k}, round(precision_{k}, 6) as precision_{k}, round(recall_{k}, 6) as recall_{k}, round(ap_{k}, 6) as ap_{k}" for k in (1, 3, 5)) + " from pm",
        "metrics_macro": over + " select method, metric, n_inputs, round(estimate, 6) as estimate, round(sd_inputs, 6) as sd_inputs, n_runs, round(sd_runs, 6) as sd_runs from (" + " union all ".join(f"select method, '{x}' as metric, count(*) as n_inputs, avg({x}) as estimate, coalesce(stddev_samp({x}), 0) as sd_inputs from ov group by 1" for x in names) + ") join (" + " union all ".join(f"select method, '{x}' as metric, count(*) as n_runs, coalesce(stddev_samp(v), 0) as sd_runs from (select method, run, avg({x}) v from pm group by 1, 2) group by 1" for x in names) + ") using (method, metric)",
        "metrics_micro": mm + " select method, " + ", ".join(f"round(sum(hits_{k})::double / (count(*) * {k}), 6) as micro_precision_{k}, round(sum(hits_{k})::double / sum(n_gold), 6) as micro_recall_{k}" for k in (1, 3, 5)) + " from pm group by 1",
        "candidate_coverage": mm + " select method, " + ", ".join(f"round(avg(cast(coalesce(first_hit, 1000000000) <= {k} as double)), 6) as coverage_{k}" for k in (1, 3, 5)) + ", round(avg(cast(first_hit is not null as double)), 6) as coverage_all from pm group by 1",
        "first_hit_distribution": mm + f" select method, run, bucket, n, round(n::double / sum(n) over (partition by method, run), 6) as share from (select method, run, {bucket} bucket, count(*) n from pm group by 1, 2, 3)",
        "per_technique_recall": tech + " select method, technique_id, support, round(recall, 6) as recall, round(sd_runs, 6) as sd_runs from pt",
        "long_tail": tech + " select method, case when support <= 5 then 'tail' when support >= 21 then 'head' else 'mid' end as bucket, count(*) as techniques, cast(sum(support) as bigint) as support, round(avg(recall), 6) as macro_recall from pt group by 1, 2",
        "candidate_signatures": f"with {ra} select method, run, input_id, sha256(string_agg(technique_id, ',' order by rank)) as order_hash, sha256(string_agg(technique_id, ',' order by technique_id)) as set_hash from rk group by 1, 2, 3",
        "unfair_inputs": f"with {ra}, sg as (select method, run, input_id, string_agg(technique_id, ',' order by technique_id) x from rk where score is not null group by 1, 2, 3) select input_id, count(*) as rankings, count(distinct x) as sets from sg group by 1 having count(distinct x) > 1",
        "missing_inputs": f"with {go}, {ra} select distinct input_id, 'no_ranking' as side from gold where input_id not in (select input_id from rk) union all select distinct input_id, 'no_gold' from rk where input_id not in (select input_id from gold)",
        "parent_rankings": f"with {ra}, pk as (select method, run, input_id, split_part(technique_id, '.', 1) technique_id, min(rank) r from rk group by 1, 2, 3, 4) select method, run, input_id, technique_id, cast(row_number() over (partition by method, run, input_id order by r, technique_id) as int) as rank from pk",
        "pairwise_differences": over + pairs.format("mrr", "ov") + " select left_method, right_method, count(*) as n_inputs, round(avg(lv), 6) as left_mean, round(avg(rv), 6) as right_mean, round(avg(lv - rv), 6) as difference, cast(sum(cast(lv - rv > 1e-15 as int)) as bigint) as wins, cast(sum(cast(abs(lv - rv) <= 1e-15 as int)) as bigint) as ties, cast(sum(cast(lv - rv < -1e-15 as int)) as bigint) as losses from pr group by 1, 2",
        "mcnemar_exact": mcn + " select left_method, right_method, left_only, right_only, round(p, 6) as p_value from mc",
        "holm_adjusted": mcn + ", hp as (select left_method, right_method, round(p, 6) p_value from mc), hr as (select *, row_number() over (order by p_value, left_method, right_method) r, count(*) over () m from hp) select left_method, right_method, p_value, round(least(1.0::double, max((m - r + 1) * p_value) over (order by r)), 6) as p_holm from hr",
        "quantile_interval": over + " select method, round(quantile_cont(cast(mrr as double), 0.025), 6) as low, round(quantile_cont(cast(mrr as double), 0.975), 6) as high, round(quantile_cont(cast(mrr as double), 0.5), 6) as median from ov group by 1",
        "beta_sweep": beta + " select * from bt",
        "beta_winner": beta + " select * from bt order by hit_1 desc, mrr desc, sd_runs, cast(method as double) desc limit 1",
        "first_hit_shares": mm + f", bu as (select method, run, {bucket} bucket from pm), na as (select method, run, count(*) n from pm group by 1, 2), al as (select unnest(['1', '2-3', '4-5', '6-10', '11-20', '>20', 'miss']) bucket) select method, bucket, round(avg(c::double / n), 6) as share from (select na.method, na.run, n, al.bucket, (select count(*) from bu where bu.method = na.method and bu.run = na.run and bu.bucket = al.bucket) c from na cross join al) group by 1, 2",
        "metric_summary": tech + ", ov as (select method, input_id, " + ", ".join(f"avg({x}) {x}" for x in every_metric) + " from pm group by 1, 2), sr as (" + " union all ".join(f"select method, 'input' averaging, '{x}' metric, avg(v) estimate, coalesce(stddev_samp(v), 0) run_sd from (select method, run, avg({x}) v from pm group by 1, 2) group by 1" for x in every_metric)
            + " union all " + " union all ".join(f"select method, 'label', 'micro_{w}_{k}', sum(hits_{k})::double / {('(count(*) * ' + str(k) + ')') if w == 'precision' else 'sum(n_gold)'}, null from pm group by 1" for w in ("precision", "recall") for k in (1, 3, 5))
            + " union all select method, 'technique', 'technique_recall', avg(recall), null from pt group by 1), nn as (select method, count(*) n_inputs from ov group by 1) select method, averaging, metric, round(estimate, 6) as estimate, round(run_sd, 6) as run_sd, n_inputs, round(estimate - max(case when method = 'text' then estimate end) over (partition by averaging, metric), 6) as delta from sr join nn using (method)",
        "retrieval_baseline": f"with {ra} select method, run, input_id, technique_id, cast(rank as int) as rank from rk where method = 'llm' union all select 'retrieved', run, input_id, technique_id, cast(rank as int) from rk where method = 'text' and run = 1",
        "evaluation_ids": f"with {go}, {ra} select input_id from rk where score is not null and input_id in (select input_id from gold) group by 1 having count(distinct method || run) = (select count(distinct method || run) from rk)",
        "strict_id_problems": f"with {go}, {ra}, p as (select input_id, count(distinct method || run) n from rk where score is not null group by 1) select input_id, 'missing in a run' as problem from p where n < (select count(distinct method || run) from rk where score is not null) union all select input_id, 'no gold' from p where input_id not in (select input_id from gold)",
        "coverage_by_view": views_ + " select view, input_id, k, first_hit, status from st",
        "coverage_reasons": views_ + " select view, k, status, count(*) as n from st group by 1, 2, 3",
        "technique_coverage": views_ + ", j as (select g.technique_id, g.parent_id, e.rank e, p.rank p from gp g left join ranks e on e.view = 'exact' and e.input_id = g.input_id and e.technique_id = g.technique_id left join ranks p on p.view = 'parent' and p.input_id = g.input_id and p.technique_id = g.parent_id) "
            "select technique_id, parent_id, count(*) as support, " + ", ".join(f"cast(count(*) filter (where {c} <= {k}) as bigint) as {n}_{k}" for c, n in (("e", "exact"), ("p", "parent")) for k in (1, 3, 5)) + " from j group by 1, 2",
        "gold_index_status": f"with {go} select distinct g.technique_id, case when revoked then 'revoked' when deprecated then 'deprecated' else 'indexed' end as status from gold g join techniques t on t.technique_id = g.technique_id",
        "coverage_status": cov + " select input_id, k, first_hit, status from cs",
        "coverage_by_k": cov + " select k, status, count(*) as n from cs group by 1, 2",
        "technique_parents": f"with {go} select distinct g.technique_id, coalesce(parent_technique_id, case when exists (select 1 from techniques p where p.technique_id = split_part(g.technique_id, '.', 1) and not coalesce(p.revoked, false) and not coalesce(p.deprecated, false)) then split_part(g.technique_id, '.', 1) end, g.technique_id) as parent_id from gold g join techniques t on t.technique_id = g.technique_id",
        "label_frequency": f"with {go} select technique_id, count(*) as support from gold group by 1",
    }
