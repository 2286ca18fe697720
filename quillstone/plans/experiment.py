"""The staged experiment: each stage maps tables to a table and is kept under the workspace; a stage that is done is read back.

A stage's folder carries the hash of the configuration and of the inputs it was made with; resuming with others is refused. Alpha, list length
and beta are chosen on the development part of the split; reranking and evaluation on the test part run over all modes and seeds.

``python -m quillstone.plans.experiment WORKSPACE --texts P --techniques P --gold P --scores P`` runs it on parquet tables.
"""

from __future__ import annotations

import argparse
import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset, explanation, extract, graph, metrics, reports, rerank, retrieval, segment
from . import settings

DEFAULTS: dict[str, Any] = {
    "segment": {"aggressive": False, "max_chars": 420, "min_chars": 24, "max_evidence": 12},
    "extract": {},
    "graph": {},
    "explain": {"max_nodes": 4, "exact_limit": 20},
    "split": {"development": 0.2, "seed": 20260805, "least": 2, "passes": 20},
    "select_retrieval": {"alphas": [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0], "lengths": [5, 10, 15, 20, 30, 50], "tolerance": 0.005},
    "retrieve": {"topn": None, "alpha": None},
    "select_beta": {"betas": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], "metric": "hit@1"},
    "rerank": {"topk": 5, "beta": None, "modes": ["full"], "seeds": [0]},
    "evaluate": {"ks": [1, 3, 5], "reference": "retrieval"},
}
STAGES = tuple(DEFAULTS)


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, dictionaries merged at every level."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def validate(config: dict) -> None:
    r, k, v = config["retrieve"], config["rerank"], config["split"]
    share = lambda x: x is None or 0 <= x <= 1
    problems = [m for bad, m in (
        (not share(r["alpha"]), "alpha must be in [0, 1]"), (r["topn"] is not None and r["topn"] < 1, "topn must be positive"), (not share(k["beta"]), "beta must be in [0, 1]"),
        (k["topk"] > (r["topn"] or min(config["select_retrieval"]["lengths"])), "topk must not exceed topn"), (any(m not in rerank.MODES for m in k["modes"]) or not k["modes"], "unknown mode"),
        (not k["seeds"], "no seed"), (not 0 < v["development"] < 1, "the development share must be between 0 and 1"),
        (config["segment"]["min_chars"] > config["segment"]["max_chars"], "min_chars must not exceed max_chars"),
    ) if bad]
    if problems:
        raise ValueError("; ".join(problems))
    settings.metric(config["select_beta"]["metric"])


def selected(stage: str = "all", through: str | None = None) -> tuple[str, ...]:
    if stage != "all" and through:
        raise ValueError("give a stage or a last stage, not both")
    if through:
        return STAGES[: STAGES.index(through) + 1]
    return STAGES if stage == "all" else (stage,)


class Experiment:
    """``texts``: (input_id, text). ``techniques``: (technique_id, name, text). ``gold``: (input_id, technique_id).

    ``scores``: (input_id, technique_id, llm_score), and if it has them mode and seed; without these columns the scores serve all modes and seeds.
    """

    def __init__(self, spark: SparkSession, workspace: str, texts: DataFrame, techniques: DataFrame, gold: DataFrame, scores: DataFrame, config: dict | None = None, resume: bool = True):
        self.spark, self.workspace, self.resume = spark, workspace.rstrip("/"), resume
        self.config = deep_merge(DEFAULTS, config or {})
        validate(self.config)
        self.inputs = {"texts": texts, "techniques": techniques, "gold": gold, "scores": scores}
        self.made: dict[str, DataFrame] = {}

    def signature(self, stage: str) -> str:
        """Hash of the inputs, and of the configuration of all stages up to this one."""
        if not hasattr(self, "_prints"):
            self._prints = {k: list(map(str, dataset.fingerprint(df).first())) for k, df in sorted(self.inputs.items())}
        part = {s: self.config.get(s, {}) for s in STAGES[: STAGES.index(stage) + 1]}
        return hashlib.sha256(json.dumps([part, self._prints], sort_keys=True).encode()).hexdigest()

    def plan(self, stages: tuple[str, ...] = STAGES) -> list[tuple[str, str]]:
        """(stage, folder) in order, without running anything."""
        return [(s, f"{self.workspace}/{s}") for s in stages]

    def table(self, stage: str) -> DataFrame:
        if stage not in self.made:
            self.made[stage] = self._kept(stage, getattr(self, f"_{stage}"))
        return self.made[stage]

    def run(self, stage: str = "all", through: str | None = None) -> DataFrame:
        for s in (chosen := selected(stage, through)):
            self.table(s)
        return self.table(chosen[-1])

    def _kept(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        path, mine = f"{self.workspace}/{stage}", self.signature(stage)
        try:
            found = self.spark.read.json(f"{path}.done").first()["signature"]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = None
        if found is not None:
            if not self.resume:
                raise FileExistsError(f"stage {stage} exists in {self.workspace}")
            if found != mine:
                raise ValueError(f"stage {stage} was made with another configuration or other inputs")
            return self.spark.read.parquet(path)
        make().write.mode("overwrite").parquet(path)  # no mark: whatever is there is unfinished
        self.spark.createDataFrame([(mine,)], "signature string").coalesce(1).write.json(f"{path}.done")
        return self.spark.read.parquet(path)

    def _segment(self) -> DataFrame:
        return segment.segment(self.inputs["texts"], "input_id", "text", **self.config["segment"])

    def _extract(self) -> DataFrame:
        return graph.drop_alias_evidence(extract.nodes(self.table("segment")), self.table("segment"))

    def _graph(self) -> DataFrame:
        return graph.layer_edges(self.table("extract"))

    def _explain(self) -> DataFrame:
        return explanation.explanations(self.table("extract"), self.table("graph"), **self.config["explain"])

    def _split(self) -> DataFrame:
        cfg = self.config["split"]
        per = self.inputs["gold"].groupBy("input_id").agg(F.array_sort(F.collect_set("technique_id")).alias("labels")).orderBy("input_id").collect()  # one labelled evaluation set
        part = min(max(1, round(len(per) * cfg["development"])), len(per) - 1)
        small = dataset.stratified_split([(r[0], r[1]) for r in per], part, cfg["seed"], cfg["least"], cfg["passes"])
        return self.spark.createDataFrame([(r[0], "development" if r[0] in small else "test") for r in per], "input_id string, split string")

    def _part(self, df: DataFrame, split: str) -> DataFrame:
        return df.join(self.table("split").where(F.col("split") == split).select("input_id"), "input_id", "left_semi")

    def _views(self) -> DataFrame:
        """Both queries of every record: its evidence in order, or its whole text if it has none, and the words of its explanation."""
        units = self.table("segment").groupBy("input_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s.text), " ").alias("_u"))  # one record's units
        told = explanation.query_text(self.table("explain"), self.table("graph")).withColumnRenamed("text", "structure")
        own = self.inputs["texts"].select("input_id", F.col("text").alias("_raw"))
        return own.join(units, "input_id", "left").join(told, "input_id", "left").select("input_id", F.coalesce("_u", "_raw", F.lit("")).alias("text"), F.coalesce("structure", F.lit("")).alias("structure"))

    def _lists(self, queries: DataFrame, alphas: list[float], n: int) -> DataFrame:
        return retrieval.retrieve_grid(queries, self.inputs["techniques"].where("text is not null"), alphas, n, q="input_id")

    def _select_retrieval(self) -> DataFrame:
        """Means of every alpha and length on the development part, best first."""
        cfg = self.config["select_retrieval"]
        lengths = tuple(sorted(cfg["lengths"]))
        g = self._lists(self._part(self._views(), "development"), cfg["alphas"], lengths[-1])
        g = g.select(F.col("alpha").cast("string").alias("method"), F.lit(0).alias("run"), "input_id", "technique_id", "rank")
        per = metrics.per_input_sweep(g, self.inputs["gold"], lengths).groupBy("method")
        names = ("coverage", "mrr", "macro_recall")
        wide = per.agg(*[F.avg(f"{m}_{k}").alias(f"{m}_{k}") for k in lengths for m in names])
        long = wide.select(F.col("method").cast("double").alias("alpha"), F.inline(F.array(*[F.struct(F.lit(k).alias("topn"), *[F.col(f"{m}_{k}").alias(m) for m in names]) for k in lengths])))
        best = long.agg(F.max("coverage").alias("b")).scalar()
        near = long.withColumn("near", F.col("coverage") >= best - cfg["tolerance"] - 1e-12)
        return near.orderBy(F.desc("near"), "topn", F.desc("coverage"), F.desc("mrr"), F.desc("macro_recall"), F.abs(F.col("alpha") - 0.5), "alpha").coalesce(1)

    def _retrieve(self) -> DataFrame:
        cfg = self.config["retrieve"]
        alpha, topn = cfg["alpha"], cfg["topn"]
        if alpha is None or topn is None:
            best = self.table("select_retrieval").first()
            alpha, topn = best["alpha"] if alpha is None else alpha, best["topn"] if topn is None else topn
        return self._lists(self._views(), [alpha], topn).drop("alpha")

    def _scores(self) -> DataFrame:
        """Scores per mode and seed of the configuration."""
        cfg, s = self.config["rerank"], self.inputs["scores"]
        for c, values in (("mode", cfg["modes"]), ("seed", cfg["seeds"])):
            s = s.where(F.col(c).isin(*values)) if c in s.columns else s.withColumn(c, F.explode(F.array(*map(F.lit, values))))
        return s

    def _top(self) -> DataFrame:
        r = self.table("retrieve")
        top = rerank.top_candidates(r, self.config["rerank"]["topk"])
        return top.join(r.select("input_id", "technique_id", F.col("score_fused").alias("retrieval_score")), ["input_id", "technique_id"])

    def _reranked(self, beta: float, top: DataFrame) -> DataFrame:
        """Every candidate list once a mode and seed: these are part of the record's key, so one pass ranks all."""
        cfg = self.config["rerank"]
        key = F.struct("mode", "seed", "input_id")
        pick = lambda c, v: F.explode(F.array(*map(F.lit, v))).alias(c)
        lists = top.select("*", pick("mode", cfg["modes"])).select("*", pick("seed", cfg["seeds"])).withColumn("input_id", key).drop("mode", "seed")
        m = rerank.merge_scores(lists, self._scores().withColumn("input_id", key), beta)
        return m.select("input_id.mode", "input_id.seed", F.col("input_id.input_id").alias("input_id"), *[c for c in m.columns if c != "input_id"])

    def _select_beta(self) -> DataFrame:
        """Means of every beta on the development part over modes and seeds, best first: the metric, mrr, the smaller deviation of runs, the greater beta."""
        name, k = settings.metric(self.config["select_beta"]["metric"])
        top = self._part(self._top(), "development")
        parts = []
        for beta in self.config["select_beta"]["betas"]:  # a grid of the configuration
            r = self._reranked(beta, top).select(F.lit(str(beta)).alias("method"), F.concat_ws("/", "mode", "seed").alias("run"), "input_id", "technique_id", F.col("rerank_rank").alias("rank"))
            parts.append(r)
        every = parts[0]
        for r in parts[1:]:
            every = every.unionByName(r)
        col = "mrr" if k is None else f"{name}_{k}"
        per = metrics.per_input(metrics.relevance(every, self.inputs["gold"]), (k or 1,)).groupBy("method", "run").agg(F.avg(col).alias("m"), F.avg("mrr").alias("r"))
        out = per.groupBy(F.col("method").cast("double").alias("beta")).agg(F.avg("m").alias("value"), F.avg("r").alias("mrr"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd_runs"))
        return out.orderBy(F.desc("value"), F.desc("mrr"), "sd_runs", F.desc("beta")).coalesce(1)

    def _rerank(self) -> DataFrame:
        beta = self.config["rerank"]["beta"]
        return self._reranked(self.table("select_beta").first()["beta"] if beta is None else beta, self._part(self._top(), "test"))

    def _evaluate(self) -> DataFrame:
        """(method, averaging, metric, estimate, run_sd, n_inputs, delta): every mode over its seeds, and the retrieval order, on the test part."""
        r, gold = self.table("rerank"), self._part(self.inputs["gold"], "test")
        long = r.select(F.col("mode").alias("method"), F.dense_rank().over(_by_seed()).alias("run"), "input_id", "technique_id", F.col("rerank_rank").alias("rank"))
        first = r.where((F.col("mode") == self.config["rerank"]["modes"][0]) & (F.col("seed") == self.config["rerank"]["seeds"][0]))
        base = first.select(F.lit(1).alias("run"), "input_id", "technique_id", F.col("retrieval_rank").alias("rank"))
        rel = metrics.relevance(reports.retrieval_baseline(long, base, "retrieval"), gold)
        ks = tuple(self.config["evaluate"]["ks"])
        return reports.summary(metrics.per_input(rel, ks), metrics.per_technique(rel, gold), self.config["evaluate"]["reference"], ks)


def _by_seed():
    from pyspark.sql import Window

    return Window.partitionBy("mode").orderBy("seed")


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("workspace")
    for name in ("texts", "techniques", "gold", "scores"):
        a.add_argument(f"--{name}", required=True, help=f"parquet table of {name}")
    a.add_argument("--config", help="JSON file that changes the defaults")
    a.add_argument("--stage", default="all", choices=("all", *STAGES))
    a.add_argument("--through", choices=STAGES, help="all stages up to this one")
    a.add_argument("--no-resume", action="store_true", help="fail where a stage is done")
    a.add_argument("--dry-run", action="store_true", help="only print the stages and their folders")
    o = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    config = json.loads("\n".join(r[0] for r in spark.read.text(o.config).collect())) if o.config else None
    tables = {n: spark.read.parquet(getattr(o, n)) for n in ("texts", "techniques", "gold", "scores")}
    e = Experiment(spark, o.workspace, config=config, resume=not o.no_resume, **tables)
    if o.dry_run:
        for stage, folder in e.plan(selected(o.stage, o.through)):
            print(stage, folder)
        return
    e.run(o.stage, o.through).show(100, truncate=False)


if __name__ == "__main__":
    main()
