"""Label files and ranking runs, each line a JSON object, in the dialects of the evaluator, the beta sweep and the coverage audit.

Lines come as a text column, so that a file is read by ``spark.read.text`` and malformed rows stay rows. Loaders return the
normalised table; the report of what was repaired or dropped is an aggregate of the same plan, and what a strict loader
refuses comes as rows (input_id, problem).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import technique_id

#: What each dialect takes as the id and the labels, whether a text is cut into labels, and whether ids without labels stay.
DIALECTS = {
    "evaluation": {"id": ("input_id",), "labels": ("labels",), "cut": True, "keep_empty": False},
    "sweep": {"id": ("input_id", "cve_id", "id"), "labels": ("labels", "gold"), "cut": False, "keep_empty": True},
    "audit": {"id": ("input_id",), "labels": ("labels",), "cut": False, "keep_empty": True},
}


def parsed(lines: DataFrame, dialect: str, line: str = "line") -> DataFrame:
    """(no, input_id, labels, was_text, broken): every non-blank line with its raw labels; ``no`` is any unique number."""
    how = DIALECTS[dialect]
    v = F.try_parse_json(F.col(line))
    d = lines.where(F.trim(line) != "").select(F.monotonically_increasing_id().alias("no"), v.alias("v"))
    first = lambda names, kind: F.coalesce(*[F.try_variant_get("v", f"$.{n}", kind) for n in names])
    text_id = F.coalesce(*[F.nullif(F.trim(F.try_variant_get("v", f"$.{n}", "string")), F.lit("")) for n in how["id"]])
    kept = first(how["labels"], "variant")
    d = d.select("no", text_id.alias("input_id"), kept.alias("l"), F.col("v").isNull().alias("broken"))
    kind = F.coalesce(F.schema_of_variant("l"), F.lit("VOID"))
    whole = F.try_variant_get("l", "$", "string")
    pieces = F.filter(F.split(whole, r"[,;\s]+"), lambda x: x != "") if how["cut"] else F.array(whole)
    values = F.when(kind == "STRING", pieces).when(kind.startswith("ARRAY"), F.try_variant_get("l", "$", "array<string>")).when(kind == "VOID", F.array().cast("array<string>")).otherwise(F.array(whole))
    odd = kind.startswith("ARRAY") & ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    return d.select("no", "input_id", F.coalesce(values, F.array().cast("array<string>")).alias("labels"), (kind == "STRING").alias("was_text"), (odd | ~(kind.isin("STRING", "VOID") | kind.startswith("ARRAY"))).alias("odd"), "broken")


def load_labels(lines: DataFrame, dialect: str = "evaluation", parent: bool = False) -> DataFrame:
    """(input_id, labels): valid technique ids, sorted and distinct, of all lines of an id. The sweep cuts a parent off before it checks an id, the others after."""
    p = parsed(lines, dialect)
    valid = (lambda x: x) if dialect == "audit" else (lambda x: technique_id(F.element_at(F.split(x, r"\."), 1) if parent and dialect == "sweep" else x, parent))
    each = p.select("input_id", F.explode_outer("labels").alias("label")).select("input_id", valid(F.trim("label")).alias("label"))
    g = each.where("input_id is not null").groupBy("input_id").agg(F.array_sort(F.collect_set(F.when(F.col("label") != "", F.col("label")))).alias("labels"))
    return g if DIALECTS[dialect]["keep_empty"] else g.where(F.size("labels") > 0)


def label_report(lines: DataFrame, dialect: str = "evaluation") -> DataFrame:
    """One row: lines, ids, further lines of an id, texts repaired, labels dropped as invalid, and lines or ids without any."""
    p = parsed(lines, dialect)
    bad = F.filter("labels", lambda x: technique_id(x).isNull())
    rows = p.agg(F.count("*").alias("rows"), F.count_distinct("input_id").alias("ids"), F.sum(F.col("was_text").cast("int")).alias("texts_repaired"), F.sum(F.size(bad)).alias("labels_dropped"), F.sum((F.size(bad) == F.size("labels")).cast("int")).alias("rows_without_label"))
    return rows.select("rows", "ids", (F.col("rows") - F.col("ids")).alias("duplicate_rows"), "texts_repaired", "labels_dropped", "rows_without_label")


def label_problems(lines: DataFrame, dialect: str = "evaluation") -> DataFrame:
    """(input_id, problem) of what a strict loader refuses."""
    p = parsed(lines, dialect)
    blank = F.when(F.col("broken"), "malformed line").when(F.col("input_id").isNull(), "no id")
    rules = [blank, F.when(F.exists("labels", lambda x: (F.trim(x) != "") & ~F.coalesce(F.trim(x).rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"), F.lit(False))), "invalid label")]
    if dialect == "audit":
        rules.append(F.when(F.col("odd"), "label is no text"))
    row = p.select("input_id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))
    if dialect != "audit":
        return row
    empty = load_labels(lines, dialect).where(F.size("labels") == 0).select("input_id", F.lit("no labels").alias("problem"))
    return row.unionByName(empty)


RUN = "input_id string, candidates array<struct<technique_id: string, retrieval_rank: int, rank: int, retrieval_score: double, score_fused: double, final_score: double, llm_score: double, rerank_rank: int>>, rerank_metadata struct<mode: string>"


def run_specs(specs: list[str]) -> list[tuple[str, str, int]]:
    """(method, path, run) of ``NAME=PATH`` texts: runs of a name are numbered in order. Fails on texts without a name or path."""
    seen: dict[str, int] = {}
    out = []
    for s in specs:
        name, mark, path = s.partition("=")
        if not mark or not name.strip() or not path.strip():
            raise ValueError(f"not NAME=PATH: {s}")
        seen[name.strip()] = seen.get(name.strip(), 0) + 1
        out.append((name.strip(), path.strip(), seen[name.strip()]))
    return out


def ranking_lines(spark: SparkSession, specs: list[str]) -> DataFrame:
    """(method, run, line) of all files of ``NAME=PATH`` texts."""
    parts = [spark.read.text(p).select(F.lit(m).alias("method"), F.lit(k).alias("run"), F.col("value").alias("line")) for m, p, k in run_specs(specs)]
    return functools.reduce(DataFrame.unionAll, parts)


def _number(c: str, default: float) -> Column:
    return F.coalesce(F.nanvl(F.col(c), F.lit(default)), F.lit(default))


def candidates(lines: DataFrame) -> DataFrame:
    """(method, run, input_id, mode, position, candidate fields) of every candidate of every line."""
    p = lines.where(F.trim("line") != "").select("method", "run", F.from_json("line", RUN).alias("r"))
    flat = p.select("method", "run", F.trim("r.input_id").alias("input_id"), F.col("r.rerank_metadata.mode").alias("mode"), F.posexplode("r.candidates").alias("p", "c"))
    return flat.select("method", "run", "input_id", "mode", (F.col("p") + 1).alias("position"), "c.*")


def load_rankings(lines: DataFrame, parent: bool = False) -> DataFrame:
    """(method, run, input_id, technique_id, rank, retrieval_rank): both orders of every run; a technique keeps its first place.

    The reranked order goes by rerank rank, or by scores where no candidate of the record has one; the retrieval order by its rank or the candidate's place.
    """
    c = candidates(lines).withColumn("raw", technique_id(F.col("technique_id"))).where("raw is not null")
    c = c.withColumn("technique_id", technique_id(F.col("raw"), parent))
    at = F.coalesce(F.nullif("retrieval_rank", F.lit(0)), F.nullif("rank", F.lit(0)), "position")
    score = F.coalesce(F.nanvl("retrieval_score", F.lit(0.0)), F.nanvl("score_fused", F.lit(0.0)), F.lit(0.0))
    of = ["method", "run", "input_id"]
    given = F.max("rerank_rank").over(Window.partitionBy(*of)).isNotNull()
    final, llm, fused = _number("final_score", 0.0), _number("llm_score", 0.0), _number("score_fused", 0.0)
    first = F.when(given, F.struct(F.coalesce(F.nullif("rerank_rank", F.lit(0)), F.lit(10**9)).cast("double").alias("a"), (-final).alias("b"), (-llm).alias("c"), at.cast("double").alias("d"), F.col("technique_id").alias("t")))
    later = F.struct((-final).alias("a"), (-llm).alias("b"), (-fused).alias("c"), F.col("position").cast("double").alias("d"), F.col("technique_id").alias("t"))
    keyed = c.select(*of, "technique_id", F.coalesce(first, later).alias("k"), F.struct(at.alias("a"), (-score).alias("b"), F.col("technique_id").alias("t")).alias("q"))
    best = keyed.groupBy(*of, "technique_id").agg(F.min("k").alias("k"), F.min("q").alias("q"))
    w = Window.partitionBy(*of)
    return best.select(*of, "technique_id", F.row_number().over(w.orderBy("k")).alias("rank"), F.row_number().over(w.orderBy("q")).alias("retrieval_rank"))


def ranking_problems(lines: DataFrame, required_length: int = 1) -> DataFrame:
    """(method, run, input_id, problem): repeated ids, empty or short lists, malformed technique ids, repeated techniques, ranks that are not 1..n, scores out of range."""
    p = lines.where(F.trim("line") != "").select("method", "run", F.from_json("line", RUN).alias("r"))
    p = p.select("method", "run", F.trim("r.input_id").alias("input_id"), F.coalesce(F.size("r.candidates"), F.lit(0)).alias("n"))
    of = ["method", "run", "input_id"]
    say = lambda cond, m: F.when(F.coalesce(cond, F.lit(False)), F.lit(m))
    per = p.groupBy(*of).agg(F.count("*").alias("rows"), F.min("n").alias("n"))
    a = per.select(*of, F.explode(F.array_compact(F.array(say(F.col("input_id").isNull() | (F.col("input_id") == ""), "no id"), say(F.col("rows") > 1, "repeated id"), say(F.col("n") <= 0, "no candidates"), say((F.col("n") > 0) & (F.col("n") < required_length), "list too short")))).alias("problem"))
    c = candidates(lines)
    off = lambda x: F.col(x).isNotNull() & (F.isnan(x) | (F.col(x) < 0) | (F.col(x) > 1))
    g = c.groupBy(*of).agg(
        F.max(technique_id(F.col("technique_id")).isNull()).alias("bad"), F.count("*").alias("n"), F.count_distinct("technique_id").alias("ids"), F.count("rerank_rank").alias("ranked"),
        F.count_distinct("rerank_rank").alias("ranks"), F.min("rerank_rank").alias("lo"), F.max("rerank_rank").alias("hi"), F.max(off("llm_score") | off("final_score")).alias("off"),
    )
    whole = (F.col("ranks") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    rules = [say(F.col("bad"), "malformed technique id"), say(F.col("ids") < F.col("n"), "repeated technique"), say((F.col("ranked") > 0) & ~whole, "ranks not 1..n"), say(F.col("off"), "score out of range")]
    return a.unionByName(g.select(*of, F.explode(F.array_compact(F.array(*rules))).alias("problem")))


def unknown_candidates(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(technique_id, n): candidates that the catalogue lacks."""
    return candidates(lines).join(catalogue.select("technique_id").distinct(), "technique_id", "left_anti").groupBy("technique_id").agg(F.count("*").alias("n"))


def length_histogram(lines: DataFrame) -> DataFrame:
    """(method, run, length, inputs)."""
    return candidates(lines).groupBy("method", "run", "input_id").agg(F.count("*").alias("length")).groupBy("method", "run", "length").agg(F.count("*").alias("inputs"))


def inconsistent_runs(lines: DataFrame) -> DataFrame:
    """(input_id, candidates, retrievals): inputs whose candidates, or their retrieval scores and ranks, differ between runs of a beta sweep or are missing in one."""
    c = candidates(lines)
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("retrieval_rank", F.lit(10**9)).alias("r"), "technique_id", "score_fused")))  # one record's candidates
    per = c.groupBy("method", "run", "input_id").agg(order.alias("x"))
    runs = c.select("method", "run").distinct().agg(F.count("*").alias("n")).scalar()
    ids = F.transform("x", lambda s: s.technique_id)
    g = per.groupBy("input_id").agg(F.count("*").alias("n"), F.count_distinct(ids).alias("candidates"), F.count_distinct("x").alias("retrievals"))
    return g.where((F.col("candidates") > 1) | (F.col("retrievals") > 1) | (F.col("n") < runs)).select("input_id", "candidates", "retrievals", "n")
