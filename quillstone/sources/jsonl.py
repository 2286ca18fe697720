"""JSON Lines: validated scan, atomic sink, append and resume.

A scan fails on malformed lines, on lines that are no objects and on repeated keys, with examples; Spark strips the byte
order mark and skips blank lines. A sink writes to a new folder by Spark's commit protocol, so readers see all or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The keys each kind of record is told by.
KINDS = {
    "reranking": ("candidates", "rerank_metadata"),
    "candidates": ("candidates", "retrieval_metadata"),
    "mes": ("chain", "compact_text"),
    "local_graph": ("nodes", "edges", "graph_version"),
    "extraction": ("behaviors", "preconditions"),
    "sentences": ("sentences", "evidence_spans"),
}


class BadLines(ValueError):
    """Lines that are no JSON objects of the schema."""


class RepeatedKeys(ValueError):
    """Keys that occur on more than one line."""


def read(spark: SparkSession, path: str, schema: StructType | str, key: str | None = "input_id", validate: bool = True) -> DataFrame:
    """Rows of the schema; ``validate`` scans once for malformed lines and repeated keys and raises."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*wanted.fields, StructField("_corrupt", StringType())])
    raw = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if validate:
        # Spark drops rows whose only column read is the corrupt one, so the whole row is looked at
        bad = raw.where("_corrupt is not null").select("_corrupt", *wanted.names).limit(3).collect()
        if bad:
            raise BadLines("; ".join(r["_corrupt"][:200] for r in bad))
        if key:
            require_unique(raw.select(key), key)
    return raw.drop("_corrupt")


def require_unique(df: DataFrame, key: str) -> None:
    twice = df.groupBy(key).count().where("count > 1").limit(3).collect()
    if twice:
        raise RepeatedKeys(", ".join(str(r[0]) for r in twice))


def write(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One object a line, keys in alphabetical order, numbers finite; fails if the folder exists and isn't to be overwritten."""
    for c, t in df.dtypes:
        if t in ("double", "float") and df.where(F.isnan(c) | (F.abs(c) == float("inf"))).limit(1).count():
            raise ValueError(f"column {c} holds numbers that JSON has no form for")
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a folder (a resumable job adds one batch at a time)."""
    df.select(*sorted(df.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


def infer_kind(df_text: DataFrame, column: str = "value") -> DataFrame:
    """Lines with ``kind``: which record kind the keys of each object tell; null if none."""
    keys = F.json_object_keys(F.col(column))
    has = lambda names: F.size(F.array_intersect(keys, F.array(*map(F.lit, names)))) == len(names)
    return df_text.withColumn("kind", F.coalesce(*[F.when(has(v), F.lit(k)) for k, v in KINDS.items()]))


def union_labels(df: DataFrame, parent: bool = False, drop_invalid: bool = True) -> DataFrame:
    """(input_id, labels): labels given as a list or as one text, united over repeated ids, normalised and sorted.

    ``df`` has input_id and labels as JSON text.
    """
    from ..functions.text import label_parts, technique_id

    raw = F.trim("labels")
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(label_parts(F.regexp_replace(raw, '^"|"$', "")))
    each = df.select("input_id", F.explode_outer(listed).alias("l")).withColumn("t", technique_id(F.col("l"), parent))
    if not drop_invalid:
        each = each.withColumn("t", F.when(F.col("l").isNotNull() & F.col("t").isNull(), F.raise_error(F.concat(F.lit("invalid label "), "l"))).otherwise(F.col("t")))
    return each.groupBy("input_id").agg(F.array_sort(F.collect_set("t")).alias("labels"))
