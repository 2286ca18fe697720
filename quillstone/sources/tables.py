"""CSV tables, id lists and recorded forms: scans that find their columns, sinks for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which the id, text and label columns of given tables are known, in order of preference.
ID_NAMES = ("cve_id", "cve", "cveid", "id", "input_id")
TEXT_NAMES = ("text", "description", "cve_description", "sentence", "raw_text")
LABEL_NAMES = ("technique_id", "label", "labels", "technique", "target")
DECISION_NAMES = ("ai_decision", "final_decision", "decision")
CVE = r"(?i)cve[-_ ]?\d{4}[-_ ]?\d+"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, quoted line breaks kept."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def _plain(name: str) -> str:
    return " ".join(name.split()).casefold().replace("﻿", "").replace(" ", "_")


def id_column(df: DataFrame) -> str:
    """The known name with a CVE id in it, else the column with most of them."""
    row = df.agg(*[F.sum(F.coalesce(F.col(f"`{c}`").cast("string").rlike(CVE), F.lit(False)).cast("long")).alias(c) for c in df.columns]).first()
    n = {c: row[c] or 0 for c in df.columns}
    known = [c for w in ID_NAMES for c in df.columns if _plain(c) == w and n[c] > 0]
    best = known[0] if known else max(df.columns, key=lambda c: n[c])
    if not n[best]:
        raise ValueError("no column holds CVE ids")
    return best


def text_column(df: DataFrame, id_col: str | None = None) -> str:
    """The known name, else the text column with the greatest mean length."""
    named = [c for w in TEXT_NAMES for c in df.columns if _plain(c) == w and c != id_col]
    if named:
        return named[0]
    texts = [c for c, t in df.dtypes if t == "string" and c != id_col]
    row = df.agg(*[F.avg(F.length(F.coalesce(F.col(f"`{c}`"), F.lit("")))).alias(c) for c in texts]).first()
    return max(texts, key=lambda c: row[c] or 0.0)


def label_column(df: DataFrame, id_col: str | None = None) -> str | None:
    return next((c for w in LABEL_NAMES for c in df.columns if _plain(c) == w and c != id_col), None)


def decision_column(df: DataFrame) -> str:
    found = next((c for w in DECISION_NAMES for c in df.columns if _plain(c) == w), None)
    if found is None:
        raise ValueError("no decision column")
    return found


def one_hot_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Columns whose values are all 0 or 1."""
    cols = [c for c in df.columns if c not in skip]
    row = df.agg(*[F.min(F.coalesce(F.col(f"`{c}`").try_cast("double").isin(0.0, 1.0), F.lit(False)).cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 1]


def read_ids(spark: SparkSession, path: str, key: str = "input_id") -> DataFrame:
    """(id, pos) of a list of ids in a text, JSON, JSON Lines or CSV file: first occurrences in order of the file; a txt list may not repeat ids."""
    if path.endswith(".csv"):
        df = read_csv(spark, path)
        values = df.select(F.col(f"`{id_column(df) if key not in df.columns else key}`").alias("id"))
    elif path.endswith(".jsonl"):
        values = spark.read.text(path).select(F.coalesce(F.get_json_object("value", f"$.{key}"), F.get_json_object("value", "$.cve_id"), F.get_json_object("value", "$.id")).alias("id"))
    elif path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        arr = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.ids"), "array<string>"))
        values = whole.select(F.explode(arr).alias("id"))
    else:
        values = spark.read.text(path).select(F.col("value").alias("id"))
    # a list of ids is one small file: its rows stand in one partition, in order
    placed = values.select(F.trim("id").alias("id"), F.monotonically_increasing_id().alias("pos")).where("id <> ''")
    first = placed.groupBy("id").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    if path.endswith(".txt"):
        if twice := [r.id for r in first.where("n > 1").limit(3).collect()]:
            raise ValueError(f"repeated ids: {', '.join(twice)}")
    return first.select("id", "pos")


def select_ids(df: DataFrame, ids: DataFrame, key: str = "input_id") -> DataFrame:
    """Rows of the listed ids in the list's order; a listed id without a row is an error."""
    lost = [r.id for r in ids.join(df, ids.id == df[key], "left_anti").limit(3).collect()]
    if lost:
        raise ValueError(f"ids without a row: {', '.join(lost)}")
    return df.join(ids, df[key] == ids.id).orderBy("pos").drop("id", "pos")


def join_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row-aligned tables side by side; they must have as many rows."""
    number = lambda df: df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF([*df.columns, "_row"])
    if left.count() != right.count():
        raise ValueError("the tables have different row counts")
    return number(left).join(number(right), "_row").orderBy("_row").drop("_row")


def write_report(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """A report (few rows) as one CSV with a header; ``decimals`` fixes places."""
    for c, n in (decimals or {}).items():
        df = df.withColumn(c, F.format_string(f"%.{n}f", F.col(c)))
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def immutable_columns_changed(form: DataFrame, sample: DataFrame, columns: list[str], key: str = "sample_id") -> DataFrame:
    """(key, column) of cells a returned form changed although they may not be."""
    j = form.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns]).join(sample.select(key, *columns), key)
    hit = F.array_compact(F.array(*[F.when(~F.col(f"_f_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in columns]))
    return j.select(key, F.explode(hit).alias("column"))
