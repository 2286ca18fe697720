"""Problem 1: one surviving record per base id, chosen field by field.

Method: one aggregation that takes, for every attribute, the maximum of the composite
``struct(usable, trust of the source, updated_at, value, where it came from)``. The maximum is idempotent and
associative, so it is combined before the shuffle: a base id that holds a third of all rows costs one row a task.

Defined cases: a base id that cannot be read takes no part; a source missing from the specs has trust below all
others; a missing time is oldest; equal composites are broken by value, then content hash, then source; a repeated
row changes nothing; a null content hash is replaced by a hash of the content; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N

FIELDS = ("raw_text", "labels", "severity", "affected")
NEVER = -(2**62)


def contents(records: DataFrame, specs: DataFrame) -> DataFrame:
    """Records with base id, parsed provenance, the trust of their source and a usable flag for each field."""
    p = F.from_json("provenance", "updated_at STRING, severity STRING, affected STRING")
    listed = F.when(F.col("p.affected").startswith("["), F.from_json("p.affected", "array<string>")).when(
        F.col("p.affected").isNotNull(), F.array("p.affected")
    )
    sentences = F.col("sentences") if "sentences" in records.columns else F.lit(None).cast("map<string,string>").alias("sentences")
    trust = specs.groupBy(F.col("source_name").alias("_s")).agg(F.max("trust").alias("_trust"))
    r = records.select(
        N.base_id(F.col("input_id")).alias("base_input_id"),
        F.coalesce("record_sha256", F.sha2(F.to_json(F.struct("raw_text", "labels", "provenance", "source_name")), 256)).alias("record_sha256"),
        "source_name", "raw_text", "labels", "provenance", sentences, p.alias("p"),
    )
    r = r.where(F.col("base_input_id").isNotNull()).select(
        "base_input_id", "record_sha256", "source_name", "raw_text", "labels", "provenance", "sentences",
        F.col("p.severity").alias("severity"), listed.alias("affected"),
        F.coalesce(N.moment_micros(F.col("p.updated_at")), F.lit(NEVER)).alias("updated_us"),
    )
    flags = {f"ok_{f}": (N.usable_list if f in ("labels", "affected") else N.usable)(F.col(f)) for f in FIELDS}
    return r.join(trust, r.source_name == trust._s, "left").drop("_s").withColumn("trust", F.coalesce("_trust", F.lit(NEVER))).drop("_trust").withColumns(flags)


def _rank(ok: Column) -> list[Column]:
    return [ok.alias("ok"), F.col("trust"), F.col("updated_us")]


def _composite(field: str, valued: bool) -> Column:
    ok = F.col(f"ok_{field}")
    value = F.struct(field, F.to_json("sentences").alias("sentences")) if field == "raw_text" else F.struct(field)  # sentences go with their text
    more = [F.when(ok, value).alias("value"), F.col("record_sha256"), F.col("source_name")] if valued else []
    return F.max(F.struct(*_rank(ok), *more)).alias(f"best_{field}")


def survivors(found: DataFrame, valued: bool = True) -> DataFrame:
    """One row per base id: the best composite of every field (``valued``: with value and origin), and the highest trust and latest time of any content."""
    return found.groupBy("base_input_id").agg(
        *[_composite(f, valued) for f in FIELDS],
        F.max("trust").alias("top_trust"), F.max("updated_us").alias("top_us"),
        F.min("record_sha256").alias("lo_sha"), F.max("record_sha256").alias("hi_sha"), F.count("*").alias("n_rows"),
    )


def merged_provenance(found: DataFrame) -> DataFrame:
    """(base_input_id, provenance, provenance_from): for every key of the JSON that any content has, the best usable value and the content it is from."""
    # objects and lists stay JSON text; a text that is no object has no keys
    keys = found.select("base_input_id", "trust", "updated_us", "record_sha256", F.explode(F.from_json("provenance", "map<string,string>")).alias("key", "value"))
    best = keys.where(N.usable(F.col("value"))).groupBy("base_input_id", "key").agg(F.max(F.struct("trust", "updated_us", "value", "record_sha256")).alias("x"))
    entries = F.array_sort(F.collect_list(F.struct("key", F.col("x.value").alias("value"), F.col("x.record_sha256").alias("sha"))))  # the keys of one record
    pick = lambda c: F.map_from_entries(F.transform("e", lambda x: F.struct(x.key, x[c])))
    return best.groupBy("base_input_id").agg(entries.alias("e")).select("base_input_id", F.to_json(pick("value")).alias("provenance"), pick("sha").alias("provenance_from"))


def merged_records(records: DataFrame, specs: DataFrame) -> DataFrame:
    """The surviving record of every base id, with the content and source each field was taken from (null where none is usable).

    ``sentences`` are those of the content that gave the text. ``provenance`` is JSON with the best value of every key, ``provenance_from`` tells the contents.
    """
    c = contents(records, specs)
    s = survivors(c)
    cols = [F.col("base_input_id"), F.col("n_rows"), F.when(F.col("top_us") > NEVER, F.timestamp_micros("top_us")).alias("latest_update")]
    for f in FIELDS:
        ok = F.col(f"best_{f}.ok")
        cols += [F.col(f"best_{f}.value.{f}").alias(f)] + [F.when(ok, F.col(f"best_{f}.{a}")).alias(f"{f}_{b}") for a, b in (("record_sha256", "from"), ("source_name", "source"))]
    cols.append(F.from_json("best_raw_text.value.sentences", "map<string,string>").alias("sentences"))
    return s.select(*cols).join(merged_provenance(c), "base_input_id", "left")


def dominant_contents(records: DataFrame, specs: DataFrame) -> DataFrame:
    """Contents of base ids with two or more that hold the survivor's rank (usable, trust, time) in every field at once."""
    c = contents(records, specs)
    s = survivors(c, valued=False).where("lo_sha <> hi_sha").select("base_input_id", "top_trust", "top_us", *[f"best_{f}" for f in FIELDS])
    narrow = c.select("base_input_id", "record_sha256", "trust", "updated_us", *[f"ok_{f}" for f in FIELDS])
    hit = narrow.join(s, "base_input_id").where((F.col("trust") == F.col("top_trust")) & (F.col("updated_us") == F.col("top_us")))
    for f in FIELDS:
        hit = hit.where(F.struct(*_rank(F.col(f"ok_{f}"))) == F.col(f"best_{f}"))
    return hit.select("base_input_id", "record_sha256").distinct()
