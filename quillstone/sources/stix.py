"""STIX bundles: technique index, status, parents, and the knowledge graph of techniques and tactics."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import without_markup

OBJECT = (
    "type string, id string, name string, description string, revoked boolean, x_mitre_deprecated boolean, x_mitre_is_subtechnique boolean, x_mitre_version string, x_mitre_shortname string, "
    "x_mitre_platforms array<string>, kill_chain_phases array<struct<kill_chain_name: string, phase_name: string>>, external_references array<struct<source_name: string, external_id: string, url: string>>, "
    "relationship_type string, source_ref string, target_ref string"
)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """One row per object of a bundle with its position."""
    return spark.read.schema(f"objects array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in _split_fields(OBJECT))}>>").json(path, multiLine=True).select(F.posexplode("objects").alias("pos", "o")).select("pos", "o.*")


def _split_fields(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def attack_reference(refs: Column) -> Column:
    """The one external reference to the technique catalogue; null if there is none or they differ."""
    own = F.array_distinct(F.filter(refs, lambda r: r.source_name == "mitre-attack"))
    return F.when(F.size(own) == 1, F.element_at(own, 1))


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def sorted_texts(c: Column) -> Column:
    """Trimmed distinct texts without regard to order of case."""
    t = F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    return F.transform(F.array_sort(F.transform(t, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda s: s.v)


def technique_index(objects: DataFrame, include_revoked: bool = False, include_deprecated: bool = False) -> DataFrame:
    """Active techniques with name, cleaned description, tactics, platforms, parent and text with hash."""
    t = objects.where("type = 'attack-pattern'").withColumn("_ref", attack_reference(F.col("external_references")))
    t = t.where(F.upper("_ref.external_id").rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"))
    revoked, deprecated = F.coalesce("revoked", F.lit(False)), F.coalesce("x_mitre_deprecated", F.lit(False))
    if not include_revoked:
        t = t.where(~revoked)
    if not include_deprecated:
        t = t.where(~deprecated)
    description = without_markup(unescaped(F.coalesce("description", F.lit(""))))
    i = t.select(
        F.upper("_ref.external_id").alias("technique_id"), F.col("id").alias("stix_id"), F.trim("name").alias("name"), description.alias("description"),
        sorted_texts(F.transform("kill_chain_phases", lambda p: p.phase_name)).alias("tactics"), sorted_texts(F.col("x_mitre_platforms")).alias("platforms"),
        F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"), revoked.alias("revoked"), deprecated.alias("deprecated"), F.col("_ref.url").alias("source_url"),
    )
    parents = parent_links(objects, i)
    text = F.concat_ws("\n", "name", F.when(F.col("description") != "", F.col("description")))
    return i.join(parents, "technique_id", "left").withColumn("text", text).withColumn("text_sha256", F.sha2("text", 256))


def parent_links(objects: DataFrame, index: DataFrame) -> DataFrame:
    """(technique_id, parent_technique_id) of active subtechniques that have just one parent."""
    r = objects.where("type = 'relationship' and relationship_type = 'subtechnique-of'").where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    a = index.select(F.col("stix_id").alias("source_ref"), "technique_id")
    b = index.select(F.col("stix_id").alias("target_ref"), F.col("technique_id").alias("parent"))
    g = r.join(a, "source_ref").join(b, "target_ref").groupBy("technique_id").agg(F.count_distinct("parent").alias("n"), F.min("parent").alias("parent_technique_id"))
    return g.where("n = 1").select("technique_id", "parent_technique_id")


def status(objects: DataFrame) -> DataFrame:
    """(technique_id, revoked, deprecated) of the last object of each id."""
    t = objects.where("type = 'attack-pattern'").withColumn("technique_id", F.upper(attack_reference(F.col("external_references")).external_id)).where("technique_id is not null")
    last = F.max_by(F.struct(F.coalesce("revoked", F.lit(False)).alias("revoked"), F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated")), "pos")
    return t.groupBy("technique_id").agg(last.alias("s")).select("technique_id", "s.revoked", "s.deprecated")


def exclusions(objects: DataFrame) -> DataFrame:
    """How many techniques are kept or left out, by the first reason that holds: one row per reason."""
    ref = attack_reference(F.col("external_references"))
    why = (
        F.when(F.coalesce("revoked", F.lit(False)), "revoked").when(F.coalesce("x_mitre_deprecated", F.lit(False)), "deprecated").when(ref.isNull(), "no id")
        .when(~F.upper(ref.external_id).rlike(r"^T[0-9]{4}(\.[0-9]{3})?$"), "malformed id").otherwise("kept")
    )
    return objects.where("type = 'attack-pattern'").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def knowledge_graph(objects: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): techniques and tactics; who is a subtechnique of whom and which tactic a technique belongs to."""
    tactics = objects.where("type = 'x-mitre-tactic' and x_mitre_shortname is not null").select(F.concat(F.lit("TACTIC::"), "x_mitre_shortname").alias("node_id"), F.lit("Tactic").alias("type"), "name")
    used = index.select(F.explode("tactics").alias("t")).distinct().select(F.concat(F.lit("TACTIC::"), "t").alias("node_id"), F.lit("Tactic").alias("type"), F.col("t").alias("name")).join(tactics, "node_id", "left_anti")
    nodes = index.select("technique_id", F.lit("Technique").alias("type"), "name").toDF("node_id", "type", "name").unionByName(tactics).unionByName(used)
    sub = index.where("parent_technique_id is not null").select(F.col("technique_id").alias("src"), F.col("parent_technique_id").alias("dst"), F.lit("subtechnique_of").alias("type"))
    in_tactic = index.select(F.col("technique_id").alias("src"), F.explode("tactics").alias("t")).select("src", F.concat(F.lit("TACTIC::"), "t").alias("dst"), F.lit("belongs_to_tactic").alias("type"))
    return nodes, sub.unionByName(in_tactic)


def merge_index(rows: DataFrame) -> DataFrame:
    """One row per technique id of an index with repeated ids: distinct texts joined by line feeds in order of the file."""
    return rows.where("technique_id is not null and trim(text) <> ''").groupBy("technique_id").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x.text)), "\n").alias("text"))
