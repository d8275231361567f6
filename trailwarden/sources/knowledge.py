"""Knowledge-base sources: pattern documents, feature rows and technique bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY_COLUMNS = ["title", "text", "source", "kb_type"]

_BUNDLE_SCHEMA = """objects array<struct<type: string, id: string, name: string, description: string,
    kill_chain_phases: array<struct<phase_name: string>>,
    external_references: array<struct<source_name: string, external_id: string>>>>"""


def read_pattern_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``## `` section of Markdown documents."""
    docs = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("body")
    )
    return pattern_sections(docs)


def pattern_sections(docs: DataFrame) -> DataFrame:
    """Sections of (file, body) rows; a heading needs a line of its own to count."""
    parts = docs.select("file", F.posexplode(F.split("body", r"(?m)^##\s+")).alias("pos", "section"))
    sections = parts.where((F.col("pos") > 0) & (F.instr("section", "\n") > 0))
    title = F.btrim(F.substring_index("section", "\n", 1), F.lit(" \t\r"))
    body = F.expr("substring(section, instr(section, '\n') + 1)")
    return sections.select(
        title.alias("title"), F.btrim(body, F.lit(" \t\r\n")).alias("text"),
        F.concat_ws("::", "file", title).alias("source"), F.lit("pattern").alias("kb_type"),
    ).where(F.col("title") != "")


def read_feature_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    title = F.col("tags") if "tags" in rows.columns else F.lit("feature_definition")
    return rows.select(
        title.alias("title"), "text", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"),
        F.lit("feature").alias("kb_type"),
    )


def knowledge_base(features: DataFrame, patterns: DataFrame) -> DataFrame:
    """Feature and pattern rows as one table with a lower-cased full text."""
    both = features.select(ENTRY_COLUMNS).unionByName(patterns.select(ENTRY_COLUMNS))
    both = both.fillna("", subset=["title", "text"])
    return both.withColumn("fulltext", F.lower(F.concat_ws(" ", "title", "text")))


def read_technique_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a technique bundle with their position, later ones winning on conflict."""
    bundle = spark.read.schema(_BUNDLE_SCHEMA).json(path, multiLine=True)
    return bundle.select(F.posexplode("objects").alias("pos", "object")).select("pos", "object.*")


def tactic_domains(objects: DataFrame) -> DataFrame:
    tactics = objects.where(F.col("type") == "x-mitre-tactic")
    latest = tactics.groupBy("name").agg(F.max_by("description", "pos").alias("description"))
    return latest.select(
        F.xxhash64("name").alias("domain_id"), "name", F.coalesce("description", F.lit("")).alias("description")
    )


def technique_entries(objects: DataFrame, domains: DataFrame, match_slugs: bool = False) -> DataFrame:
    """Attack patterns joined to their domain.

    Domains match on the literal name; ``match_slugs`` also lets the phase
    ``initial-access`` find the tactic ``Initial Access``.
    """
    ref = F.filter(
        "external_references",
        lambda r: (r["source_name"] == "mitre-attack") & (F.coalesce(r["external_id"], F.lit("")) != ""),
    )
    phase = F.try_element_at("kill_chain_phases", F.lit(1))["phase_name"]
    patterns = objects.where(F.col("type") == "attack-pattern").select(
        "pos", F.col("name").alias("title"), F.coalesce("description", F.lit("")).alias("content"),
        F.coalesce(F.try_element_at(ref, F.lit(1))["external_id"], F.col("id"), F.lit("")).alias("external_ref"),
        F.coalesce(phase, F.lit("unknown")).alias("tactic"),
    )
    latest = Window.partitionBy("external_ref").orderBy(F.desc("pos"))
    patterns = patterns.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") == 1)

    def slug(name):
        return F.lower(F.regexp_replace(name, r"\s+", "-")) if match_slugs else name

    keyed = domains.select("domain_id", F.col("name").alias("domain"), slug(F.col("name")).alias("_key"))
    return patterns.join(keyed, slug(F.col("tactic")) == F.col("_key"), "left").select(
        "domain_id", "domain", "title", "content", F.lit("threat").alias("entry_type"),
        F.lit("mitre_attack").alias("source"), "external_ref", F.lit(0.95).alias("confidence"),
    )


def purge_unreferenced(entries: DataFrame, source: str = "mitre_attack") -> DataFrame:
    """Drop rows of a source written before external references were kept."""
    stale = F.coalesce(F.col("source") == source, F.lit(False)) & F.col("external_ref").isNull()
    return entries.where(~stale)
