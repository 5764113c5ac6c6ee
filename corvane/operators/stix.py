"""Threat-intelligence bundles: objects to entities and back, relationship names, export selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.addresses import canonical_ipv6
from corvane.functions.urls import canonical_url

# Relationship names outside and inside.
TO_CORE = {
    "indicates": "indicates", "attributed-to": "attributed_to", "targets": "targets", "mitigates": "mitigates", "uses": "uses",
    "located-at": "located_at", "derived-from": "derived_from", "belongs-to": "belongs_to", "member-of": "member_of",
}
OBJECT_TYPES = {
    "threat-actor": "threat_actor", "malware": "malware", "vulnerability": "vulnerability", "indicator": "indicator",
    "domain-name": "domain", "ipv4-addr": "ip", "url": "url", "email-addr": "email",
}
#: What entities are outside that have no counterpart there.
CUSTOM_TYPE = "x-entity"
ID = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?--[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
OBJECT = "id string, type string, name string, value string, description string, identity_class string, relationship_type string, source_ref string, target_ref string"


def is_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ID), F.lit(False))


def core_relationship(name: Column) -> Column:
    kind = F.lit("associated_with")
    for outside, inside in TO_CORE.items():
        kind = F.when(F.trim(name) == outside, inside).otherwise(kind)
    return kind


def stix_relationship(kind: Column) -> Column:
    return F.when(kind == "associated_with", "related-to").otherwise(F.replace(kind, F.lit("_"), F.lit("-")))


def core_type(object_type: Column, identity_class: Column) -> Column:
    """Null for what is no entity."""
    kind = F.when((object_type == "identity") & (identity_class == "individual"), "person").when(
        (object_type == "identity") & identity_class.isin("organization", "group", "class"), "organization"
    )
    for outside, inside in OBJECT_TYPES.items():
        kind = kind.when(object_type == outside, inside)
    return kind


def stix_type(entity_type: Column, custom: str = CUSTOM_TYPE) -> Column:
    """What an entity is outside; types without a counterpart are custom objects."""
    kind = F.when(entity_type.isin("person", "organization"), "identity")
    for outside, inside in OBJECT_TYPES.items():
        kind = kind.when(entity_type == inside, outside)
    return kind.otherwise(custom)


def name_key(entity_type: Column, name: Column) -> Column:
    """Names under which entities of a type meet: addresses and urls in their canonical form, CVEs in capitals, all else in lower case.

    What can't be read as what it is stays as it is.
    """
    flat = F.trim(F.regexp_replace(name, r"\p{IsWhite_Space}+", " "))
    dotless = F.rtrim(F.lower(name), F.lit("."))
    return (
        F.when(entity_type == "vulnerability", F.upper(flat)).when(entity_type.isin("domain", "email"), dotless)
        .when(entity_type == "ip", F.coalesce(canonical_ipv6(name), name)).when(entity_type == "url", F.coalesce(canonical_url(name), name)).otherwise(F.lower(flat))
    )


def read_bundle(spark, path: str) -> DataFrame:
    """Objects of bundle files, one row each."""
    raw = spark.read.text(path, wholetext=True)
    objects = F.from_json("value", f"type string, id string, objects array<struct<{', '.join(c.replace(' ', ':', 1) for c in OBJECT.split(', '))}>>")
    bundles = raw.select(objects.alias("b")).where("b.type = 'bundle'")
    return bundles.select(F.explode("b.objects").alias("o")).select("o.*")


def invalid_objects(objects: DataFrame) -> DataFrame:
    """Objects with a malformed id, or one that isn't their type's, and relationships without ends."""
    wrong = ~is_id(F.col("id")) | (F.substring_index("id", "--", 1) != F.col("type"))
    ends = (F.col("type") == "relationship") & ~(is_id(F.col("source_ref")) & is_id(F.col("target_ref")))
    return objects.where(wrong | ends)


def to_entities(objects: DataFrame) -> DataFrame:
    """(stix_id, entity_type, name, name_key, description) of the objects that are entities."""
    kind = core_type(F.col("type"), F.col("identity_class"))
    name = F.coalesce("name", "value")
    rows = objects.select(F.col("id").alias("stix_id"), kind.alias("entity_type"), name.alias("name"), "description").where("entity_type IS NOT NULL")
    return rows.withColumn("name_key", name_key(F.col("entity_type"), F.col("name")))


def to_relationships(objects: DataFrame) -> DataFrame:
    rows = objects.where("type = 'relationship'")
    return rows.select("source_ref", "target_ref", core_relationship(F.col("relationship_type")).alias("relationship_type"), F.col("relationship_type").alias("stix_relationship_type"))


def import_entities(stored: DataFrame, found: DataFrame, least: float = 0.8) -> DataFrame:
    """Upsert by (entity_type, name_key): stored names and descriptions stay, confidence is at least ``least``."""
    one = found.groupBy("entity_type", "name_key").agg(F.first("name").alias("new_name"), F.first("description", True).alias("new_description"))
    both = stored.join(one, ["entity_type", "name_key"], "full")
    confidence = F.when(F.col("new_name").isNotNull(), F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(least))).otherwise(F.col("confidence"))
    return both.select(
        "entity_type", "name_key", F.coalesce("name", "new_name").alias("name"),
        F.coalesce("description", "new_description").alias("description"), confidence.alias("confidence"),
    )


def export_objects(entities: DataFrame, custom: str = CUSTOM_TYPE) -> DataFrame:
    """(id, object): every entity (entity_id, entity_type, name) as JSON; types without a counterpart are objects of type ``custom``."""
    kind = stix_type(F.col("entity_type"), custom)
    stix_id = F.concat(kind, F.lit("--"), F.col("entity_id"))
    value = kind.isin("domain-name", "ipv4-addr", "url", "email-addr")
    body = F.struct(
        kind.alias("type"), F.lit("2.1").alias("spec_version"), stix_id.alias("id"), F.when(~value, F.col("name")).alias("name"),
        F.when(value, F.col("name")).alias("value"),
        F.when(kind == "identity", F.when(F.col("entity_type") == "person", "individual").otherwise("organization")).alias("identity_class"),
        F.when(kind == custom, F.col("entity_type")).alias("x_entity_type"),
    )
    return entities.select(stix_id.alias("id"), F.to_json(body).alias("object"))


def select_for_export(entities: DataFrame, ids: DataFrame | None = None, types=None, time_range=(None, None)) -> DataFrame:
    """Entities that aren't merged, by id, open time range and, last, type."""
    rows = entities.where("merged_into IS NULL")
    if ids is not None:
        rows = rows.join(ids, "entity_id", "left_semi")
    lo, hi = time_range
    if lo is not None:
        rows = rows.where(F.col("last_seen") >= F.lit(lo))
    if hi is not None:
        rows = rows.where(F.col("first_seen") <= F.lit(hi))
    return rows.where(F.col("entity_type").isin(*types)) if types else rows


def write_bundle(objects: DataFrame, path: str) -> None:
    """One object a line, in as many files as there are tasks; a reader wraps them into bundles."""
    objects.select(F.col("object").alias("value")).write.text(path)
