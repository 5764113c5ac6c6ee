"""Reader of threat-intelligence bundles whose objects have mixed shapes, by VARIANT: what is wrong with each is told, not thrown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.stix import is_id

MAX_OBJECTS = 10_000


def bundle_texts(spark, path: str) -> DataFrame:
    """(bundle, value) of bundle files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("bundle"), "value")


def parsed_bundles(texts: DataFrame, max_objects: int = MAX_OBJECTS) -> DataFrame:
    """(bundle, id, objects, error) of (bundle, value): the objects as a VARIANT; ``error`` is null for a bundle that can be read.

    The first that holds is told: no_json, not_an_object, not_a_bundle, bad_id, no_objects, too_many_objects.
    """
    v = F.col("v")
    text = lambda path: F.try_variant_get(v, path, "string")
    kind = lambda x: F.schema_of_variant(x)
    objects = F.try_variant_get(v, "$.objects", "variant")
    rows = texts.select("bundle", F.try_parse_json("value").alias("v"))
    judged = rows.select("bundle", "v", text("$.id").alias("id"), text("$.type").alias("type"), objects.alias("objects"))
    count = F.size(F.try_variant_get("objects", "$", "array<variant>"))
    error = (
        F.when(v.isNull(), "no_json").when(~F.startswith(kind(v), F.lit("OBJECT")), "not_an_object").when(~F.coalesce(F.col("type") == "bundle", F.lit(False)), "not_a_bundle")
        .when(~(is_id(F.col("id")) & F.startswith("id", F.lit("bundle--"))), "bad_id").when(F.col("objects").isNull() | ~F.startswith(kind(F.col("objects")), F.lit("ARRAY")), "no_objects")
        .when(count > max_objects, "too_many_objects")
    )
    return judged.select("bundle", "id", "objects", error.alias("error"))


def bundle_objects(bundles: DataFrame) -> DataFrame:
    """(bundle, pos, id, type, object, error) of the objects of bundles that can be read; ``object`` is a VARIANT, ``error`` is null for a valid one.

    The first that holds is told: not_an_object, no_type, bad_id, id_of_other_type, and of relationships bad_ends.
    """
    spark = bundles.sparkSession
    good = bundles.where("error IS NULL")
    each = good.lateralJoin(spark.tvf.variant_explode(F.col("objects").outer())).select("bundle", "pos", F.col("value").alias("object"))
    text = lambda name: F.try_variant_get("object", f"$.{name}", "string")
    rows = each.withColumns({c: text(c) for c in ("id", "type", "source_ref", "target_ref", "relationship_type")})
    ends = is_id(F.col("source_ref")) & is_id(F.col("target_ref")) & (F.trim(F.coalesce("relationship_type", F.lit(""))) != "")
    error = (
        F.when(F.col("object").isNull() | ~F.startswith(F.schema_of_variant("object"), F.lit("OBJECT")), "not_an_object").when(F.trim(F.coalesce("type", F.lit(""))) == "", "no_type")
        .when(~is_id(F.col("id")), "bad_id").when(F.substring_index("id", "--", 1) != F.col("type"), "id_of_other_type").when((F.col("type") == "relationship") & ~ends, "bad_ends")
    )
    return rows.select("bundle", "pos", "id", "type", "object", error.alias("error"))


def references(objects: DataFrame) -> DataFrame:
    """(bundle, pos, field, ref) of all that valid objects refer to: every field whose name ends in _ref, and each of a list that ends in _refs."""
    spark = objects.sparkSession
    fields = objects.where("error IS NULL").lateralJoin(spark.tvf.variant_explode(F.col("object").outer()).select(F.col("key").alias("field"), F.col("value").alias("held")))
    one = fields.where("field LIKE '%\\_ref'").select("bundle", F.col("pos"), "field", F.try_variant_get("held", "$", "string").alias("ref"))
    many = fields.where("field LIKE '%\\_refs'").select("bundle", F.col("pos"), "field", F.explode(F.try_variant_get("held", "$", "array<string>")).alias("ref"))
    return one.unionByName(many)


def dangling_references(objects: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """References to what is neither a valid object of the same bundle nor, if given, stored (column id)."""
    known = objects.where("error IS NULL").select("bundle", F.col("id").alias("ref")).distinct()
    left = references(objects).join(known, ["bundle", "ref"], "left_anti")
    return left if stored is None else left.join(stored.select(F.col("id").alias("ref")), "ref", "left_anti").select("bundle", "ref", "pos", "field")


def judged_objects(objects: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(bundle, pos, id, type, verdict): valid, what is wrong, or dangling for an object that refers to something that isn't there."""
    dangling = dangling_references(objects, stored).select("bundle", "pos").distinct().withColumn("dangling", F.lit("dangling"))
    return objects.join(dangling, ["bundle", "pos"], "left").select("bundle", "pos", "id", "type", F.coalesce("error", "dangling", F.lit("valid")).alias("verdict"))
