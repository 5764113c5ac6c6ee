"""Queries over bundles of mixed and broken objects, and the names under which entities meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import stix
from corvane.plans.catalog import query
from corvane.session import materialise, table
from corvane.sources import bundles

_TAIL = "-0000-5000-8000-000000000000"


def _id(kind: str, key):
    return F.concat(F.lit(f"{kind}--"), F.lpad(F.lower(F.hex(key)), 8, "0"), F.lit(_TAIL))


def _bundles(spark, d):
    """Bundles of up to twelve objects: of customers, some of them broken, some relationships to what is there or isn't; and bundles that are none."""
    k = F.col("c_custkey")
    identity = lambda kid, kind="identity": F.to_json(F.struct(F.lit(kind).alias("type"), kid.alias("id"), F.col("c_name").alias("name"), F.lit("individual").alias("identity_class"), F.array(F.lit(1)).alias("x_odd")))
    link = lambda target: F.to_json(F.struct(F.lit("relationship").alias("type"), _id("relationship", k).alias("id"), F.lit("uses").alias("relationship_type"), _id("identity", k - k % 6).alias("source_ref"), target.alias("target_ref")))
    note = F.to_json(F.struct(F.lit("note").alias("type"), _id("note", k).alias("id"), F.array(_id("identity", k - k % 6), _id("identity", k + 12)).alias("object_refs")))
    forms = [
        identity(_id("identity", k)), identity(F.lit("identity--1")), F.to_json(F.struct(_id("identity", k).alias("id"))), F.to_json(F.array(F.lit("not an object"))), link(_id("identity", k - k % 6)), link(F.lit("nothing")),
        identity(_id("malware", k)), note,
    ]
    pick = F.when(k % 6 != 5, k % 6).otherwise(F.when(k % 12 == 5, 5).otherwise(F.when(k % 24 == 11, 6).otherwise(7)))
    rows = table(spark, d, "customer").select(F.floor(k / 12).alias("bundle"), k.alias("key"), F.element_at(F.array(*forms), (pick + 1).cast("int")).alias("object"))
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "object"))), lambda x: x["object"]), ",")
    whole = F.concat(F.lit('{"type":"bundle","id":"'), _id("bundle", F.col("bundle")), F.lit('","objects":['), held, F.lit("]}"))
    b = F.col("bundle")
    broken = F.when(b % 50 == 7, "[1]").when(b % 50 == 8, '{"type":"bundle","id":"x--1","objects":[]}').when(b % 50 == 9, F.concat(F.lit('{"type":"bundle","id":"'), _id("bundle", b), F.lit('","objects":{}}'))).when(b % 50 == 10, "{")
    return rows.groupBy("bundle").agg(whole.alias("value")).select("bundle", F.coalesce(broken, "value").alias("value"))


_REJECTED = "CASE b % 50 WHEN 7 THEN 'not_an_object' WHEN 8 THEN 'bad_id' WHEN 9 THEN 'no_objects' WHEN 10 THEN 'no_json' END"


@query(f"SELECT b AS bundle, {_REJECTED} AS error FROM (SELECT DISTINCT c_custkey // 12 AS b FROM customer)")
def bundle_verdicts(spark, d):
    return bundles.parsed_bundles(_bundles(spark, d)).select("bundle", "error")


@query(f"""
    WITH k AS (SELECT c_custkey AS k, c_custkey // 12 AS b FROM customer), g AS (SELECT k FROM k WHERE k % 6 = 0)
    SELECT b AS bundle, row_number() OVER (PARTITION BY b ORDER BY k) - 1 AS pos, CASE WHEN k % 6 = 0 THEN 'valid' WHEN k % 6 = 1 THEN 'bad_id' WHEN k % 6 = 2 THEN 'no_type' WHEN k % 6 = 3 THEN 'not_an_object'
        WHEN k % 6 = 4 THEN CASE WHEN k - 4 IN (FROM g) THEN 'valid' ELSE 'dangling' END WHEN k % 12 = 5 THEN 'bad_ends' WHEN k % 24 = 11 THEN 'id_of_other_type' ELSE 'dangling' END AS verdict
    FROM k WHERE {_REJECTED} IS NULL""")
def bundle_objects(spark, d):
    """Each object: valid, what is wrong with it, or that it refers to what isn't there."""
    objects = bundles.bundle_objects(materialise(bundles.parsed_bundles(_bundles(spark, d)), "bundles"))
    return bundles.judged_objects(objects).select("bundle", F.col("pos").cast("long").alias("pos"), "verdict")


@query("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'CVE-2024-' || event_id WHEN 1 THEN 'mail.example.com' WHEN 2 THEN '2001:db8::' || printf('%x', event_id % 65535 + 1) WHEN 3 THEN 'not an ip' WHEN 4 THEN 'https://example.com/a?id=' || event_id
        ELSE 'the name ' || event_id END AS name_key FROM events""")
def entity_name_keys(spark, d):
    e = F.col("event_id")
    kinds = ["vulnerability", "domain", "ip", "ip", "url", "organization"]
    names = [F.concat(F.lit("cve-2024-"), e), F.lit("Mail.Example.COM."), F.concat(F.lit("2001:0DB8:0::0:"), F.hex(e % 65535 + 1)), F.lit("not an ip"), F.concat(F.lit("HTTPS://Example.com/a?utm_source=x&id="), e), F.concat(F.lit("  The\tNAME  "), e)]
    at = (e % 6 + 1).cast("int")
    return table(spark, d, "events").select("event_id", stix.name_key(F.element_at(F.array(*map(F.lit, kinds)), at), F.element_at(F.array(*names), at)).alias("name_key"))
