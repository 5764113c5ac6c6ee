"""Queries over domains, addresses and what entities gather of attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import addresses, domains
from corvane.functions import text as T
from corvane.operators import extract
from corvane.plans.catalog import query
from corvane.plans.text_queries import _EMAIL_RE, _HITS, _IPV4_ITEMS
from corvane.session import table

# domains

_SUFFIXES = ("com", "net", "org", "io", "md", "uk", "co.uk", "github.io", "example")


def _with_domains(spark, d):
    """Documents with names in a url, in addresses, by themselves, and in places that don't count."""
    i = F.col("doc_id").cast("string")
    parts = [
        F.coalesce("text", F.lit("")), F.lit(" 見(https://www.Site"), F.col("doc_id") % 7, F.lit(".co.uk/a.b.com?x=1). Mail bob"), i, F.lit("@Mail"), F.col("doc_id") % 5,
        F.lit(".github.io or al.net@nowhere.lan; http://10.0.0.1/x.org README.md, 1.2.com and co.uk, but 在Host"), i, F.lit(".example.com。new.house notaco.uk github.io end"),
    ]
    return table(spark, d, "documents", spread=True).select("doc_id", F.concat(*parts).alias("text"))


def _suffixes(spark):
    return spark.createDataFrame([(s,) for s in _SUFFIXES], "suffix string")


_KNOWN = f"s(suffix) AS (VALUES {', '.join(f"('{s}')" for s in _SUFFIXES)})"
_PLANTED_DOMAINS = """
    SELECT doc_id, 'www.site' || doc_id % 7 || '.co.uk' AS entity_key, 0.95::DOUBLE AS confidence, 'co.uk' AS public_suffix, 'site' || doc_id % 7 || '.co.uk' AS registrable_domain FROM documents
    UNION ALL SELECT doc_id, 'mail' || doc_id % 5 || '.github.io', 0.95, 'github.io', 'mail' || doc_id % 5 || '.github.io' FROM documents
    UNION ALL SELECT doc_id, 'host' || doc_id || '.example.com', 0.8, 'com', 'example.com' FROM documents
    UNION ALL SELECT doc_id, 'al.net', 0.8, 'net', 'al.net' FROM documents UNION ALL SELECT doc_id, 'notaco.uk', 0.8, 'uk', 'notaco.uk' FROM documents"""
# the texts' own: of addresses, and of running text without urls and addresses
_OWN_DOMAINS = rf"""
    h AS (SELECT doc_id, split_part(lower(hit), '@', 2) AS host, 0.95::DOUBLE AS confidence FROM ({_HITS.format(_EMAIL_RE)})
        UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(regexp_replace(text, '{_EMAIL_RE}', ' ', 'g'),
            '(?i)\b[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)*\.[a-z]{{2,}}\b'))), 0.8 FROM documents),
    k AS (SELECT host, arg_max(suffix, length(suffix)) AS suffix FROM (SELECT DISTINCT host FROM h), s WHERE host = suffix OR ends_with(host, '.' || suffix) GROUP BY host)"""


@query(rf"""WITH {_KNOWN}, {_OWN_DOMAINS}
    SELECT doc_id, host AS entity_key, confidence, suffix AS public_suffix, CASE WHEN host <> suffix THEN split_part(host[: length(host) - length(suffix) - 1], '.', -1) || '.' || suffix END AS registrable_domain
    FROM h JOIN k USING (host) WHERE confidence > 0.9 OR (host <> suffix AND NOT regexp_matches(host, '^[0-9.]*\.[a-z]+$')) UNION ALL {_PLANTED_DOMAINS}""")
def extract_domain(spark, d):
    docs = _with_domains(spark, d)
    suffixes = _suffixes(spark)
    items = extract.extract_all(docs, suffixes=suffixes).where("entity_type = 'domain'")
    said = F.col("attributes")
    return items.select("doc_id", "entity_key", "confidence", said["public_suffix"].alias("public_suffix"), said["registrable_domain"].alias("registrable_domain"))


@query("SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS entity_key, 0.95::DOUBLE AS confidence FROM pages")
def url_domains(spark, d):
    """The host of a url in running text, as a domain."""
    docs = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("see "), "url", F.lit(", and")).alias("text"))
    return extract.extract_all(docs).where("entity_type = 'domain'").select(F.col("doc_id").alias("page_id"), "entity_key", "confidence")


# addresses


@query(f"""
    SELECT doc_id, hit AS entity_key, '4' AS ip_version, CASE WHEN hit LIKE '127.%' THEN 'true' ELSE 'false' END AS is_loopback FROM ({_IPV4_ITEMS})
    UNION ALL SELECT doc_id, '2001:db8::' || printf('%x', doc_id % 65535 + 1) || ':0:0:1', '6', 'false' FROM documents
    UNION ALL SELECT doc_id, 'fe80::' || printf('%x', doc_id % 9 + 1), '6', 'false' FROM documents UNION ALL SELECT doc_id, '::1', '6', 'true' FROM documents
    UNION ALL SELECT doc_id, '::ffff:192.0.2.' || doc_id % 256, '6', 'false' FROM documents""")
def extract_ip(spark, d):
    """IPv4 of the texts, and planted IPv6 in several spellings between times and other things with colons."""
    parts = [
        F.coalesce("text", F.lit("")), F.lit(" at 12:34:56 在2001:0DB8:0:0:"), F.hex(F.col("doc_id") % 65535 + 1), F.lit(":0:0:1，fe80:0:0:0:0:0:0:"), F.col("doc_id") % 9 + 1,
        F.lit(" 0:0:0:0:0:0:0:1 1:2:3:4:5:6:7 0::ffff:c000:2"), F.lpad(F.hex(F.col("doc_id") % 256), 2, "0"), F.lit(" 1::2::3"),
    ]
    items = extract.extract_all(table(spark, d, "documents", spread=True).select("doc_id", F.concat(*parts).alias("text"))).where("entity_type = 'ip'")
    return items.select("doc_id", "entity_key", F.col("attributes")["ip_version"].alias("ip_version"), F.col("attributes")["is_loopback"].alias("is_loopback"))


@query("""
    SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'soft_deny' WHEN 1 THEN CASE WHEN event_id % 223 IN (0, 10, 127) THEN 'soft_deny' ELSE 'public' END WHEN 2 THEN 'hard_deny' WHEN 3 THEN 'soft_deny' WHEN 4 THEN 'hard_deny'
        WHEN 5 THEN 'soft_deny' WHEN 6 THEN 'soft_deny' WHEN 7 THEN 'public' WHEN 8 THEN 'hard_deny' WHEN 9 THEN NULL ELSE NULL END AS class FROM events""")
def host_classes(spark, d):
    e, low = F.col("event_id"), F.col("event_id") % 256
    forms = [
        F.concat(F.lit("10.1."), low, F.lit(".3")), F.concat(e % 223, F.lit(".8.8."), low), F.lit("169.254.169.254"), F.concat(F.lit("::ffff:10.1.2."), low), F.lit("FD00:ec2:0::254"),
        F.concat(F.lit("fe80::"), F.hex(e % 65536)), F.concat(F.lit("fd12:"), F.hex(e % 65536), F.lit("::9")), F.concat(F.lit("2001:4860:4860::"), F.hex(e % 65536)),
        F.lit("Metadata.Google.Internal."), F.concat(F.lit("host"), e, F.lit(".example.com")), F.concat(F.lit("1.2."), e),
    ]
    host = F.element_at(F.array(*forms), (e % 11 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.host_class(host).alias("class"))


@query("""
    WITH r(net, bits, owner) AS (SELECT (n_nationkey * 16777216)::BIGINT, 8, n_name FROM nation UNION ALL SELECT (n_nationkey * 16777216 + 65536 * n_nationkey)::BIGINT, 16, n_name || '/16' FROM nation),
    a AS (SELECT event_id, (event_id % 31 * 16777216 + user_id % 40 * 65536 + event_id % 65536)::BIGINT AS n FROM events)
    SELECT event_id, arg_max(owner, bits) AS owner FROM a LEFT JOIN r ON n >> (32 - bits) = net >> (32 - bits) GROUP BY event_id
    UNION ALL SELECT -1 - event_id, CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'doc' ELSE 'even' END END FROM events""")
def address_ranges(spark, d):
    """The owner of the longest range that holds each address, IPv4 and IPv6."""
    nation = table(spark, d, "nation")
    key, name = F.col("n_nationkey"), F.col("n_name")
    wide = nation.select(F.concat(key, F.lit(".0.0.0/8")).alias("cidr"), name.alias("owner"))
    narrow = nation.select(F.concat(key, F.lit("."), key, F.lit(".9.9/16")).alias("cidr"), F.concat(name, F.lit("/16")).alias("owner"))
    six = spark.createDataFrame([("2001:db8::/33", "even"), ("2001:db8:0:1::/64", "doc"), ("no range", "none")], "cidr string, owner string")
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, d, "events")
    v4 = rows.select("event_id", F.concat_ws(".", e % 31, u % 40, F.floor(e % 65536 / 256).cast("long"), e % 256).alias("ip"))
    v6 = rows.select((-1 - e).alias("event_id"), F.concat(F.lit("2001:db8:"), F.when(u % 2 == 0, F.when(e % 2 == 0, "0:1").otherwise("7fff:1")).otherwise("8000:1"), F.lit("::"), F.hex(e % 65536)).alias("ip"))
    numbered = v4.unionByName(v6).select("event_id", addresses.address_number(F.col("ip")).alias("number"))
    return addresses.match_ranges(numbered, "number", wide.unionByName(narrow).unionByName(six)).select("event_id", "owner")


# attributes


@query(f"""
    WITH i AS (SELECT DISTINCT lower(hit) AS entity_key FROM ({_HITS.format(_EMAIL_RE)}))
    SELECT 'email' AS entity_type, entity_key, 'domain=' || split_part(entity_key, '@', 2) AS attributes FROM i
    UNION ALL SELECT DISTINCT 'ip', hit, 'ip_version=4' FROM ({_IPV4_ITEMS})""")
def entity_attributes(spark, d):
    items = extract.extract_all(table(spark, d, "documents", spread=True)).where("entity_type IN ('email', 'ip')")
    overlaid = extract.overlaid_attributes(items)
    shown = F.filter(F.map_entries("attributes"), lambda a: a["key"].isin("domain", "ip_version"))
    return overlaid.select("entity_type", "entity_key", F.array_join(F.transform(shown, lambda a: F.concat_ws("=", a["key"], a["value"])), ";").alias("attributes"))


@query("""
    WITH a AS (SELECT user_id, event_id % 5 AS name, arg_max(event_type, event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)
    SELECT 'user' AS entity_type, user_id::VARCHAR AS entity_key, coalesce(string_agg('k' || name || '=' || value, ';' ORDER BY name), '') AS attributes
    FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN a USING (user_id) GROUP BY user_id""")
def attribute_overlay(spark, d):
    """What the last event of each kind says about a user; a third of the events say nothing."""
    e = F.col("event_id")
    said = F.when(e % 3 != 0, F.create_map(F.concat(F.lit("k"), e % 5), F.col("event_type")))
    items = table(spark, d, "events").select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_key"), said.alias("attributes"), e.alias("doc_id"), F.lit(0).alias("at"))
    shown = F.transform(F.map_entries("attributes"), lambda a: F.concat_ws("=", a["key"], a["value"]))
    return extract.overlaid_attributes(items).select("entity_type", "entity_key", F.array_join(shown, ";").alias("attributes"))
