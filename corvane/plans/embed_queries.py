"""Queries over what is embedded, duplicates by meaning, pages of listings, and small operational decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import domains
from corvane.operators import embed, extract, graph, ops, rebuild, resolve, search
from corvane.plans.catalog import query
from corvane.session import fresh_path, materialise, table


@query("""
    SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ': ' || c_mktsegment END AS embedded,
        'embedding-cache:v1:' || sha256(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ': ' || c_mktsegment END) AS cache_key FROM customer""")
def embedding_keys(spark, d):
    text = embed.entity_text(F.col("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("embedded"), embed.cache_key(text).alias("cache_key"))


@query("""
    SELECT doc_id AS target, sha256(text) AS content_hash FROM documents
    WHERE text IS NOT NULL AND NOT (doc_id % 4 = 0) AND NOT (doc_id % 4 = 1 AND source <> 'x' AND length(text) % 2 = 0)""")
def embed_if_new(spark, d):
    """Stored are some texts as they are, and others as they were before a change."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("target"), F.lit("document").alias("target_type"), F.lit("m").alias("model"), "text", "source")
    same = rows.where("target % 4 = 0 OR (target % 4 = 1 AND source <> 'x' AND length(text) % 2 = 0)")
    changed = rows.where("target % 4 = 2").withColumn("text", F.concat(F.lit("before "), "text"))
    stored = same.unionByName(changed).withColumn("content_hash", embed.content_key(F.col("text")))
    return embed.to_embed(rows.drop("source"), stored).select("target", "content_hash")


@query("""
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN lang <> 'fr' THEN 'title' END WHEN trim(coalesce(text, '')) <> '' THEN 'body' WHEN lang <> 'fr' THEN 'title' END AS section FROM documents""")
def matched_sections(spark, d):
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", embed.matched_section(body, F.when(F.col("lang") != "fr", F.col("lang"))).alias("section"))


_COS = "list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))"


@query(f"""
    WITH p AS (SELECT b.vec_id AS doc_id, a.vec_id AS parent, {_COS} AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
    SELECT doc_id, parent, round(cos, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, parent) AS r FROM p WHERE cos >= 0.45) WHERE r = 1""")
def dedup_semantic(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("model"), "embedding")
    return embed.semantic_parents(vectors, 0.45).withColumn("similarity", F.round("similarity", 6))


@query("""
    WITH m AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'), t AS (SELECT count(*) AS total FROM m)
    SELECT o_orderkey, o_totalprice, total FROM m, t ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def page_with_total(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return search.page_with_total(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("""
    WITH p AS (SELECT 'full' AS page, o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_custkey % 50 = 1),
    q AS (SELECT page, id FROM p WHERE r <= 5 UNION ALL SELECT * FROM (SELECT 'short', n_nationkey::BIGINT FROM nation WHERE n_nationkey < 3))
    SELECT page, max(id) AS last_id, CASE WHEN count(*) >= 5 THEN max(id) END AS next_cursor FROM q GROUP BY page""")
def next_cursors(spark, d):
    full = table(spark, d, "orders").where("o_custkey % 50 = 1").select(F.col("o_orderkey").alias("id"))
    short = table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("long").alias("id"))
    rows = [search.next_cursor(search.first_page(r, "id", 5), "id", 5).select(F.lit(name).alias("page"), "last_id", "next_cursor") for name, r in (("full", full), ("short", short))]
    return rows[0].unionByName(rows[1])


@query("""
    SELECT user_id AS collection, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS ai_calls, count(*) AS requests FROM events
    WHERE ts::DATE = (SELECT min(ts)::DATE FROM events) GROUP BY user_id ORDER BY ai_calls DESC, requests DESC, user_id LIMIT 20""")
def daily_usage(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("collection"), F.to_date("ts").alias("day"), (F.col("event_type") == "click").cast("long").alias("ai"))
    rows = events.groupBy("collection", "day").agg(F.sum("ai").alias("ai_calls"), F.count("*").alias("requests"))
    return ops.daily_usage(rows, events.agg(F.min("day")).first()[0]).select("collection", "ai_calls", "requests")


@query("""
    SELECT event_id, round((event_id % 5000) / 1000.0 * 0.5 + (event_id % 700) / 1000.0 * 1.5, 9) AS cost,
        CASE WHEN event_id * 7 <= 3000 THEN 0 ELSE least(greatest(event_id * 7 // 3000, 1), 8) END AS sleep_factor FROM events""")
def cost_and_pressure(spark, d):
    rows = table(spark, d, "events")
    cost = ops.token_cost(F.col("event_id") % 5000, F.col("event_id") % 700, 0.5, 1.5)
    return rows.select("event_id", F.round(cost, 9).alias("cost"), ops.lag_sleep_factor(F.col("event_id") * 7, 3000).alias("sleep_factor"))


@query("""
    SELECT event_id AS job_id, CASE WHEN event_id % 4 = 1 AND event_id % 3 IN (0, 1) THEN 'failed' ELSE ['queued', 'running', 'completed', 'failed'][event_id % 4 + 1] END AS status,
        CASE WHEN event_id % 4 = 1 AND event_id % 3 IN (0, 1) THEN 'orphan' END AS error FROM events""")
def orphan_reclaim(spark, d):
    import datetime

    e = F.col("event_id")
    kind, status = F.get(F.array(*map(F.lit, ("graph", "stix", "collect"))), (e % 3).cast("int")), F.get(F.array(*map(F.lit, ("queued", "running", "completed", "failed"))), (e % 4).cast("int"))
    jobs = table(spark, d, "events").select(e.alias("job_id"), kind.alias("job_type"), status.alias("status"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error"))
    return ops.reclaim_orphans(jobs, ("graph", "stix"), datetime.datetime(2026, 1, 1), "orphan").select("job_id", "status", "error")


@query("""
    WITH b AS (SELECT s_suppkey % 40 AS collection, 200 AS cap, s_suppkey AS id, row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY s_suppkey) AS r FROM supplier),
    g AS (SELECT collection, count(*) AS n FROM b WHERE id % 3 = 0 GROUP BY collection),
    s AS (SELECT collection, id, row_number() OVER (PARTITION BY collection ORDER BY id) AS r FROM b WHERE id % 3 <> 0)
    SELECT collection, 'graph_expansion' AS method, id, 0.7::DOUBLE AS score FROM (SELECT collection, id, row_number() OVER (PARTITION BY collection ORDER BY id) AS r FROM b WHERE id % 3 = 0) WHERE r <= 2
    UNION ALL SELECT s.collection, 'source_expansion', id, 0.4 FROM s LEFT JOIN g USING (collection) WHERE r + least(coalesce(n, 0), 2) <= 2""")
def source_expansion(spark, d):
    rows = table(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("collection"), F.col("s_suppkey").alias("id"))
    found = rows.where("id % 3 = 0").withColumn("score", F.lit(0.7))
    return graph.source_expansion(found, rows.where("id % 3 <> 0"), 2)


@query("""
    SELECT n_nationkey::BIGINT AS collection, CASE WHEN n_nationkey % 3 = 0 THEN 10 * n_nationkey ELSE 200 END::BIGINT AS max_candidates_per_run, 500::BIGINT AS max_requests_per_run, 50::BIGINT AS max_ai_calls_per_run,
        CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey ELSE 3 END::BIGINT AS max_depth, 5000::BIGINT AS daily_request_budget, 500::BIGINT AS daily_ai_budget FROM nation""")
def default_budget(spark, d):
    """Collections of which some set a limit of their own; all else is by default."""
    k = F.col("n_nationkey").cast("long")
    own = table(spark, d, "nation").select(k.alias("collection"), F.when(k % 3 == 0, 10 * k).alias("max_candidates_per_run"), F.when(k % 5 == 0, k).alias("max_depth"))
    return ops.with_default_budget(own)


@query("""
    WITH l AS (SELECT DISTINCT 's' || s_suppkey AS entity, 'alias ' || s_nationkey AS alias FROM supplier), f AS (SELECT alias, min(entity) AS a FROM l GROUP BY alias HAVING count(*) > 1)
    SELECT DISTINCT a, entity AS b, 'alias' AS method, 0.55::DOUBLE AS score FROM l JOIN f USING (alias) WHERE entity > a""")
def resolve_alias_groups(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity"), F.concat(F.lit("alias "), "s_nationkey").alias("alias"))
    return resolve.star_links(rows, ["alias"], "alias")


@query("""
    WITH i AS (SELECT DISTINCT 'p' || p_partkey AS entity, p_brand AS namespace, p_type || p_size AS value FROM part),
    f AS (SELECT value, min(entity) AS first, arg_min(namespace, entity) AS kind FROM i GROUP BY value HAVING count(DISTINCT namespace) > 1),
    g AS (SELECT f.value, first, kind, min(entity) AS second FROM f JOIN i ON i.value = f.value AND namespace <> kind GROUP BY ALL),
    h AS (SELECT entity, CASE WHEN namespace <> kind THEN first ELSE second END AS hub FROM i JOIN g USING (value))
    SELECT DISTINCT least(entity, hub) AS a, greatest(entity, hub) AS b, 'account_handle' AS method, 0.35::DOUBLE AS score FROM h WHERE entity <> hub""")
def resolve_handle_groups(spark, d):
    """Accounts with one handle on different platforms, in a row a member and not in all pairs."""
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity"), F.col("p_brand").alias("namespace"), F.concat("p_type", "p_size").alias("value"))
    return resolve.star_links(rows, ["value"], "account_handle", "namespace")


@query("SELECT 'o' || o_custkey AS src, 'n' || (o_orderkey % 997) AS dst, CAST(count(*) AS BIGINT) AS evidence_count FROM orders GROUP BY ALL")
def graph_rebuild(spark, d):
    """The edges of all orders, built in about four pages: stopped after the first, taken up again, stopped once more, and finished."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    again = rebuild.Rebuild(spark, fresh_path(spark, "graph"))
    edges = lambda page: page.groupBy(F.concat(F.lit("o"), "o_custkey").alias("src"), F.concat(F.lit("n"), F.col("o_orderkey") % 997).alias("dst")).agg(F.count("*").alias("n"))
    rows = orders.count() // 4 + 1
    for stop in (1, 2, None):
        again.run(orders, "o_orderkey", edges, rows, stop)
    return again.read("src string, dst string, n long").groupBy("src", "dst").agg(F.sum("n").alias("evidence_count"))


_GRAPH = "links AS (SELECT DISTINCT 'o' || o_custkey AS src, 'n' || (o_orderkey % 997) AS dst FROM orders)"


@query(f"""WITH {_GRAPH}, w AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), deg AS (SELECT a, count(*) AS n FROM w GROUP BY a),
    via AS (SELECT x.a, y.a AS c, count(*) AS shared FROM w x JOIN w y ON x.b = y.b AND x.a < y.a GROUP BY ALL)
    SELECT via.a, c AS b, 'graph_context' AS method, round(0.7 * shared / (p.n + q.n - shared), 6) AS score FROM via JOIN deg p ON p.a = via.a JOIN deg q ON q.a = c
    ANTI JOIN w ON w.a = via.a AND w.b = c WHERE shared / (p.n + q.n - shared) >= 0.25""")
def resolve_graph_context(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("src"), F.concat(F.lit("n"), F.col("o_orderkey") % 997).alias("dst")).distinct()
    return resolve.by_graph_context(graph.neighbour_jaccard(rows.withColumn("edge_id", F.concat("src", "dst")), 0.25))


@query("""
    WITH l AS (SELECT DISTINCT 'p' || p_partkey AS entity, p_brand AS domain FROM part), f AS (SELECT domain, min(entity) AS a FROM l GROUP BY domain HAVING count(*) > 1)
    SELECT DISTINCT a, entity AS b, 'domain' AS method, 0.3::DOUBLE AS score FROM l JOIN f USING (domain) WHERE entity > a""")
def resolve_domain_groups(spark, d):
    """A frequent domain: a row a member and not all pairs of them."""
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity"), F.col("p_brand").alias("domain"))
    return resolve.star_links(rows, ["domain"], "domain")


def _planted(spark, d):
    """Documents with indicators of which the tables have none, put at their ends."""
    i = F.col("doc_id").cast("string")
    planted = F.concat(F.coalesce("text", F.lit("")), F.lit(" 見cve-2"), F.lpad(F.col("doc_id") % 1000, 3, "0"), F.lit("-"), F.lpad(i, 6, "0"), F.lit("的 www.GitHub.com/User_"), i, F.lit(" github.com/login"))
    return materialise(table(spark, d, "documents").select("doc_id", planted.alias("text")), "planted")


@query("SELECT doc_id, 'CVE-2' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '-' || lpad(doc_id::VARCHAR, 6, '0') AS entity_key, 1.0::DOUBLE AS confidence FROM documents")
def extract_cve(spark, d):
    return extract.extract_cves(_planted(spark, d)).select("doc_id", "entity_key", "confidence")


@query("SELECT doc_id, 'github:user_' || doc_id AS entity_key, 0.75::DOUBLE AS confidence FROM documents")
def extract_account(spark, d):
    return extract.extract_accounts(_planted(spark, d)).select("doc_id", "entity_key", "confidence")


@query("""
    WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages)
    SELECT host, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS domain FROM h WHERE host LIKE '%.example.%'""")
def registrable_hosts(spark, d):
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host")).distinct().where("host LIKE '%.example.%'")
    suffixes = spark.createDataFrame([(s,) for s in ("com", "net", "org", "example.com", "example.net", "example.org")], "suffix string")
    return domains.with_suffix(hosts, "host", suffixes).select("host", F.col("registrable").alias("domain"))
