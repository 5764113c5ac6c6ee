"""Queries over imports, feeds, bundles, text helpers, links, and changes to stored chunks and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunk, extract, graph, project, search, stix
from corvane.plans.catalog import query
from corvane.plans.text_queries import _EMAIL_RE, _HITS
from corvane.session import fresh_path, table
from corvane.sources import imports, web

# imports


@query("""
    SELECT o_orderkey::VARCHAR AS external_id, o_orderpriority AS title, CASE WHEN o_orderkey % 6 <> 5 THEN strftime(o_orderdate::DATE + 4000, '%Y-%m-%d') END AS published
    FROM orders WHERE o_orderkey % 5 <> 0""")
def import_mapping(spark, d):
    """Columns by other names, blank titles, and times in five forms and one that is none."""
    day, k = F.date_add("o_orderdate", 4000), F.col("o_orderkey") % 6
    forms = ["yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "'Mon, 'd MMM yyyy HH:mm:ss' GMT'"]
    when = F.lit("some day")
    for i, form in enumerate(forms):
        when = F.when(k == i, F.date_format(day.cast("timestamp"), form)).otherwise(when)
    when = F.when(k == 4, F.unix_timestamp(day.cast("timestamp")).cast("string")).otherwise(when)
    raw = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("GUID"), F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("Subject"), when.alias("PubDate")
    )
    found = imports.drop_empty(imports.map_fields(raw))
    return found.select("external_id", "title", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


@query("SELECT p_partkey::VARCHAR AS external_id, p_brand AS title, p_type AS summary FROM part")
def import_csv(spark, d):
    path = fresh_path(spark, "csv")
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("  "), "p_brand").alias("Headline"), F.col("p_type").alias("excerpt")).write.csv(path, header=True)
    return imports.read_csv(spark, path).select("external_id", "title", "summary")


@query("SELECT p_partkey::VARCHAR AS external_id, p_brand AS title, p_type AS body FROM part WHERE p_partkey % 7 <> 0")
def import_json_lines(spark, d):
    """An object a line; those with nothing to say are skipped."""
    path = fresh_path(spark, "json")
    says = F.col("p_partkey") % 7 != 0
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("guid"), F.when(says, F.col("p_brand")).alias("name"), F.when(says, F.col("p_type")).alias("content"))
    rows.write.json(path)
    return imports.read_json(spark, path).select("external_id", "title", "body")


@query("SELECT doc_id::VARCHAR AS external_id FROM documents WHERE 40 * strlen(text) > 65536")
def import_limits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("external_id"), F.repeat("text", 40).alias("body"))
    return imports.over_limits(docs).select("external_id")


@query("SELECT event_id, CAST(event_id % 40 AS INT) AS depth, event_id % 40 > 32 AS too_deep FROM events")
def import_depth(spark, d):
    """Brackets in strings are no nesting."""
    k = (F.col("event_id") % 40).cast("int")
    nested = F.concat(F.expr("repeat('[', cast(event_id % 40 AS int))"), F.lit('"}[\\"{"'), F.expr("repeat(']', cast(event_id % 40 AS int))"))
    depth = imports.json_depth(F.when(k == 0, F.lit('"[["')).otherwise(nested))
    return table(spark, d, "events").select("event_id", depth.alias("depth"), (depth > imports.MAX_DEPTH).alias("too_deep"))


@query("""
    SELECT 's' || s_suppkey AS source, 'i' || s_suppkey AS item_id, 'https://example.com/' || s_suppkey AS link, s_name AS title, 'About ' || s_name AS summary,
        CASE WHEN s_suppkey % 3 <> 2 THEN 'Ann' END AS author FROM supplier""")
def feed_entries(spark, d):
    """Feeds of three kinds, with an item each."""
    k, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    link = F.concat(F.lit("https://example.com/"), k)
    rss = F.concat(
        F.lit("<rss><channel><item><guid>i"), k, F.lit("</guid><link>"), link, F.lit("</link><link>https://example.com/other</link><title> "), name,
        F.lit("</title><description>About "), name, F.lit("</description><author>Ann</author><author>Bob</author></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i'), k, F.lit('</id><link href="'), link, F.lit('"/><title>'), name,
        F.lit("</title><content>About "), name, F.lit("</content><author><name>Ann</name></author></entry></feed>"),
    )
    json = F.concat(F.lit('{"items":[{"id":"i'), k, F.lit('","url":"'), link, F.lit('","title":"'), name, F.lit('","content_text":"About '), name, F.lit('"}]}'))
    kind = F.col("s_suppkey") % 3
    bodies = table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("source"), F.when(kind == 0, rss).when(kind == 1, atom).otherwise(json).alias("body"))
    return web.read_feeds(bodies).drop("published")


@query("""
    SELECT page_id, page_id % 4 = 0 AS made_up, page_id % 4 IN (1, 2) AS web FROM pages""")
def url_kinds(spark, d):
    k = F.col("page_id") % 4
    url = F.when(k == 0, " Import://x").when(k == 1, F.col("url")).when(k == 2, F.concat(F.lit(" HTTPS://Example.com/"), "page_id")).otherwise("ftp://example.com")
    return table(spark, d, "pages").select("page_id", T.is_import_url(url).alias("made_up"), T.is_web_url(url).alias("web"))


# text helpers


@query("""
    SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '…' ELSE text END AS by_chars,
        CASE WHEN strlen(text) > 101 THEN substr(text, 1, list_max(list_filter(range(0, 102), lambda i: strlen(substr(text, 1, i)) <= 101))) ELSE text END AS by_bytes
    FROM documents""")
def truncated_texts(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.truncate_chars(text, 50).alias("by_chars"), T.truncate_bytes(text, 101).alias("by_bytes"))


@query("SELECT c_custkey, c_name || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || chr(10) ELSE '' END AS chunked FROM customer")
def chunk_sources(spark, d):
    k = F.col("c_custkey") % 3
    part = F.when(k == 0, F.col("c_mktsegment")).when(k == 1, "")
    return table(spark, d, "customer").select("c_custkey", T.source_text(F.col("c_name"), part, F.lit(None).cast("string")).alias("chunked"))


@query("""SELECT c_custkey, '{"kept":"' || c_mktsegment || '","both":"new","added":"' || c_custkey || '"}' AS merged FROM customer""")
def merged_attributes(spark, d):
    base = F.to_json(F.struct(F.col("c_mktsegment").alias("kept"), F.lit("old").alias("both")))
    patch = F.to_json(F.struct(F.lit("new").alias("both"), F.col("c_custkey").cast("string").alias("added")))
    return table(spark, d, "customer").select("c_custkey", T.merge_json(base, patch).alias("merged"))


@query(r"""
    SELECT doc_id, regexp_replace(substr(text, greatest(strpos(lower(text), 'the') - 80, 1), 160), '(?i)(the)', '<em>\1</em>', 'g') AS shown
    FROM documents WHERE contains(lower(text), 'the')""")
def highlighted_hits(spark, d):
    rows = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("the")))
    return rows.select("doc_id", search.highlight(F.col("text"), "the").alias("shown"))


def _field_sql(name, field, boost):
    return f"""{name}_t AS (SELECT doc_id, regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}]+') AS terms FROM documents),
        {name}_c AS (SELECT doc_id, len(terms) AS n, len(list_filter(terms, lambda x: x = 'the')) AS f FROM {name}_t),
        {name}_g AS (SELECT count(*) AS docs, avg(n) AS avg_n, count(*) FILTER (f > 0) AS d FROM {name}_c),
        {name} AS (SELECT doc_id, {boost} * round(ln(1 + (docs - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / avg_n)), 6) AS score
            FROM {name}_c, {name}_g WHERE f > 0)"""


@query(f"""
    WITH {_field_sql("head", "substr(text, 1, 60)", 3)}, {_field_sql("body", "text", 1)}
    SELECT doc_id, max(score) AS score FROM (SELECT * FROM head UNION ALL SELECT * FROM body) GROUP BY doc_id""")
def boosted_fields(spark, d):
    docs = table(spark, d, "documents", spread=True).select("doc_id", F.substring("text", 1, 60).alias("title"), "text")
    return search.boosted(docs, ["the"], {"title": 3, "text": 1})


# links


@query("""
    SELECT doc_id, 'url' AS entity_type, 'https://example.com/p/' || doc_id || '?a=1&b=2' AS entity_key, 0.95::DOUBLE AS confidence FROM documents""")
def extract_url(spark, d):
    """Planted, as the texts hold few: with marks at the end, a bracket that nothing opens, and a parameter that tracks."""
    planted = F.concat(F.lit("(see 在https://Example.com/p/"), "doc_id", F.lit("?utm_source=x&b=2&a=1). And more"))
    return extract.extract_urls(table(spark, d, "documents").select("doc_id", planted.alias("text"))).select("doc_id", "entity_type", "entity_key", "confidence")


@query(f"""
    SELECT DISTINCT split_part(lower(hit), '@', 2) AS domain, 'associated_with' AS relationship_type, 'email' AS entity_type, lower(hit) AS entity_key FROM ({_HITS.format(_EMAIL_RE)})
    UNION SELECT regexp_extract(url, '://([^/:?#]+)', 1), 'belongs_to', 'url', url FROM pages""")
def derived_links(spark, d):
    items = extract.extract_emails(table(spark, d, "documents", spread=True)).select("entity_type", "entity_key")
    urls = table(spark, d, "pages").select(F.lit("url").alias("entity_type"), F.col("url").alias("entity_key"))
    return extract.derived_edges(items.unionByName(urls))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 10 <> 9")
def documents_to_extract(spark, d):
    docs = table(spark, d, "documents").withColumn("is_duplicate", F.col("doc_id") % 10 == 9)
    return extract.to_extract(docs).select("doc_id", "source")


@query("SELECT 'stored' AS index, doc_id FROM documents WHERE doc_id % 50 = 0")
def missing_index(spark, d):
    """Of two indexes one isn't there."""
    path = fresh_path(spark, "index")
    table(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id").write.parquet(path)
    each = [search.read_index(spark, p, "doc_id long").select(F.lit(name).alias("index"), "doc_id") for name, p in (("stored", path), ("none", path + "-none"))]
    return each[0].unionByName(each[1])


@query("SELECT o_custkey, o_orderkey, nth FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS nth FROM orders) WHERE nth <= 5")
def collection_objects(spark, d):
    """The first links of each collection, ascending."""
    return project.latest_per(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", [F.col("o_orderkey")], 5)


# bundles


@query("""
    WITH s AS (SELECT lower(c_name) AS name_key, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'old' END AS description, (c_custkey % 10) / 10.0 AS confidence FROM customer WHERE c_custkey % 2 = 0),
    f AS (SELECT lower(c_name) AS name_key, upper(c_name) AS name, 'new' AS description FROM customer WHERE c_custkey % 3 = 0)
    SELECT 'person' AS entity_type, name_key, coalesce(s.name, f.name) AS name, coalesce(s.description, f.description) AS description,
        CASE WHEN f.name IS NOT NULL THEN greatest(coalesce(confidence, 0), 0.8) ELSE confidence END::DOUBLE AS confidence FROM s FULL JOIN f USING (name_key)""")
def bundle_upsert(spark, d):
    rows = table(spark, d, "customer").withColumns({"entity_type": F.lit("person"), "name_key": F.lower("c_name")})
    k = F.col("c_custkey")
    stored = rows.where(k % 2 == 0).select("entity_type", "name_key", F.col("c_name").alias("name"), F.when(k % 4 != 0, "old").alias("description"), ((k % 10) / 10.0).alias("confidence"))
    found = rows.where(k % 3 == 0).select("entity_type", "name_key", F.upper("c_name").alias("name"), F.lit("new").alias("description"))
    return stix.import_entities(stored, found)


@query("""
    SELECT o_orderkey AS entity_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
        AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1993-06-01' AND o_orderdate <= TIMESTAMP '1995-01-31' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def export_selection(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("entity_id"), F.col("o_orderpriority").alias("entity_type"), F.when(k % 7 == 0, k + 1).alias("merged_into"),
        F.to_date("o_orderdate").alias("first_seen"), F.date_add("o_orderdate", 30).alias("last_seen"),
    )
    ids = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("entity_id"))
    return stix.select_for_export(rows, ids, ("1-URGENT", "2-HIGH"), ("1993-06-01", "1995-01-31")).select("entity_id")


@query("SELECT event_id, event_id % 5 < 2 AS valid FROM events")
def bundle_ids(spark, d):
    tail = F.concat(F.lit("--"), F.lpad(F.lower(F.hex("event_id")), 8, "0"), F.lit("-0000-5000-8000-000000000000"))
    kinds = ("indicator", "x-tool9", "Indicator", "-tool", "tool-")
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").select("event_id", stix.is_id(F.concat(kind, tail)).alias("valid"))


# changes to what is stored


@query("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_orderkey % 3 = 0 OR (l_orderkey % 5 = 0 AND l_linenumber = 1)")
def changed_chunks(spark, d):
    """Of some documents a chunk's text has changed, of others one is new."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit("record").alias("strategy"), F.col("l_linenumber").alias("seq"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("l_returnflag").alias("chunk")
    )
    old = rows.where("NOT (doc_id % 5 = 0 AND seq = 1)").withColumn("chunk", F.when(F.col("doc_id") % 3 == 0, "before").otherwise(F.col("chunk")))
    return chunk.changed_documents(rows, old)


_LINKS = "SELECT DISTINCT 'o' || o_custkey AS src, 'n' || (o_orderkey % 97) AS dst FROM orders"


def _links(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("src"), F.concat(F.lit("n"), F.col("o_orderkey") % 97).alias("dst")).distinct()


@query(f"SELECT src, dst FROM ({_LINKS}) WHERE dst NOT IN ('n1', 'n2') AND src <> 'o7' AND NOT (dst = 'n3')")
def graph_deletes(spark, d):
    """Nodes go with their edges, and some edges go alone."""
    edges = _links(spark, d)
    left = graph.without_nodes(edges, spark.createDataFrame([("n1",), ("n2",), ("o7",)], "node string"))
    return graph.without_edges(left, edges.where("dst = 'n3'"), ["src", "dst"])


@query(f"""
    SELECT src, dst, CASE WHEN dst IN ('n4', 'n5') THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM ({_LINKS}) WHERE NOT (dst = 'n5' AND src LIKE 'o1%')""")
def graph_change_apply(spark, d):
    """Two nodes' edges have changed; some of those are gone by the time that the change is read."""
    links = _links(spark, d)
    canonical = links.where("NOT (dst = 'n5' AND src LIKE 'o1%')").withColumn("confidence", F.lit(0.9))
    return graph.apply_changes(links.withColumn("confidence", F.lit(0.5)), links.where("dst IN ('n4', 'n5')"), canonical, ["src", "dst"])
