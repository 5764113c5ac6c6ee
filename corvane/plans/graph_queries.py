"""Queries over the graph, timelines, resolution and discovery; the graph is that of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import graph, resolve, timeline
from corvane.plans.catalog import query
from corvane.session import materialise, table

_EDGES = """edges AS (
    SELECT 'p' || l_partkey || '>s' || l_suppkey AS edge_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, min(l_returnflag) AS edge_type,
        max(l_discount) AS confidence, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS evidence_count
    FROM lineitem GROUP BY l_partkey, l_suppkey)"""
_WAYS = f"{_EDGES}, ways AS (SELECT edge_id, src AS a, dst AS b FROM edges UNION ALL SELECT edge_id, dst, src FROM edges)"
_STARTS = ("s1", "p1")


def _bfs(hops: int, starts: str) -> str:
    return f"""WITH RECURSIVE {_WAYS}, walk AS (SELECT start, start AS node, 0 AS hop FROM ({starts})
        UNION SELECT w.start, b, hop + 1 FROM walk w JOIN ways ON a = w.node WHERE hop < {hops}),
        seen AS (SELECT start, node, min(hop) AS hop FROM walk GROUP BY ALL)"""


_TWO = "VALUES ('s1'), ('p1')"


def edges(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_returnflag").alias("edge_type"), F.max("l_discount").alias("confidence"), F.min("l_shipdate").alias("first_seen"),
        F.max("l_shipdate").alias("last_seen"), F.count("*").alias("evidence_count"),
    )
    src, dst = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    return rows.select(F.concat(src, F.lit(">"), dst).alias("edge_id"), src.alias("src"), dst.alias("dst"), "edge_type", "confidence", "first_seen", "last_seen", "evidence_count")


def _starts(spark):
    return spark.createDataFrame([(s,) for s in _STARTS], "node string")


@query(f"{_bfs(2, 'SELECT * FROM (' + _TWO + ') t(start)')} SELECT start, node FROM seen WHERE node <> start")
def graph_neighbors_k(spark, d):
    return graph.neighbours(materialise(edges(spark, d), "edges"), _starts(spark), 2)


@query(f"{_bfs(2, 'SELECT * FROM (' + _TWO + ') t(start)')} SELECT start, node FROM seen WHERE node <> start AND starts_with(node, 's')")
def graph_neighbors_by_type(spark, d):
    found = materialise(edges(spark, d), "edges")
    nodes = graph.both_ways(found).select(F.col("a").alias("node")).distinct().withColumn("node_type", F.when(F.col("node").startswith("s"), "supplier").otherwise("part"))
    return graph.neighbours(found, _starts(spark), 2, nodes, ["supplier"])


@query(f"{_bfs(1, 'SELECT * FROM (' + _TWO + ') t(start)')} SELECT DISTINCT start, edge_id FROM seen JOIN ways ON a = node")
def graph_relationships_k(spark, d):
    return graph.neighbourhood_edges(materialise(edges(spark, d), "edges"), _starts(spark), 2)


_PAIRS = "SELECT * FROM (VALUES ('s1', 's2'), ('p1', 's1'), ('p1', 'p2'), ('s1', 's1'), ('s1', 'nobody')) t(start, stop)"


@query(f"""{_bfs(6, "SELECT DISTINCT start FROM (" + _PAIRS + ")")} SELECT p.start, p.stop AS "end", hop AS hops
    FROM ({_PAIRS}) p LEFT JOIN seen s ON s.start = p.start AND s.node = p.stop""")
def graph_shortest_path(spark, d):
    pairs = spark.createDataFrame([("s1", "s2"), ("p1", "s1"), ("p1", "p2"), ("s1", "s1"), ("s1", "nobody")], "start string, end string")
    return graph.shortest_path_lengths(materialise(edges(spark, d), "edges"), pairs, 6)


@query(f"""WITH {_EDGES} SELECT edge_id, confidence FROM edges WHERE first_seen <= TIMESTAMP '1996-06-30' AND last_seen >= TIMESTAMP '1996-01-01'
    AND edge_type IN ('A', 'R') AND confidence >= 0.05""")
def graph_edges_time_range(spark, d):
    import datetime

    lo, hi = datetime.datetime(1996, 1, 1), datetime.datetime(1996, 6, 30)
    return graph.edge_filter(edges(spark, d), ["A", "R"], 0.05, (lo, hi)).select("edge_id", "confidence")


_CO = """links AS (SELECT DISTINCT 'o' || o_custkey AS src, 'n' || (o_orderkey % 997) AS dst FROM orders)"""


@query(f"""WITH {_CO}, w AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), deg AS (SELECT a, count(*) AS n FROM w GROUP BY a),
    via AS (SELECT x.a, y.a AS c, count(*) AS shared FROM w x JOIN w y ON x.b = y.b AND x.a < y.a GROUP BY ALL)
    SELECT via.a, c, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM via JOIN deg p ON p.a = via.a JOIN deg q ON q.a = c
    ANTI JOIN w ON w.a = via.a AND w.b = c WHERE shared / (p.n + q.n - shared) >= 0.2""")
def graph_jaccard(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("src"), F.concat(F.lit("n"), F.col("o_orderkey") % 997).alias("dst")).distinct()
    found = graph.neighbour_jaccard(rows.withColumn("edge_id", F.concat("src", "dst")), 0.2)
    return found.withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {_EDGES}, new AS (SELECT src, dst, edge_type, 0.5::DOUBLE AS confidence, TIMESTAMP '2000-01-01' AS first_seen, TIMESTAMP '2000-01-02' AS last_seen
        FROM edges WHERE dst = 's1' UNION ALL SELECT 'p0', 's1', 'N', 0.5, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-02')
    SELECT src, dst, edge_type, coalesce(n.confidence, o.confidence) AS confidence, strftime(coalesce(o.first_seen, n.first_seen), '%Y-%m-%d') AS first_seen,
        strftime(coalesce(n.last_seen, o.last_seen), '%Y-%m-%d') AS last_seen FROM edges o FULL JOIN new n USING (src, dst, edge_type)""")
def graph_edge_upsert(spark, d):
    old = edges(spark, d)
    at = lambda day: F.lit(f"2000-01-{day}").cast("timestamp_ntz")
    more = spark.createDataFrame([("p0", "s1", "N")], "src string, dst string, edge_type string")
    new = old.where("dst = 's1'").select("src", "dst", "edge_type").unionByName(more)
    new = new.select("*", F.lit(0.5).alias("confidence"), at("01").alias("first_seen"), at("02").alias("last_seen"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return graph.upsert_edges(old, new).select("src", "dst", "edge_type", "confidence", day("first_seen"), day("last_seen"))


@query(f"WITH {_EDGES} SELECT edge_id FROM edges WHERE CAST(substr(src, 2) AS INT) % 2 = 0 AND CAST(substr(dst, 2) AS INT) % 2 = 0")
def graph_inner_edges(spark, d):
    found = materialise(edges(spark, d), "edges")
    nodes = graph.both_ways(found).select(F.col("a").alias("node")).distinct().where("CAST(substr(node, 2) AS INT) % 2 = 0")
    return graph.inside(found, nodes).select("edge_id")


@query(f"WITH {_WAYS} SELECT DISTINCT b AS candidate, 0.4::DOUBLE AS score, 1 AS depth FROM ways WHERE a = 's1' AND starts_with(b, 'p')")
def discovery_graph_expansion(spark, d):
    found = graph.neighbours(materialise(edges(spark, d), "edges"), spark.createDataFrame([("s1",)], "node string"), 1).where(F.col("node").startswith("p"))
    return found.select(F.col("node").alias("candidate"), F.lit(0.4).alias("score"), F.lit(1).alias("depth"))


@query("""
    SELECT s_suppkey AS source, n FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_custkey = 7 GROUP BY l_suppkey) ORDER BY source LIMIT 100""")
def sources_by_entity(spark, d):
    """Entity to sources over two equi joins, distinct before the limit."""
    own = table(spark, d, "orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    met = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("source")).join(own, "l_orderkey")
    return met.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").limit(100)


@query("""
    WITH own AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 10),
    n AS (SELECT count(*) >= 10 AS truncated FROM own)
    SELECT o_orderkey AS extraction_id, o_orderkey AS doc_id, strftime(CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%d') AS at,
        CASE WHEN o_orderstatus = 'P' THEN 'observed' ELSE 'published' END AS time_source, truncated
    FROM own, n WHERE o_orderpriority <> '5-LOW'""")
def entity_timeline(spark, d):
    orders = table(spark, d, "orders")
    mentions = orders.select(F.col("o_orderkey").alias("extraction_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("entity"))
    docs = orders.select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"),
        F.expr("o_orderdate + INTERVAL 1 DAY").alias("observed_at"), (F.col("o_orderpriority") == "5-LOW").alias("is_duplicate"),
    )
    return timeline.entity_timeline(mentions, docs, 7, 10).withColumn("at", F.date_format("at", "yyyy-MM-dd"))


# resolution: customers are people and suppliers organisations; parts have brands as platforms

_NAMES = """names AS (SELECT 'c' || c_custkey AS entity, 'person' AS entity_type, regexp_replace(c_name, '[^0-9]', '', 'g') AS name_key FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'organization', regexp_replace(s_name, '[^0-9]', '', 'g') FROM supplier)"""


def _pair_sql(source: str, key: str, differ: str, method: str) -> str:
    return f"""SELECT DISTINCT x.entity AS a, y.entity AS b, '{method}' AS method, {resolve.SCORES[method]}::DOUBLE AS score
        FROM {source} x JOIN {source} y ON x.{key} = y.{key} AND x.entity < y.entity {differ}"""


@query(f"WITH {_NAMES} {_pair_sql('names', 'name_key', 'AND x.entity_type <> y.entity_type', 'normalized_name')}")
def resolve_normalized_name(spark, d):
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "").alias("name_key")
    people = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity"), F.lit("person").alias("entity_type"), digits("c_name"))
    firms = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity"), F.lit("organization").alias("entity_type"), digits("s_name"))
    return resolve.by_normalized_name(people.unionByName(firms))


@query(f"WITH al AS (SELECT 's' || s_suppkey AS entity, s_nationkey || ':' || CAST(floor(s_acctbal / 1000) AS INT) AS alias FROM supplier) {_pair_sql('al', 'alias', '', 'alias')}")
def resolve_alias(spark, d):
    alias = F.concat_ws(":", "s_nationkey", F.floor(F.col("s_acctbal") / 1000)).alias("alias")
    return resolve.by_alias(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity"), alias))


@query(f"WITH l AS (SELECT 'p' || p_partkey AS entity, p_brand || p_size || p_type AS domain FROM part) {_pair_sql('l', 'domain', '', 'domain')}")
def resolve_domain(spark, d):
    return resolve.by_domain(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity"), F.concat("p_brand", "p_size", "p_type").alias("domain")))


@query(f"WITH i AS (SELECT 'p' || p_partkey AS entity, p_brand AS namespace, p_type || p_size AS value FROM part) {_pair_sql('i', 'value', 'AND x.namespace <> y.namespace', 'account_handle')}")
def resolve_account_handle(spark, d):
    ids = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity"), F.concat("p_brand", F.lit("_handle")).alias("namespace"), F.concat("p_type", "p_size").alias("value"))
    return resolve.by_account_handle(ids)


@query("""
    WITH i AS (SELECT 'p' || p_partkey AS entity, p_brand AS namespace, p_type || p_size AS value FROM part),
    f AS (SELECT namespace, value, min(entity) AS a FROM i GROUP BY ALL)
    SELECT DISTINCT a, entity AS b, 'exact_identifier' AS method, 0.95::DOUBLE AS score FROM i JOIN f USING (namespace, value) WHERE entity > a""")
def identifier_conflicts(spark, d):
    ids = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity"), F.col("p_brand").alias("namespace"), F.concat("p_type", "p_size").alias("value"))
    return resolve.identifier_conflicts(ids)


@query(f"""WITH {_EDGES}, m AS (SELECT src, edge_type, CASE WHEN dst IN ('s2', 's3') THEN 's1' ELSE dst END AS dst, evidence_count, confidence, first_seen, last_seen FROM edges)
    SELECT src, edge_type, dst, CAST(sum(evidence_count) AS BIGINT) AS evidence_count, max(confidence) AS confidence, strftime(min(first_seen), '%Y-%m-%d') AS first_seen,
        strftime(max(last_seen), '%Y-%m-%d') AS last_seen FROM m WHERE src <> dst GROUP BY ALL""")
def merge_collision(spark, d):
    merged = spark.createDataFrame([("s2", "s1"), ("s3", "s1")], "entity string, survivor string")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return resolve.merge_edges(edges(spark, d), merged).select("src", "edge_type", "dst", "evidence_count", "confidence", day("first_seen"), day("last_seen"))
