"""Queries over search and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import search
from corvane.plans.catalog import query
from corvane.session import table

_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_BM25 = f"""t AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
    c AS (SELECT doc_id, len(terms) AS n, len(list_filter(terms, lambda x: x = 'blend')) AS f1, len(list_filter(terms, lambda x: x = 'the')) AS f2 FROM t),
    g AS (SELECT count(*) AS docs, avg(n) AS avg_n, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM c),
    s AS (SELECT doc_id, round(ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / avg_n))
        + ln(1 + (docs - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / avg_n)), 6) AS score FROM c, g WHERE f1 > 0 AND f2 > 0),
    bm AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s)"""
_COS = """q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
    sims AS (SELECT vec_id, label, round(coalesce(list_inner_product(embedding::DOUBLE[], e::DOUBLE[])
        / nullif(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[])), 0), 0), 6) AS score FROM embeddings, q)"""


def _probe(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


@query(f"WITH {_BM25} SELECT rank, doc_id, score FROM bm WHERE rank <= 20")
def bm25_topk(spark, d):
    return search.bm25(table(spark, d, "documents", spread=True), ["blend", "the"], 20)


@query(f"WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents) SELECT doc_id FROM t WHERE (list_contains(terms, 'blend') OR list_contains(terms, 'ouou')) AND list_contains(terms, 'the') AND NOT list_contains(terms, 'of')")
def keyword_search(spark, d):
    rows = table(spark, d, "documents", spread=True).select("doc_id", search.terms_of(F.col("text")).alias("terms"))
    return rows.where(search.query_condition("(blend OR ouou) the AND NOT of", F.col("terms"))).select("doc_id")


@query(f"WITH {_COS} SELECT vec_id, score FROM sims ORDER BY score DESC, vec_id LIMIT 10")
def knn_topk(spark, d):
    return search.nearest(table(spark, d, "embeddings"), _probe(spark, d), 10)


@query(f"WITH {_COS} SELECT vec_id, score FROM sims WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 10")
def knn_prefiltered(spark, d):
    return search.nearest(table(spark, d, "embeddings"), _probe(spark, d), 10, F.col("label") == 1)


@query(f"WITH {_COS} SELECT vec_id, score FROM (SELECT * FROM sims ORDER BY score DESC, vec_id LIMIT 11) WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def similar_excluding_self(spark, d):
    return search.similar(table(spark, d, "embeddings"), 0, 10)


@query(f"""WITH {_BM25}, {_COS}, v AS (SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM sims)
    SELECT id, round(coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0), 9) AS score, k.rank AS left_rank, v.rank AS right_rank
    FROM (SELECT doc_id AS id, rank FROM bm WHERE rank <= 60) k FULL JOIN (SELECT * FROM v WHERE rank <= 60) v USING (id) ORDER BY score DESC, id LIMIT 20""")
def rrf_hybrid(spark, d):
    from pyspark.sql import Window

    n = search.pool_size(20)
    left = search.bm25(table(spark, d, "documents", spread=True), ["blend", "the"], n).select(F.col("doc_id").alias("id"), "rank")
    nearest = search.nearest(table(spark, d, "embeddings"), _probe(spark, d), n)
    right = nearest.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rank"))
    return search.fuse_ranks(left, right, 20)


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id < 150 ORDER BY doc_id DESC LIMIT 20")
def keyset_page(spark, d):
    return search.keyset_page(table(spark, d, "documents", spread=True), 150, 20).select("doc_id", "lang", "source")


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm WHERE score < 4.0 OR (score = 4.0 AND doc_id > 10) ORDER BY score DESC, doc_id LIMIT 10")
def search_after_page(spark, d):
    docs = table(spark, d, "documents", spread=True)
    rows = search.bm25_scores(docs, ["blend", "the"]).select(F.col("doc_id").alias("id"), "score")
    return search.search_after(rows, (4.0, 10), 10).select(F.col("id").alias("doc_id"), "score")


@query("""
    SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45""")
def nested_entity_filter(spark, d):
    """Both conditions on one element of an order's array of lines."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("items"))
    return items.where(F.exists("items", lambda x: (x["l_returnflag"] == "R") & (x["l_quantity"] >= 45))).select("l_orderkey")


@query("""
    SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, lower(o_orderpriority) AS priority FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' AND lower(o_orderstatus) = lower('f')""")
def filtered_listing(spark, d):
    rows = table(spark, d, "orders").where("o_orderdate BETWEEN TIMESTAMP_NTZ '1995-01-01' AND TIMESTAMP_NTZ '1995-03-31'")
    rows = rows.where(F.lower("o_orderstatus") == "f")
    return rows.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lower("o_orderpriority").alias("priority"))


@query("""
    SELECT 'all' AS filters, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer
    UNION ALL SELECT 'segment', count(*), coalesce(sum(c_custkey), 0)::BIGINT FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey >= 50
    UNION ALL SELECT 'missing', count(*), coalesce(sum(c_custkey), 0)::BIGINT FROM customer WHERE c_acctbal < 0 AND c_custkey <= 900""")
def optional_filters(spark, d):
    """The same listing with no parameter set, with some, and asking for rows that lack a value."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    cases = {
        "all": {"equal": {"c_mktsegment": None}, "at_least": {"c_custkey": None}}, "segment": {"equal": {"c_mktsegment": "BUILDING"}, "at_least": {"c_custkey": 50}, "at_most": {"c_custkey": None}},
        "missing": {"at_most": {"c_custkey": 900}, "missing": ("balance",)},
    }
    found = [search.optional_filters(rows, **c).agg(F.lit(n).alias("filters"), F.count("*").alias("n"), F.coalesce(F.sum("c_custkey"), F.lit(0)).cast("long").alias("keys")) for n, c in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])
