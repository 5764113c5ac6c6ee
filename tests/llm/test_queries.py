"""The queries of the ten operators against their SQL in DuckDB: on the smallest tables, and on hostile documents."""

import random
import string

import duckdb
import pytest

from corvane.llm.queries import QUERIES, SQL
from tests.test_queries import DIR, TABLES, rows


def duck(folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'" if folder != DIR else f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def same(spark, con, name, folder):
    got, wanted = QUERIES[name](spark, folder), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    found = rows(got.columns, got.collect())
    assert found == rows(wanted.columns, wanted.fetchall())
    return found


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert same(spark, duck(DIR, TABLES), name, DIR)


@pytest.fixture(scope="module")
def hostile(spark, docs, tmp_path_factory):
    """The fixture's documents, each id once, and keys of all classes in prose, in base spans and around them."""
    rng = random.Random(8)
    keys = ["".join(rng.choices(letters, k=n)) for letters in (string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, "0123456789abcdef")
            for n in (20, 23, 40, 90)]
    planted = [f"é {k} or x={k}, password: {k}; {k}0123456789abcdef01234567ZZZZ-{k}\ntoken={k[:9]} 😀 a/{k}" for k in keys]
    planted += ["Some/Path/of_names/and-9/words", "123e4567-e89b-12d3-a456-426614174000", "a" * 64 + "B1", "CamelCaseNamesOfSomething"]
    folder = str(tmp_path_factory.mktemp("hostile"))
    more = spark.createDataFrame([(1000 + i, t, "fr", f"s{i % 3}", len(t)) for i, t in enumerate(planted)], "doc_id long, text string, lang string, source string, n_chars long")
    columns = more.columns
    docs.dropDuplicates(["doc_id"]).select(columns).unionByName(more).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_secret_scan", "op6_substring_dedup", "op8_source_mixing", "op10_line_dedup"])
def test_query_matches_sql_on_hostile_documents(spark, hostile, name):
    found = same(spark, duck(hostile, ["documents"]), name, hostile)
    if name == "op5_secret_scan":
        assert sum("entropy" in str(r) for r in found) >= 10
