"""The queries over rules and sources against their SQL, on tables with nulls, empty texts and odd names."""

import duckdb
import pytest

from quillgraph.plans import rule_queries  # noqa: F401
from quillgraph.plans.queries import ORACLES, QUERIES

TABLES = {
    "part": "SELECT i AS p_partkey, ['steel plate', 'Red  Tin', 'gad symptoms', ''][1 + i % 4] AS p_name, 'Brand#' || i % 3 AS p_brand, 'TYPE ' || i % 2 AS p_type FROM range(1, 300) t(i)",
    "documents": "SELECT i AS doc_id, CASE i % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' || chr(10) ELSE 'Some text of ' || i || chr(10) || chr(10) || 'and *more* ' END AS text, ['web', 'a b', 'x/y'][1 + i % 3] AS source, ['en', 'fr', 'de'][1 + i % 3] AS lang FROM range(0, 240) t(i)",
    "labels": "SELECT i AS doc_id, CAST(i % 2 AS INTEGER) AS quality, CAST(i % 3 = 0 AS INTEGER) AS toxic FROM range(0, 300, 2) t(i)",
    "pages": "SELECT i AS page_id, CASE WHEN i % 9 = 0 THEN NULL ELSE 'http://h.example.com/a b/' || i % 20 || '?q=' || i % 3 END AS url FROM range(0, 90) t(i)",
}
NAMES = ["names_canonical", "names_judged", "strengths", "symptom_aliases", "headers_judged", "chunks_enriched", "registry_manifest", "output_paths", "pages_joined", "chunk_metadata", "chunks_to_do"]


@pytest.fixture(scope="module", params=["rows", "empty"])
def folder(request, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, sql in TABLES.items():
        duckdb.sql(f"COPY ({sql}{' WHERE i < 0' if request.param == 'empty' else ''}) TO '{path}/{name}.parquet'")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, folder)
    told = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert plain(df.collect()) == plain(told)
