"""The queries of this subpackage against their SQL, run by DuckDB on the same tables."""

import hashlib
from pathlib import Path

import duckdb
import pytest


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return len(rows), hashlib.sha256("\n".join(sorted(repr(tuple(r[i] for i in order)) for r in rows)).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_decontamination", "op4_repeats", "op8_url_filter", "op10_mixing", "op11_ranked_search", "op12_prefix_trie"])
def test_query(spark, duck, sf, name):
    from loomspan.llm.queries import ORACLES, QUERIES

    got, want = QUERIES[name](spark, sf), duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert digest(got.columns, [tuple(r) for r in got.collect()]) == digest(columns, want.fetchall())


@pytest.mark.parametrize("name, columns", [("op3_pii", ["doc_id", "text", "n_values"]), ("op5_near_duplicates", ["doc_id", "class_id", "n_class", "is_kept"]), ("op9_token_ids", ["doc_id", "start", "n_tokens", "ids_crc32"])])
def test_rows_of_queries_without_sql(spark, sf, name, columns):
    """One row for each document, with the columns that are promised; the operators themselves are held against brute force elsewhere."""
    from loomspan.llm.queries import QUERIES

    got = QUERIES[name](spark, sf)
    assert got.columns == columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
