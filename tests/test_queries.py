"""Each query against its SQL on the smallest tables, where they exist."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name,table,key", [("lay7_header_slots", "part", "id"), ("lay10_plan", "part", "id"), ("set2_union", "nation", "name")])
def test_whole_tables(spark, name, table, key):
    """No row of the table is left out."""
    rows = spark.read.parquet(f"{DIR}/{table}.parquet")
    want = {r[0] for r in rows.select({"part": "p_partkey", "nation": "n_name"}[table]).collect()}
    assert want <= {r[key] for r in entry.queries()[name](spark, DIR).collect()}
    assert " % 4 = 0" not in entry.oracle_sql()[name] and "WHERE NOT" not in entry.oracle_sql()[name]


def test_documents_of_any_language(spark, tmp_path):
    rows = [(1, "a", "en"), (2, "\u00e9", None), (3, "b", "vi")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["str1_plain_documents"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.same for r in got} == {1: True, 2: False, 3: True}
