"""Queries with SQL twins against them in DuckDB, on given tables and on odd rows."""

import os

import duckdb
import pytest

from marketspark.llm import queries as llm

ONE_TABLE = ["op4_pii", "op7_quality", "op8_mixing", "op10_substrings", "op11_merkle", "op12_jaccard"]
LONG = "".join(f"word{i * i % 977} é{i}\n" for i in range(300))
ODD = [
    (1, "a", None),
    (2, "a", ""),
    (3, None, " \n\t\n "),
    (4, "b", LONG),
    (4, "b", LONG),
    (5, "b", "x " * 500 + "\nsame line # $\nsame line # $\n\r\nsame line # $"),
    (6, "b", "start " + LONG[40:700] + LONG[1500:2600] + "  end   | <tag> 100% *"),
    (7, "b", "ü" * 2500),
    (8, "b", "one two three four five six seven eight nine ten. " * 3 + " ".join(f"only{i}" for i in range(90))),
    (9, "b", "ü mail 1.2.3.4@ho-st.com, +12345678901@x.org 000000000018.1.1.1 4111 1111-1111 1111; IBAN DE89 3704 0044 0532 0130 00, xDE89370400440532013000 ssn 078-05-1120 or 1078-05-1120"),
    (10, "b", "078-05-1120 a@b.c_d@e.fr 1.2.3.4.5.6.7.8 300.1.1.1 +49 (30) 1234-567. bank GB82WEST12345698765432 GB82 WEST 1234 5698 7654 33"),
    (None, "c", "no id, few words"),
]


def compare(spark, name, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet{'/*.parquet' if os.path.isdir(f'{d}/documents.parquet') else ''}')")
    found = con.execute(llm.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = llm.queries()[name](spark, d)
    assert sorted(got.columns) == sorted(names)
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want and want


@pytest.mark.parametrize("name", ONE_TABLE)
def test_given_documents(spark, name):
    if not os.path.exists("/root/testdata/sf0.001/documents.parquet"):
        pytest.skip("no test tables")
    compare(spark, name, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op4_pii", "op7_quality", "op10_substrings", "op12_jaccard"])
def test_odd_documents(spark, name, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    compare(spark, name, str(tmp_path))


def test_every_twin_is_compared():
    assert sorted(llm.oracle_sql()) == sorted([*ONE_TABLE, "op13_search"])


def test_search_on_given_tables(spark):
    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = sorted(con.execute(llm.oracle_sql()["op13_search"]).fetchall())
    assert sorted(map(tuple, llm.queries()["op13_search"](spark, d).collect())) == want and want
