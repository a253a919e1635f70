"""The SQL of the queries on rows that the given tables lack: repeated and null ids."""

from __future__ import annotations

import duckdb

from ledgerloom.llm import queries

WORDS = " ".join(f"w{i}" for i in range(26))
ROWS = [(1, WORDS), (1, WORDS), (None, WORDS), (2, "x"), (2, None), (3, f"{WORDS} more words"), (None, "")]


def test_op9_tells_rows_of_one_id_apart(spark, tmp_path) -> None:
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["op9_substring_dedup"]).fetchall(), key=repr)
    assert want == sorted(map(tuple, queries.op9_substring_dedup(spark, str(tmp_path)).collect()), key=repr)


def test_op11_and_op12_on_odd_rows(spark, tmp_path) -> None:
    rows = [(i, t, s) for i, (t, s) in enumerate([(WORDS * 40, "a"), (WORDS, "b"), (None, "b"), ("", None), ("words words words wordz", None), ("ß Ünder ünder Ünder under", "é")])] + [(None, "words here", "a"), (1, WORDS, "b"), (1, WORDS, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op11_mixing", "op12_spelling_variants"):
        r = con.execute(queries.ORACLE_SQL[name])
        cols = [c[0] for c in r.description]
        want = sorted(r.fetchall(), key=repr)
        assert want == sorted((tuple(x[c] for c in cols) for x in queries.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
