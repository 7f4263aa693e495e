"""Driver contract: entry runs, every key has an oracle unless it is rows-only."""

import duckdb

import __spark_entry__ as entry_mod

ROWS_ONLY = {"subword_len"}


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"split", "label", "label_name", "n", "pct"}


def test_keys_have_oracles():
    q = entry_mod.queries()
    o = entry_mod.oracle_sql()
    own = {k for k in q if not (k == "pipeline" or k.startswith("op"))}
    assert own - set(o) == ROWS_ONLY
    assert set(o) <= set(q)


def test_oracles_parse_in_duckdb():
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for key, sql in entry_mod.oracle_sql().items():
        con.sql(sql).fetchall()  # raises on any SQL error
        assert key
