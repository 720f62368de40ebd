"""Contract checks: names, oracles and one end-to-end comparison with DuckDB."""

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_zone_board_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()["zone_board"])
    names = [c[0] for c in rel.description]
    want = sorted((r[names.index("mission_id")], r[names.index("zone_id")], r[names.index("rank")]) for r in rel.fetchall())
    got = sorted((r.mission_id, r.zone_id, r.rank) for r in entry.queries()["zone_board"](spark, sf).collect())
    assert got == want
