"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pandas as pd
import pytest

from vigil.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that give rows only where there are more than the smallest tables have.
LARGER = {"c2_beaconing_regular_intervals", "dga_nxdomain_spike", "dns_tunneling_high_volume", "dns_txt_record_abuse", "stream_beaconing", "stream_beaconing_state"}


@pytest.fixture(scope="session")
def dbs(sf):
    """The tables' folders with connections: the smallest tables, and larger ones."""
    found = []
    for folder in (sf, "/root/testdata/sf0.01"):
        connection = duckdb.connect()
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        found.append((folder, connection))
    return found


def shown(v):
    if v is None or v is pd.NaT or v != v:
        return "~"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, dbs, name):
    sf, db = dbs[name in LARGER]
    found = registry.queries()[name](spark, sf)
    cursor = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(shown(r[c]) for c in order) for r in found.collect())
    want = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert got == want
    assert got, "a query without rows shows nothing"


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    found = registry.queries()[name](spark, sf)
    assert found.columns and found.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
