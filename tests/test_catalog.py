"""Every registered query that has SQL gives the rows of its SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

from quarrylens.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark_frame, sql: str, tables=TABLES) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours, theirs = spark_frame.toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple("%.6g" % x if isinstance(x, float) else str(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False))

    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    frame = catalog.QUERIES[name](spark, str(DATA))
    if name in catalog.ORACLES:
        same(frame, catalog.ORACLES[name])
    else:
        assert frame.count() >= 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_memory_adds_prices_in_order(spark, tmp_path):
    """Three files in which a customer's prices add up to a whole number, or just under it, as the order of additions has it."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    made = "SELECT k * 300 + i AS o_orderkey, i % 60 AS o_custkey, 1000 + (i * 7919 + k * 104729) % 90000 / 100.0::DOUBLE AS o_totalprice FROM range(3) a(k), range(300) b(i)"
    # The last price makes each sum a whole number in exact figures; one customer has no prices, and one no key.
    con.execute(f"CREATE TABLE m AS {made} UNION ALL SELECT 900 + o_custkey, o_custkey, 5000 - (sum(round(o_totalprice * 100)) % 100) / 100 FROM ({made}) GROUP BY o_custkey UNION ALL SELECT 2000, 99, NULL UNION ALL SELECT 2001 + i, NULL, 0.1 FROM range(30) c(i)")
    (tmp_path / "orders.parquet").mkdir()
    for k in range(3):
        con.execute(f"COPY (SELECT * FROM m WHERE o_orderkey // 400 = {k} OR {k} = 2 AND o_orderkey >= 1200 ORDER BY o_orderkey) TO '{tmp_path}/orders.parquet/{k}.parquet'")
    con.execute("CREATE TABLE orders AS SELECT * FROM m ORDER BY o_orderkey")
    spread = spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.getNumPartitions()
    rows = lambda found: sorted((str(r[0]), r[1]) for r in found)
    got = rows(catalog.QUERIES["y02_memory"](spark, str(tmp_path)).select("o_custkey", "used_bytes").collect())
    assert spread > 1 and got == rows(con.sql(f"SELECT o_custkey, used_bytes FROM ({catalog.ORACLES['y02_memory']})").fetchall())
