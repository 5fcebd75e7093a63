"""Rows that an ORDER BY leaves tied are taken in the order of the table."""

import duckdb

from larkspur.plans import queries as core


def test_citations_tied_by_line_number_follow_the_table(spark, sf, tmp_path):
    con = duckdb.connect()
    con.execute("SET threads = 1")  # more threads pick other rows from run to run
    lines = tmp_path / "lineitem.parquet"
    lines.mkdir()
    con.execute(f"COPY (SELECT * FROM '{sf}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    # the later file is the larger one, which Spark reads first
    con.execute(f"COPY (SELECT * FROM '{sf}/lineitem.parquet' WHERE l_orderkey % 3 = 0) TO '{lines}/a.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_partkey + 9 AS l_partkey) FROM '{sf}/lineitem.parquet') TO '{lines}/b.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{lines}/*.parquet')")
    want = sorted(con.execute(core.ORACLE["citation_resolution"]).fetchall())
    got = sorted(tuple(r) for r in core.QUERIES["citation_resolution"](spark, str(tmp_path)).collect())
    assert want and got == want
