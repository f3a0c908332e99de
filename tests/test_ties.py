"""Rows that an order leaves open come in the table's order, however the table is read."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lookups, references
from corpusloom.plans import catalog

ROWS = [(1, 10, 1, s, n) for n, s in enumerate(["unresolved", "anchored", "no_changes", "added_section"] * 3)]


def tied(spark):
    rows = spark.createDataFrame(ROWS, "file_no long, section_id long, position int, status string, n long")
    return rows.select("file_no", "section_id", "position", "status", F.struct(F.lit("f").alias("file_path"), F.col("n").alias("row_index")).alias("arrival")).orderBy(F.desc("n"))


def test_first_seen_by_arrival(spark):
    got = references.first_seen(tied(spark), ["file_no", "section_id"], ["position"])
    assert got.columns == ["file_no", "section_id", "position", "status"]
    assert [r["status"] for r in got.collect()] == ["unresolved"]


def test_first_status_by_arrival(spark):
    chunks = spark.createDataFrame([(1, 10)], "file_no long, section_id long")
    bills = spark.createDataFrame([(1, "ok")], "file_no long, parse_status string")
    assert lookups.with_diffs(tied(spark), chunks, bills).count() == 0
    assert lookups.with_diffs(tied(spark).where("status <> 'unresolved'"), chunks, bills).count() == 1


@pytest.mark.parametrize("name", ["first_outcomes", "bills_with_diffs"])
def test_ties_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = c.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, folder).select(*names).collect())) == sorted(rel.fetchall())


@pytest.mark.parametrize("name", ["first_outcomes", "bills_with_diffs"])
def test_odd_rows_against_sql(spark, name, tmp_path):
    """Rows without a position, a section or a bill, and bills that no order has; one thread, as several give tied rows in changing order."""
    c = duckdb.connect()
    c.execute("set threads = 1")
    odd = lambda column, every: f"CASE WHEN hash(r, '{column}') % {every} > 0 THEN {column} END AS {column}"
    c.execute(f"""create table lineitem as select * replace ({", ".join(odd(x, n) for x, n in (("l_orderkey", 9), ("l_partkey", 4), ("l_linenumber", 3), ("l_quantity", 6), ("l_returnflag", 7), ("l_linestatus", 7)))})
    from (select *, row_number() over () AS r from (select * replace (l_orderkey % 40 AS l_orderkey, l_partkey % 5 AS l_partkey) from '/root/testdata/sf0.001/lineitem.parquet'))""")
    c.execute("create table orders as select * from '/root/testdata/sf0.001/orders.parquet' where o_orderkey % 2 = 0")
    for t in ("lineitem", "orders"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    rel = c.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(*names).collect()), key=repr) == want and len(want) > 40
