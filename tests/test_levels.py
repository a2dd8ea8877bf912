"""Levels of an acyclic graph, of one with a loop and of one with a ring; and how many tables they take."""

import random

import duckdb

from strandloom.operators import extras, graph, levels
from strandloom.plans import derived, registry


def test_levels_and_tables(spark, monkeypatch):
    made, plain = [], extras.written
    monkeypatch.setattr(extras, "written", lambda df, label: made.append(label) or plain(df, label))
    rows = [("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("x", "x"), ("x", "y"), ("r", "s"), ("s", "r"), ("s", "t"), ("c", "d")]
    got = {r["contig"]: r["level"] for r in extras.topological_levels(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    # one of the edges, and one of nodes for each level and the start
    assert len(made) == 6


def test_levels_in_lots(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("x", "x"), ("x", "y"), ("r", "s"), ("s", "r"), ("s", "t")] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    rows += [(f"g{g:02}n{min(p)}", f"g{g:02}n{max(p)}") for g in range(30) for p in [rng.sample(range(9), 2) for _ in range(rng.randint(1, 14))]]
    edges = spark.createDataFrame(rows, "a string, b string")
    want = sorted(extras.topological_levels(edges).collect())
    assert sorted(levels.component_levels(edges).collect()) == want
    monkeypatch.setattr(graph, "AT_ONCE", 12)
    assert sorted(levels.component_levels(edges).collect()) == want


def test_levels_of_all_orders_and_items(spark, tmp_path):
    """Orders 1 to 3 of one customer, of which 2 has no items, and an item of an order 9 that isn't there."""
    con = duckdb.connect()
    con.sql("create table orders as select k as o_orderkey, 7::bigint as o_custkey, timestamp '2020-01-01' + interval (k) day as o_orderdate from range(1, 4) t(k)")
    con.sql("create table lineitem as select unnest([1, 1, 3, 9])::bigint as l_orderkey, 1 as l_linenumber, unnest([4, 5, 6, 7])::bigint as l_partkey, 1::bigint as l_suppkey, 2.0::double as l_extendedprice, 3.0::double as l_quantity, 'O' as l_linestatus")
    for table in ("orders", "lineitem"):
        con.sql(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
    con.sql("create table events as select 1 as user_id, 'e' as event_type, 1 as ts, 1 as event_id")
    got = {r["contig"][7:]: r["level"] for r in registry.QUERIES["g20_topological_levels"](spark, str(tmp_path)).collect()}
    assert got == {"001:0": 0, "001:101": 1, "001:102": 1, "001:2": 2, "002:0": 3, "002:2": 4, "003:0": 5, "003:101": 6, "003:2": 7, "009:0": 0, "009:101": 1, "009:2": 2}
    assert {r[0][7:]: r[1] for r in con.sql(registry.ORACLE_SQL["g20_topological_levels"]).fetchall()} == got
    assert derived.order_flow(spark, str(tmp_path)).count() == 7
