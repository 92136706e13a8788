"""Roll-ups with planted unit errors, and JSON lines that appear as a whole."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from causeway.operators import rollup
from causeway.plans import catalogue, skeleton  # noqa: F401
from causeway.sources import jsonl

SF = "/root/testdata/sf0.001"
SCHEMA = "node string, parent string, value double"


def _run(spark, rows):
    return {r.node: (r.total, r.factor, r.status) for r in rollup.reconciled(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_tree_of_sums(spark):
    rows = [("all", None, 60.0), ("a", "all", 30.0), ("b", "all", 30.0), ("a1", "a", 10.0), ("a2", "a", 20.0), ("b1", "b", None), ("b11", "b1", 30.0)]
    got = _run(spark, rows)
    assert got == {"all": (60.0, 1.0, "ok"), "a": (30.0, 1.0, "ok"), "b": (30.0, 1.0, "ok"), "a1": (10.0, 1.0, "leaf"), "a2": (20.0, 1.0, "leaf"), "b1": (30.0, 1.0, "filled"), "b11": (30.0, 1.0, "leaf")}
    # A parent in thousands, a leaf in units among thousands, and a sum that nothing explains.
    got = _run(spark, [("all", None, 0.06), ("a", "all", 30.0), ("b", "all", 30.0), ("a1", "a", 10_000.0), ("a2", "a", 20.0), ("b1", "b", 7.0)])
    assert got["a1"] == (10.0, 1e-3, "scaled") and got["a"] == (30.0, 1.0, "ok") and got["b"] == (7.0, 1.0, "broken")
    got = _run(spark, [("all", None, 0.06), ("a", "all", 30.0), ("b", "all", 30.0), ("a1", "a", 30.0)])
    assert got["all"] == (60.0, 1e3, "scaled")


def test_rings_and_empty_tables(spark):
    assert set(_run(spark, [("x", "y", 1.0), ("y", "x", 1.0), ("z", None, 1.0), ("w", "gone", None)])) == {"z", "w"}
    assert rollup.reconciled(spark.createDataFrame([], SCHEMA)).collect() == []


def test_parents_alone_are_healed(spark):
    # 1 * 1000 + 1997 makes up 2997; and a total in thousands.
    rows = [("all", None, 1.998), ("a", "all", 2997.0), ("a1", "a", 1.0), ("a2", "a", 1997.0)]
    got = {r.node: (r.total, r.factor, r.status) for r in rollup.reconciled(spark.createDataFrame(rows, SCHEMA), heal_children=False).collect()}
    assert got == {"all": (1998.0, 1e3, "scaled"), "a": (1998.0, 1.0, "broken"), "a1": (1.0, 1.0, "leaf"), "a2": (1997.0, 1.0, "leaf")}
    assert _run(spark, rows)["a1"] == (1000.0, 1e3, "scaled")


def test_nodes_without_values_or_names(spark):
    got = _run(spark, [("all", None, None), ("a", "all", None), ("a1", "a", None), ("b", "all", 5.0), (None, "b", 2.0), (None, "b", 3.0)])
    assert got == {"all": (5.0, 1.0, "filled"), "a": (None, 1.0, "filled"), "a1": (None, 1.0, "leaf"), "b": (5.0, 1.0, "ok"), None: (got[None][0], 1.0, "leaf")}


CUSTOMERS = {
    "one fits by chance": [(1, 2, 1.0), (2, 2, 1997.0), (3, 0, 250.5), (4, 1, -20.25), (5, 3, 7.0), (6, 2, None)],
    "no balances": [(1, 2, None), (2, 0, None), (3, 1, None), (4, 1, 12.5)],
    "no customers": [],
    "keys that are null": [(None, 2, 1.0), (None, 2, 1997.0), (3, None, 5.0), (4, 4, 8.0), (5, 9, 3.0)],
}


@pytest.mark.parametrize("case", list(CUSTOMERS))
def test_parent_child_sums_are_its_sql(spark, tmp_path, case):
    spark.createDataFrame(CUSTOMERS[case], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (4, None)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t, at in (("customer", f"{tmp_path}/customer.parquet/*.parquet"), ("nation", f"{tmp_path}/nation.parquet/*.parquet"), ("orders", f"{SF}/orders.parquet"), ("lineitem", f"{SF}/lineitem.parquet"), ("events", f"{SF}/events.parquet")):
        con.sql(f"create view {t} as select * from '{at}'")
    found = sorted(map(tuple, catalogue.QUERIES["parent_child_sums"](spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted(con.sql(catalogue.SQL["parent_child_sums"]).fetchall(), key=repr)


def test_json_lines_appear_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([(k, f'é "{k}"\n', None if k % 3 else 1.5) for k in range(20)], "k long, t string, x double").repartition(3)
    jsonl.write(rows, path)
    assert sorted(map(tuple, jsonl.read(spark, path, rows.schema).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    # One task fails after the others have written.
    bad = rows.withColumn("t", F.when(F.col("k") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        jsonl.write(bad, path)
    assert jsonl.read(spark, path, rows.schema).count() == 20 and len([f for f in os.listdir(path) if f.startswith("part-")]) == len(jsonl.committed(path))
    jsonl.write(rows.limit(2), path)
    assert jsonl.read(spark, path, rows.schema).count() == 22
    jsonl.write(rows.limit(1), path, "overwrite")
    assert jsonl.read(spark, path, rows.schema).count() == 1
    assert jsonl.read(spark, f"{tmp_path}/none", rows.schema).count() == 0
