from tabloom.session import derive_once
from tabloom.sources import fixture


def test_derived_tables_keep_the_parts_of_their_plan(spark):
    table = derive_once(spark, "parts", "none", lambda: spark.range(90).repartition(3))
    assert len(table.inputFiles()) == 3
    assert sorted(r[0] for r in table.collect()) == list(range(90))


def test_lines_are_dealt_once_and_by_order(spark, tmp_path, monkeypatch):
    lines = [(k, s, 2.0, "R", "O") for k in (1, 2, 3) for s in (5, 5, 6)] + [(None, 7, 1.0, "N", "F")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 10, "O", "1-URGENT") for k in (1, 2, 4, 4, None)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").selectExpr(
        "*", "timestamp'1995-03-04 00:00:00' AS o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(10, "BUILDING")], "c_custkey bigint, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(fixture, "LINES_OF_A_PART", 1)
    table = fixture.derived_property_table(spark, str(tmp_path))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and not any(
        "hashpartitioning" in line and "l_suppkey" in line for line in plan.splitlines() if "Exchange" in line
    )
    found = sorted(((r["row_id"], r["total_rooms"], r["full_baths"]) for r in table.collect()), key=str)
    assert found == [(1, 3, 2), (2, 3, 2), (4, None, None), (4, None, None), (None, None, None)]
