"""Set operations over whole tables."""

from __future__ import annotations

from lexspan.plans import catalog


def test_set_difference_looks_at_every_order(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "2-HIGH"), (2, "1-URGENT")], "o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r["k"] for r in catalog.queries()["set_difference"](spark, str(tmp_path)).collect()] == [3]
