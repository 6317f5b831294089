"""The layered graph deals the stops by their line once."""

from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.registry import entries


def test_next_stops_are_those_of_the_join(spark):
    rows = [(1, 1, 5), (1, 2, 6), (1, 2, 7), (1, 3, None), (1, 5, 8), (None, 1, 2), (None, 2, 3), (2, None, 1), (2, -1, 4), (2, 0, 4)]
    stops = spark.createDataFrame(rows, "line long, seq int, station long")
    a = stops.select("line", F.col("seq").alias("from_seq"), F.col("station").alias("from_station"))
    b = stops.select("line", (F.col("seq") - 1).alias("from_seq"), F.col("station").alias("to_station"))
    want = a.join(b, ["line", "from_seq"])
    got = R.successor_join(stops)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 5


def test_lines_are_dealt_once(spark, sf_dir):
    plan = entries()["successor_join"].fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    plan = entries()["layered_graph"].fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = {x.split("[plan_id")[0].strip(" :+-*()0123456789") for x in plan.splitlines() if "Exchange hashpartitioning(line" in x}
    assert lines and all("seq" not in x and "station" not in x for x in lines)
