from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from dqwatch.operators.lookup import input_bytes, lookup
from dqwatch.operators.name_lists import name_parts

SALTED = {"broadcast_bytes": -1, "hot_rows": 50}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, and those rows are copies of each other."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("v"),
    )


@pytest.fixture(scope="module")
def facts(spark):
    known = spark.range(0, 400).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("x"))
    return known.unionByName(spark.createDataFrame([("hot", -1)], "k string, x long"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_plain_join(skewed, facts, how):
    plain = Counter(map(tuple, skewed.join(facts, ["k"], how).collect()))
    salted = Counter(map(tuple, lookup(skewed, facts, ["k"], how, **SALTED).collect()))
    assert salted == plain and sum(plain.values()) > 1000


def test_given_counts_are_used(skewed, facts):
    counts = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = lookup(skewed, facts, ["k"], "left", key_counts=counts, **SALTED)
    assert got.count() == 3000


def test_hot_key_is_spread_over_tasks(spark, skewed, facts):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(skewed, facts, ["k"], "left", **SALTED)
        where = joined.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(where) > 3 and max(r["count"] for r in where) < 900


def test_only_inputs_of_known_small_size_are_broadcast(spark, skewed, facts):
    def plan(*args, **options):
        return lookup(skewed, *args, ["k"], **options)._jdf.queryExecution().analyzed().toString()

    small = spark.range(10).select(F.col("id").cast("string").alias("k"))
    assert input_bytes(small) < 1000
    assert "strategy=broadcast" in plan(small) and "_salt" not in plan(small)
    assert "_salt" in plan(small, broadcast_bytes=10)
    # rows handed over by the driver have no known size
    assert "_salt" in plan(facts)


def test_lookups_upon_lookups_repeat_no_inputs(spark):
    """Each lookup used to stand in the plan of the next one several times over, which filled the driver."""
    rows = spark.range(40).select((F.col("id") % 5).cast("string").alias("k"), F.col("id").alias("v"))
    facts = spark.range(5).select(F.col("id").cast("string").alias("k"))
    for i in range(4):
        rows = lookup(rows, facts.withColumn(f"x{i}", F.lit(i)), ["k"], broadcast_bytes=-1)
    assert rows._jdf.queryExecution().analyzed().collectLeaves().size() == 5
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 40


@pytest.mark.parametrize("per_part", [1, 7, 1000])
def test_name_parts_hold_every_name_once(skewed, per_part):
    parts = name_parts(skewed.withColumn("g", F.lit(1)), ["g"], "k", per_part=per_part).collect()
    names = Counter({i["name"]: i["copies"] for p in parts for i in p["items"]})
    assert names == Counter(r.k for r in skewed.collect())
    assert sum(len(p["items"]) for p in parts) == len(names)
    assert {p["total"] for p in parts} == {3000}
    assert len(parts) == 1 if per_part == 1000 else len(parts) > 10


def test_name_parts_with_salted_lookup(skewed):
    parts = name_parts(skewed.withColumn("g", F.lit(1)), ["g"], "k", per_part=9, **SALTED).collect()
    assert sum(i["copies"] for p in parts for i in p["items"]) == 3000
