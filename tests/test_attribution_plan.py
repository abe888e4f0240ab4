"""Best candidates as one number: its order, and the plan that reduces them."""

import random

from docprov.operators import attribution as at
from pyspark.sql import functions as F

SCHEMA = "event_id long, user_id long, created_at timestamp_ntz, payload long, short_id long, receipt_id string, p_hash long, d_hash long, a_hash long"


def test_packed_numbers_have_the_order_of_their_parts(spark):
    r = random.Random(6)
    rows = [(m, t, e) for m in (0, 29, 48) for t in (None, "1969-01-01", "1970-01-01", "1998-12-31 23:59:59.999999", "2262-01-01") for e in (0, 1, 2**63 - 1, r.getrandbits(60))]
    df = spark.createDataFrame(rows, "m int, t string, e long").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    df = df.select("m", "t", "e", at.packed(F.col("m"), F.col("ts"), F.col("e")).alias("b"))
    got = df.select("*", at.matches_of("b").alias("m2"), at.event_of("b").alias("e2")).collect()
    assert all((x["m"], x["e"]) == (x["m2"], x["e2"]) for x in got)
    early = {None: "", "1969-01-01": "", "1970-01-01": ""}
    key = lambda x: (x["m"], early.get(x["t"], x["t"]), x["e"])
    assert [key(x) for x in sorted(got, key=lambda x: x["b"])] == sorted(key(x) for x in got)


def test_candidates_of_few_bits_only_close_their_tier(spark):
    """A leak whose narrow tier finds a release of 20 bits is not looked for at a wider one, which would find 40."""
    register = spark.createDataFrame([(1, 5, None, (1 << 20) - 1 << 28, 0, "a", 0, 0, 0), (2, 6, None, (1 << 40) - 1 << 8, 0, "b", (1 << 20) - 1, 1 << 40, 1 << 41)], SCHEMA)
    leaks = spark.createDataFrame([(9, (1 << 48) - 1, 0, None, None), (8, (1 << 48) - 1, (1 << 20) - 1, None, None)], "leak_id long, read_bits long, p_hash long, d_hash long, a_hash long")
    got = at.best_of_users(leaks, register, (12, 28), newest=0, least=29).select("leak_id", "user_id", at.matches_of("b").alias("m"), at.event_of("b").alias("e"))
    assert [tuple(r) for r in got.collect()] == [(8, 6, 40, 2)]
    every = at.best_of_users(leaks, register, (12, 28), newest=0).select("leak_id", at.matches_of("b").alias("m"))
    assert sorted(map(tuple, every.collect())) == [(8, 40), (9, 20)]


def test_pairs_are_reduced_by_hash_where_they_are_found(spark):
    sf = "/root/testdata/sf0.001"
    from docprov.sources import register as reg

    plan = at.best_of_users(reg.leaks(spark, sf), reg.releases(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_nested_loop_is_dealt_by_its_pairs(spark, monkeypatch):
    """A register of one file met all leaks in one task."""
    monkeypatch.setattr(at, "TASK_PAIRS", 1000)
    ids = spark.range(0, 500, 1, 1).select(F.col("id").alias("event_id"), F.xxhash64("id").alias("h"))
    leaks = spark.range(10).withColumnRenamed("id", "leak_id")
    pairs = at.nested(leaks, ids, F.col("h") > F.col("leak_id") * 0)
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 10 * ids.filter("h > 0").count()
