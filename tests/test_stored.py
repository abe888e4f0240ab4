"""The stored register's plans, and regions of any shape and size."""

import random

from docprov.operators import raster
from docprov.sources import register as reg
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_dates_prune_and_joins_move_nothing(spark):
    register, leaks = reg.stored(reg.releases(spark, SF), "event_id", "created_at"), reg.stored(reg.leaks(spark, SF), "leak_id")
    assert register.drop("created_year").count() == reg.releases(spark, SF).count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = reg.of_years(register, "1994-03-01", "1995-06-30").join(leaks, F.col("leak_id") == F.col("event_id")).select("leak_id", "user_id")
        plan = some._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert "PartitionFilters: [isnotnull(created_year" in plan and "created_year" in plan.split("PartitionFilters: [")[1]
    want = reg.releases(spark, SF).filter("to_date(created_at) BETWEEN '1994-03-01' AND '1995-06-30' AND event_id % 50 = 0").count()
    assert some.count() == want


def flood(spots, width):
    left, boxes = set(spots), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            t = todo.pop()
            seen.append(t)
            for k in (t - width, t + width, *([t - 1] if t % width else []), *([t + 1] if t % width < width - 1 else [])):
                if k in left:
                    left.discard(k)
                    todo.append(k)
        xs, ys = [t % width for t in seen], [t // width for t in seen]
        boxes.append((8 * min(xs), 8 * min(ys), 8 * (max(xs) - min(xs) + 1), 8 * (max(ys) - min(ys) + 1)))
    return sorted(boxes, key=lambda b: (-b[2] * b[3], b))


def test_regions_of_any_shape(spark):
    r, width = random.Random(3), 40
    spiral = {y * width + x for y in range(1, 20) for x in range(1, 20) if min(x, y, 20 - x, 20 - y) % 2 == 1 and not (x == y + 1 and x < 10)}
    shapes = {0: {t for t in range(1600) if r.random() < 0.55}, 1: spiral, 2: {39, 40, 79, 80}, 3: {7}, 4: set(range(1600)), 5: set()}
    rows = [(i, t, t in s) for i, s in shapes.items() for t in range(1600)]
    checked = spark.createDataFrame(rows, "image_id long, t int, failed boolean").repartition(4)
    got = {}
    for x in raster.regions(checked, most=1000, width=width).orderBy("image_id", "place").collect():
        got.setdefault(x["image_id"], []).append(tuple(x)[2:])
    assert got == {i: flood(s, width) for i, s in shapes.items() if s}
    assert raster.regions(checked, most=3, width=width).filter("image_id = 0").count() == 3
    assert raster.regions(checked.filter("false")).count() == 0


def test_buckets_grow_with_the_table(spark, monkeypatch):
    """Eight of any size were read by a task each."""
    from docprov.plans import registry

    query = registry.queries()["s1_register_range_join"]
    few, rows = sorted(map(tuple, query(spark, SF).collect())), spark.range(1000)
    assert reg.buckets_of(rows) == 8
    monkeypatch.setattr(reg, "BUCKET_ROWS", 100)
    assert reg.buckets_of(rows) == 16 and reg.buckets_of(rows.limit(0)) == 8 and reg.buckets_of(spark.range(1601)) == 32
    many = query(spark, SF)
    assert few and any("_00015" in f for f in many.inputFiles()) and sorted(map(tuple, many.collect())) == few
