"""Pairs by bands against brute force: assets held together, groups that are cut, and no side that is broadcast."""

import random

import numpy as np
import pytest
from docprov.operators import attribution, near
from pyspark.sql import functions as F


def _tables(spark, top=64):
    """Releases of 40 assets, some far from their others, some null; leaks at 0 to 18 bits of them."""
    r = random.Random(8)
    word = lambda h: h - (1 << 64) if h >> 63 else h
    wear = lambda h, n: h ^ sum(1 << k for k in r.sample(range(top), min(n, top)))
    own = [r.getrandbits(top) for _ in range(40)]
    releases = [(i, i // 8 % 40, None if i % 13 == 0 else wear(own[i // 8 % 40], r.choice((0, 1, 2, 7))), wear(own[i // 16], 1)) for i in range(640)]
    leaks = [(i, None if i % 11 == 0 else wear(r.choice(own), r.randint(0, 18)), wear(r.choice(own), r.randint(0, 18))) for i in range(300)]
    want = {(a, i, k, (x ^ y).bit_count()) for a, *p in leaks for i, _, *q in releases for k, (x, y) in enumerate(zip(p, q, strict=True)) if None not in (x, y)}
    maybe = lambda h: None if h is None else word(h)
    register = spark.createDataFrame([(i, a, *map(maybe, h)) for i, a, *h in releases], "event_id long, asset_id long, p long, d long")
    return spark.createDataFrame([(i, *map(maybe, h)) for i, *h in leaks], "leak_id long, p long, d long"), register, want


@pytest.mark.parametrize(("radius", "most", "top"), [(12, 4_000_000, 64), (12, 40, 60), (4, 7, 64), (15, 100, 9), (0, 50, 64)])
def test_every_pair_once(spark, radius, most, top):
    leaks, register, every = _tables(spark, top)
    want = {x for x in every if x[3] <= radius}
    for rows in (register, register.drop("asset_id")):
        got = [tuple(x) for x in near.pairs(leaks, rows, ("p", "d"), radius, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert want or not radius


def test_values_of_a_band_are_compared_with_those_near_them(monkeypatch, spark):
    """Groups too large to be compared whole go by the band's value."""
    r = np.random.default_rng(4)
    h, rep = (r.integers(0, 1 << 62, n) for n in (4000, 3000))
    rep[:2000] = h[:2000] ^ 0b101
    import pyarrow as pa

    edges, t = [64 * b // 5 for b in range(6)], near.thresholds(14)
    asked = pa.table({"leak_id": np.arange(4000), "h": h, "key": np.zeros(4000, np.int32)})
    one = [[int(i)] for i in range(3000)]
    held = pa.table({"rep": rep, "ids": pa.array(one, pa.list_(pa.int64())), "hs": pa.array([[int(x)] for x in rep], pa.list_(pa.int64()))})
    got = near._comparison(edges, t, 12)(asked, held)
    far = np.bitwise_count(h[:, None] ^ rep[None, :])
    low = np.bitwise_count((h[:, None] ^ rep[None, :]) & ((1 << edges[1]) - 1))
    want = set(zip(*(x.tolist() for x in np.nonzero((far <= 12) & (low <= t[0]))), strict=True))
    assert set(zip(got["leak_id"].to_pylist(), got["event_id"].to_pylist(), strict=True)) == want and got.num_rows == len(want) >= 2000


def test_probes_are_not_broadcast(spark):
    """A leak's rows of all its bands, hundreds, were sent to the driver for a broadcast, as their size was taken for the leaks'."""
    ids = spark.range(200).select(F.col("id").alias("event_id"), *(F.xxhash64("id", F.lit(h)).alias(h) for h in ("p_hash", "d_hash", "a_hash")))
    leaks = ids.withColumnRenamed("event_id", "leak_id").withColumn("read_bits", F.lit(0).cast("long"))
    found = attribution.three_way(leaks, ids, most=0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 200


@pytest.mark.parametrize("bands", near._CHOICES)
def test_pairs_are_the_same_with_any_number_of_bands(spark, monkeypatch, bands):
    monkeypatch.setattr(near, "fitting", lambda *_: bands)
    leaks, register, every = _tables(spark)
    got = [tuple(x) for x in near.pairs(leaks, register, ("p", "d"), 12, 100).collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in every if x[3] <= 12}


def test_larger_tables_get_wider_bands():
    """Compared pairs were a tenth of leaks times clusters at any size."""
    assert near.fitting(60, 13, 3_000, 19_000) == 5 and near.fitting(60, 13, 1_080_000, 6_750_000) < 5


def test_a_cluster_is_looked_for_by_its_majority(spark):
    """Copies a bit from their asset's hash are two from each other, so that one of them is further from a leak than that."""
    own = 0b1011 << 40
    rows = spark.createDataFrame([(i, 0, own ^ 1 << i) for i in range(8)] + [(9, 1, 7), (10, 1, None)], "event_id long, asset_id long, p long")
    got = sorted((r["rep"], sorted(r["ids"])) for r in near.clusters(rows, ("p",)).collect())
    assert got == [(7, [9]), (own, list(range(8)))]


def test_rows_of_any_hash_are_not_moved(spark, monkeypatch):
    """They grow as leaks times releases, and were gathered by leak and release, and joined to what came along."""
    leaks, register, every = _tables(spark)
    leaks, register = (rows.select("*", F.col("p").alias("p_hash"), F.col("d").alias("d_hash"), F.when(F.pmod(F.col("d"), F.lit(3)) > 0, F.col("p")).alias("a_hash")) for rows in (leaks.withColumn("read_bits", F.col("leak_id")), register.withColumn("user_id", F.col("event_id") % 9)))
    for rows in (register, register.drop("asset_id")):
        found = attribution.three_way(leaks, rows, most=0, carry=("user_id",))
        got = sorted(map(str, found.collect()))
        assert got == sorted(map(str, attribution.three_way(leaks, rows, carry=("user_id",)).collect())) and len({x[:2] for x in every if x[3] <= 12}) == len(got)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "event_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


@pytest.mark.parametrize("loops", [True, False])
def test_a_pool_of_what_comes_along_with_candidates(spark, monkeypatch, loops):
    monkeypatch.setattr(attribution, "_loops", lambda *_: loops)
    leaks, register, _ = _tables(spark)
    hashes = [F.col(h).alias(f"{h}_hash") for h in ("p", "d")] + [F.lit(None).cast("long").alias("a_hash")]
    leaks = leaks.select("leak_id", F.col("leak_id").alias("read_bits"), *hashes)
    register = register.select("event_id", "asset_id", (F.col("event_id") % 9).alias("user_id"), F.timestamp_seconds(F.col("event_id") % 70).alias("created_at"), (F.col("event_id") * 3).alias("payload"), *hashes)
    want = attribution.pool(leaks, register, attribution.three_way(leaks, register))
    assert sorted(attribution.pooled(leaks, register).collect()) == sorted(want.collect())
    if not loops:
        plan = attribution.pooled(leaks, register)._jdf.queryExecution().executedPlan().toString()
        assert "event_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
