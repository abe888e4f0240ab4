"""Literal rows and boundaries of the register's operators."""

import pytest
from docprov.functions import bits
from docprov.operators import attribution as at
from docprov.operators import audit, raster
from docprov.sources import files
from docprov.streaming import register as streams
from pyspark.sql import functions as F


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_hamming_and_payloads(spark):
    n = lambda v: F.lit(v).cast("bigint")
    assert one(spark, bits.hamming(n(0), n(0)), bits.hamming(n(0), n(-1)), bits.hamming(n(0b1011), n(0b1000))) == (0, 64, 2)
    receipt = "0x7f2c8b41e93ad6570c1f2b8e4a97d3510fbc62e8a4d17395c0e8b2f61a4d9037"
    short = bits.short_id(F.lit(receipt))
    payload = bits.build_payload(short)
    text, back = one(spark, bits.bit_string(payload), bits.payload_id(bits.payload_of(bits.bit_string(payload))))
    assert len(text) == 48 and back == int(receipt[2:11], 16) and int(text[36:44], 2) == bits.id_crc(back)
    assert one(spark, bits.payload_of(F.lit("01x")), bits.payload_of(F.lit("0" * 47))) == (None, None)
    for ones, bad in ((6, True), (7, False), (41, False), (42, True)):
        low = ((1 << min(ones, 48 - ones)) - 1) << 20
        assert one(spark, bits.degenerate(n(low if ones < 24 else (1 << 48) - 1 ^ low))) == (bad,)


def test_repair_takes_the_first_flip():
    masks = bits.flip_masks()
    assert sum(m > 0 for m in masks) == 171
    for k in range(36):
        syndrome = bits.id_crc(1 << k)
        assert masks[syndrome].bit_count() in (1, 2)


def leaks(spark, rows):
    return spark.createDataFrame(rows, "leak_id long, read_bits long, p_hash long, d_hash long, a_hash long")


def register(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, created_at timestamp_ntz, payload long, short_id long, receipt_id string, p_hash long, d_hash long, a_hash long")


def test_radius_is_inclusive_and_nulls_find_nothing(spark):
    r = register(spark, [(1, 1, None, 0, 0, "a", 0, 0, None), (2, 1, None, 0, 0, "b", 3, 0, None), (3, 1, None, 0, 0, "c", -1, 0, None), (4, 1, None, 0, 0, "d", None, 0, None)])
    probe = leaks(spark, [(9, 0, 0, None, None), (8, 0, None, None, None)])
    for most in (100, 0):
        got = sorted((x["leak_id"], x["event_id"], x["distance"]) for x in at.radius_join(probe, r, 4, most).collect())
        assert got == [(9, 1, 0), (9, 2, 2)]
    assert at.nested(at.as_leaks(probe), r, F.lit(True), 1).count() == 8


def test_bands_find_what_a_nested_loop_finds(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(20)]
    worn = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 16))) for b in base for _ in range(4)]
    r = register(spark, [(i, 1, None, 0, 0, str(i), b, 0, 0) for i, b in enumerate(base)])
    probe = leaks(spark, [(i, 0, w, 0, 0) for i, w in enumerate(worn)])
    a = {tuple(x) for x in at.radius_join(probe, r, 12, 1000).collect()}
    b = [tuple(x) for x in at.radius_join(probe, r, 12, 0).collect()]
    assert len(b) == len(set(b)) and set(b) == a and a


@pytest.mark.parametrize("radius", [12, 28])
def test_many_leaks_find_what_few_find(spark, radius):
    import random

    rng = random.Random(5)

    def maybe(h):
        return None if rng.random() < 0.2 else h

    base = [tuple(rng.getrandbits(63) for _ in range(3)) for _ in range(15)]
    worn = [tuple(maybe(h ^ sum(1 << k for k in rng.sample(range(63), rng.randint(8, 20)))) for h in b) for b in base for _ in range(4)]
    r = register(spark, [(i, 1, None, 0, 0, str(i), *map(maybe, b)) for i, b in enumerate(base)])
    probe = leaks(spark, [(i, 0, *w) for i, w in enumerate(worn)])
    few = sorted(map(str, at.three_way(probe, r, radius).collect()))
    assert few and sorted(map(str, at.three_way(probe, r, radius, most=0).collect())) == few
    pairs = at.gridded(at.as_leaks(probe), r, F.lit(True), block_rows=7, shard_rows=4).select("leak_id", "event_id")
    assert pairs.count() == pairs.distinct().count() == len(base) * len(worn)


@pytest.mark.parametrize(("flips", "tier"), [(11, 12), (12, 12), (13, 28), (27, 28), (28, 28), (29, 34), (33, 34), (34, 34), (35, None)])
def test_tiers(spark, flips, tier):
    r = register(spark, [(1, 1, None, 0, 0, "a", 0, None, None)])
    got = at.tiered(leaks(spark, [(9, 0, (1 << flips) - 1, None, None)]), r).collect()
    assert [x["tier"] for x in got] == ([tier] if tier else [])


@pytest.mark.parametrize(("matches", "rival", "p", "ok"), [(29, 20, 3, False), (30, 28, 3, True), (30, 29, 3, False), (31, 30, 3, False), (32, 31, 3, True), (32, 32, 3, False), (35, 20, 13, False), (35, 20, None, False), (36, 20, 13, True), (36, 20, None, True), (30, None, 12, True)])
def test_margin_rule(spark, matches, rival, p, ok):
    i = lambda v: F.lit(v).cast("int")
    assert one(spark, at.accepted(F.lit(0x0F0F0F0F0F0F).cast("bigint"), i(matches), i(rival), i(p))) == (ok,)
    assert one(spark, at.accepted(F.lit(3).cast("bigint"), i(48), i(0), i(0))) == (False,)


def test_score_and_reasons(spark):
    n = F.lit(None).cast("int")
    nothing = at.score(F.lit(None).cast("double"), n, n, n, F.lit(None).cast("boolean"))
    whole = at.score(F.lit(1.0), F.lit(0), F.lit(0), F.lit(0), F.lit(True))
    shot = at.score(F.lit(0.6), F.lit(17), F.lit(0), F.lit(64), F.lit(False))
    assert [round(x, 6) for x in one(spark, nothing, whole, shot)] == [0.0, 1.0, round(0.72 * 0.6 + 0.13, 6)]
    said = one(spark, at.reasons(F.lit(0.9), F.lit(3), F.lit(20), F.lit(None).cast("boolean")))[0]
    assert len(said) == 4 and said[-1].startswith("No receipt")


def test_roles_and_recipients(spark):
    roles = [F.lit(r).cast("string") for r in (None, "officer", "ADMIN", "auditor", "x")]
    assert one(spark, *(audit.normal_role(r) for r in roles)) == ("TACTICAL_OFFICER", "TACTICAL_OFFICER", "CRYPTO_CUSTODIAN", "NAVAL_AUDITOR", "X")
    texts = [F.lit(t).cast("string") for t in ("[1, 2]", "3, x,-1,4", "none", None, "[0]")]
    assert one(spark, *(audit.recipients(t) for t in texts)) == ([1, 2], [3, 4], None, None, None)


def test_pages(spark):
    rows = spark.range(10).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    assert [r["event_id"] for r in audit.page(rows, 2, 4).collect()] == [5, 4, 3, 2]
    assert tuple(audit.envelope(rows, 4).first()) == (10, 3)
    with pytest.raises(ValueError, match="page"):
        audit.page(rows, 0)


def flat(spark, images=2, px=128):
    return spark.range(images).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(1023))).alias("t")).withColumn("px", F.array_repeat(F.lit(px), 64))


def test_mark_survives_and_is_read_in_any_orientation(spark):
    image = flat(spark)
    marked = raster.embed(image, raster.payload_for(F.col("image_id")))
    for r in raster.extract(marked).select(bits.matching(F.col("payload"), raster.payload_for(F.col("image_id"))).alias("n"), "confidence").collect():
        assert (r["n"], r["confidence"]) == (48, 1.0)
    worn = raster.turned(marked).filter("turn = image_id + 1").select("image_id", "t", "px")
    assert all(r["ok"] for r in raster.best_turn(worn).collect())
    with pytest.raises(ValueError, match="too few"):
        raster.carriers(spark, coefficients=1007)


def test_psnr_edges(spark):
    assert one(spark, raster.psnr(F.lit(0), F.lit(64)), raster.psnr(F.lit(0), F.lit(0))) == (float("inf"), 0.0)


def test_tampering_is_found_where_it_is(spark):
    marked = raster.fragile_embed(flat(spark))
    hit = (F.col("image_id") == 1) & F.col("t").isin(33, 34, 65, 900)
    worn = marked.withColumn("px", F.when(hit, F.transform("px", lambda v: 255 - v)).otherwise(F.col("px")))
    checked = raster.fragile_check(worn)
    status = {r["image_id"]: (r["status"], r["failed"]) for r in raster.tamper_verdict(checked).collect()}
    assert status == {0: ("intact", 0), 1: ("tampered", 4)}
    boxes = [tuple(r)[2:] for r in raster.regions(checked).orderBy("place").collect()]
    assert boxes == [(8, 8, 16, 16), (32, 224, 8, 8)]


def test_metrics_source(spark):
    assert files.read_metrics(spark, None).first()["source"] == "not-run"


def test_receipt_events(spark):
    rows = spark.createDataFrame([("a", "s"), ("b", None)], "receipt_id string, signature_commit string")
    assert sorted(tuple(r) for r in streams.receipt_events(rows).collect()) == [("a", "ReceiptStored"), ("a", "SignatureAnchored"), ("b", "ReceiptStored")]
