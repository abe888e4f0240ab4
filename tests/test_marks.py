"""Marks whose reading has wrong bits."""

import math

from docprov.functions import bits
from docprov.operators import passes, raster
from pyspark.sql import functions as F

from .test_operators import flat


def test_a_wrong_bit_is_repaired(spark):
    """Image 1 carries its payload with a bit of the id flipped; image 0 is whole."""
    want = raster.payload_for(F.col("image_id"))
    worn = raster.embed(flat(spark), want.bitwiseXOR(F.shiftleft(F.col("image_id"), 30)))
    raw = {r["image_id"]: r["ok"] for r in raster.extract(worn).select("image_id", bits.crc_ok(F.col("payload")).alias("ok")).collect()}
    assert raw == {0: True, 1: False}
    read = raster.read_mark(worn).select("image_id", "corrected", (F.col("payload") == want).alias("same"), "confidence")
    assert sorted(map(tuple, read.collect())) == [(0, False, True, 1.0), (1, True, True, 1.0)]
    turned = raster.turned(worn).filter("turn = 1").select("image_id", "t", "px")
    found = raster.best_turn(turned).select("image_id", "ok", (F.col("payload") == want).alias("same"))
    assert sorted(map(tuple, found.collect())) == [(0, True, True), (1, True, True)]


def test_each_pass_reads_what_the_others_cannot(spark):
    """A mark in half the width and height is read by the scaled pass, a darkened one by tones, one in the upper 55 percent by topcrop."""
    marked = raster.embed(textured(spark), raster.payload_for(F.lit(0)), 16)
    rows = {r["t"]: r["px"] for r in marked.filter("image_id = 0").collect()}

    def value(x, y):
        return rows[y // 8 * 32 + x // 8][y % 8 * 8 + x % 8]

    def raster_of(number, w, h, at):
        return [(number, 8 * w, 8 * h, ty * w + tx, [at(tx * 8 + i % 8, ty * 8 + i // 8) for i in range(64)]) for ty in range(h) for tx in range(w)]

    half = raster_of(0, 16, 16, lambda x, y: (value(2 * x, 2 * y) + value(2 * x + 1, 2 * y) + value(2 * x, 2 * y + 1) + value(2 * x + 1, 2 * y + 1) + 2) // 4)
    dark = raster_of(1, 32, 32, lambda x, y: value(x, y) * 3 // 5 + 30)
    upper = raster_of(2, 32, 32, lambda x, y: value(x, min(255, (2 * y + 1) * 128 // 141)) if y < 141 else 7)
    wide = raster_of(3, 32, 16, value)
    leaks = spark.createDataFrame(half + dark + upper + wide, "image_id long, w int, h int, t int, px array<int>")
    got = passes.read(leaks, marked, (16,)).withColumn("m", bits.matching(F.col("payload"), raster.payload_for(F.lit(0))))
    m = {(r["image_id"], r["pass"]): r["m"] for r in got.collect()}
    assert m[0, "scaled"] >= 46 and m[0, "direct"] < 40
    assert m[1, "tones"] == 48 and m[1, "direct"] < 48 and m[1, "scaled"] < 48
    assert m[2, "topcrop"] >= 42 and m[2, "direct"] < 40
    assert (3, "topcrop") not in m and (3, "scaled") in m
    assert passes.read(leaks.filter("false"), marked).count() == 0


def textured(spark):
    """Four images of equal tiles that differ from place to place."""
    rows = [(k, t, [min(255, 60 + (t * 37 + i * 5) % 120) for i in range(64)]) for k in range(4) for t in range(1024)]
    return spark.createDataFrame(rows, "image_id long, t int, px array<int>")


def test_carriers_have_room_in_every_size(spark):
    sizes = spark.createDataFrame([(2048,), (2048,), (512,), (50,), (48,), (47,), (0,)], "n long")
    got = raster.carriers_by_size(sizes.filter("n > 0")).collect()
    own = {(r["idx"], r["bit"]) for r in raster.carriers(spark).collect()}
    assert {(r["idx"], r["bit"]) for r in got if r["n"] == 2048} == own
    for n, votes in ((512, 10), (50, 1), (48, 1)):
        rows = [r for r in got if r["n"] == n]
        assert len(rows) == 48 * votes == len({r["idx"] for r in rows}) and all(sum(r["bit"] == b for r in rows) == votes for b in range(48))
    assert 47 not in {r["n"] for r in got}


def test_a_page_mark_is_read_at_a_third_of_the_size(spark):
    image, want = flat(spark, 2), raster.payload_for(F.col("image_id"))
    marked = raster.embed_coarse(image, want)
    got = raster.extract_coarse(marked).select(bits.matching(F.col("payload"), want).alias("m"), bits.crc_ok(F.col("payload")).alias("ok")).collect()
    assert [(r["m"], r["ok"]) for r in got] == [(48, True)] * 2
    none = raster.extract_coarse(image).select(bits.matching(F.col("payload"), want).alias("m")).collect()
    assert all(14 <= r["m"] <= 34 for r in none)
    same = raster.squared_error(image, marked, ["image_id"]).filter("sse > 0 AND n = 65536").count()
    assert same == 2


def test_pooled_figures_have_a_ceiling_and_gaps(spark):
    errors = spark.createDataFrame([(1, 0, 64), (1, 0, 64), (2, 5, 64), (3, 64, 64)], "doc long, sse long, n long")
    has = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 1)], "doc long, has long")
    got = {r["doc"]: (r["pages"], r["psnr"]) for r in raster.pooled_psnr(errors, has).collect()}
    assert got == {1: (2, round(10 * math.log10(65025 * 128), 6)), 2: (1, None), 3: (1, round(10 * math.log10(65025), 6)), 4: (0, None)}
