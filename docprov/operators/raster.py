"""Rasters as tile tables: fingerprints, robust and fragile marks, fidelity, tone matching.

An image is GRID by GRID tiles of 8 by 8 values (image_id, t, px); tile t stands at column t % GRID, row t // GRID.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.sources.files import written

GRID, VOTES, BITS = 32, 21, 48
_LEFT = [1 if i % 8 < 4 else -1 for i in range(64)]
_TOP = [1 if i < 32 else -1 for i in range(64)]


def images(tiles: DataFrame, each: int = 100) -> DataFrame:
    """One image for `each` tiles, of GRID * GRID tiles: number 7 t + each i of the table, around its end."""
    n = tiles.count()
    if not n:
        return tiles.sparkSession.createDataFrame([], "image_id long, t int, px array<int>")
    spots = tiles.sparkSession.range(math.ceil(n / each)).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(GRID * GRID - 1))).alias("t"))
    return spots.withColumn("tile_id", (F.col("t") * 7 + F.col("image_id") * each) % n).join(tiles, "tile_id").select("image_id", "t", "px")


def held(rows: DataFrame) -> DataFrame:
    """rows, with every column computed once: what is above can't be merged into what made them."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def dot(px: Column, weights: list[int]) -> Column:
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.zip_with(px, w, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x)


def total(px: Column) -> Column:
    return F.aggregate(px, F.lit(0).cast("bigint"), lambda a, x: a + x)


def haar(px: Column) -> tuple[Column, Column]:
    """Third-level HL and LH of a tile: halves of the differences of its halves' means."""
    return dot(px, _LEFT) / 64, dot(px, _TOP) / 64


def a_hash(px: Column) -> Column:
    """Bit i is 1 where value i exceeds the mean (compared in whole numbers), lowest bit first."""
    every = F.sequence(F.lit(0), F.size(px) - 1)
    return F.aggregate(every, F.lit(0).cast("bigint"), lambda acc, i: F.when(px[i] * F.size(px) > total(px), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(acc))


def p_hash(image: DataFrame) -> DataFrame:
    """image_id, p_hash: low 8 by 8 of a 32 by 32 DCT without its first, against their upper median."""
    spark = image.sparkSession
    n = GRID
    basis = [(u * 8 + v, y * n + x, math.cos((2 * y + 1) * u * math.pi / (2 * n)) * math.cos((2 * x + 1) * v * math.pi / (2 * n))) for u in range(8) for v in range(8) if u or v for y in range(n) for x in range(n)]
    weights = F.broadcast(spark.createDataFrame(basis, "k int, t int, w double"))  # 63 * 1024 rows, whatever the input
    coef = image.select("image_id", "t", total(F.col("px")).alias("v")).join(weights, "t").groupBy("image_id", "k").agg(F.sum(F.col("v") * F.col("w")).alias("c"))
    rows = coef.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("l"))
    rows = rows.withColumn("median", F.sort_array(F.transform("l", lambda x: x["c"]))[31])
    bit = F.aggregate("l", F.lit(0).cast("bigint"), lambda acc, x: F.when(x["c"] > F.col("median"), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["k"] - 1))).otherwise(acc))
    return rows.select("image_id", bit.alias("p_hash"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def carriers(spark, seed: str = "mark", coefficients: int = 2 * GRID * GRID, votes: int = VOTES) -> DataFrame:
    """idx, bit: coefficient idx (2 t for HL, 2 t + 1 for LH) votes for bit. A seeded permutation of one image size: some
    thousand rows, whatever the input. Fewer coefficients than votes are refused."""
    if coefficients < BITS * votes:
        raise ValueError("too few tiles for a mark")
    place = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string")), 256))) - 1
    return spark.range(coefficients).select(F.col("id").alias("idx")).withColumn("place", place).filter(F.col("place") < BITS * votes).select("idx", F.floor(F.col("place") / votes).cast("int").alias("bit"))


def carriers_by_size(sizes: DataFrame, seed: str = "mark") -> DataFrame:
    """n, idx, bit: carriers() of rasters of n coefficients, for every n of sizes: a permutation of its own for each, with as many
    votes a bit as n has room for, VOTES at most. Sizes below BITS have none."""
    votes = F.least(F.lit(VOTES), F.floor(F.col("n") / BITS))
    every = sizes.select("n").distinct().select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string")), 256))) - 1
    return every.withColumn("place", place).filter(F.col("place") < BITS * votes).select("n", "idx", F.floor(F.col("place") / votes).cast("int").alias("bit"))


def coefficients(image: DataFrame) -> DataFrame:
    hl, lh = haar(F.col("px"))
    both = F.explode(F.array(F.struct((F.col("t") * 2).cast("bigint").alias("idx"), hl.alias("c")), F.struct((F.col("t") * 2 + 1).cast("bigint").alias("idx"), lh.alias("c"))))
    keys = [c for c in image.columns if c not in ("t", "px")]
    return held(image).select(*keys, both.alias("x")).select(*keys, "x.idx", "x.c")


def qim(c: Column, delta: Column, bit: Column) -> Column:
    """The value next to c that reads as bit."""
    o = F.when(bit == 1, 0.75).otherwise(0.25)
    return delta * (F.floor(c / delta - o + 0.5) + o)


def qim_read(c: Column, delta: Column) -> Column:
    share = c / delta - F.floor(c / delta)
    return F.when(share < 0.5, 0).otherwise(1)


def extract(image: DataFrame, delta: Column | int = 12, seed: str = "mark", own: DataFrame | None = None) -> DataFrame:
    """Per image (and any further keys) the 48 bits by majority, as number and text, and the mean agreement.

    Votes come from the tiles that are there: a bit without votes is 0 with agreement one half. own: other carriers; those of
    several sizes (carriers_by_size()) meet the image's column n.
    """
    keys = [c for c in image.columns if c not in ("t", "px")]
    step = F.lit(delta).cast("double") if isinstance(delta, int) else delta
    if own is not None and "n" in own.columns:
        met = coefficients(image).join(own, ["n", "idx"])
    else:
        met = coefficients(image).join(F.broadcast(own if own is not None else carriers(image.sparkSession, seed)), "idx")
    keys = [k for k in keys if k != "n"]
    votes = met.groupBy(*keys, "bit").agg(F.sum(qim_read(F.col("c"), step)).alias("ones"), F.count("*").alias("n"))
    known = votes.select(*keys, "bit", (F.col("ones") * 2 > F.col("n")).cast("int").alias("v"), F.greatest("ones", F.col("n") - F.col("ones")).alias("most"), "n")
    number = F.sum(F.call_function("shiftleft", F.col("v").cast("bigint"), F.lit(BITS - 1) - F.col("bit")))
    return known.groupBy(*keys).agg(number.alias("payload"), bits.half_up((F.sum(F.col("most") / F.col("n")) + (BITS - F.count("*")) * 0.5) / BITS, 6).alias("confidence"))


def read_mark(image: DataFrame, delta: Column | int = 12, seed: str = "mark", own: DataFrame | None = None) -> DataFrame:
    """extract(), with the flip that explains a wrong CRC undone; `corrected` where there was one."""
    read = held(extract(image, delta, seed, own)).withColumn("_fixed", bits.repaired(F.col("payload")))
    keys = [c for c in read.columns if c not in ("payload", "confidence", "_fixed")]
    return held(read).select(*keys, F.col("_fixed").alias("payload"), "confidence", (F.col("_fixed") != F.col("payload")).alias("corrected"))


def payload_for(image_id: Column) -> Column:
    return bits.build_payload(bits.short_id(F.sha2(F.concat(F.lit("image:"), image_id.cast("string")), 256)))


def embed(image: DataFrame, payload: Column, delta: Column | int = 12, seed: str = "mark", own: DataFrame | None = None) -> DataFrame:
    """image with each carrier moved to read as its bit of payload; values are rounded and clipped. own: other carriers."""
    keys = [c for c in image.columns if c != "px"]
    step = F.lit(delta).cast("double") if isinstance(delta, int) else delta
    own = (own if own is not None else carriers(image.sparkSession, seed)).select(F.floor(F.col("idx") / 2).cast("int").alias("t"), (F.col("idx") % 2).alias("kind"), "bit")
    both = own.groupBy("t").agg(F.max(F.when(F.col("kind") == 0, F.col("bit"))).alias("b_hl"), F.max(F.when(F.col("kind") == 1, F.col("bit"))).alias("b_lh"))
    hl, lh = haar(F.col("px"))
    known = image.join(F.broadcast(both), "t", "left").withColumns({"_p": payload, "_hl": hl, "_lh": lh})

    def move(c: str, b: str) -> Column:
        bit = F.call_function("shiftright", F.col("_p"), F.lit(BITS - 1) - F.col(b)).bitwiseAND(F.lit(1))
        return F.when(F.col(b).isNotNull(), qim(F.col(c), step, bit) - F.col(c)).otherwise(0.0)  # others than carriers stay

    known = held(known)
    moved = known.withColumns({"_x": move("_hl", "b_hl"), "_y": move("_lh", "b_lh")})
    moved = held(moved)
    w = F.arrays_zip(F.col("px").alias("v"), F.array(*map(F.lit, _LEFT)).alias("a"), F.array(*map(F.lit, _TOP)).alias("b"))
    px = F.transform(w, lambda z: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(z["v"] + z["a"] * F.col("_x") + z["b"] * F.col("_y") + 0.5).cast("int"))))
    return held(moved.select(*keys, px.alias("px")).select(*image.columns))


def squared_error(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sse and n of two tile tables."""
    other = b.select(*keys, "t", F.col("px").alias("px_b"))
    each = F.aggregate(F.zip_with("px", "px_b", lambda x, y: ((x - y) * (x - y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return a.join(other, [*keys, "t"]).groupBy(*keys).agg(F.sum(each).alias("sse"), F.sum(F.size("px")).alias("n"))


def psnr(sse: Column, n: Column) -> Column:
    """Decibels; infinite for equal rasters, 0 for empty ones."""
    return F.when(n == 0, 0.0).when(sse == 0, float("inf")).otherwise(F.log10(F.lit(255.0 * 255.0) / (sse / n)) * 10)


def block_digest(px: Column, image_id: Column, t: Column, key: str = "key") -> Column:
    """A keyed digest of a tile and its place, values' lowest bits aside; 64 characters of hex."""
    clear = F.array_join(F.transform(px, lambda v: (v - v % 2).cast("string")), ",")
    return F.sha2(F.concat_ws("|", F.lit(key), image_id.cast("string"), t.cast("string"), clear), 256)


def _bit(digest: Column, i: Column) -> Column:
    nibble = F.instr(F.lit("0123456789abcdef"), F.substr(digest, F.floor(i / 4).cast("int") + 1, F.lit(1))) - 1
    return F.call_function("shiftright", nibble, 3 - i % 4).bitwiseAND(F.lit(1))


def fragile_embed(image: DataFrame, key: str = "key") -> DataFrame:
    d = held(image.withColumn("_d", block_digest(F.col("px"), F.col("image_id"), F.col("t"), key)))
    return d.withColumn("px", F.transform("px", lambda v, i: (v - v % 2 + _bit(F.col("_d"), i)).cast("int"))).drop("_d")


def fragile_check(image: DataFrame, key: str = "key") -> DataFrame:
    """image_id, t, wrong (values whose lowest bit isn't the digest's), failed (over a quarter of them)."""
    d = held(held(image).withColumn("_d", block_digest(F.col("px"), F.col("image_id"), F.col("t"), key)))
    wrong = F.size(F.filter(F.transform("px", lambda v, i: v % 2 != _bit(F.col("_d"), i)), lambda x: x))
    return held(d.select("image_id", "t", wrong.alias("wrong"), F.size("px").alias("of"))).withColumn("failed", F.col("wrong") * 4 > F.col("of"))


def tamper_verdict(checked: DataFrame, tiles: int = GRID * GRID) -> DataFrame:
    n = checked.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    status = F.when(F.col("n") != tiles, "unassessable").when(F.col("failed") == 0, "intact").when(F.col("failed") > F.col("n") * 0.6, "unassessable").otherwise("tampered")
    return n.select("image_id", status.alias("status"), "failed", bits.half_up(F.col("failed") / F.col("n") * 100, 1).alias("pct"))


def runs(failed: DataFrame, width: int = GRID) -> DataFrame:
    """image_id, y, x0, x1: the failed tiles (image_id, t) as runs along rows of `width` tiles."""
    x, y = (F.col("t") % width).cast("int"), F.floor(F.col("t") / width).cast("int")
    spots = failed.select("image_id", x.alias("x"), y.alias("y")).distinct()
    own = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))  # the same for all of a run
    return spots.withColumn("own", own).groupBy("image_id", "y", "own").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("own")


def labelled(rows: DataFrame, width: int = GRID) -> DataFrame:
    """runs() with label, the same for all runs that touch, one below another, over any number of steps: the least first tile.

    Runs of a row are joined to those of the next; then labels spread along these links, each round taking the least of a run's
    neighbours and then the label's own label, until a round changes nothing: rounds grow with the logarithm of the longest
    way. An image may have any number of tiles; its runs are spread over tasks.
    """
    nodes = written(rows.select("*", (F.col("y") * width + F.col("x0")).cast("long").alias("run")), "runs")
    below = nodes.select("image_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("other"))
    down = nodes.join(below, ["image_id", "y"]).filter("x0 <= b1 AND b0 <= x1").select("image_id", "run", "other")
    links = written(down.union(down.select("image_id", F.col("other").alias("run"), F.col("run").alias("other"))), "links")
    labels, changed = written(nodes.select("image_id", "run", F.col("run").alias("label")), "labels"), True
    while changed:
        near = links.join(labels.select("image_id", F.col("run").alias("other"), "label"), ["image_id", "other"]).select("image_id", "run", "label")
        least = near.union(labels).groupBy("image_id", "run").agg(F.min("label").alias("label"))
        own = labels.select("image_id", F.col("run").alias("label"), F.col("label").alias("further"))
        after = least.join(own, ["image_id", "label"]).select("image_id", "run", F.least("label", "further").alias("label"))
        after = written(after, "labels")
        changed = after.agg(F.sum("label")).first() != labels.agg(F.sum("label")).first()
        labels = after
    return nodes.join(labels, ["image_id", "run"]).drop("run")


def regions(checked: DataFrame, most: int = 20, width: int = GRID) -> DataFrame:
    """image_id, place, x, y, w, h (in values): boxes of failed tiles that touch at a side, the `most` largest boxes of an image first.

    Equal areas go by x, then y, w and h. Images without a failed tile have no rows.
    """
    each = labelled(runs(checked.filter("failed").select("image_id", "t"), width), width).groupBy("image_id", "label").agg(F.min("x0").alias("a"), F.max("x1").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    boxes = each.select("image_id", (F.col("a") * 8).alias("x"), (F.col("c") * 8).alias("y"), ((F.col("b") - F.col("a") + 1) * 8).alias("w"), ((F.col("d") - F.col("c") + 1) * 8).alias("h"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.col("w") * F.col("h")), "x", "y", "w", "h"))
    return boxes.withColumn("place", place).filter(F.col("place") <= most).select("image_id", "place", "x", "y", "w", "h")


def histogram(image: DataFrame) -> DataFrame:
    """image_id, v (0..255), n, upto: counts of values and their running sum, empty ones too."""
    counts = image.select("image_id", F.explode("px").alias("v")).groupBy("image_id", "v").agg(F.count("*").alias("n"))
    every = image.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    w = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(counts, ["image_id", "v"], "left").select("image_id", "v", F.coalesce("n", F.lit(0)).alias("n")).withColumn("upto", F.sum("n").over(w))


def tones_of(hist: DataFrame, released: DataFrame) -> DataFrame:
    """tone_table(), each image with the image of its number in released (histograms, too) for its reference."""
    ref = released.select("image_id", F.col("v").alias("to"), F.col("upto").alias("ref_upto"))
    pairs = hist.join(ref, "image_id").filter(F.col("ref_upto") >= F.col("upto"))  # 256 rows against 256 of each image
    return pairs.groupBy("image_id", "v").agg(F.least(F.min("to"), F.lit(255)).alias("to"))


def tone_table(hist: DataFrame, reference: int = 0) -> DataFrame:
    """image_id, v, to: the least value of the reference whose share of smaller ones reaches v's; 255 at most."""
    ref = hist.filter(F.col("image_id") == reference).select(F.col("v").alias("to"), F.col("upto").alias("ref_upto"))
    pairs = hist.join(F.broadcast(ref), F.col("ref_upto") >= F.col("upto"))  # 256 rows against 256 of each image of equal size
    return pairs.groupBy("image_id", "v").agg(F.least(F.min("to"), F.lit(255)).alias("to"))


def tone_match(image: DataFrame, reference: int = 0) -> DataFrame:
    return toned(image, tone_table(histogram(image), reference))


def toned(image: DataFrame, table: DataFrame) -> DataFrame:
    """image_id, t, px of image, its values looked up in tone_table()'s rows."""
    luts = table.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "to"))), lambda x: x["to"]).alias("lut"))
    return image.join(luts, "image_id").select("image_id", "t", F.transform("px", lambda v: F.col("lut")[v]).alias("px"))


def turned(image: DataFrame) -> DataFrame:
    """Each image in its four orientations (turn 0..3 quarters), tiles moved and their values with them."""

    def quarter(i: Column, side: int, turn: Column) -> Column:
        y, x, m = F.floor(i / side).cast("int"), i % side, side - 1
        return F.when(turn == 0, i).when(turn == 1, (m - x) * side + y).when(turn == 2, (m - y) * side + m - x).otherwise(x * side + m - y)

    four = image.withColumn("turn", F.explode(F.array(*map(F.lit, range(4)))))
    px = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("px")[quarter(i, 8, F.col("turn"))])
    back = F.when(F.col("turn") == 0, 0).otherwise(4 - F.col("turn"))
    return four.select("image_id", "turn", quarter(F.col("t"), GRID, back).cast("int").alias("t"), px.alias("px"))


def best_turn(image: DataFrame, delta: int = 12) -> DataFrame:
    """The repaired reading of the orientation whose CRC holds (of several, the surest), else of the highest confidence; unturned first on ties."""
    read = read_mark(turned(image), delta)
    read = read.withColumn("ok", bits.crc_ok(F.col("payload")))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("ok"), F.desc("confidence"), "turn"))
    return read.withColumn("place", place).filter("place = 1").select("image_id", "turn", "payload", "confidence", "ok")


def coarse(image: DataFrame, scale: int = 3) -> DataFrame:
    """image_id, t, px: tiles of the image at 1/scale of its size, each value the mean of scale by scale values."""
    small = GRID // scale
    bx, by = F.col("t") % GRID, F.floor(F.col("t") / GRID).cast("int")
    spots = image.select("image_id", bx.alias("bx"), by.alias("by"), F.posexplode("px").alias("i", "v"))
    gx, gy = F.floor((F.col("bx") * 8 + F.col("i") % 8) / scale).cast("int"), F.floor((F.col("by") * 8 + F.floor(F.col("i") / 8)) / scale).cast("int")
    cells = spots.select("image_id", gx.alias("gx"), gy.alias("gy"), "v").filter((F.col("gx") < small * 8) & (F.col("gy") < small * 8))
    means = cells.groupBy("image_id", "gx", "gy").agg(F.floor(F.avg("v") + 0.5).cast("int").alias("v"))
    t = F.floor(F.col("gy") / 8).cast("int") * small + F.floor(F.col("gx") / 8).cast("int")
    place = F.col("gy") % 8 * 8 + F.col("gx") % 8
    return means.groupBy("image_id", t.alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "v"))), lambda x: x["v"]).alias("px"))


def coarse_carriers(spark, seed: str = "page", scale: int = 3) -> DataFrame:
    """Carriers of an image at 1/scale of its size: as many votes for each bit as its tiles have."""
    coefficients = 2 * (GRID // scale) ** 2
    return carriers(spark, seed, coefficients, coefficients // BITS)


def embed_coarse(image: DataFrame, payload: Column, delta: int = 8, scale: int = 3, seed: str = "page") -> DataFrame:
    """image with a mark in its copy at 1/scale of the size: what the mark adds to a value there is added to all the scale by
    scale values that it is the mean of. Values outside whole tiles of the copy stay."""
    small = GRID // scale
    before = coarse(image, scale)
    after = embed(before, payload, delta, own=coarse_carriers(image.sparkSession, seed, scale))
    added = before.join(after.select("image_id", "t", F.col("px").alias("to")), ["image_id", "t"]).select("image_id", F.col("t").alias("small"), F.zip_with("to", "px", lambda a, b: a - b).alias("added"))
    bx, by = (F.col("t") % GRID) * 8, F.floor(F.col("t") / GRID).cast("int") * 8
    spots = image.select("image_id", "t", F.posexplode("px").alias("i", "v"))
    gx, gy = F.floor((bx + F.col("i") % 8) / scale).cast("int"), F.floor((by + F.floor(F.col("i") / 8)) / scale).cast("int")
    spots = spots.select("image_id", "t", "i", "v", gx.alias("gx"), gy.alias("gy"))
    inside = (F.col("gx") < small * 8) & (F.col("gy") < small * 8)
    tile = F.when(inside, F.floor(F.col("gy") / 8).cast("int") * small + F.floor(F.col("gx") / 8).cast("int"))
    spots = spots.select("image_id", "t", "i", "v", tile.alias("small"), (F.col("gy") % 8 * 8 + F.col("gx") % 8).alias("k"))
    new = F.col("v") + F.coalesce(F.get("added", F.col("k")), F.lit(0))
    new = F.greatest(F.lit(0), F.least(F.lit(255), new)).cast("int")
    moved = spots.join(added, ["image_id", "small"], "left").select("image_id", "t", F.struct("i", new.alias("v")).alias("x"))
    return moved.groupBy("image_id", "t").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("px"))


def extract_coarse(image: DataFrame, delta: int = 8, scale: int = 3, seed: str = "page") -> DataFrame:
    """extract() of embed_coarse()'s mark."""
    return extract(coarse(image, scale), delta, own=coarse_carriers(image.sparkSession, seed, scale))


def pooled_psnr(errors: DataFrame, has: DataFrame) -> DataFrame:
    """doc, pages and psnr over all pages of a document, from errors (doc, sse, n of a page) and has (doc, has: its pages).

    Null where a page has no partner; equal pages have the figure of one level of error in all of the document.
    """
    sums = errors.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    figure = F.log10(F.lit(65025.0) * F.col("n").cast("double") / F.greatest(F.col("sse").cast("double"), F.lit(1.0))) * 10
    return has.join(sums, "doc", "left").select("doc", F.coalesce("pages", F.lit(0)).alias("pages"), F.when(F.col("pages") == F.col("has"), bits.half_up(figure, 6)).alias("psnr"))
