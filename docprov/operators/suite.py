"""The robustness suite: marks under attacks of several kinds, each with its own target, and the curve over strengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.functions.workers import ship
from docprov.operators import raster, resample

#: Attacks, and the bits of 48 that each must leave.
TARGETS = {"JPEG q90": 48, "JPEG q75": 46, "JPEG q60": 44, "JPEG q45": 41, "Resize 50%": 43, "Crop 20%": 40, "Gaussian noise": 42, "Screenshot sim": 40}
#: Strengths of the curve, the one that attacks are run at, and the attack of the curve.
DELTAS, USUAL, CURVE = (4, 8, 12, 16, 24), 12, "JPEG q75"
NONE = "none"
QUALITY = {"JPEG q90": 90, "JPEG q75": 75, "JPEG q60": 60, "JPEG q45": 45, "Screenshot sim": 70}
#: The luminance table of the JPEG standard (its annex K), row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
_TIE = 1e-9  # what is nearer to a half than this is one: sums of cosines differ by less between engines


def quantisers(quality: int) -> list[int]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (q * scale + 50) // 100)) for q in LUMINANCE]


def _cosines() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)


def compressed(rasters: DataFrame, quality: Column) -> DataFrame:
    """rasters (any columns, and px) with every tile's cosine transform rounded to multiples of a quality's quantisers (null: left
    as it is): the losses of JPEG, without its codes. Tiles are taken one by one; an empty table gives no rows."""
    steps = {q: np.array(quantisers(q), np.float64).reshape(8, 8) for q in range(1, 101)}
    base, names = _cosines(), list(rasters.columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qs = b.column("_q").to_pylist()
            some = [i for i, q in enumerate(qs) if q is not None]
            v = b.column("px").flatten().to_numpy().reshape(-1, 8, 8).astype(np.float64)
            if some:
                step = np.stack([steps[qs[i]] for i in some])
                c = np.floor(base @ (v[some] - 128) @ base.T / step + 0.5 + _TIE) * step
                v[some] = np.clip(np.floor(base.T @ c @ base + 128.5 + _TIE), 0, 255)
            px = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * 64, pa.int32()), pa.array(v.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([px if n == "px" else b.column(n) for n in names], names=names)

    ship(rasters.sparkSession)
    return rasters.select("*", quality.cast("int").alias("_q")).mapInArrow(run, kinds)


def _per_attack(names: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(F.col("attack") == k, F.lit(v)) for k, v in names.items()))


def attacked(marked: DataFrame) -> DataFrame:
    """image_id, delta, attack, t, px: marked (image_id, delta, w, h, t, px) under every attack, at the size it had.

    At deltas other than USUAL only the curve's attack is run. Resize halves and doubles, crop takes the inner 80 percent back to
    the full size, noise is a blur (as the published suite has it), a screenshot is taken at 80 percent (in whole tiles),
    brightened by a fifth, compressed and brought back.
    """
    some = F.when(F.col("delta") == USUAL, F.array(*map(F.lit, (NONE, *TARGETS)))).otherwise(F.array(F.lit(NONE), F.lit(CURVE)))
    each = marked.select("image_id", "delta", F.explode(some).alias("attack"), "w", "h", "t", "px")
    keys = ["image_id", "delta", "attack"]
    flat = F.col("attack").isin(NONE, *(k for k in QUALITY if k != "Screenshot sim"))
    still = compressed(each.filter(flat), _per_attack({k: q for k, q in QUALITY.items() if k != "Screenshot sim"}))

    def first(row: dict, n: int) -> resample.Taps:
        if row["attack"] == "Resize 50%":
            return resample.area(n, 8 * (n // 16))
        if row["attack"] == "Crop 20%":
            return resample.linear(n, n, (n + 5) // 10, (8 * n + 5) // 10)
        if row["attack"] == "Screenshot sim":
            return resample.area(n, 8 * (n // 10))
        return resample.blur(n)

    size = each.filter(F.col("attack") == "Resize 50%").select("image_id", F.col("w").alias("w0"), F.col("h").alias("h0")).distinct()
    moved = resample.filtered(each.filter(~flat), keys, first)
    done = moved.filter(F.col("attack").isin("Crop 20%", "Gaussian noise"))
    small = moved.filter(~F.col("attack").isin("Crop 20%", "Gaussian noise"))
    brighter = F.transform("px", lambda v: F.least(F.lit(255), F.floor((v * 12 + 5) / 10).cast("int")))
    small = small.withColumn("px", F.when(F.col("attack") == "Screenshot sim", brighter).otherwise(F.col("px")))
    small = compressed(small, _per_attack({"Screenshot sim": QUALITY["Screenshot sim"]})).join(size, "image_id")
    back = resample.resized(small, keys, "w0", "h0")
    out = [df.select(*keys, "t", "px") for df in (still, done, back)]
    return out[0].union(out[1]).union(out[2])


def suite(image: DataFrame, side: int = 8 * raster.GRID) -> DataFrame:
    """image_id, delta, attack, recovered (bits of 48): image's marks of every strength, read again after every attack."""
    return _read(_marked(image), side)


def _marked(image: DataFrame) -> DataFrame:
    grid = image.withColumn("delta", F.explode(F.array(*map(F.lit, DELTAS))))
    return raster.embed(grid, raster.payload_for(F.col("image_id")), F.col("delta").cast("double"))


def _read(marked: DataFrame, side: int) -> DataFrame:
    read = raster.extract(attacked(resample.sized(marked, side, side)), F.col("delta").cast("double"))
    return read.select("image_id", "delta", "attack", bits.matching(F.col("payload"), raster.payload_for(F.col("image_id"))).cast("int").alias("recovered"))


def table(image: DataFrame, side: int = 8 * raster.GRID) -> DataFrame:
    """kind, name, delta, bits (fewest of all images), psnr (of the marks, all images pooled), target and survived: a row for each
    attack at USUAL, held against its own target, and one for each strength of the curve, after its attack, without a target."""
    marked = _marked(image)
    before = image.withColumn("delta", F.explode(F.array(*map(F.lit, DELTAS))))
    error = raster.squared_error(before, marked, ["image_id", "delta"]).groupBy("delta").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    error = error.select("delta", bits.half_up(raster.psnr(F.col("sse"), F.col("n")), 2).alias("psnr"))
    got = _read(marked, side).groupBy("attack", "delta").agg(F.min("recovered").alias("bits"))
    target = _per_attack(TARGETS)
    attacks = got.filter((F.col("attack") != NONE) & (F.col("delta") == USUAL)).select(F.lit("attack").alias("kind"), F.col("attack").alias("name"), "delta", "bits", target.alias("target"))
    curve = got.filter(F.col("attack") == CURVE).select(F.lit("curve").alias("kind"), F.col("delta").cast("string").alias("name"), "delta", "bits", F.lit(None).cast("int").alias("target"))
    return attacks.union(curve).join(error, "delta").select("kind", "name", "delta", "bits", "psnr", "target", (F.col("bits") >= F.col("target")).alias("survived"))
