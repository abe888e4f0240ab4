"""Reading passes over suspected leaks that come in sizes of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprov.operators import raster, resample
from docprov.sources.files import written

#: The share of a tall capture that its topcrop pass reads, and from which share of its width on it is tall.
UPPER, TALL = 55, 0.85


def passes(leaks: DataFrame, released: DataFrame, w: int = 8 * raster.GRID, h: int = 8 * raster.GRID) -> DataFrame:
    """image_id, pass, n, t, px: leaks (image_id, w, h, t, px) as each pass reads them; n is the number of their coefficients.

    direct: at the size it came in. scaled: brought to the released copies' size (w, h) by linear interpolation. tones: that, with
    the tones of the released copy of its number (released: image_id, t, px). topcrop: the upper 55 percent of tall leaks,
    brought to that size. Leaks without a released copy have no tones pass. An empty table gives no rows.
    """
    keys = ["image_id"]

    def whole(row: dict, size: int, to: int) -> resample.Taps:
        return resample.linear(size, to)

    def upper(row: dict, size: int, to: int) -> resample.Taps:
        return resample.linear(size, to, 0, (size * UPPER + 50) // 100)

    scaled = written(resample.fitted(leaks, keys, (w, whole), (h, whole)), "scaled")
    luts = raster.tones_of(raster.histogram(scaled), raster.histogram(released))
    tall = leaks.filter(F.col("h") > F.col("w") * TALL)
    each = {
        "direct": leaks.select("image_id", "w", "h", "t", "px"),
        "scaled": scaled,
        "tones": resample.sized(raster.toned(scaled, luts), w, h),
        "topcrop": resample.fitted(tall, keys, (w, whole), (h, upper)),
    }
    n = (F.col("w") / 8 * F.col("h") / 8 * 2).cast("long").alias("n")
    out = [df.select("image_id", F.lit(k).alias("pass"), n, F.col("t").cast("int").alias("t"), "px") for k, df in each.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def read(leaks: DataFrame, released: DataFrame, deltas: tuple[int, ...] = (8, 12, 14, 16)) -> DataFrame:
    """image_id, pass, delta, payload, confidence and corrected: every pass at every strength, each raster by the carriers of its own
    number of coefficients, with the CRC-guided repair."""
    rows = written(passes(leaks, released), "passes")
    swept = rows.withColumn("delta", F.explode(F.array(*map(F.lit, deltas))))
    return raster.read_mark(swept, F.col("delta").cast("double"), own=raster.carriers_by_size(rows))
