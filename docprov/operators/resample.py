"""Rasters of any size as tile tables: resampling, blurring and what else needs a value's neighbours in other tiles.

A raster is w by h values, both multiples of 8; tile t of its w / 8 times h / 8 tiles stands at column t % (w / 8). A separable
filter goes over it in two steps, along rows and along columns: the tiles of one row (column) of tiles meet in one group, a strip
whose size is the raster's width (height), so that a tile moves once for each step and no value moves by itself. Weights are whole
numbers and values are rounded once, behind the second step: results are exact, across tiles as well as inside.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions.workers import ship

#: (places, weights) of each new value: rows of equal length. All rows of weights have the same sum.
Taps = tuple[np.ndarray, np.ndarray]
#: Tiles that a task of a filter gives out at once, or those of one strip.
TILES = 4096


def blur(size: int, sigma: float = 1.5) -> Taps:
    """A Gaussian, its weights in thousandths; the outermost values go on beyond the edges."""
    reach = math.ceil(2.5 * sigma)
    near = np.arange(-reach, reach + 1)
    weights = np.floor(1000 * np.exp(-(near**2) / (2 * sigma * sigma)) + 0.5).astype(np.int64)
    return np.clip(np.arange(size)[:, None] + near, 0, size - 1), np.tile(weights, (size, 1))


def area(size: int, to: int) -> Taps:
    """Means of equal shares of the axis; a value that two of them share counts for each by its part."""
    g = np.arange(to)
    first = g * size // to
    place = first[:, None] + np.arange(-(-size // to) + 1)
    overlap = np.minimum((place + 1) * to, (g[:, None] + 1) * size) - np.maximum(place * to, g[:, None] * size)
    return np.minimum(place, size - 1), np.maximum(overlap, 0)


def linear(size: int, to: int, start: int = 0, length: int | None = None) -> Taps:
    """`length` values from `start` on, as `to` values between them by linear interpolation."""
    length = size if length is None else length
    at = (2 * np.arange(to) + 1) * length - to
    low, part = at // (2 * to), at % (2 * to)
    place = np.stack((low, low + 1), 1)
    return start + np.clip(place, 0, length - 1), np.stack((2 * to - part, part), 1)


def _strips(rasters: DataFrame, keys: list[str], along: str) -> DataFrame:
    across = (F.col("w") / 8).cast("int")
    column, row = F.col("t") % across, F.floor(F.col("t") / across).cast("int")
    line, place = (row, column) if along == "x" else (column, row)
    return rasters.groupBy(*keys, "w", "h", "d", line.alias("line")).agg(F.collect_list(F.struct(place.alias("place"), "px")).alias("p"))


def _along(rasters: DataFrame, keys: list[str], along: str, rule: Callable[[dict, int], Taps], last: bool) -> DataFrame:
    """One step of filtered(): d is what values have been multiplied by so far."""
    kinds = {f.name: f.dataType.simpleString() for f in rasters.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "w int, h int, d long, t int, px array<long>"])

    def put(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        """A row for each tile of out: (row of b, w, h, d, numbers of tiles, their px)."""
        n = [len(o[4]) for o in out]
        row = pa.array(np.repeat([o[0] for o in out], n), pa.int64())
        size = [pa.array(np.repeat([o[k] for o in out], n), f) for k, f in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()))]
        px = np.concatenate([o[5] for o in out])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(px) + 1) * 64, pa.int32()), pa.array(px.ravel(), pa.int64()))
        t = pa.array(np.concatenate([o[4] for o in out]), pa.int32())
        return pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in keys), *size, t, lists], names=[*keys, "w", "h", "d", "t", "px"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            ready = 0
            own = [b.column(k).to_pylist() for k in keys]
            lists, size = b.column("p"), (b.column(c).to_pylist() for c in ("w", "h", "d", "line"))
            for i, (w, h, d, line) in enumerate(zip(*size, strict=True)):
                key = tuple(c[i] for c in own)
                n = w if along == "x" else h
                tiles = lists[i].values
                strip = np.zeros((n // 8, 8, 8), np.int64)  # tile, line in it, place in it
                strip[tiles.field("place").to_numpy()] = tiles.field("px").flatten().to_numpy().reshape(-1, 8, 8)
                if along == "y":
                    strip = strip.transpose(0, 2, 1)
                places, weights = rule(dict(zip(keys, key, strict=True)), n)
                values = np.zeros((8, len(places)), np.int64)
                flat = strip.transpose(1, 0, 2).reshape(8, n)
                for k in range(places.shape[1]):
                    values += flat[:, places[:, k]] * weights[:, k]
                d *= int(weights[0].sum())
                if last:
                    values = np.clip((2 * values + d) // (2 * d), 0, 255)
                made = values.reshape(8, -1, 8).transpose(1, 0, 2)
                if along == "y":
                    made = made.transpose(0, 2, 1)
                new = len(places)
                w2, h2 = (new, h) if along == "x" else (w, new)
                j = np.arange(len(made))
                out.append((i, w2, h2, 1 if last else d, line * (w2 // 8) + j if along == "x" else j * (w2 // 8) + line, made.reshape(-1, 64)))
                ready += len(made)
                if ready >= TILES:  # what is ready goes out: memory doesn't grow with a batch's strips
                    yield put(b, out)
                    out, ready = [], 0
            if out:
                yield put(b, out)

    ship(rasters.sparkSession)
    return _strips(rasters, keys, along).mapInArrow(run, schema)


def filtered(rasters: DataFrame, keys: list[str], rule: Callable[[dict, int], Taps]) -> DataFrame:
    """keys, w, h, t and px of rasters (keys, w, h, t, px), each axis gone over by rule(the row's keys, its size)'s taps.

    New sizes are multiples of 8. Keys name a raster, a null key being one like others. A tile that isn't there counts as zeros; a
    raster without any has no rows. Values are rounded half up and clipped to 0..255. An empty table gives no rows.
    """
    px = F.col("px").cast("array<long>").alias("px")
    start = rasters.select(*keys, F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.lit(1).cast("long").alias("d"), F.col("t").cast("int").alias("t"), px)
    both = _along(_along(start, keys, "x", rule, False), keys, "y", rule, True)
    return both.select(*keys, "w", "h", "t", F.col("px").cast("array<int>").alias("px"))


def resized(rasters: DataFrame, keys: list[str], w: str, h: str) -> DataFrame:
    """keys, w, h, t and px of rasters (keys, w, h, t, px and two columns with each one's new size), by linear interpolation."""
    own = [*keys, w, h]
    by = {"x": w, "y": h}
    start = rasters.select(*own, F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.lit(1).cast("long").alias("d"), F.col("t").cast("int").alias("t"), F.col("px").cast("array<long>").alias("px"))
    for along in ("x", "y"):
        start = _along(start, own, along, lambda row, n, to=by[along]: linear(n, row[to]), along == "y")
    return start.select(*keys, "w", "h", "t", F.col("px").cast("array<int>").alias("px"))


def fitted(rasters: DataFrame, keys: list[str], w: tuple[int, Callable], h: tuple[int, Callable]) -> DataFrame:
    """filtered(), the axes each with its new size and a rule of (the row's keys, the old size, the new one)."""
    px = F.col("px").cast("array<long>").alias("px")
    start = rasters.select(*keys, F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.lit(1).cast("long").alias("d"), F.col("t").cast("int").alias("t"), px)
    first = _along(start, keys, "x", lambda row, n: w[1](row, n, w[0]), False)
    both = _along(first, keys, "y", lambda row, n: h[1](row, n, h[0]), True)
    return both.select(*keys, "w", "h", "t", F.col("px").cast("array<int>").alias("px"))


def sized(image: DataFrame, w: int, h: int) -> DataFrame:
    """A tile table of rasters of one size with that size."""
    return image.select("*", F.lit(w).alias("w"), F.lit(h).alias("h"))


def shares(rasters: DataFrame, keys: list[str], sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """keys and, for each name in sizes (columns, rows), an array of columns * rows sums over equal shares of a raster, row by row.

    A value that lies in several shares counts for each by its part: sums are w * h times the means and whole numbers, whatever
    sides divide. Each tile is reduced to the shares that it touches before anything moves.
    """

    def span(at: Column, side: Column, to: int) -> Column:
        return F.sequence(F.floor(at * 8 * to / side).cast("int"), F.floor((at * 8 * to + 8 * to - 1) / side).cast("int"))

    def cells(name: str, c: int, r: int) -> Column:
        def one(x: Column, y: Column) -> Column:
            return F.struct(F.lit(name).alias("kind"), (y * c + x).alias("cell"), x.alias("x"), y.alias("y"), F.lit(c).alias("c"), F.lit(r).alias("r"))

        return F.flatten(F.transform(span(F.col("ty"), F.col("h"), r), lambda y: F.transform(span(F.col("tx"), F.col("w"), c), lambda x: one(x, y))))

    across = (F.col("w") / 8).cast("int")
    each = [cells(name, c, r) for name, (c, r) in sizes.items()]
    tiles = rasters.select(*keys, "w", "h", "px", (F.col("t") % across).alias("tx"), F.floor(F.col("t") / across).cast("int").alias("ty"))
    spread = tiles.select("*", F.explode(F.concat(*each)).alias("s")).select(*keys, "w", "h", "px", "tx", "ty", "s.*")

    def overlap(at: Column, to: str, cell: str, side: str) -> Column:
        return F.greatest(F.lit(0), F.least((at + 1) * F.col(to), (F.col(cell) + 1) * F.col(side)) - F.greatest(at * F.col(to), F.col(cell) * F.col(side))).cast("long")

    wx = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: overlap(F.col("tx") * 8 + i, "c", "x", "w"))
    wy = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: overlap(F.col("ty") * 8 + i, "r", "y", "h"))
    weighed = spread.select(F.inline(F.array(F.struct(*keys, "kind", "cell", "px", wx.alias("wx"), wy.alias("wy")))))
    whole = F.aggregate(F.transform("px", lambda v, i: v * F.col("wx")[i % 8] * F.col("wy")[F.floor(i / 8).cast("int")]), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = weighed.select(*keys, "kind", "cell", whole.alias("v")).groupBy(*keys, "kind", "cell").agg(F.sum("v").alias("v"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("cell", "v")))), lambda x: x["v"]).alias(name) for name in sizes]
    return sums.groupBy(*keys).agg(*lists)


def _cosines(n: int, low: int = 8) -> list[float]:
    return [math.cos((2 * x + 1) * u * math.pi / (2 * n)) for u in range(low) for x in range(n)]


def _low_cosines(v: Column, n: int = 32) -> tuple[Column, Column]:
    """(rows, coefficients): the low 8 by 8 of n by n values' cosine transform without its first, from the transform of each row,
    which is the column _rows: the work is 8 n (n + 8) for a raster."""
    basis = F.array(*map(F.lit, _cosines(n)))
    every = F.sequence(F.lit(0), F.lit(n - 1))

    def low(k: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(every, F.lit(0.0), lambda a, x: a + of(x) * basis[k * n + x])

    rows = F.transform(F.sequence(F.lit(0), F.lit(8 * n - 1)), lambda i: low(i % 8, lambda x: v[F.floor(i / 8).cast("int") * n + x]))
    return rows, F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: low(F.floor(i / 8).cast("int"), lambda y: F.col("_rows")[y * 8 + i % 8]))


def fingerprints(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p_hash, d_hash and a_hash, 64 bits each, of every raster: of its 32 by 32, 9 by 8 and 8 by 8 equal shares.

    p: bit k - 1 is 1 where coefficient k of the low 8 by 8 of the cosine transform exceeds their upper median; bit 63 is 0. d: bit 8 y + x is 1 where a share exceeds the one to its right. a: bit i is 1 where a share exceeds the mean. One shuffle, of
    sums, for all three.
    """
    small = shares(rasters, keys, {"p": (32, 32), "d": (9, 8), "a": (8, 8)})
    rows, coefficients = _low_cosines(F.col("p"))
    small = small.select(F.inline(F.array(F.struct(*keys, "d", "a", rows.alias("_rows")))))
    small = small.select(F.inline(F.array(F.struct(*keys, "d", "a", coefficients.alias("c")))))

    def number(n: int, bit: Callable[[Column], Column]) -> Column:
        one = F.lit(1).cast("long")
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda a, i: F.when(bit(i), a.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(a))

    at = lambda i: F.floor(i / 8).cast("int") * 9 + i % 8
    total = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x)
    small = small.select("*", F.sort_array("c")[31].alias("m"), total.alias("s"))
    small = small.select(F.inline(F.array(F.struct(*small.columns))))
    return small.select(
        *keys,
        number(63, lambda i: F.col("c")[i] > F.col("m")).alias("p_hash"),
        number(64, lambda i: F.col("d")[at(i)] > F.col("d")[at(i) + 1]).alias("d_hash"),
        number(64, lambda i: F.col("a")[i] * 64 > F.col("s")).alias("a_hash"),
    )


def sql_area(size: str, to: str) -> str:
    """area()'s taps as a query of g, x and wt."""
    over = f"least((x + 1) * {to}, (g + 1) * {size}) - greatest(x * {to}, g * {size})"
    return f"SELECT g, x, {over} AS wt FROM (SELECT unnest(range({to})) AS g), (SELECT unnest(range({size})) AS x) WHERE {over} > 0"


def sql_linear(to: str, start: str, length: str) -> str:
    """linear()'s taps."""
    at = f"floor(((2 * g + 1) * {length} - {to}) / CAST(2 * {to} AS DOUBLE))"
    part = f"((2 * g + 1) * {length} - {to} - 2 * {to} * {at})"
    return f"SELECT g, CAST({start} + greatest(0, least({length} - 1, {at} + k)) AS BIGINT) AS x, CAST(CASE k WHEN 0 THEN 2 * {to} - {part} ELSE {part} END AS BIGINT) AS wt FROM (SELECT unnest(range({to})) AS g), (SELECT unnest([0, 1]) AS k)"


def sql_blur(size: str) -> str:
    """blur()'s taps at its usual width."""
    near = blur(1)[1][0].tolist()
    values = ", ".join(f"({k - len(near) // 2}, {w})" for k, w in enumerate(near))
    return f"SELECT g, greatest(0, least({size} - 1, g + k)) AS x, wt FROM (SELECT unnest(range({size})) AS g), (VALUES {values}) n(k, wt)"
