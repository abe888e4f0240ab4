"""Resampling and blurring across tiles, and hashes of rasters of any size, against whole arrays."""

import math

import numpy as np
import pytest
from docprov.operators import resample


def tiles(spark, rasters):
    """Rasters ({name: h by w array}) as a tile table."""
    rows = []
    for name, v in rasters.items():
        h, w = v.shape
        for ty in range(h // 8):
            for tx in range(w // 8):
                rows.append((name, w, h, ty * (w // 8) + tx, v[8 * ty : 8 * ty + 8, 8 * tx : 8 * tx + 8].flatten().tolist()))
    return spark.createDataFrame(rows, "image_id string, w int, h int, t int, px array<int>").repartition(5)


def arrays(df):
    out = {}
    for r in df.collect():
        v = out.setdefault(r["image_id"], np.full((r["h"], r["w"]), -1))
        y, x = divmod(r["t"], r["w"] // 8)
        v[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.array(r["px"]).reshape(8, 8)
    return out


def noise(h, w, seed):
    return np.random.default_rng(seed).integers(0, 256, (h, w))


def brute(v, rule):
    """Both axes by dense matrices of fractions."""
    h, w = v.shape

    def matrix(n):
        places, weights = rule(n)
        m = np.zeros((len(places), n), dtype=object)
        for g in range(len(places)):
            for p, k in zip(places[g].tolist(), weights[g].tolist(), strict=True):
                m[g, p] += k
        return m

    a, b = matrix(h), matrix(w)
    d = int(sum(a[0]) * sum(b[0]))
    assert all(sum(r) == sum(a[0]) for r in a)
    out = a.dot(v.astype(object)).dot(b.T)
    return np.array([[min(255, max(0, (2 * int(x) + d) // (2 * d))) for x in r] for r in out])


@pytest.mark.parametrize("rule", [lambda n: resample.blur(n), lambda n: resample.area(n, 8 * (n // 16)), lambda n: resample.linear(n, 2 * n), lambda n: resample.linear(n, n, round(n * 0.1), round(n * 0.8)), lambda n: resample.area(n, 24)], ids=["blur", "half", "double", "crop", "to 24"])
def test_filters_are_exact_across_tiles(spark, rule):
    rasters = {"a": noise(32, 64, 1), "b": noise(56, 40, 2), "c": np.full((24, 24), 255)}
    got = arrays(resample.filtered(tiles(spark, rasters), ["image_id"], lambda _, n: rule(n)))
    for name, v in rasters.items():
        assert (got[name] == brute(v, rule)).all()
    assert resample.filtered(tiles(spark, rasters).filter("false"), ["image_id"], lambda _, n: rule(n)).count() == 0


def test_taps():
    for size, to in ((256, 9), (40, 32), (24, 32), (7, 7), (200, 1)):
        places, weights = resample.area(size, to)
        assert (weights.sum(1) == size).all() and places.max() < size
        dense = np.zeros((to, size))
        np.add.at(dense, (np.arange(to)[:, None], places), weights)
        want = [[max(0.0, min((x + 1) * to, (g + 1) * size) - max(x * to, g * size)) for x in range(size)] for g in range(to)]
        assert (dense == want).all()
    assert resample.blur(9)[1][0].tolist() == [29, 135, 411, 801, 1000, 801, 411, 135, 29]
    places, weights = resample.linear(4, 8)
    assert places[0].tolist() == [0, 0] and weights.sum(1).tolist() == [16] * 8 and places[-1].tolist() == [3, 3]


def brute_hashes(v):
    h, w = v.shape

    def small(columns, rows):
        wx = [[max(0, min((x + 1) * columns, (g + 1) * w) - max(x * columns, g * w)) for x in range(w)] for g in range(columns)]
        wy = [[max(0, min((y + 1) * rows, (g + 1) * h) - max(y * rows, g * h)) for y in range(h)] for g in range(rows)]
        return np.array(wy) @ v @ np.array(wx).T

    a, d, p = small(8, 8), small(9, 8), small(32, 32).astype(float)
    c = np.array([[math.cos((2 * x + 1) * u * math.pi / 64) for x in range(32)] for u in range(8)])
    low = (c @ p @ c.T).flatten()[1:]
    m = np.sort(low)[31]
    number = lambda bits: sum(1 << i for i, b in enumerate(bits) if b)
    return number(low > m), number((d[:, :-1] > d[:, 1:]).flatten()), number((a * 64 > a.sum()).flatten())


def test_three_hashes_of_sides_that_do_not_divide(spark):
    rasters = {"a": noise(256, 256, 1), "b": noise(56, 200, 2), "c": noise(24, 24, 3), "d": noise(8, 16, 4), "flat": np.full((40, 40), 9)}
    got = {r["image_id"]: tuple(x % 2**64 for x in r[1:]) for r in resample.fingerprints(tiles(spark, rasters), ["image_id"]).collect()}
    assert got["flat"][1:] == (0, 0)
    for name, v in rasters.items():
        assert got[name][1:] == brute_hashes(v)[1:]
        assert name == "flat" or got[name][0] == brute_hashes(v)[0]
    assert max(x[1] for x in got.values()) >> 56  # a d_hash has more than 56 bits
    assert resample.fingerprints(tiles(spark, rasters).filter("false"), ["image_id"]).count() == 0


def test_a_batch_of_many_strips_goes_out_in_parts(spark, monkeypatch):
    """What a task held grew with its batch: all tiles of 10,000 strips, as Python numbers."""
    monkeypatch.setattr(resample, "TILES", 4)
    v = {str(k): noise(32, 48, k) for k in range(6)}
    got = arrays(resample.filtered(tiles(spark, v), ["image_id"], lambda row, n: resample.area(n, n)))
    assert all((got[k] == v[k]).all() for k in v)
