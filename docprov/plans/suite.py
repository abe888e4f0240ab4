"""Queries of the robustness suite, and of fingerprints of rasters of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprov.operators import passes, raster, resample
from docprov.operators import suite as op
from docprov.plans.rasters import _COEF, _IMG
from docprov.plans.registry import query
from docprov.sources import files
from docprov.sources import register as reg

_SIDE = 8 * raster.GRID


def _images(s, d):
    return raster.images(reg.tiles(s, d))


def sql_marked(deltas: tuple[int, ...] = op.DELTAS) -> str:
    """mk: image_id, delta, t, old and px, marked at every strength; wa: what each image's mark says."""
    return _COEF + f""", sid AS (SELECT image_id, CAST('0x' || substr(sha256('image:' || image_id), 1, 9) AS BIGINT) AS sid FROM (SELECT DISTINCT image_id FROM img)),
wa AS (SELECT image_id, (sid << 12) | (CAST({reg.SQL_CRC.format(x='sid')} AS BIGINT) << 4) | 1 AS want FROM sid),
of0 AS (SELECT image_id, t, px, hl, lh, CAST(d AS DOUBLE) AS d, CAST(CASE WHEN (want >> CAST(47 - a.bit AS BIGINT)) & 1 = 1 THEN 0.75 ELSE 0.25 END AS DOUBLE) AS oa, a.bit IS NULL AS na, CAST(CASE WHEN (want >> CAST(47 - b.bit AS BIGINT)) & 1 = 1 THEN 0.75 ELSE 0.25 END AS DOUBLE) AS ob, b.bit IS NULL AS nb
  FROM img JOIN hv USING (image_id, t) JOIN wa USING (image_id) LEFT JOIN car a ON a.idx = 2 * t LEFT JOIN car b ON b.idx = 2 * t + 1, (SELECT unnest([{', '.join(map(str, deltas))}]) AS d)),
mv AS (SELECT image_id, t, px, d, CASE WHEN na THEN 0 ELSE d * (floor(hl / d - oa + 0.5) + oa) - hl END AS x, CASE WHEN nb THEN 0 ELSE d * (floor(lh / d - ob + 0.5) + ob) - lh END AS y FROM of0),
mk AS (SELECT image_id, CAST(d AS INTEGER) AS delta, t, px AS old, list_transform(range(64), lambda i: CAST(greatest(0, least(255, floor(px[i + 1] + CASE WHEN i % 8 < 4 THEN x ELSE -x END + CASE WHEN i < 32 THEN y ELSE -y END + 0.5))) AS BIGINT)) AS px FROM mv)"""


def sql_filtered(name: str, values: str, taps: str, total: str, taps_y: str | None = None) -> str:
    """{name}: image_id, delta, attack, x, y, v of values (the same) along both axes by taps (attack, g, x, wt; taps_y: those along
    y, of equal sums); total: attack's sum of weights of an axis."""
    return f""", {name}_h AS (SELECT a.image_id, a.delta, a.attack, a.y, t.g AS x, sum(a.v * t.wt) AS v FROM {values} a JOIN {taps} t ON t.attack = a.attack AND t.x = a.x GROUP BY ALL),
{name}_v AS (SELECT a.image_id, a.delta, a.attack, a.x, t.g AS y, CAST(sum(a.v * t.wt) AS BIGINT) AS v, any_value(s.n * s.n) AS d FROM {name}_h a JOIN {taps_y or taps} t ON t.attack = a.attack AND t.x = a.y JOIN {total} s ON s.attack = a.attack GROUP BY ALL),
{name} AS (SELECT image_id, delta, attack, x, y, CAST(greatest(0, least(255, (2 * v + d) // (2 * d))) AS BIGINT) AS v FROM {name}_v)"""


_TRANSFORM = """, cs AS (SELECT u, x, cos((2 * x + 1) * u * pi() / 16) * CASE WHEN u = 0 THEN sqrt(CAST(1 AS DOUBLE) / 8) ELSE 0.5 END AS c FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS x)),
cc AS (SELECT a.u * 8 + b.u AS k, a.x * 8 + b.x AS p, a.c * b.c AS c FROM cs a, cs b),
fw AS (SELECT list(b ORDER BY k) AS f FROM (SELECT k, list(c ORDER BY p) AS b FROM cc GROUP BY k)),
bw AS (SELECT list(b ORDER BY p) AS r FROM (SELECT p, list(c ORDER BY k) AS b FROM cc GROUP BY p)),
qs AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', {op.quantisers(q)})" for k, q in op.QUALITY.items()) + """) q(attack, st))"""


def sql_compressed(name: str, tiles: str) -> str:
    """{name}: tiles (image_id, delta, attack, t, px) whose transform is rounded by the attack's quantisers."""
    return f""", {name}_f AS (SELECT image_id, delta, attack, t, list_transform(f, lambda b: list_dot_product(list_transform(px, lambda v: CAST(v - 128 AS DOUBLE)), b)) AS cf FROM {tiles}, fw),
{name}_q AS (SELECT image_id, delta, attack, t, list_transform(range(1, 65), lambda i: floor(cf[i] / st[i] + 0.5 + 1e-9) * st[i]) AS rc FROM {name}_f JOIN qs USING (attack)),
{name} AS (SELECT image_id, delta, attack, t, list_transform(r, lambda b: CAST(greatest(0, least(255, floor(list_dot_product(rc, b) + 128.5 + 1e-9))) AS BIGINT)) AS px FROM {name}_q, bw)"""


_SMALL = 8 * (_SIDE // 10)
_FIRST = f""", tp1 AS (SELECT 'Resize 50%' AS attack, * FROM ({resample.sql_area(str(_SIDE), str(_SIDE // 2))}) UNION ALL SELECT 'Crop 20%', * FROM ({resample.sql_linear(str(_SIDE), str((_SIDE + 5) // 10), str((8 * _SIDE + 5) // 10))})
  UNION ALL SELECT 'Gaussian noise', * FROM ({resample.sql_blur(str(_SIDE))}) UNION ALL SELECT 'Screenshot sim', * FROM ({resample.sql_area(str(_SIDE), str(_SMALL))})),
sm1 AS (SELECT attack, sum(wt) AS n FROM tp1 WHERE g = 0 GROUP BY attack),
tp2 AS (SELECT 'Resize 50%' AS attack, * FROM ({resample.sql_linear(str(_SIDE), "0", str(_SIDE // 2))}) UNION ALL SELECT 'Screenshot sim', * FROM ({resample.sql_linear(str(_SIDE), "0", str(_SMALL))})),
sm2 AS (SELECT attack, sum(wt) AS n FROM tp2 WHERE g = 0 GROUP BY attack)"""

_FLAT = ", ".join(f"'{k}'" for k in op.QUALITY if k != "Screenshot sim")
#: rv: image_id, delta, attack and recovered, of every attack.
_SUITE = sql_marked() + _TRANSFORM + _FIRST + f""", jt AS (SELECT image_id, delta, attack, t, px FROM mk, (SELECT unnest([{_FLAT}]) AS attack) WHERE delta = {op.USUAL} OR attack = '{op.CURVE}')""" + sql_compressed("jq", "jt") + f""",
vx AS (SELECT image_id, delta, attack, t % {raster.GRID} * 8 + i % 8 AS x, t // {raster.GRID} * 8 + i // 8 AS y, v FROM (SELECT image_id, delta, t, unnest(px) AS v, unnest(range(64)) AS i FROM mk WHERE delta = {op.USUAL}), (SELECT DISTINCT attack FROM tp1))""" + sql_filtered("st", "vx", "tp1", "sm1") + f""",
bt AS (SELECT image_id, delta, attack, y // 8 * {_SMALL // 8} + x // 8 AS t, list(least(255, (v * 12 + 5) // 10) ORDER BY y % 8, x % 8) AS px FROM st WHERE attack = 'Screenshot sim' GROUP BY ALL)""" + sql_compressed("bq", "bt") + f""",
sv AS (SELECT * FROM st WHERE attack = 'Resize 50%' UNION ALL SELECT image_id, delta, attack, t % {_SMALL // 8} * 8 + i % 8 AS x, t // {_SMALL // 8} * 8 + i // 8 AS y, v FROM (SELECT image_id, delta, attack, t, unnest(px) AS v, unnest(range(64)) AS i FROM bq))""" + sql_filtered("up", "sv", "tp2", "sm2") + f""",
pt AS (SELECT image_id, delta, attack, y // 8 * {raster.GRID} + x // 8 AS t, list(v ORDER BY y % 8, x % 8) AS px FROM (SELECT * FROM up UNION ALL SELECT * FROM st WHERE attack IN ('Crop 20%', 'Gaussian noise')) GROUP BY ALL),
al AS (SELECT image_id, delta, '{op.NONE}' AS attack, t, px FROM mk UNION ALL SELECT * FROM jq UNION ALL SELECT * FROM pt),
ah AS (SELECT image_id, delta, attack, t, list_sum(list_transform(range(64), lambda i: CASE WHEN i % 8 < 4 THEN px[i + 1] ELSE -px[i + 1] END)) / CAST(64 AS DOUBLE) AS hl, list_sum(list_transform(range(64), lambda i: CASE WHEN i < 32 THEN px[i + 1] ELSE -px[i + 1] END)) / CAST(64 AS DOUBLE) AS lh FROM al),
ac AS (SELECT image_id, delta, attack, 2 * t AS idx, hl AS c FROM ah UNION ALL SELECT image_id, delta, attack, 2 * t + 1, lh FROM ah),
av AS (SELECT image_id, delta, attack, bit, sum(CASE WHEN c / delta - floor(c / delta) < 0.5 THEN 0 ELSE 1 END) AS ones, count(*) AS n FROM ac JOIN car USING (idx) GROUP BY ALL),
ap AS (SELECT image_id, delta, attack, CAST(sum(CASE WHEN 2 * ones > n THEN CAST(1 AS BIGINT) << CAST(47 - bit AS BIGINT) ELSE 0 END) AS BIGINT) AS payload FROM av GROUP BY ALL),
rv AS (SELECT image_id, delta, attack, CAST(48 - bit_count(xor(payload, want)) AS INTEGER) AS recovered FROM ap JOIN wa USING (image_id))"""
#: rt: the robustness table.
_TABLE = _SUITE + f""", er AS (SELECT delta, floor(10 * log10(CAST(65025 AS DOUBLE) / (sum(list_sum(list_transform(range(64), lambda i: (px[i + 1] - old[i + 1]) * (px[i + 1] - old[i + 1])))) / CAST(count(*) * 64 AS DOUBLE))) * 100 + 0.5) / 100 AS psnr FROM mk GROUP BY delta),
tg AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in op.TARGETS.items())}) t(attack, target)),
fe AS (SELECT attack, delta, min(recovered) AS bits FROM rv GROUP BY ALL),
rt AS (SELECT 'attack' AS kind, attack AS name, delta, bits, target FROM fe JOIN tg USING (attack) WHERE delta = {op.USUAL} UNION ALL SELECT 'curve', CAST(delta AS VARCHAR), delta, bits, NULL FROM fe WHERE attack = '{op.CURVE}'),
rw AS (SELECT kind, name, delta, bits, psnr, target, bits >= target AS survived FROM rt JOIN er USING (delta))"""


@query("m11_robustness_sweep", _SUITE + " SELECT image_id, delta, attack, recovered FROM rv")
def m11(s, d):
    """Every image's bits recovered after every attack, and at every strength."""
    return op.suite(_images(s, d))


@query("r13_robustness_table", _TABLE + " SELECT * FROM rw")
def r13(s, d):
    """Attacks, each against its own target, and the curve over strengths."""
    return op.table(_images(s, d))


@query("s6_suite_metrics_source", _TABLE + " SELECT 'suite' AS source, kind, name, bits, psnr FROM rw")
def s6(s, d):
    """The robustness table written as one JSON record, and read back as rows."""
    return files.read_metrics(s, files.write_metrics(op.table(_images(s, d))))


@query("s7_suite_metrics_sink", _TABLE + """ SELECT CAST(to_json({'source': 'suite', 'generatedAt': '1970-01-01', 'attacks': list({'name': name, 'survived': survived, 'bitsRecovered': bits, 'psnrDb': psnr, 'target': target} ORDER BY name) FILTER (kind = 'attack'),
  'psnrCurve': list({'delta': delta, 'psnrDb': psnr, 'bitsRecovered': bits} ORDER BY delta) FILTER (kind = 'curve')}) AS VARCHAR) AS value FROM rw""")
def s7(s, d):
    """The text of that record."""
    return s.read.text(files.write_metrics(op.table(_images(s, d))))


#: Marked images as they leak, by image_id % 3: whole; at half the size; at 208 of 256 values a side, and darker by a quarter.
_WORN_SIDES = (_SIDE, _SIDE // 2, 208)


def _sql_sides(taps) -> str:
    return " UNION ALL ".join(f"SELECT 'k{k}' AS attack, * FROM ({taps(n)})" for k, n in enumerate(_WORN_SIDES))


_PASSES = sql_marked((op.USUAL,)) + f""", w1 AS ({_sql_sides(lambda n: resample.sql_area(str(_SIDE), str(n)))}), n1 AS (SELECT attack, sum(wt) AS n FROM w1 WHERE g = 0 GROUP BY attack),
w2 AS ({_sql_sides(lambda n: resample.sql_linear(str(_SIDE), "0", str(n)))}), n2 AS (SELECT attack, sum(wt) AS n FROM w2 WHERE g = 0 GROUP BY attack),
w3 AS ({_sql_sides(lambda n: resample.sql_linear(str(_SIDE), "0", str((n * 55 + 50) // 100)))}),
vx AS (SELECT image_id, delta, 'k' || image_id % 3 AS attack, t % {raster.GRID} * 8 + i % 8 AS x, t // {raster.GRID} * 8 + i // 8 AS y, v FROM (SELECT image_id, delta, t, unnest(px) AS v, unnest(range(64)) AS i FROM mk))""" + sql_filtered("w0", "vx", "w1", "n1") + """,
lk AS (SELECT image_id, delta, attack, x, y, CASE WHEN attack = 'k2' THEN v * 3 // 4 ELSE v END AS v FROM w0)""" + sql_filtered("sc", "lk", "w2", "n2") + sql_filtered("tc", "lk", "w2", "n2", "w3") + f""",
""" + "".join(f"""{n}c AS (SELECT image_id, v, count(*) AS n FROM {t} GROUP BY ALL), {n}h AS (SELECT image_id, CAST(v AS BIGINT) AS v, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY image_id ORDER BY v) AS BIGINT) AS upto FROM (SELECT DISTINCT image_id FROM img) CROSS JOIN (SELECT unnest(range(256)) AS v) LEFT JOIN {n}c USING (image_id, v)),
""" for n, t in (("a", "sc"), ("b", "vx"))) + f"""lu AS (SELECT a.image_id, a.v, least(min(b.v), 255) AS u FROM ah a JOIN bh b ON b.image_id = a.image_id AND b.upto >= a.upto GROUP BY ALL),
pv AS (SELECT image_id, 'direct' AS pass, 2 * (s // 8) * (s // 8) AS n, y // 8 * (s // 8) + x // 8 AS t, x, y, v FROM lk JOIN (VALUES {", ".join(f"('k{k}', {n})" for k, n in enumerate(_WORN_SIDES))}) z(attack, s) USING (attack)
  UNION ALL SELECT image_id, 'scaled', 2048, y // 8 * 32 + x // 8, x, y, v FROM sc UNION ALL SELECT image_id, 'tones', 2048, y // 8 * 32 + x // 8, x, y, u FROM sc JOIN lu USING (image_id, v)
  UNION ALL SELECT image_id, 'topcrop', 2048, y // 8 * 32 + x // 8, x, y, v FROM tc),
ph AS (SELECT image_id, pass, n, t, sum(CASE WHEN x % 8 < 4 THEN v ELSE -v END) / CAST(64 AS DOUBLE) AS hl, sum(CASE WHEN y % 8 < 4 THEN v ELSE -v END) / CAST(64 AS DOUBLE) AS lh FROM pv GROUP BY ALL),
pc AS (SELECT image_id, pass, n, 2 * t AS idx, hl AS c FROM ph UNION ALL SELECT image_id, pass, n, 2 * t + 1, lh FROM ph),
cz AS (SELECT n, idx, place // least(21, n // 48) AS bit FROM (SELECT n, idx, row_number() OVER (PARTITION BY n ORDER BY sha256('mark:' || idx)) - 1 AS place FROM (SELECT n, unnest(range(n)) AS idx FROM (SELECT DISTINCT n FROM pv))) WHERE place < 48 * least(21, n // 48)),
vo AS (SELECT image_id, pass, d AS delta, bit, sum(CASE WHEN c / d - floor(c / d) < 0.5 THEN 0 ELSE 1 END) AS ones, count(*) AS n FROM pc JOIN cz USING (n, idx), (SELECT unnest([8, 12, 14, 16]) AS d) GROUP BY ALL),
ma AS (SELECT image_id, pass, delta, CAST(sum(CASE WHEN 2 * ones > n THEN CAST(1 AS BIGINT) << CAST(47 - bit AS BIGINT) ELSE 0 END) AS BIGINT) AS payload, floor((sum(greatest(ones, n - ones) / CAST(n AS DOUBLE)) + (48 - count(*)) * 0.5) / 48 * 1000000 + 0.5) / 1000000 AS confidence FROM vo GROUP BY image_id, pass, delta)"""


def _leaked(s, d):
    """(leaks, released): see _WORN_SIDES."""
    marked = files.written(raster.embed(_images(s, d), raster.payload_for(F.col("image_id")), op.USUAL), "released")
    rows = resample.sized(marked, _SIDE, _SIDE)

    def smaller(row: dict, n: int) -> resample.Taps:
        return resample.area(n, _WORN_SIDES[row["image_id"] % 3])

    worn = resample.filtered(rows, ["image_id"], smaller)
    darker = F.when(F.col("image_id") % 3 == 2, F.transform("px", lambda v: F.floor(v * 3 / 4).cast("int"))).otherwise(F.col("px"))
    return files.written(worn.withColumn("px", darker), "leaks"), marked


@query("m6_strength_passes", _PASSES + reg.SQL_REPAIR + " SELECT image_id, pass, delta, payload, confidence, corrected FROM re")
def m6_passes(s, d):
    """Leaks of three sizes, one of them darkened, read in all four passes at all four strengths, repaired."""
    return passes.read(*_leaked(s, d))


@query("w7_permutation_by_size", """, sz AS (SELECT tile_id % 97 + 24 AS n, count(*) AS rasters FROM tiles GROUP BY 1)
SELECT n, idx, place // least(21, n // 48) AS bit, rasters FROM (SELECT n, rasters, idx, row_number() OVER (PARTITION BY n ORDER BY sha256('mark:' || idx)) - 1 AS place FROM (SELECT n, rasters, unnest(range(n)) AS idx FROM sz)) WHERE n >= 48 AND place < 48 * least(21, n // 48)""")
def w7_sizes(s, d):
    """Carriers of rasters of many sizes, a permutation for each number of coefficients."""
    sizes = reg.tiles(s, d).groupBy((F.col("tile_id") % 97 + 24).alias("n")).agg(F.count("*").alias("rasters"))
    return raster.carriers_by_size(sizes).join(sizes, "n").select("n", "idx", "bit", "rasters")


#: Rasters of the tile table's images cut to 24 to 32 tiles a side, by their number: few of these sides divide.
_CUT = _IMG + """, sz AS (SELECT image_id, 8 * (32 - image_id % 9) AS w, 8 * (24 + image_id * 5 % 9) AS h FROM (SELECT DISTINCT image_id FROM img)),
cv AS (SELECT image_id, w, h, x, y, v FROM (SELECT image_id, t % 32 * 8 + i % 8 AS x, t // 32 * 8 + i // 8 AS y, v FROM (SELECT image_id, t, unnest(px) AS v, unnest(range(64)) AS i FROM img)) JOIN sz USING (image_id) WHERE x < w AND y < h)"""


def _sql_shares(name: str, columns: int, rows: int) -> str:
    def axis(side: str, n: int) -> str:
        over = f"least((p + 1) * {n}, (g + 1) * {side}) - greatest(p * {n}, g * {side})"
        return f"SELECT n AS {side}, g, p, {over.replace(side, 'n')} AS wt FROM (SELECT DISTINCT {side} AS n FROM sz), (SELECT unnest(range({n})) AS g), (SELECT unnest(range({_SIDE})) AS p) WHERE {over.replace(side, 'n')} > 0 AND p < n"

    return f""", {name}_c AS ({axis('w', columns)}), {name}_r AS ({axis('h', rows)}),
{name}_1 AS (SELECT image_id, cv.h, y, g AS gx, sum(v * wt) AS v FROM cv JOIN {name}_c k ON k.w = cv.w AND k.p = cv.x GROUP BY ALL),
{name}_2 AS (SELECT image_id, g * {columns} + gx AS cell, CAST(sum(v * wt) AS BIGINT) AS v FROM {name}_1 a JOIN {name}_r k ON k.h = a.h AND k.p = a.y GROUP BY ALL),
{name} AS (SELECT image_id, list(v ORDER BY cell) AS px FROM {name}_2 GROUP BY image_id)"""


_BIT = "CASE WHEN {i} = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST({i} % 63 AS BIGINT) END"


def _sql_number(of: str, on: str) -> str:
    return f"CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN {on} THEN CAST({_BIT.format(i='i')} AS HUGEINT) ELSE 0 END)) AS BIGINT) AS {of}"


_D_HASH = _sql_number("d_hash", "px[CAST(i // 8 * 9 + i % 8 + 1 AS BIGINT)] > px[CAST(i // 8 * 9 + i % 8 + 2 AS BIGINT)]")
_PRINTS = _CUT + _sql_shares("sp", 32, 32) + _sql_shares("sd", 9, 8) + _sql_shares("sa", 8, 8) + f""", basis AS (SELECT CAST(u * 8 + v AS INTEGER) AS k, y * 32 + x AS cell, cos((2 * y + 1) * u * pi() / 64) * cos((2 * x + 1) * v * pi() / 64) AS w
  FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS v), (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x) WHERE u + v > 0),
cf AS (SELECT image_id, k, sum(v * w) AS c FROM sp_2 JOIN basis USING (cell) GROUP BY image_id, k),
md AS (SELECT image_id, c AS m FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c) AS n FROM cf) WHERE n = 32),
hp AS (SELECT image_id, CAST(sum(CASE WHEN c > m THEN CAST(1 AS BIGINT) << (k - 1) ELSE 0 END) AS BIGINT) AS p_hash FROM cf JOIN md USING (image_id) GROUP BY image_id),
hd AS (SELECT image_id, {_D_HASH} FROM sd),
ha AS (SELECT image_id, {_sql_number("a_hash", "px[i + 1] * 64 > list_sum(px)")} FROM sa)"""


def _cut(s, d):
    n = F.col("image_id")
    tx, ty = F.col("t") % raster.GRID, F.floor(F.col("t") / raster.GRID).cast("int")
    w, h = (32 - n % 9).cast("int"), (24 + n * 5 % 9).cast("int")
    rows = _images(s, d).select("image_id", (w * 8).alias("w"), (h * 8).alias("h"), (ty * w + tx).cast("int").alias("t"), "px", tx.alias("tx"), ty.alias("ty"), w.alias("c"), h.alias("r"))
    return rows.filter("tx < c AND ty < r").select("image_id", "w", "h", "t", "px")


@query("m1_fingerprint_table", _PRINTS + " SELECT image_id, p_hash, d_hash, a_hash FROM hp JOIN hd USING (image_id) JOIN ha USING (image_id)")
def m1(s, d):
    """Three hashes of 64 bits for each raster, of sides that don't divide."""
    return resample.fingerprints(_cut(s, d), ["image_id"])


@query("x20_d_hash", _CUT + _sql_shares("sd", 9, 8) + f" SELECT image_id, {_D_HASH} FROM sd")
def x20(s, d):
    """The difference hash of 9 by 8 shares: 64 bits."""
    return resample.fingerprints(_cut(s, d), ["image_id"]).select("image_id", "d_hash")
