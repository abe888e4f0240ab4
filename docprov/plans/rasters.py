"""Queries over tile tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.operators import raster as op
from docprov.plans.registry import query
from docprov.sources import register as reg
from docprov.sources.files import written

#: The tile table as SQL: images of 1024 tiles, half-tile differences, carriers and votes.
_IMG = """, cnt AS (SELECT count(*) AS n FROM tiles), img AS (
  SELECT image_id, t, px FROM (SELECT image_id, t, (t * 7 + image_id * 100) % n AS tile_id FROM (SELECT unnest(range(CAST(ceil(n / 100.0) AS BIGINT))) AS image_id, n FROM cnt), (SELECT unnest(range(1024)) AS t)) JOIN tiles USING (tile_id))"""
_COEF = _IMG + """, hv AS (SELECT image_id, t, list_sum(list_transform(range(64), lambda i: CASE WHEN i % 8 < 4 THEN px[i + 1] ELSE -px[i + 1] END)) / CAST(64 AS DOUBLE) AS hl,
  list_sum(list_transform(range(64), lambda i: CASE WHEN i < 32 THEN px[i + 1] ELSE -px[i + 1] END)) / CAST(64 AS DOUBLE) AS lh FROM img),
co AS (SELECT image_id, t, 2 * t AS idx, hl AS c FROM hv UNION ALL SELECT image_id, t, 2 * t + 1, lh FROM hv),
car AS (SELECT idx, place // 21 AS bit FROM (SELECT idx, row_number() OVER (ORDER BY sha256('mark:' || idx)) - 1 AS place FROM (SELECT unnest(range(2048)) AS idx)) WHERE place < 1008)"""


def _votes(where: str = "true", delta: str = "12") -> str:
    return _COEF + f""", vo AS (SELECT image_id, {delta} AS delta, bit, sum(CASE WHEN c / {delta} - floor(c / {delta}) < 0.5 THEN 0 ELSE 1 END) AS ones, count(*) AS n FROM co JOIN car USING (idx){' , (SELECT unnest([8, 12, 14, 16]) AS d)' if delta != '12' else ''} WHERE {where} GROUP BY ALL),
ma AS (SELECT image_id, delta, CAST(sum(CASE WHEN 2 * ones > n THEN CAST(1 AS BIGINT) << CAST(47 - bit AS BIGINT) ELSE 0 END) AS BIGINT) AS payload, floor((sum(greatest(ones, n - ones) / CAST(n AS DOUBLE)) + (48 - count(*)) * 0.5) / 48 * 1000000 + 0.5) / 1000000 AS confidence FROM vo GROUP BY image_id, delta)"""


def _images(s, d):
    return op.images(reg.tiles(s, d))


@query("x19_a_hash", "SELECT tile_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(64), lambda i: CASE WHEN px[i + 1] * 64 > list_sum(px) THEN CAST(1 AS BIGINT) << CAST(i % 63 AS BIGINT) ELSE 0 END)[:63]), lambda a, b: a | b) AS BIGINT) AS low63, px[64] * 64 > list_sum(px) AS top FROM tiles")
def x19(s, d):
    h = op.a_hash(F.col("px"))
    return reg.tiles(s, d).select("tile_id", h.alias("h")).select("tile_id", F.col("h").bitwiseAND(F.lit(2**63 - 1)).alias("low63"), (F.col("h") < 0).alias("top"))


@query("x21_p_hash", _IMG + """, basis AS (SELECT CAST(u * 8 + v AS INTEGER) AS k, y * 32 + x AS t, cos((2 * y + 1) * u * pi() / 64) * cos((2 * x + 1) * v * pi() / 64) AS w
  FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS v), (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x) WHERE u + v > 0),
cf AS (SELECT image_id, k, sum(list_sum(px) * w) AS c FROM img JOIN basis USING (t) GROUP BY image_id, k),
md AS (SELECT image_id, c AS m FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c) AS n FROM cf) WHERE n = 32)
SELECT image_id, CAST(sum(CASE WHEN c > m THEN CAST(1 AS BIGINT) << (k - 1) ELSE 0 END) AS BIGINT) AS p_hash FROM cf JOIN md USING (image_id) GROUP BY image_id""")
def x21(s, d):
    return op.p_hash(_images(s, d))


@query("x22_luma", ", " + reg.SQL_PLANES + " SELECT tile_id, CAST(list_sum(list_transform(range(64), lambda i: floor((r[i + 1] * CAST(0.299 AS DOUBLE) + g[i + 1] * CAST(0.587 AS DOUBLE) + b[i + 1] * CAST(0.114 AS DOUBLE)) * 1000 + 0.5) * (i + 1))) AS BIGINT) AS digest FROM planes")
def x22(s, d):
    """The luma of every value of three planes, as a sum weighted by place."""
    y = F.transform("r", lambda v, i: bits.half_up(op.luma(v, F.col("g")[i], F.col("b")[i]) * 1000) * (i + 1))
    return reg.planes(s, d).select("tile_id", F.aggregate(y, F.lit(0.0), lambda acc, x: acc + x).cast("long").alias("digest"))


@query("x23_haar_level_3", _COEF + " SELECT image_id, t, hl, lh FROM hv")
def x23(s, d):
    hl, lh = op.haar(F.col("px"))
    return _images(s, d).select("image_id", "t", hl.alias("hl"), lh.alias("lh"))


@query("x24_qim", _COEF + ", q AS (SELECT image_id, idx, c, 12 * (floor(c / 12 - 0.25 + 0.5) + 0.25) AS zero, 12 * (floor(c / 12 - 0.75 + 0.5) + 0.75) AS one FROM co) SELECT image_id, idx, zero, one, CASE WHEN zero / 12 - floor(zero / 12) < 0.5 THEN 0 ELSE 1 END AS read0, CASE WHEN one / 12 - floor(one / 12) < 0.5 THEN 0 ELSE 1 END AS read1 FROM q")
def x24(s, d):
    step, c = F.lit(12.0), F.col("c")
    q = op.coefficients(_images(s, d)).select("image_id", "idx", op.qim(c, step, F.lit(0)).alias("zero"), op.qim(c, step, F.lit(1)).alias("one"))
    return q.select("*", op.qim_read(F.col("zero"), step).alias("read0"), op.qim_read(F.col("one"), step).alias("read1"))


@query("x28_block_digest", _IMG + " SELECT image_id, t, sha256('key|' || image_id || '|' || t || '|' || array_to_string(list_transform(px, lambda v: v - v % 2), ',')) AS digest FROM img")
def x28(s, d):
    return _images(s, d).select("image_id", "t", op.block_digest(F.col("px"), F.col("image_id"), F.col("t")).alias("digest"))


@query("w7_keyed_permutation", _COEF + " SELECT idx, CAST(bit AS INTEGER) AS bit, (SELECT count(*) FROM img WHERE t = idx // 2) AS images FROM car")
def w7(s, d):
    n = _images(s, d).groupBy("t").agg(F.count("*").alias("images"))
    return op.carriers(s).join(n, F.floor(F.col("idx") / 2) == F.col("t")).select("idx", "bit", "images")


@query("r8_majority_vote", _votes() + " SELECT image_id, CAST(bit AS INTEGER) AS bit, CASE WHEN ones * 2 > n THEN 1 ELSE 0 END AS v, greatest(ones, n - ones) AS most FROM vo")
def r8(s, d):
    votes = op.coefficients(_images(s, d)).join(F.broadcast(op.carriers(s)), "idx").groupBy("image_id", "bit").agg(F.sum(op.qim_read(F.col("c"), F.lit(12.0))).alias("ones"), F.count("*").alias("n"))
    return votes.select("image_id", "bit", (F.col("ones") * 2 > F.col("n")).cast("int").alias("v"), F.greatest("ones", F.col("n") - F.col("ones")).alias("most"))


@query("m3_robust_extract", _votes() + " SELECT image_id, payload, confidence FROM ma")
def m3(s, d):
    return op.extract(_images(s, d))


@query("m4_partial_view_extract", _votes("t % 32 BETWEEN 4 AND 20 AND t // 32 BETWEEN 3 AND 9") + " SELECT image_id, payload, confidence FROM ma")
def m4(s, d):
    inside = (F.col("t") % 32).between(4, 20) & F.floor(F.col("t") / 32).between(3, 9)
    return op.extract(_images(s, d).filter(inside))


@query("m6_strength_sweep", _votes(delta="d") + " SELECT image_id, delta, payload, confidence FROM ma")
def m6(s, d):
    swept = _images(s, d).withColumn("delta", F.explode(F.array(*map(F.lit, (8, 12, 14, 16)))))
    return op.extract(swept, F.col("delta").cast("double"))


@query("r21_release_inspection", _votes() + f""", w AS (SELECT *, CAST('0x' || substr(sha256('image:' || image_id), 1, 9) AS BIGINT) AS sid FROM ma),
x AS (SELECT image_id, payload, (sid << 12) | (CAST({reg.SQL_CRC.format(x='sid')} AS BIGINT) << 4) | 1 AS want FROM w)
SELECT image_id, CAST({reg.SQL_CRC.format(x='(payload >> 12)')} AS BIGINT) = ((payload >> 4) & 255) AND bit_count(payload) BETWEEN 7 AND 41 AND (payload >> 12) NOT IN (0, 68719476735) AS crc_ok, 48 - bit_count(xor(payload, want)) AS matching, 48 AS total, CAST(floor((48 - bit_count(xor(payload, want))) / CAST(48 AS DOUBLE) * 100 + 0.5) AS BIGINT) AS pct, payload = want AS intact FROM x""")
def r21(s, d):
    read = op.held(op.extract(_images(s, d)).select("image_id", "payload", op.payload_for(F.col("image_id")).alias("want")))
    m = bits.matching(F.col("payload"), F.col("want"))
    return read.select("image_id", bits.crc_ok(F.col("payload")).alias("crc_ok"), m.alias("matching"), F.lit(48).alias("total"), bits.half_up(m / 48 * 100).cast("long").alias("pct"), (F.col("payload") == F.col("want")).alias("intact"))


_FIX = reg.SQL_REPAIR


@query("m3_repaired_extract", _votes() + _FIX + " SELECT image_id, payload, confidence, corrected FROM re")
def m3_repaired(s, d):
    return op.read_mark(_images(s, d))


@query("m4_repaired_extract", _votes("t % 32 BETWEEN 4 AND 20 AND t // 32 BETWEEN 3 AND 9") + _FIX + " SELECT image_id, payload, confidence, corrected FROM re")
def m4_repaired(s, d):
    inside = (F.col("t") % 32).between(4, 20) & F.floor(F.col("t") / 32).between(3, 9)
    return op.read_mark(_images(s, d).filter(inside))


@query("m6_repaired_sweep", _votes(delta="d") + _FIX + " SELECT image_id, delta, payload, confidence, corrected FROM re")
def m6_repaired(s, d):
    swept = _images(s, d).withColumn("delta", F.explode(F.array(*map(F.lit, (8, 12, 14, 16)))))
    return op.read_mark(swept, F.col("delta").cast("double"))


@query("r21_repaired_inspection", _votes() + _FIX + f""", w AS (SELECT *, CAST('0x' || substr(sha256('image:' || image_id), 1, 9) AS BIGINT) AS sid FROM re),
x AS (SELECT image_id, payload, corrected, (sid << 12) | (CAST({reg.SQL_CRC.format(x='sid')} AS BIGINT) << 4) | 1 AS want FROM w)
SELECT image_id, corrected, 48 - bit_count(xor(payload, want)) AS matching, payload = want AS intact FROM x""")
def r21_repaired(s, d):
    read = op.read_mark(_images(s, d)).withColumn("want", op.payload_for(F.col("image_id")))
    return read.select("image_id", "corrected", bits.matching(F.col("payload"), F.col("want")).alias("matching"), (F.col("payload") == F.col("want")).alias("intact"))


def _sql_reading(table: str, keys: str = "image_id") -> str:
    """ma2: payload and confidence for each of the keys of a table (keys, t, px), at strength 12."""
    return f""", hv2 AS (SELECT {keys}, t, list_sum(list_transform(range(64), lambda i: CASE WHEN i % 8 < 4 THEN px[i + 1] ELSE -px[i + 1] END)) / CAST(64 AS DOUBLE) AS hl,
  list_sum(list_transform(range(64), lambda i: CASE WHEN i < 32 THEN px[i + 1] ELSE -px[i + 1] END)) / CAST(64 AS DOUBLE) AS lh FROM {table}),
co2 AS (SELECT {keys}, 2 * t AS idx, hl AS c FROM hv2 UNION ALL SELECT {keys}, 2 * t + 1, lh FROM hv2),
vo2 AS (SELECT {keys}, bit, sum(CASE WHEN c / 12 - floor(c / 12) < 0.5 THEN 0 ELSE 1 END) AS ones, count(*) AS n FROM co2 JOIN car USING (idx) GROUP BY ALL),
ma2 AS (SELECT {keys}, CAST(sum(CASE WHEN 2 * ones > n THEN CAST(1 AS BIGINT) << CAST(47 - bit AS BIGINT) ELSE 0 END) AS BIGINT) AS payload, floor((sum(greatest(ones, n - ones) / CAST(n AS DOUBLE)) + (48 - count(*)) * 0.5) / 48 * 1000000 + 0.5) / 1000000 AS confidence FROM vo2 GROUP BY {keys})"""


def _sql_turned(table: str) -> str:
    """Rows (image_id, turn, t, px) of a table of those, turned by so many quarters."""

    def quarter(i: str, side: int, turn: str) -> str:
        m = side - 1
        return f"CASE {turn} WHEN 0 THEN {i} WHEN 1 THEN ({m} - {i} % {side}) * {side} + {i} // {side} WHEN 2 THEN ({m} - {i} // {side}) * {side} + {m} - {i} % {side} ELSE {i} % {side} * {side} + {m} - {i} // {side} END"

    return f"SELECT image_id, turn, {quarter('t', 32, '(4 - turn) % 4')} AS t, list_transform(range(64), lambda i: px[CAST({quarter('i', 8, 'turn')} AS BIGINT) + 1]) AS px FROM {table}"


_EMBED = _COEF + f""", sid AS (SELECT image_id, CAST('0x' || substr(sha256('image:' || image_id), 1, 9) AS BIGINT) AS sid FROM (SELECT DISTINCT image_id FROM img)),
wa AS (SELECT image_id, (sid << 12) | (CAST({reg.SQL_CRC.format(x='sid')} AS BIGINT) << 4) | 1 AS want FROM sid),
off0 AS (SELECT image_id, t, px, hl, lh, CASE WHEN (want >> CAST(47 - a.bit AS BIGINT)) & 1 = 1 THEN 0.75 ELSE 0.25 END AS oa, a.bit IS NULL AS na, CASE WHEN (want >> CAST(47 - b.bit AS BIGINT)) & 1 = 1 THEN 0.75 ELSE 0.25 END AS ob, b.bit IS NULL AS nb
  FROM img JOIN hv USING (image_id, t) JOIN wa USING (image_id) LEFT JOIN car a ON a.idx = 2 * t LEFT JOIN car b ON b.idx = 2 * t + 1),
mv AS (SELECT image_id, t, px, CASE WHEN na THEN 0 ELSE 12 * (floor(hl / 12 - CAST(oa AS DOUBLE) + 0.5) + CAST(oa AS DOUBLE)) - hl END AS x, CASE WHEN nb THEN 0 ELSE 12 * (floor(lh / 12 - CAST(ob AS DOUBLE) + 0.5) + CAST(ob AS DOUBLE)) - lh END AS y FROM off0),
mk AS (SELECT image_id, t, px AS old, list_transform(range(64), lambda i: CAST(greatest(0, least(255, floor(px[i + 1] + CASE WHEN i % 8 < 4 THEN x ELSE -x END + CASE WHEN i < 32 THEN y ELSE -y END + 0.5))) AS BIGINT)) AS px FROM mv)"""


@query("m2_robust_embed", _EMBED + _sql_reading("mk") + """, e AS (SELECT image_id, sum(list_sum(list_transform(range(64), lambda i: (px[i + 1] - old[i + 1]) * (px[i + 1] - old[i + 1])))) AS sse, count(*) * 64 AS n FROM mk GROUP BY image_id)
SELECT image_id, 48 - bit_count(xor(payload, want)) AS recovered, floor(10 * log10(CAST(65025 AS DOUBLE) / (sse / CAST(n AS DOUBLE))) * 100 + 0.5) / 100 AS psnr FROM ma2 JOIN wa USING (image_id) JOIN e USING (image_id)""")
def m2(s, d):
    """Marks embedded and read back: bits recovered and PSNR of every image."""
    image = _images(s, d)
    marked = op.embed(image, op.payload_for(F.col("image_id")))
    error = op.squared_error(image, marked, ["image_id"])
    read = op.extract(marked)
    return read.join(error, "image_id").select("image_id", bits.matching(F.col("payload"), op.payload_for(F.col("image_id"))).alias("recovered"), bits.half_up(op.psnr(F.col("sse"), F.col("n")), 2).alias("psnr"))


@query("m5_four_orientations", _EMBED + f""", once AS ({_sql_turned("(SELECT *, image_id % 4 AS turn FROM mk)")}),
four AS ({_sql_turned("(SELECT image_id, t, px, k.turn FROM once, (SELECT unnest(range(4)) AS turn) k)")})""" + _sql_reading("four", "image_id, turn") + ", ma AS (SELECT * FROM ma2)" + _FIX + f""",
rd AS (SELECT *, CAST({reg.SQL_CRC.format(x="(payload >> 12)")} AS BIGINT) = ((payload >> 4) & 255) AND bit_count(payload) BETWEEN 7 AND 41 AND (payload >> 12) NOT IN (0, 68719476735) AS ok FROM re),
pk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ok DESC, confidence DESC, turn) AS place FROM rd)
SELECT image_id, turn, ok, 48 - bit_count(xor(payload, want)) AS recovered FROM pk JOIN wa USING (image_id) WHERE place = 1""")
def m5(s, d):
    """Marked images turned by image_id quarters, and read in all four orientations."""
    marked = op.embed(_images(s, d), op.payload_for(F.col("image_id")))
    worn = op.turned(marked).filter(F.col("turn") == F.col("image_id") % 4).select("image_id", "t", "px")
    return op.best_turn(worn).select("image_id", "turn", "ok", bits.matching(F.col("payload"), op.payload_for(F.col("image_id"))).alias("recovered"))


def _sql_coarse(name: str, values: str) -> str:
    """Tables {name}_c, the image at a third of the size from values (image_id, x, y, v), and {name}_p, the payload read there."""
    return f""", {name}_c AS (SELECT image_id, gx, gy, CAST(floor(avg(v) + 0.5) AS INTEGER) AS v FROM (SELECT image_id, x // 3 AS gx, y // 3 AS gy, v FROM {values}) WHERE gx < 80 AND gy < 80 GROUP BY image_id, gx, gy),
{name}_h AS (SELECT image_id, gy // 8 * 10 + gx // 8 AS t, sum(CASE WHEN gx % 8 < 4 THEN v ELSE -v END) / CAST(64 AS DOUBLE) AS hl, sum(CASE WHEN gy % 8 < 4 THEN v ELSE -v END) / CAST(64 AS DOUBLE) AS lh FROM {name}_c GROUP BY ALL),
{name}_v AS (SELECT image_id, bit, sum(CASE WHEN c / 8 - floor(c / 8) < 0.5 THEN 0 ELSE 1 END) AS ones, count(*) AS n FROM (SELECT image_id, 2 * t AS idx, hl AS c FROM {name}_h UNION ALL SELECT image_id, 2 * t + 1, lh FROM {name}_h) JOIN pc USING (idx) GROUP BY image_id, bit),
{name}_p AS (SELECT image_id, CAST(sum(CASE WHEN 2 * ones > n THEN CAST(1 AS BIGINT) << CAST(47 - bit AS BIGINT) ELSE 0 END) AS BIGINT) AS payload FROM {name}_v GROUP BY image_id)"""


_PAGE = _IMG + f""", pc AS (SELECT idx, place // 4 AS bit FROM (SELECT idx, row_number() OVER (ORDER BY sha256('page:' || idx)) - 1 AS place FROM (SELECT unnest(range(200)) AS idx)) WHERE place < 192),
sid AS (SELECT image_id, CAST('0x' || substr(sha256('image:' || image_id), 1, 9) AS BIGINT) AS sid FROM (SELECT DISTINCT image_id FROM img)),
wa AS (SELECT image_id, (sid << 12) | (CAST({reg.SQL_CRC.format(x='sid')} AS BIGINT) << 4) | 1 AS want FROM sid),
vx AS (SELECT image_id, t % 32 * 8 + i % 8 AS x, t // 32 * 8 + i // 8 AS y, v FROM (SELECT image_id, t, unnest(px) AS v, unnest(range(64)) AS i FROM img))""" + _sql_coarse("a", "vx") + """,
off0 AS (SELECT image_id, t, hl, lh, CAST(CASE WHEN (want >> CAST(47 - k.bit AS BIGINT)) & 1 = 1 THEN 0.75 ELSE 0.25 END AS DOUBLE) AS ok, k.bit IS NULL AS nk, CAST(CASE WHEN (want >> CAST(47 - m.bit AS BIGINT)) & 1 = 1 THEN 0.75 ELSE 0.25 END AS DOUBLE) AS om, m.bit IS NULL AS nm
  FROM a_h JOIN wa USING (image_id) LEFT JOIN pc k ON k.idx = 2 * t LEFT JOIN pc m ON m.idx = 2 * t + 1),
mv AS (SELECT image_id, t, CASE WHEN nk THEN 0 ELSE 8 * (floor(hl / 8 - ok + 0.5) + ok) - hl END AS p, CASE WHEN nm THEN 0 ELSE 8 * (floor(lh / 8 - om + 0.5) + om) - lh END AS q FROM off0),
ad AS (SELECT image_id, gx, gy, greatest(0, least(255, floor(v + CASE WHEN gx % 8 < 4 THEN p ELSE -p END + CASE WHEN gy % 8 < 4 THEN q ELSE -q END + 0.5))) - v AS added FROM a_c JOIN mv USING (image_id) WHERE mv.t = gy // 8 * 10 + gx // 8),
vy AS (SELECT vx.image_id, x, y, vx.v AS old, CAST(greatest(0, least(255, vx.v + coalesce(added, 0))) AS INTEGER) AS v FROM vx LEFT JOIN ad ON ad.image_id = vx.image_id AND gx = x // 3 AND gy = y // 3)""" + _sql_coarse("b", "vy") + """,
e AS (SELECT image_id, sum((v - old) * (v - old)) AS sse, count(*) AS n FROM vy GROUP BY image_id)"""


@query("m7_coarse_page_mark", _PAGE + " SELECT image_id, 48 - bit_count(xor(b_p.payload, want)) AS recovered, 48 - bit_count(xor(a_p.payload, want)) AS unmarked, floor(10 * log10(CAST(65025 AS DOUBLE) / (sse / CAST(n AS DOUBLE))) * 100 + 0.5) / 100 AS psnr FROM a_p JOIN b_p USING (image_id) JOIN wa USING (image_id) JOIN e USING (image_id)")
def m7(s, d):
    """Page marks embedded at a third of the size and read there: bits recovered from the marked page, from the unmarked one, and
    the page's PSNR."""
    image, want = _images(s, d), op.payload_for(F.col("image_id"))
    marked = written(op.embed_coarse(image, want), "pages")
    error = op.squared_error(image, marked, ["image_id"])
    found = [op.extract_coarse(i).select("image_id", bits.matching(F.col("payload"), want).alias(n)) for i, n in ((marked, "recovered"), (image, "unmarked"))]
    return found[0].join(found[1], "image_id").join(error, "image_id").select("image_id", "recovered", "unmarked", bits.half_up(op.psnr(F.col("sse"), F.col("n")), 2).alias("psnr"))


_ERR = _IMG + ", er AS (SELECT a.image_id, sum(list_sum(list_transform(range(64), lambda i: (a.px[i + 1] - b.px[i + 1]) * (a.px[i + 1] - b.px[i + 1])))) AS sse, count(*) * 64 AS n FROM img a JOIN img b ON b.image_id = a.image_id + 1 AND b.t = a.t GROUP BY a.image_id)"


def _next_error(s, d):
    image = _images(s, d)
    return op.squared_error(image, image.withColumn("image_id", F.col("image_id") - 1), ["image_id"])


@query("r10_psnr", _ERR + " SELECT image_id, floor(10 * log10(CAST(65025 AS DOUBLE) / (sse / CAST(n AS DOUBLE))) * 1000000 + 0.5) / 1000000 AS psnr FROM er")
def r10(s, d):
    return _next_error(s, d).select("image_id", bits.half_up(op.psnr(F.col("sse"), F.col("n")), 6).alias("psnr"))


#: Documents of three pages against their next ones: the last document's have a page less to compare.
_POOLED = _ERR + """, pg AS (SELECT image_id // 3 AS doc, count(*) AS has FROM (SELECT DISTINCT image_id FROM img) GROUP BY ALL),
po AS (SELECT image_id // 3 AS doc, count(*) AS pages, sum(sse) AS sse, sum(n) AS n FROM er GROUP BY ALL),
pl AS (SELECT doc, coalesce(pages, 0) AS pages, CASE WHEN pages = has THEN floor(10 * log10(CAST(65025 AS DOUBLE) * CAST(n AS DOUBLE) / greatest(CAST(sse AS DOUBLE), 1)) * 1000000 + 0.5) / 1000000 END AS psnr FROM pg LEFT JOIN po USING (doc))"""


def pooled(s, d):
    """doc, pages and psnr of all documents: null where a page has no partner."""
    image = _images(s, d)
    has = image.select(F.floor(F.col("image_id") / 3).alias("doc"), "image_id").distinct().groupBy("doc").agg(F.count("*").alias("has"))
    return op.pooled_psnr(_next_error(s, d).withColumn("doc", F.floor(F.col("image_id") / 3)), has)


@query("r11_pooled_psnr", _POOLED + " SELECT doc, pages, psnr FROM pl")
def r11(s, d):
    return pooled(s, d)


_HIST = _IMG + """, cn AS (SELECT image_id, v, count(*) AS n FROM (SELECT image_id, unnest(px) AS v FROM img) GROUP BY ALL),
hi AS (SELECT image_id, CAST(v AS INTEGER) AS v, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY image_id ORDER BY v) AS BIGINT) AS upto FROM (SELECT DISTINCT image_id FROM img) CROSS JOIN (SELECT unnest(range(256)) AS v) LEFT JOIN cn USING (image_id, v))"""


@query("r14_histogram_cdf", _HIST + " SELECT * FROM hi")
def r14(s, d):
    return op.histogram(_images(s, d))


@query("w9_tone_lut", _HIST + " SELECT h.image_id, h.v, least(min(r.v), 255) AS \"to\" FROM hi h JOIN hi r ON r.image_id = 0 AND r.upto >= h.upto GROUP BY ALL")
def w9(s, d):
    return op.tone_table(op.histogram(_images(s, d)))


@query("m10_tone_match", _HIST + ", lu AS (SELECT h.image_id, h.v, least(min(r.v), 255) AS w FROM hi h JOIN hi r ON r.image_id = 0 AND r.upto >= h.upto GROUP BY ALL) SELECT image_id, t, CAST(sum(w * i) AS BIGINT) AS digest FROM (SELECT image_id, t, unnest(px) AS v, unnest(range(1, 65)) AS i FROM img) JOIN lu USING (image_id, v) GROUP BY image_id, t")
def m10(s, d):
    out = op.tone_match(_images(s, d))
    return out.select("image_id", "t", F.aggregate(F.transform("px", lambda v, i: (v * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("digest"))


@query("r19_aligned_correlation", _IMG + " SELECT a.image_id, a.t, coalesce(CASE WHEN isnan(c) THEN NULL ELSE c END, -1) AS ncc FROM (SELECT a.image_id, a.t, floor(corr(a.v, b.v) * 10000 + 0.5) / 10000 AS c FROM (SELECT image_id, t, unnest(px) AS v, unnest(range(64)) AS i FROM img) a JOIN (SELECT image_id, t, unnest(px) AS v, unnest(range(64)) AS i FROM img) b ON b.image_id = a.image_id + 1 AND b.t = a.t AND a.i = b.i GROUP BY ALL) a")
def r19(s, d):
    image = _images(s, d)
    a = image.select("image_id", "t", F.posexplode("px").alias("i", "a"))
    b = image.select((F.col("image_id") - 1).alias("image_id"), "t", F.posexplode("px").alias("i", "b"))
    ncc = F.corr("a", "b")
    return a.join(b, ["image_id", "t", "i"]).groupBy("image_id", "t").agg(F.coalesce(F.nanvl(bits.half_up(ncc, 4), F.lit(-1.0)), F.lit(-1.0)).alias("ncc"))


def _tampered(s, d):
    """Fragile marks, then blocks of every third image altered."""
    marked = op.fragile_embed(_images(s, d))
    hit = (F.col("image_id") % 3 == 1) & (F.col("t") % 32).between(3, 6) & F.floor(F.col("t") / 32).between(8, 9) | (F.col("image_id") % 3 == 1) & (F.col("t") % 97 == 0)
    return marked.withColumn("px", F.when(hit, F.transform("px", lambda v: 255 - v)).otherwise(F.col("px")))


@query("m8_fragile_embed", _IMG + """, dg AS (SELECT image_id, t, px, sha256('key|' || image_id || '|' || t || '|' || array_to_string(list_transform(px, lambda v: v - v % 2), ',')) AS h FROM img)
SELECT image_id, t, CAST(list_sum(list_transform(range(64), lambda i: (px[i + 1] - px[i + 1] % 2 + ((CAST('0x' || substr(h, CAST(i // 4 + 1 AS BIGINT), 1) AS BIGINT) >> (3 - i % 4)) & 1)) * (i + 1))) AS BIGINT) AS digest FROM dg""")
def m8(s, d):
    out = op.fragile_embed(_images(s, d))
    return out.select("image_id", "t", F.aggregate(F.transform("px", lambda v, i: (v * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("digest"))


_WORN_TILES = _IMG + """, dg AS (SELECT image_id, t, px, sha256('key|' || image_id || '|' || t || '|' || array_to_string(list_transform(px, lambda v: v - v % 2), ',')) AS h FROM img),
mk AS (SELECT image_id, t, list_transform(range(64), lambda i: px[i + 1] - px[i + 1] % 2 + ((CAST('0x' || substr(h, CAST(i // 4 + 1 AS BIGINT), 1) AS BIGINT) >> (3 - i % 4)) & 1)) AS px FROM dg),
wn AS (SELECT image_id, t, CASE WHEN image_id % 3 = 1 AND (t % 32 BETWEEN 3 AND 6 AND t // 32 BETWEEN 8 AND 9 OR t % 97 = 0) THEN list_transform(px, lambda v: 255 - v) ELSE px END AS px FROM mk),
ck AS (SELECT image_id, t, px, sha256('key|' || image_id || '|' || t || '|' || array_to_string(list_transform(px, lambda v: v - v % 2), ',')) AS h FROM wn),
bd AS (SELECT image_id, t, 4 * list_sum(list_transform(range(64), lambda i: CASE WHEN px[i + 1] % 2 <> ((CAST('0x' || substr(h, CAST(i // 4 + 1 AS BIGINT), 1) AS BIGINT) >> (3 - i % 4)) & 1) THEN 1 ELSE 0 END)) > 64 AS failed FROM ck),
tv AS (SELECT image_id, count(*) AS n, count(*) FILTER (failed) AS failed FROM bd GROUP BY image_id),
tw AS (SELECT image_id, CASE WHEN n <> 1024 THEN 'unassessable' WHEN failed = 0 THEN 'intact' WHEN failed > n * 0.6 THEN 'unassessable' ELSE 'tampered' END AS status, failed, floor(failed / CAST(n AS DOUBLE) * 100 * 10 + 0.5) / 10 AS pct FROM tv)"""
_BOXES = "RECURSIVE" + _WORN_TILES + """, f AS (SELECT image_id, t FROM bd WHERE failed),
reach AS (SELECT image_id, t AS root, t FROM f UNION SELECT r.image_id, r.root, f.t FROM reach r JOIN f ON f.image_id = r.image_id AND (abs(f.t - r.t) = 32 OR abs(f.t - r.t) = 1 AND f.t // 32 = r.t // 32)),
cp AS (SELECT image_id, t, min(root) AS c FROM reach GROUP BY image_id, t),
bx AS (SELECT image_id, 8 * min(t % 32) AS x, 8 * min(t // 32) AS y, 8 * (max(t % 32) - min(t % 32) + 1) AS w, 8 * (max(t // 32) - min(t // 32) + 1) AS h FROM cp GROUP BY image_id, c),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, x, y, w, h) AS place FROM bx)"""


@query("r16_tamper_verdict", _WORN_TILES + " SELECT * FROM tw")
def r16(s, d):
    return op.tamper_verdict(op.fragile_check(_tampered(s, d)))


@query("r17_tamper_regions", _BOXES + " SELECT image_id, place, x, y, w, h FROM rk WHERE place <= 20")
def r17(s, d):
    return op.regions(op.fragile_check(_tampered(s, d)))


@query("o5_top_regions", _BOXES + " SELECT image_id, place AS by_area, x, y, w, h FROM rk WHERE place <= 20")
def o5(s, d):
    rows = op.regions(op.fragile_check(_tampered(s, d)))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.col("w") * F.col("h")), "x", "y"))
    return rows.withColumn("by_area", place).filter("by_area <= 20").select("image_id", "by_area", "x", "y", "w", "h")


@query("m9_fragile_verify", _BOXES + " SELECT tw.*, (SELECT count(*) FROM rk WHERE rk.image_id = tw.image_id AND place <= 20) AS regions FROM tw")
def m9(s, d):
    checked = op.fragile_check(_tampered(s, d))
    return op.tamper_verdict(checked).join(op.regions(checked).groupBy("image_id").agg(F.count("*").alias("regions")), "image_id", "left").withColumn("regions", F.coalesce("regions", F.lit(0)))
