"""Queries over single columns, digests, text extraction, and file and JSON sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.operators import audit
from docprov.plans.registry import query
from docprov.sources import files
from docprov.sources import register as reg

_WORN = ", worn AS (SELECT event_id, payload, xor(payload, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN CAST(1 AS BIGINT) << (4 + event_id % 44) WHEN 2 THEN (CAST(1 AS BIGINT) << (12 + event_id % 36)) | (CAST(1 AS BIGINT) << (12 + event_id * 5 % 36)) ELSE (CAST(1 AS BIGINT) << (event_id % 48)) - 1 END) AS b FROM releases)"


def _worn(s, d):
    k = F.col("event_id")

    def one(n):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))

    worn = F.when(k % 4 == 0, F.lit(0).cast("bigint")).when(k % 4 == 1, one(k % 44 + 4)).when(k % 4 == 2, one(k % 36 + 12).bitwiseOR(one(k * 5 % 36 + 12))).otherwise(one(k % 48) - 1)
    return reg.releases(s, d).select(F.inline(F.array(F.struct("event_id", "payload", F.col("payload").bitwiseXOR(worn).alias("b")))))


@query("x1_hamming64", "SELECT event_id, bit_count(xor(p_hash, d_hash)) AS pd, bit_count(xor(p_hash, -d_hash)) AS wrapped, bit_count(xor(CAST(0 AS BIGINT), CAST(-1 AS BIGINT))) AS most FROM releases")
def x1(s, d):
    r = reg.releases(s, d)
    return r.select("event_id", bits.hamming(F.col("p_hash"), F.col("d_hash")).alias("pd"), bits.hamming(F.col("p_hash"), -F.col("d_hash")).alias("wrapped"), bits.hamming(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")).alias("most"))


@query("x2_crc8", f"SELECT event_id, CAST({reg.SQL_CRC.format(x='short_id')} AS BIGINT) AS crc FROM releases")
def x2(s, d):
    return reg.releases(s, d).select("event_id", bits.crc8(F.col("short_id")).alias("crc"))


@query("x3_short_id", "SELECT event_id, short_id FROM releases")
def x3(s, d):
    return reg.releases(s, d).select("event_id", bits.short_id(F.concat(F.lit("0x"), "receipt_id")).alias("short_id"))


@query("x4_build_payload", "SELECT event_id, right(bin(payload | (CAST(1 AS BIGINT) << 50)), 48) AS bits FROM releases")
def x4(s, d):
    return reg.releases(s, d).select("event_id", bits.bit_string(F.col("payload")).alias("bits"))


@query("x5_parse_payload", _WORN + f"""
SELECT event_id, b >> 12 AS own, (b >> 4) & 255 AS crc, b & 15 AS version, CAST({reg.SQL_CRC.format(x='(b >> 12)')} AS BIGINT) = ((b >> 4) & 255) AND NOT (bit_count(b) <= 6 OR bit_count(b) >= 42 OR (b >> 12) IN (0, 68719476735)) AS crc_ok FROM worn WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM worn WHERE event_id % 5 = 0""")
def x5(s, d):
    text = F.when(F.col("event_id") % 5 != 0, bits.bit_string(F.col("b"))).otherwise("01x")
    p = _worn(s, d).select("event_id", bits.payload_of(text).alias("p")).select(F.inline(F.array(F.struct("event_id", "p"))))
    return p.select("event_id", bits.payload_id(F.col("p")).alias("own"), bits.payload_crc(F.col("p")).alias("crc"), F.col("p").bitwiseAND(F.lit(15)).alias("version"), bits.crc_ok(F.col("p")).alias("crc_ok"))


_EFFECT = f"""{_WORN}, pos AS (SELECT unnest(range(44)) AS i),
eff AS (SELECT q AS i, CASE WHEN q < 36 THEN CAST({reg.SQL_CRC.format(x='(CAST(1 AS BIGINT) << greatest(35 - q, 0))')} AS BIGINT) ELSE CAST(1 AS BIGINT) << (43 - q) END AS e, CAST(1 AS BIGINT) << (47 - q) AS m FROM (SELECT CAST(i AS INTEGER) AS q FROM pos)),
flips AS (SELECT i, -1 AS j, e, m FROM eff UNION ALL SELECT a.i, b.i, xor(a.e, b.e), a.m | b.m FROM eff a JOIN eff b ON a.i < b.i WHERE b.i < 36),
firsts AS (SELECT e, m FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY j >= 0, i, j) AS n FROM flips) WHERE n = 1 AND e <> 0),
syn AS (SELECT event_id, b, xor(CAST({reg.SQL_CRC.format(x='(b >> 12)')} AS BIGINT), (b >> 4) & 255) AS s FROM worn)"""


@query("x6_crc_guided_repair", _EFFECT + " SELECT event_id, b AS read, xor(b, coalesce(m, 0)) AS repaired FROM syn LEFT JOIN firsts ON s = e")
def x6(s, d):
    return _worn(s, d).select("event_id", F.col("b").alias("read"), bits.repaired(F.col("b")).alias("repaired"))


@query("x7_digests", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def x7(s, d):
    return reg.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("x8_pseudonym_refs", "SELECT event_id, sha256('user:' || user_id || ':docprov') AS user_ref, sha256('device:' || coalesce(device_label, 'unknown') || ':docprov') AS device_ref FROM releases")
def x8(s, d):
    return reg.releases(s, d).select("event_id", audit.reference("user", F.col("user_id")).alias("user_ref"), audit.reference("device", F.col("device_label")).alias("device_ref"))


@query("x9_receipt_id", "SELECT event_id, sha256(sha256('asset:' || asset_id || ':docprov') || sha256('user:' || user_id || ':docprov') || md5('content') || sha256('nonce' || event_id)) AS receipt FROM releases")
def x9(s, d):
    parts = F.concat(audit.reference("asset", F.col("asset_id")), audit.reference("user", F.col("user_id")), F.md5(F.lit("content")), F.sha2(F.concat(F.lit("nonce"), F.col("event_id").cast("string")), 256))
    return reg.releases(s, d).select("event_id", F.sha2(parts, 256).alias("receipt"))


@query("x10_hex_bytes32", "SELECT event_id, right(repeat('0', 64) || lower(tx_hash), 64) AS word, '0x' || substr(receipt_id, 1, 8) || '…' AS short FROM releases")
def x10(s, d):
    word = F.lower(F.right(F.lpad(F.regexp_replace(F.concat(F.lit("0x"), F.upper("tx_hash")), "^0x", ""), 64, "0"), F.lit(64)))
    return reg.releases(s, d).select("event_id", word.alias("word"), F.concat(F.lit("0x"), F.substring("receipt_id", 1, 8), F.lit("…")).alias("short"))


@query("x11_to_signed64", "SELECT event_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS signed FROM (SELECT event_id, CAST(CAST('0x' || substr(receipt_id, 1, 8) AS BIGINT) AS HUGEINT) * 4294967296 + CAST('0x' || substr(receipt_id, 9, 8) AS BIGINT) AS u FROM releases)")
def x11(s, d):
    return reg.releases(s, d).select("event_id", bits.signed64(F.substring("receipt_id", 1, 16)).alias("signed"))


@query("x12_content_hash", "SELECT doc_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS p_hash FROM (SELECT doc_id, CAST(CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) AS HUGEINT) * 4294967296 + CAST('0x' || substr(sha256(text), 9, 8) AS BIGINT) AS u FROM documents)")
def x12(s, d):
    return reg.table(s, d, "documents").select("doc_id", bits.signed64(F.substring(F.sha2("text", 256), 1, 16)).alias("p_hash"))


@query("x17_canonical_json_digest", "SELECT investigation_id, sha256(json_object('created', CAST(created_at AS VARCHAR)[:10], 'id', investigation_id, 'inner', json_object('a', verdict, 'b', top_receipt_id))) AS digest FROM investigations")
def x17(s, d):
    whole = F.struct(F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.col("investigation_id").alias("id"), F.struct(F.col("verdict").alias("a"), F.col("top_receipt_id").alias("b")).alias("inner"))
    return reg.investigations(s, d).select("investigation_id", F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256).alias("digest"))


@query("x18_stamp_verification", """, st AS (SELECT event_id, [sha256('a' || event_id), sha256('b' || event_id), CASE WHEN event_id % 3 = 0 THEN sha256('x') ELSE sha256('c' || event_id) END] AS stamps, substr(sha256('c' || event_id), 1, 12) AS want FROM releases),
f AS (SELECT event_id, list_filter(stamps, lambda x: starts_with(x, want)) AS hit FROM st) SELECT event_id, len(hit) > 0 AS found, coalesce(hit[1] = sha256('c' || event_id), false) AS valid FROM f""")
def x18(s, d):
    k = F.col("event_id").cast("string")
    own = F.sha2(F.concat(F.lit("c"), k), 256)
    stamps = F.array(F.sha2(F.concat(F.lit("a"), k), 256), F.sha2(F.concat(F.lit("b"), k), 256), F.when(F.col("event_id") % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(own))
    hit = F.get(F.filter(stamps, lambda x: x.startswith(F.substring(own, 1, 12))), F.lit(0))
    return reg.releases(s, d).select("event_id", hit.isNotNull().alias("found"), F.coalesce(hit == own, F.lit(False)).alias("valid"))


@query("x25_column_crypto", "WITH d AS (SELECT doc_id, text FROM documents) SELECT doc_id, doc_id % 10 = 0 OR text IS NULL AS refused, doc_id % 10 <> 0 AND text IS NOT NULL AS same FROM d")
def x25(s, d):
    """AES-GCM over document texts, opened again; a worn ciphertext opens to null."""
    key, iv = F.unhex(F.lit("00" * 32)), F.unhex(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 24))
    sealed = reg.table(s, d, "documents").select("doc_id", "text", F.aes_encrypt(F.col("text"), key, F.lit("GCM"), F.lit("DEFAULT"), iv).alias("c"))
    worn = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("c"), F.unhex(F.lit("00")))).otherwise(F.col("c"))
    opened = sealed.select("doc_id", "text", F.try_aes_decrypt(worn, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string").alias("back"))
    return opened.select("doc_id", F.col("back").isNull().alias("refused"), F.coalesce(F.col("back") == F.col("text"), F.lit(False)).alias("same"))


@query("x26_mark_text_extraction", f"""
, m AS (SELECT doc_id, regexp_extract(text, 'payload:([01]{{48}})', 1) AS bits, regexp_extract(text, '0x([0-9a-fA-F]{{64}})', 1) AS receipt FROM marked_text),
n AS (SELECT *, CASE WHEN bits = '' AND receipt <> '' THEN CAST('0x' || substr(receipt, 1, 9) AS BIGINT) ELSE 0 END AS sid FROM m)
SELECT doc_id, CASE WHEN bits <> '' THEN bits WHEN receipt <> '' THEN right(bin((sid << 12) | (CAST({reg.SQL_CRC.format(x='sid')} AS BIGINT) << 4) | 1 | (CAST(1 AS BIGINT) << 50)), 48) END AS mark FROM n""")
def x26(s, d):
    m = reg.marked_text(s, d).select("doc_id", F.regexp_extract("text", "payload:([01]{48})", 1).alias("b"), F.regexp_extract("text", "0x([0-9a-fA-F]{64})", 1).alias("receipt"))
    n = m.select(F.inline(F.array(F.struct("doc_id", "b", "receipt"))))
    return n.select("doc_id", F.when(F.col("b") != "", F.col("b")).when(F.col("receipt") != "", bits.bit_string(bits.build_payload(bits.short_id(F.col("receipt"))))).alias("mark"))


@query("x27_file_extension", "SELECT asset_id, mime_type, CASE mime_type WHEN 'application/pdf' THEN '.pdf' ELSE '.png' END AS ext FROM assets")
def x27(s, d):
    return reg.assets(s, d).select("asset_id", "mime_type", files.extension(F.col("mime_type")).alias("ext"))


@query("x29_rounding", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10 + 0.5) / 10 AS tenth, CAST(floor(-l_discount * 100 + 0.5) AS BIGINT) AS pct FROM lineitem")
def x29(s, d):
    return reg.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", bits.half_up(F.col("l_extendedprice"), 1).alias("tenth"), F.floor(-F.col("l_discount") * 100 + 0.5).cast("long").alias("pct"))


@query("x30_id_time_format", "SELECT investigation_id, 'INV-' || CASE WHEN investigation_id > 99999 THEN CAST(investigation_id AS VARCHAR) ELSE lpad(CAST(investigation_id AS VARCHAR), 5, '0') END AS code, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM investigations")
def x30(s, d):
    n = F.col("investigation_id").cast("string")
    code = F.concat(F.lit("INV-"), F.when(F.length(n) > 5, n).otherwise(F.lpad(n, 5, "0")))
    return reg.investigations(s, d).select("investigation_id", code.alias("code"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("r9_bit_agreement", _WORN + " SELECT event_id, 48 - bit_count(xor(payload, b)) AS matches, floor((48 - bit_count(xor(payload, b))) / CAST(48 AS DOUBLE) * 1000000 + 0.5) / 1000000 AS agreement FROM worn")
def r9(s, d):
    m = bits.matching(F.col("payload"), F.col("b"))
    return _worn(s, d).select("event_id", m.alias("matches"), bits.half_up(m / 48, 6).alias("agreement"))


#: By page_id % 10: extension, what the page's bytes start with (hex), and the type of those.
_UPLOADS = (
    ("png", "89504E470D0A1A0A", "image/png"),
    ("pdf", "255044462D312E37", "application/pdf"),
    ("jpg", "FFD8FFE0", "image/jpeg"),
    ("jpeg", "FFD8FFE1", "image/jpeg"),
    ("webp", "524946460000000057454250", "image/webp"),
    ("bmp", "424D", "image/bmp"),
    ("tiff", "4D4D002A", "image/tiff"),
    ("exe", "4D5A", None),
    ("png", "255044462D312E37", "application/pdf"),  # a PDF under another name
    ("pdf", "", None),  # the page alone
)
_DECLARED = {"png": "image/png", "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff"}


@query("s3_file_source", "WITH u AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{e}', {len(h) // 2}, {repr(_DECLARED[e]) if e in _DECLARED else 'NULL'}, {repr(t) if t else 'NULL'})" for i, (e, h, t) in enumerate(_UPLOADS)) + """) v(i, ext, n, declared, found))
SELECT page_id, declared, found, strlen(coalesce(html, '')) + n AS n_bytes, coalesce(declared = found, false) AS accepted FROM pages JOIN u ON page_id % 10 = i WHERE ext <> 'exe' AND strlen(coalesce(html, '')) + n > 0""")
def s3(s, d):
    """The pages written as files of all types, and a file source over them: each file judged by its name, its length and its bytes."""
    kind = F.col("page_id") % 10
    of = lambda k: reg.pick(tuple(u[k] for u in _UPLOADS), kind)
    body = F.concat(F.unhex(of(1)), F.coalesce("html", F.lit("")).cast("binary"))
    folder = files.shared_path(s, "uploads")
    rows = reg.table(s, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit("."), of(0)).alias("name"), body.alias("content"))
    files.put_files(rows, folder)
    return files.uploads(s, folder).select(F.regexp_extract("path", r"page-(\d+)\.", 1).cast("long").alias("page_id"), "declared", "found", "n_bytes", "accepted")


@query("s9_investigation_append", " SELECT CAST(created_at AS DATE) AS created_date, count(*) AS n, sum(investigation_id) AS ids FROM investigations GROUP BY 1")
def s9(s, d):
    """Investigations appended in two goes to one table."""
    rows, path = reg.investigations(s, d), files.shared_path(s, "investigations")
    for rest in (0, 1):
        files.append_investigations(rows.filter(F.col("investigation_id") % 2 == rest), path)
    return s.read.parquet(path).groupBy("created_date").agg(F.count("*").alias("n"), F.sum("investigation_id").alias("ids"))
