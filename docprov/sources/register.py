"""The register's tables, derived from the given ones, as DataFrames and (FIXTURE_SQL) as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.sources.files import shared_path

#: Roles, their aliases, who holds which capability, classifications, strengths.
ROLES = ("CRYPTO_CUSTODIAN", "TACTICAL_OFFICER", "FORENSIC_ANALYST", "NAVAL_AUDITOR", "ADMIN", "OFFICER", "INVESTIGATOR")
ALIASES = {"ADMIN": "CRYPTO_CUSTODIAN", "OFFICER": "TACTICAL_OFFICER", "INVESTIGATOR": "FORENSIC_ANALYST", "AUDITOR": "NAVAL_AUDITOR"}
AUDIT_READ = ("NAVAL_AUDITOR", "CRYPTO_CUSTODIAN", "FORENSIC_ANALYST", "ADMIN", "INVESTIGATOR")
USERS_WRITE = ("CRYPTO_CUSTODIAN", "ADMIN")
CLASSIFICATIONS = ("RESTRICTED", "CONFIDENTIAL", "SECRET")
CLASSES = (*CLASSIFICATIONS, "TOP SECRET // NOFORN")
DELTAS = (8, 12, 14, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("dept"),
        (F.col("c_acctbal") >= 0).alias("active"),
        pick(ROLES, F.col("c_custkey") % 7).alias("role"),
        (F.col("c_custkey") % 10 != 0).alias("has_kem"),
        (F.col("c_custkey") % 4 != 1).alias("has_dsa"),
        F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lower("c_name"), F.lit("@fleet"))).alias("email"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("asset_id"),
        F.col("p_name").alias("title"),
        pick(CLASSES, F.col("p_size") % 4).alias("classification"),
        F.when(F.col("p_partkey") % 5 == 0, "application/pdf").otherwise("image/png").alias("mime_type"),
        (F.col("p_size") * 1000).cast("bigint").alias("size_bytes"),
    )


def _hash(kind: str, turn: int | None) -> Column:
    own = F.conv(F.substring(F.md5(F.concat(F.lit(f"{kind}:"), F.col("asset_id").cast("string"))), 1, 15), 16, 10).cast("bigint")
    if turn is None:
        return own
    return own.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("event_id") % turn).cast("int")))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases_of(table(spark, sf_dir, "orders"))


def releases_of(orders: DataFrame) -> DataFrame:
    """The releases that orders stand for, of a table or of a stream."""
    key = F.col("o_orderkey")
    base = orders.select(
        key.alias("event_id"),
        F.col("o_custkey").alias("user_id"),
        F.floor(key / 8).alias("asset_id"),
        F.col("o_orderdate").alias("created_at"),
        F.sha2(F.concat(F.lit("receipt:"), key.cast("string")), 256).alias("receipt_id"),
        pick(DELTAS, key % 4).alias("delta_used"),
        F.when(key % 8 == 1, None).when(key % 8 == 2, F.concat(F.lit("mobile-"), key.cast("string"))).when(key % 8 == 3, "unknown").otherwise(F.concat(F.lit("DESK-"), key.cast("string"))).alias("device_label"),
        (key % 3 != 0).alias("fragile_layer"),
        F.when(key % 6 != 0, F.md5(key.cast("string"))).alias("tx_hash"),
        F.when(key % 9 == 0, "off").when(key % 9 == 1, "sepolia").otherwise("localhost").alias("chain_mode"),
    )
    known = base.select(
        "*",
        bits.short_id(F.col("receipt_id")).alias("short_id"),
        _hash("p", 60).alias("p_hash"),
        _hash("d", 59).alias("d_hash"),
        F.when(F.col("event_id") % 17 != 0, _hash("a", None)).alias("a_hash"),
        F.when(F.col("asset_id") % 5 == 0, 0.0).otherwise(38 + (F.col("event_id") % 200) / 10).alias("psnr_db"),
        F.when(F.col("event_id") % 4 != 3, F.concat(F.lit("marked/"), F.substring("receipt_id", 1, 16), F.lit(".png"))).alias("marked_path"),
    )
    return known.withColumn("payload", bits.build_payload(F.col("short_id")))


#: Buckets of a stored table at least, and rows that one holds, about.
BUCKETS, BUCKET_ROWS = 8, 1_000_000


def buckets_of(rows: DataFrame) -> int:
    """The number of buckets for a table of so many rows: what a task reads doesn't grow with it. A power of two, so that tables
    of other sizes can be read in the same buckets."""
    return max(BUCKETS, 1 << max(0, -(-rows.count() // BUCKET_ROWS) - 1).bit_length())


def stored(rows: DataFrame, key: str, created_at: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """rows written once as a table bucketed by key, in folders by the year of created_at if that is given (column created_year), and
    read from it: joins on key of tables with as many buckets move nothing, filters on created_year leave other folders unread."""
    spark = rows.sparkSession
    name, path = f"stored_{uuid.uuid4().hex}", shared_path(spark, "stored")
    rows = rows.withColumn("created_year", F.year(created_at)) if created_at else rows
    out = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    (out.partitionBy("created_year") if created_at else out).saveAsTable(name)
    return spark.table(name)


def of_years(register: DataFrame, first: str, last: str) -> DataFrame:
    """The rows of a stored() register created from the day first to the day last; the years' folders are chosen before reading."""
    days = F.to_date("created_at").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return register.filter(F.col("created_year").between(int(first[:4]), int(last[:4])) & days)


def _ones(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's queries: every fiftieth release has leaked; hashes and bits are worn by a rule."""
    r, turn = releases(spark, sf_dir).filter("event_id % 50 = 0"), F.floor(F.col("event_id") / 50)
    worn = _ones(pick((3, 20, 31, 45), turn % 4))
    return r.select(
        F.col("event_id").alias("leak_id"),
        *(F.col(c).bitwiseXOR(worn).alias(c) for c in ("p_hash", "d_hash", "a_hash")),
        F.col("payload").bitwiseXOR(_ones(pick((0, 3, 8, 12, 16, 24), turn % 6))).alias("read_bits"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts on the current ledger and on a legacy one, some twice, and a zero id."""
    r = releases(spark, sf_dir).filter("event_id % 20 <> 7")
    rows = r.select("receipt_id", "asset_id", F.when(F.col("event_id") % 3 != 0, 0).otherwise(1).alias("priority"), F.when(F.col("event_id") % 3 != 0, F.md5("receipt_id")).alias("signature_commit"), F.lit(1).alias("copy"), F.col("event_id").alias("seq"))
    again = rows.filter("seq % 101 = 0").withColumn("copy", F.lit(2)).withColumn("priority", F.lit(1)).withColumn("signature_commit", F.lit(None).cast("string"))
    zero = rows.filter("seq % 1009 = 0").withColumn("receipt_id", F.lit("0" * 64))
    return rows.union(again).union(zero)


def encapsulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = releases(spark, sf_dir).select("asset_id", "user_id").distinct()
    return pairs.select("*", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("pw-"), F.col("user_id").cast("string"))).alias("passphrase"))


def verdict(score: Column) -> Column:
    return F.when(score >= 0.85, "ATTRIBUTED").when(score >= 0.6, "PROBABLE").when(score >= 0.3, "SUSPICION").otherwise("INCONCLUSIVE")


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    confidence = F.when(n % 13 != 0, (n % 101) / 100)
    return e.select(
        n.alias("investigation_id"),
        F.col("ts").alias("created_at"),
        confidence.alias("confidence"),
        verdict(F.coalesce(confidence, F.lit(0.0))).alias("verdict"),
        F.when(n % 3 != 0, F.sha2(F.concat(F.lit("receipt:"), n.cast("string")), 256)).alias("top_receipt_id"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 by 8 tile per embedding: tile_id, px (array of int)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("tile_id"), F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * v.cast("double") + 0.5).cast("int")))).alias("px"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id and r, g, b: a tile and the two behind it as the planes of one."""
    t = tiles(spark, sf_dir)
    n = t.count()
    out = t.withColumnRenamed("px", "r")
    for k, name in ((n - 1, "g"), (n - 2, "b")):
        out = out.join(t.select(((F.col("tile_id") + k) % n).alias("tile_id"), F.col("px").alias(name)), "tile_id")
    return out


def marked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every tenth with the payload of the release of its number, the next with its receipt."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    receipt = F.sha2(F.concat(F.lit("receipt:"), n.cast("string")), 256)
    payload = bits.bit_string(bits.build_payload(bits.short_id(receipt)))
    tail = F.when(n % 10 == 0, F.concat(F.lit(" payload:"), payload)).when(n % 10 == 1, F.concat(F.lit(" 0x"), receipt)).otherwise("")
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


#: CRC-8 bit by bit, as a macro-like text: {x} is a 36-bit id.
SQL_CRC = "list_reduce(list_prepend(0, list_transform(range(40), lambda i: (({x} << 4) >> (39 - i)) & 1)), lambda c, b: xor((c << 1) & 255, 7 * xor(c >> 7, b)))"
_OWN = "CAST('0x' || substr(md5('{k}:' || asset_id), 1, 15) AS BIGINT)"
FIXTURE_SQL = f"""
WITH users AS (
  SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS dept, c_acctbal >= 0 AS active,
    {_list(ROLES)}[c_custkey % 7 + 1] AS role, c_custkey % 10 <> 0 AS has_kem, c_custkey % 4 <> 1 AS has_dsa,
    CASE WHEN c_custkey % 11 <> 0 THEN lower(c_name) || '@fleet' END AS email
  FROM customer),
assets AS (
  SELECT p_partkey AS asset_id, p_name AS title, {_list(CLASSES)}[p_size % 4 + 1] AS classification,
    CASE WHEN p_partkey % 5 = 0 THEN 'application/pdf' ELSE 'image/png' END AS mime_type, CAST(p_size * 1000 AS BIGINT) AS size_bytes
  FROM part),
rel0 AS (
  SELECT o_orderkey AS event_id, o_custkey AS user_id, o_orderkey // 8 AS asset_id, o_orderdate AS created_at,
    sha256('receipt:' || o_orderkey) AS receipt_id, {_list(DELTAS)}[o_orderkey % 4 + 1] AS delta_used,
    CASE o_orderkey % 8 WHEN 1 THEN NULL WHEN 2 THEN 'mobile-' || o_orderkey WHEN 3 THEN 'unknown' ELSE 'DESK-' || o_orderkey END AS device_label,
    o_orderkey % 3 <> 0 AS fragile_layer, CASE WHEN o_orderkey % 6 <> 0 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS tx_hash,
    CASE o_orderkey % 9 WHEN 0 THEN 'off' WHEN 1 THEN 'sepolia' ELSE 'localhost' END AS chain_mode
  FROM orders),
rel1 AS (
  SELECT *, CAST('0x' || substr(receipt_id, 1, 9) AS BIGINT) AS short_id,
    xor({_OWN.format(k="p")}, CAST(1 AS BIGINT) << (event_id % 60)) AS p_hash, xor({_OWN.format(k="d")}, CAST(1 AS BIGINT) << (event_id % 59)) AS d_hash,
    CASE WHEN event_id % 17 <> 0 THEN {_OWN.format(k="a")} END AS a_hash,
    CASE WHEN asset_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE 38 + CAST(event_id % 200 AS DOUBLE) / 10 END AS psnr_db,
    CASE WHEN event_id % 4 <> 3 THEN 'marked/' || substr(receipt_id, 1, 16) || '.png' END AS marked_path
  FROM rel0),
releases AS (SELECT *, (short_id << 12) | (CAST({SQL_CRC.format(x="short_id")} AS BIGINT) << 4) | 1 AS payload FROM rel1),
leak0 AS (
  SELECT *, (CAST(1 AS BIGINT) << [3, 20, 31, 45][event_id // 50 % 4 + 1]) - 1 AS worn, (CAST(1 AS BIGINT) << [0, 3, 8, 12, 16, 24][event_id // 50 % 6 + 1]) - 1 AS lost
  FROM releases WHERE event_id % 50 = 0),
leaks AS (SELECT event_id AS leak_id, xor(p_hash, worn) AS p_hash, xor(d_hash, worn) AS d_hash, xor(a_hash, worn) AS a_hash, xor(payload, lost) AS read_bits FROM leak0),
led0 AS (
  SELECT receipt_id, asset_id, CASE WHEN event_id % 3 <> 0 THEN 0 ELSE 1 END AS priority,
    CASE WHEN event_id % 3 <> 0 THEN md5(receipt_id) END AS signature_commit, 1 AS copy, event_id AS seq
  FROM releases WHERE event_id % 20 <> 7),
ledger AS (
  SELECT * FROM led0 UNION ALL SELECT receipt_id, asset_id, 1, NULL, 2, seq FROM led0 WHERE seq % 101 = 0
  UNION ALL SELECT repeat('0', 64), asset_id, priority, signature_commit, copy, seq FROM led0 WHERE seq % 1009 = 0),
encapsulations AS (SELECT *, CASE WHEN user_id % 3 <> 0 THEN 'pw-' || user_id END AS passphrase FROM (SELECT DISTINCT asset_id, user_id FROM releases)),
inv0 AS (SELECT event_id AS investigation_id, ts AS created_at, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 101 AS DOUBLE) / 100 END AS confidence FROM events),
investigations AS (
  SELECT investigation_id, created_at, confidence,
    CASE WHEN coalesce(confidence, 0) >= 0.85 THEN 'ATTRIBUTED' WHEN confidence >= 0.6 THEN 'PROBABLE' WHEN confidence >= 0.3 THEN 'SUSPICION' ELSE 'INCONCLUSIVE' END AS verdict,
    CASE WHEN investigation_id % 3 <> 0 THEN sha256('receipt:' || investigation_id) END AS top_receipt_id
  FROM inv0),
tiles AS (SELECT vec_id AS tile_id, list_transform(embedding, lambda v: CAST(greatest(0, least(255, floor(128 + 400 * CAST(v AS DOUBLE) + 0.5))) AS INTEGER)) AS px FROM embeddings),
mt0 AS (SELECT doc_id, coalesce(text, '') AS text, sha256('receipt:' || doc_id) AS receipt FROM documents),
mt1 AS (SELECT *, CAST('0x' || substr(receipt, 1, 9) AS BIGINT) AS sid FROM mt0),
marked_text AS (
  SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN ' payload:' || right(bin((sid << 12) | (CAST({SQL_CRC.format(x="sid")} AS BIGINT) << 4) | 1 | (CAST(1 AS BIGINT) << 50)), 48)
    WHEN doc_id % 10 = 1 THEN ' 0x' || receipt ELSE '' END AS text FROM mt1)
"""
#: Repair of `payload` in a table ma: re has it with the first flip that explains its CRC undone, and `corrected`.
SQL_REPAIR = f""", eff AS (SELECT q AS i, CASE WHEN q < 36 THEN CAST({SQL_CRC.format(x="(CAST(1 AS BIGINT) << greatest(35 - q, 0))")} AS BIGINT) ELSE CAST(1 AS BIGINT) << (43 - q) END AS e, CAST(1 AS BIGINT) << (47 - q) AS m FROM (SELECT CAST(unnest(range(44)) AS INTEGER) AS q)),
flips AS (SELECT i, -1 AS j, e, m FROM eff UNION ALL SELECT a.i, b.i, xor(a.e, b.e), a.m | b.m FROM eff a JOIN eff b ON a.i < b.i WHERE b.i < 36),
firsts AS (SELECT e, m FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY j >= 0, i, j) AS n FROM flips) WHERE n = 1 AND e <> 0),
syn AS (SELECT *, xor(CAST({SQL_CRC.format(x="(payload >> 12)")} AS BIGINT), (payload >> 4) & 255) AS s FROM ma),
re AS (SELECT syn.* EXCLUDE (payload, s), xor(payload, coalesce(m, 0)) AS payload, m IS NOT NULL AS corrected FROM syn LEFT JOIN firsts ON s = e)"""
#: 8 by 8 pages of three planes of colour: a tile and the two behind it.
SQL_PLANES = "planes AS (SELECT a.tile_id, a.px AS r, b.px AS g, c.px AS b FROM tiles a JOIN tiles b ON b.tile_id = (a.tile_id + 1) % (SELECT count(*) FROM tiles) JOIN tiles c ON c.tile_id = (a.tile_id + 2) % (SELECT count(*) FROM tiles))"
