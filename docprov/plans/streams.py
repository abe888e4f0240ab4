"""Queries that run as streams over the given tables until these are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.plans import rasters
from docprov.plans.registry import query
from docprov.sources import files
from docprov.sources import register as reg
from docprov.streaming import register as st


def _receipts(s, d):
    k = F.col("o_orderkey")
    rows = st.stream(s, d, "orders").select(
        F.when(k % 1009 == 0, st.ZERO).otherwise(F.sha2(F.concat(F.lit("receipt:"), F.floor(k / 2).cast("string")), 256)).alias("receipt_id"),
        (k % 100).alias("asset_id"),
        F.when(k % 3 != 0, F.md5(k.cast("string"))).alias("signature_commit"),
    )
    return rows


_REC = "WITH rec AS (SELECT CASE WHEN o_orderkey % 1009 = 0 THEN repeat('0', 64) ELSE sha256('receipt:' || (o_orderkey // 2)) END AS receipt_id, o_orderkey % 100 AS asset_id, CASE WHEN o_orderkey % 3 <> 0 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS signature_commit FROM orders)"


@query("t1_hot_register", """, h AS (SELECT event_id, p_hash FROM releases) SELECT l.event_id AS leak_id, count(*) AS n, min(r.event_id) AS least, max(r.event_id) AS latest FROM (SELECT event_id, p_hash FROM releases WHERE event_id % 50 = 0) l JOIN h r ON r.event_id <= l.event_id AND bit_count(xor(l.p_hash, r.p_hash)) <= 12 GROUP BY l.event_id""")
def t1(s, d):
    """Releases arrive in the order of their numbers, in four goes, every fiftieth followed by a leak of it: a leak finds what arrived
    before it, and what is released later stays unfound."""
    orders, path = reg.table(s, d, "orders"), files.shared_path(s, "arrivals")
    least, most = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    for k in range(4):  # files of rising times: the stream reads them in this order
        part = orders.filter(F.floor((F.col("o_orderkey") - least) * 4 / (most - least + 1)) == k)
        part.repartition(1).write.mode("append").parquet(path)
    arriving = reg.releases_of(s.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(path)).select("event_id", "asset_id", "p_hash")
    kinds = F.when(F.col("event_id") % 50 == 0, F.array(F.lit("release"), F.lit("leak"))).otherwise(F.array(F.lit("release")))
    rows = arriving.select(F.explode(kinds).alias("kind"), F.col("event_id").alias("id"), "asset_id", "p_hash")
    rows = rows.select("kind", (F.col("id") * 2 + (F.col("kind") == "leak").cast("long")).alias("seq"), "id", "asset_id", "p_hash")
    return st.hot_register(rows, "hot").groupBy("leak_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("latest"))


@query("t2_challenge_response", """WITH c AS (SELECT event_id, event_id % 3 AS asset_id, user_id, ts FROM events WHERE event_type = 'view'),
o AS (SELECT event_id AS for_challenge, CASE WHEN event_id % 4 = 1 THEN event_id + 1 ELSE event_id END % 3 AS asset, CASE WHEN event_id % 5 = 2 THEN user_id + 1 ELSE user_id END AS user, ts + CASE WHEN event_id % 7 = 3 THEN INTERVAL 120 SECOND ELSE INTERVAL 119 SECOND END AS resp_ts FROM events WHERE event_type IN ('view', 'click'))
SELECT DISTINCT c.event_id AS challenge_id, c.asset_id, c.user_id FROM c JOIN o ON o.for_challenge = c.event_id AND o.asset = c.asset_id AND o.user = c.user_id AND o.resp_ts >= c.ts AND o.resp_ts < c.ts + INTERVAL 2 MINUTE""")
def t2(s, d):
    """Views are challenges; each event is answered twice, some answers for another asset or user, some too late."""
    e, n = st.stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    asked = e.filter("event_type = 'view'").select(n.alias("challenge_id"), (n % 3).alias("asset_id"), "user_id", F.col("ts").alias("ch_ts"))
    wait = F.when(n % 7 == 3, F.expr("INTERVAL 120 SECOND")).otherwise(F.expr("INTERVAL 119 SECOND"))
    given = e.filter("event_type IN ('view', 'click')").select(
        n.alias("for_challenge"),
        (F.when(n % 4 == 1, n + 1).otherwise(n) % 3).alias("asset"),
        F.when(n % 5 == 2, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user"),
        (F.col("ts") + wait).alias("resp_ts"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"),
    ).drop("copy")
    with st.stateful(s):
        return st.drained(st.answered(asked, given), "answered")


@query("t3_first_receipts", _REC + " SELECT DISTINCT receipt_id FROM rec WHERE receipt_id <> repeat('0', 64)")
def t3(s, d):
    return st.first_receipts(_receipts(s, d).select("receipt_id"), "receipts")


@query("t4_receipt_events", _REC + " SELECT receipt_id, 'ReceiptStored' AS event_name FROM rec UNION ALL SELECT receipt_id, 'SignatureAnchored' FROM rec WHERE signature_commit IS NOT NULL")
def t4(s, d):
    return st.drained(st.receipt_events(_receipts(s, d)), "receipt_events")


@query("t5_running_counts", _REC + " SELECT asset_id, count(*) AS n FROM rec GROUP BY asset_id UNION ALL SELECT NULL, count(*) FROM rec")
def t5(s, d):
    """Receipts per asset, and of all under a null asset."""
    each = F.explode(F.array(F.col("asset_id"), F.lit(None).cast("long")))
    counts = _receipts(s, d).select(each.alias("asset_id")).groupBy("asset_id").agg(F.count("*").alias("n"))
    rows = st.each_batch(counts, "counts", lambda b: b, mode="update")
    return rows.groupBy("asset_id").agg(F.max_by("n", "batch").alias("n"))


@query("t6_fidelity_backfill", rasters._POOLED + """, docs AS (SELECT CAST(count(*) AS BIGINT) AS k FROM pl)
SELECT event_id, floor(psnr * 10 + 0.5) / 10 AS psnr FROM releases JOIN assets USING (asset_id), docs JOIN pl ON pl.doc = asset_id % k WHERE psnr_db <= 0 AND mime_type = 'application/pdf' AND psnr IS NOT NULL ORDER BY event_id""")
def t6(s, d):
    """PDF releases without a figure are measured batch by batch, from the pages of their document; figures already there stay,
    and releases whose pages can't be compared are left for later."""
    pages = rasters.pooled(s, d)
    pages = files.written(pages, "pooled")
    n = pages.count()
    figures = pages.filter("psnr IS NOT NULL").select("doc", bits.half_up(F.col("psnr"), 1).alias("psnr"))
    pdfs = reg.assets(s, d).filter("mime_type = 'application/pdf'").select("asset_id")
    open_ = reg.releases_of(st.stream(s, d, "orders")).filter("psnr_db <= 0").select("event_id", "asset_id")

    def measured(batch):
        own = batch.join(pdfs, "asset_id", "left_semi").withColumn("doc", F.col("asset_id") % n)
        return own.join(figures, "doc").select("event_id", "psnr").sort("event_id")

    return st.each_batch(open_, "backfill", measured).drop("batch")


@query("t7_account_state", "SELECT event_id, user_id FROM releases JOIN users USING (user_id) WHERE active")
def t7(s, d):
    """Requests pass while their account is active; accounts are read anew for each batch."""
    asked = st.stream(s, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("user_id"))
    return st.each_batch(asked, "state", lambda b: b.join(reg.users(s, d).filter("active").select("user_id"), "user_id", "left_semi")).select("event_id", "user_id")
