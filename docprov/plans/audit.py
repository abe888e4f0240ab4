"""Queries over the register: scans, filters, joins, roll-ups, windows, paging, data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.operators import audit as op
from docprov.plans.registry import query
from docprov.sources import files
from docprov.sources import register as reg

_STAR = "releases r JOIN users u USING (user_id) JOIN assets a USING (asset_id)"


@query("s1_register_scan", "SELECT event_id, user_id, asset_id, receipt_id, short_id, p_hash, d_hash, a_hash, payload FROM releases")
def s1(s, d):
    """The register, written once with all that is derived, and scanned."""
    register = reg.releases(s, d)
    return reg.stored(register, "event_id", "created_at", reg.buckets_of(register)).select("event_id", "user_id", "asset_id", "receipt_id", "short_id", "p_hash", "d_hash", "a_hash", "payload")


@query("s2_projected_index_scan", "SELECT event_id, p_hash, d_hash, a_hash FROM releases WHERE a_hash IS NOT NULL")
def s2(s, d):
    register = reg.releases(s, d)
    return reg.stored(register, "event_id", "created_at", reg.buckets_of(register)).select("event_id", "p_hash", "d_hash", "a_hash").filter("a_hash IS NOT NULL")


@query("s1_register_range_join", " SELECT leak_id, user_id, 48 - bit_count(xor(read_bits, payload)) AS matches FROM releases JOIN leaks ON leak_id = event_id WHERE CAST(created_at AS DATE) BETWEEN DATE '1994-03-01' AND DATE '1996-06-30'")
def s1_range(s, d):
    """Leaks beside their own releases of some years, both stored in buckets of the same key."""
    buckets = reg.buckets_of(reg.releases(s, d))
    register, leaks = reg.stored(reg.releases(s, d), "event_id", "created_at", buckets), reg.stored(reg.leaks(s, d), "leak_id", buckets=buckets)
    own = reg.of_years(register, "1994-03-01", "1996-06-30").join(leaks, F.col("leak_id") == F.col("event_id"))
    return own.select("leak_id", "user_id", bits.matching(F.col("read_bits"), F.col("payload")).alias("matches"))


@query("s4_tiered_read", """, local AS (SELECT page_id AS k, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN html END AS b FROM pages),
durable AS (SELECT page_id AS k, html AS b FROM pages WHERE page_id % 5 <> 0)
SELECT coalesce(l.k, x.k) AS page_id, length(CASE WHEN length(l.b) > 0 THEN l.b ELSE x.b END) AS n FROM local l FULL JOIN durable x ON l.k = x.k""")
def s4(s, d):
    p = reg.table(s, d, "pages").select("page_id", "html")
    local = p.select("page_id", F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.col("html")).alias("near"))
    durable = p.filter("page_id % 5 <> 0").withColumnRenamed("html", "far")
    return local.join(durable, "page_id", "full").select("page_id", F.length(F.coalesce(F.when(F.length("near") > 0, F.col("near")), F.col("far"))).cast("long").alias("n"))


@query("s5_keyed_upsert", """, up AS (SELECT event_id % 1000 AS k, event_id, created_at FROM releases), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, event_id DESC) AS n FROM up)
SELECT k AS file_key, event_id FROM r WHERE n = 1""")
def s5(s, d):
    """Files put under their keys in two goes, the older first: the second replaces what it has anew."""
    rows = reg.releases(s, d).select((F.col("event_id") % 1000).alias("file_key"), "event_id", "created_at")
    old, new = (op.latest(rows.filter(when), ["file_key"], op.newest_first()) for when in (F.year("created_at") < 1996, F.year("created_at") >= 1996))
    path = files.shared_path(s, "files")
    files.put_table(old, "file_key", path)
    files.upsert(new, "file_key", path)
    return s.read.schema(old.schema).parquet(path).select("file_key", "event_id")


@query("s8_versioned_ledger", "SELECT receipt_id, asset_id, signature_commit, priority, copy FROM ledger")
def s8(s, d):
    rows = reg.ledger(s, d)
    now = rows.filter("priority = 0").select("receipt_id", "asset_id", "signature_commit", "priority", "copy")
    old = rows.filter("priority = 1").select("receipt_id", "asset_id", "priority", "copy")
    return now.unionByName(old, allowMissingColumns=True)


@query("s10_evidence", "SELECT investigation_id, json_object('confidence', coalesce(confidence, 0), 'id', investigation_id, 'receipt', top_receipt_id, 'verdict', verdict) AS record FROM (SELECT investigation_id, CAST(floor(coalesce(confidence, 0) * 100 + 0.5) AS BIGINT) AS confidence, verdict, top_receipt_id FROM investigations)")
def s10(s, d):
    i = reg.investigations(s, d)
    whole = bits.half_up(F.coalesce("confidence", F.lit(0.0)) * 100).cast("long")
    rec = F.struct(whole.alias("confidence"), F.col("investigation_id").alias("id"), F.col("top_receipt_id").alias("receipt"), "verdict")
    return i.select("investigation_id", F.to_json(rec, {"ignoreNullFields": "false"}).alias("record"))


@query("f1_audit_filter", f"SELECT event_id, user_id, asset_id, classification FROM {_STAR} WHERE classification = 'SECRET' AND created_at >= TIMESTAMP '1995-01-01' AND created_at <= TIMESTAMP '1997-06-30'")
def f1(s, d):
    rows = op.star(reg.releases(s, d), reg.users(s, d), reg.assets(s, d))
    return op.audit_filter(rows, classification="SECRET", since="1995-01-01", until="1997-06-30").select("event_id", "user_id", "asset_id", "classification")


@query("f2_row_validation", """, raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(o_orderkey % 7 - 1 AS VARCHAR) END AS page, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 300 AS VARCHAR) END AS lim,
CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'SECRET' WHEN 2 THEN 'ALL' ELSE o_orderpriority END AS c FROM orders),
v AS (SELECT id, CASE WHEN page IS NULL THEN 1 ELSE TRY_CAST(page AS INTEGER) END AS page, CASE WHEN lim IS NULL THEN 50 ELSE TRY_CAST(lim AS INTEGER) END AS lim, c FROM raw)
SELECT id, page, lim, array_to_string(list_filter([CASE WHEN page IS NULL OR page < 1 THEN 'page' END, CASE WHEN lim IS NULL OR lim NOT BETWEEN 1 AND 200 THEN 'limit' END,
CASE WHEN c NOT IN ('RESTRICTED', 'CONFIDENTIAL', 'SECRET', 'ALL') THEN 'classification' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v""")
def f2(s, d):
    k = F.col("o_orderkey")
    raw = reg.table(s, d, "orders").select(
        k.alias("id"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "x").otherwise((k % 7 - 1).cast("string")).alias("page"),
        F.when(k % 3 != 0, (k % 300).cast("string")).alias("lim"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "SECRET").when(k % 4 == 2, "ALL").otherwise(F.col("o_orderpriority")).alias("classification"),
    )
    return op.validated(raw)


@query("f3_recipient_list", """, raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '[' || o_custkey || ', ' || (o_custkey % 3) || ']' WHEN 1 THEN o_custkey || ',x, -4' WHEN 2 THEN NULL ELSE 'none' END AS t FROM orders),
p AS (SELECT id, CASE WHEN t LIKE '[%' THEN CAST(t AS INTEGER[]) ELSE list_transform(string_split(t, ','), lambda x: TRY_CAST(trim(x) AS INTEGER)) END AS l FROM raw), g AS (SELECT id, list_filter(l, lambda x: x > 0) AS l FROM p)
SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') END AS ids FROM g""")
def f3(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    t = F.when(k % 4 == 0, F.concat(F.lit("["), c, F.lit(", "), (F.col("o_custkey") % 3).cast("string"), F.lit("]"))).when(k % 4 == 1, F.concat(c, F.lit(",x, -4"))).when(k % 4 == 2, None).otherwise("none")
    return reg.table(s, d, "orders").select(k.alias("id"), F.array_join(op.recipients(t), ",").alias("ids"))


@query("f4_recipient_eligibility", "SELECT user_id, 'listed' AS why FROM users WHERE active AND user_id IN (SELECT user_id FROM releases) UNION ALL SELECT user_id, 'default' FROM users WHERE active AND has_kem")
def f4(s, d):
    u = reg.users(s, d)
    listed = u.join(reg.releases(s, d).select("user_id"), "user_id", "left_semi").filter("active")
    return listed.select("user_id", F.lit("listed").alias("why")).union(u.filter("active AND has_kem").select("user_id", F.lit("default")))


@query("f5_traceable_releases", "SELECT event_id, mime_type FROM releases JOIN assets USING (asset_id) WHERE mime_type LIKE 'image/%' OR mime_type = 'application/pdf'")
def f5(s, d):
    mime = F.col("mime_type")
    return reg.releases(s, d).join(reg.assets(s, d), "asset_id").filter(mime.startswith("image/") | (mime == "application/pdf")).select("event_id", "mime_type")


@query("f7_degenerate_payload", """, x AS (SELECT leak_id, read_bits AS b FROM leaks UNION ALL SELECT event_id, payload & 127 FROM releases)
SELECT leak_id, count(*) AS n, count(*) FILTER (bit_count(b) <= 6 OR bit_count(b) >= 42 OR (b >> 12) IN (0, 68719476735)) AS bad FROM x GROUP BY leak_id""")
def f7(s, d):
    rows = reg.leaks(s, d).select("leak_id", F.col("read_bits").alias("b")).union(reg.releases(s, d).select("event_id", F.col("payload").bitwiseAND(F.lit(127))))
    return rows.groupBy("leak_id").agg(F.count("*").alias("n"), F.count_if(bits.degenerate(F.col("b"))).alias("bad"))


@query("f8_relative_time", "SELECT 7 AS days, count(*) AS n FROM investigations WHERE created_at >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY UNION ALL SELECT 30, count(*) FROM investigations WHERE created_at >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAY UNION ALL SELECT 0, count(*) FROM investigations")
def f8(s, d):
    i, out = reg.investigations(s, d), None
    for days in (7, 30, None):
        n = op.within_days(i, "2024-01-30 00:00:00", days).agg(F.count("*").alias("n")).select(F.lit(days or 0).alias("days"), "n")
        out = n if out is None else out.union(n)
    return out


@query("f9_free_text_search", "SELECT investigation_id, verdict FROM investigations WHERE contains('inv-' || lpad(CAST(investigation_id AS VARCHAR), greatest(5, 5), '0'), 'prob') OR contains(lower(verdict), 'prob') OR contains(strftime(created_at, '%Y-%m-%d %H:%M:%S'), 'prob')")
def f9(s, d):
    return op.search(reg.investigations(s, d), " PROB ").select("investigation_id", "verdict")


@query("f10_classification_scope", f"SELECT classification, count(*) AS n FROM {_STAR} GROUP BY classification UNION ALL SELECT 'only ' || classification, count(*) FROM {_STAR} WHERE classification = 'SECRET' GROUP BY classification")
def f10(s, d):
    rows = op.star(reg.releases(s, d), reg.users(s, d), reg.assets(s, d)).select("classification")
    every = op.audit_filter(rows, classification="ALL").groupBy("classification").agg(F.count("*").alias("n"))
    return every.union(op.audit_filter(rows, classification="SECRET").groupBy(F.concat(F.lit("only "), "classification")).agg(F.count("*")))


@query("f11_authorised_documents", "SELECT user_id, asset_id FROM users JOIN encapsulations USING (user_id) JOIN assets USING (asset_id)")
def f11(s, d):
    held = reg.encapsulations(s, d).join(reg.assets(s, d).select("asset_id"), "asset_id", "left_semi")
    return held.join(reg.users(s, d).select("user_id"), "user_id", "left_semi").select("user_id", "asset_id")


@query("f12_row_level_scope", """, w AS (SELECT user_id, role IN ('NAVAL_AUDITOR', 'CRYPTO_CUSTODIAN', 'FORENSIC_ANALYST', 'ADMIN', 'INVESTIGATOR') AS sees_all FROM users)
SELECT w.user_id AS viewer_id, sees_all, CASE WHEN sees_all THEN (SELECT count(*) FROM releases) ELSE (SELECT count(*) FROM releases r WHERE r.user_id = w.user_id) END AS visible FROM w""")
def f12(s, d):
    return op.scoped(reg.releases(s, d), reg.users(s, d))


@query("f14_column_masking", "SELECT user_id, name, role, email, email IS NOT NULL AS can_sign_in, true AS writer FROM users UNION ALL SELECT user_id, name, role, NULL, NULL, false FROM users")
def f14(s, d):
    u = reg.users(s, d)
    return op.masked(u, True).withColumn("writer", F.lit(True)).unionByName(op.masked(u, False).withColumn("writer", F.lit(False)))


@query("f15_role_capability", """, u AS (SELECT user_id, CASE WHEN user_id % 13 = 0 THEN NULL WHEN user_id % 5 = 0 THEN lower(role) ELSE role END AS raw FROM users),
n AS (SELECT user_id, raw, CASE upper(coalesce(raw, 'TACTICAL_OFFICER')) WHEN 'ADMIN' THEN 'CRYPTO_CUSTODIAN' WHEN 'OFFICER' THEN 'TACTICAL_OFFICER' WHEN 'INVESTIGATOR' THEN 'FORENSIC_ANALYST' WHEN 'AUDITOR' THEN 'NAVAL_AUDITOR' ELSE upper(coalesce(raw, 'TACTICAL_OFFICER')) END AS norm FROM u)
SELECT user_id, norm, norm IN ('CRYPTO_CUSTODIAN', 'ADMIN') OR coalesce(raw IN ('CRYPTO_CUSTODIAN', 'ADMIN'), false) AS may_write FROM n""")
def f15(s, d):
    k = F.col("user_id")
    raw = F.when(k % 13 == 0, None).when(k % 5 == 0, F.lower("role")).otherwise(F.col("role"))
    return reg.users(s, d).select("user_id", raw.alias("raw")).select("user_id", op.normal_role(F.col("raw")).alias("norm"), op.can(F.col("raw"), reg.USERS_WRITE).alias("may_write"))


@query("f16_explorer_link", "SELECT event_id, CASE WHEN tx_hash IS NOT NULL AND chain_mode = 'sepolia' THEN 'https://sepolia.etherscan.io/tx/0x' || tx_hash END AS link FROM releases")
def f16(s, d):
    return reg.releases(s, d).select("event_id", op.explorer_link(F.col("tx_hash"), F.col("chain_mode")).alias("link"))


@query("f17_device_anomaly", "SELECT event_id, CASE WHEN coalesce(device_label, '') = '' OR regexp_matches(upper(device_label), 'UNKNOWN|EXTERNAL|MOBILE') THEN 'Unverified endpoint hardware (' || coalesce(nullif(device_label, ''), 'UNKNOWN') || ')' ELSE '' END AS warnings FROM releases")
def f17(s, d):
    return reg.releases(s, d).select("event_id", F.array_join(op.anomalies(F.col("device_label")), "; ").alias("warnings"))


@query("f18_registry_warnings", """, g AS (SELECT count(p_hash) AS n_index, count(*) FILTER (chain_mode <> 'off') AS n_on FROM releases)
SELECT concat_ws('; ', CASE WHEN n_index = 0 THEN 'Search index has not been built.' END, CASE WHEN n_on = 0 THEN 'Receipts are not being anchored.' END, CASE WHEN n_on > 0 AND (SELECT count(*) FROM ledger WHERE priority = 0) = 0 THEN 'Ledger is configured but not connected.' END) AS warnings, n_index FROM g""")
def f18(s, d):
    g = reg.releases(s, d).agg(F.count("p_hash").alias("n_index"), F.count_if(F.col("chain_mode") != "off").alias("n_on"))
    now = reg.ledger(s, d).filter("priority = 0").agg(F.count("*").alias("n_now"))
    said = F.array_compact(F.array(F.when(F.col("n_index") == 0, "Search index has not been built."), F.when(F.col("n_on") == 0, "Receipts are not being anchored."), F.when((F.col("n_on") > 0) & (F.col("n_now") == 0), "Ledger is configured but not connected.")))
    return g.crossJoin(now).select(F.array_join(said, "; ").alias("warnings"), "n_index")


@query("j1_register_star_join", f"SELECT event_id, name, dept, title, classification FROM {_STAR}")
def j1(s, d):
    return op.star(reg.releases(s, d), reg.users(s, d), reg.assets(s, d)).select("event_id", "name", "dept", "title", "classification")


@query("j9_key_holder_choice", """, e AS (SELECT asset_id, e.user_id, row_number() OVER (PARTITION BY asset_id ORDER BY (e.user_id % 100 = asset_id % 100) DESC, e.user_id) AS n FROM encapsulations e JOIN users u ON e.user_id = u.user_id WHERE has_kem)
SELECT asset_id, user_id FROM e WHERE n = 1""")
def j9(s, d):
    e = reg.encapsulations(s, d).join(reg.users(s, d).filter("has_kem").select("user_id"), "user_id")
    return op.latest(e, ["asset_id"], [F.desc(F.col("user_id") % 100 == F.col("asset_id") % 100), F.asc("user_id")]).select("asset_id", "user_id")


@query("j10_batch_dispatch_plan", """, q AS (SELECT asset_id, unnest([asset_id * 7 + 1, asset_id * 11 + 3, asset_id + 9000000]) AS user_id FROM assets),
x AS (SELECT q.*, active, has_kem, trim(CASE WHEN q.user_id = asset_id * 7 + 1 THEN CASE WHEN asset_id % 2 = 0 THEN ' own ' ELSE '  ' END ELSE 'common' END) AS pw FROM q LEFT JOIN users USING (user_id))
SELECT asset_id, user_id, CASE WHEN active IS NULL THEN 'unknown' WHEN NOT active THEN 'inactive' WHEN pw = '' THEN 'no passphrase' WHEN NOT has_kem THEN 'no key' ELSE 'ready' END AS status FROM x""")
def j10(s, d):
    a, first = F.col("asset_id"), F.col("asset_id") * 7 + 1
    asked = reg.assets(s, d).select(a, F.array(first, a * 11 + 3, a + 9000000).alias("user_ids"), F.create_map(first, F.when(a % 2 == 0, " own ").otherwise("  ")).alias("passphrases"))
    return op.dispatch_plan(asked, reg.users(s, d), "common")


@query("r18_dispatch_summary", """, q AS (SELECT asset_id, unnest([asset_id * 7 + 1, asset_id * 11 + 3]) AS user_id FROM assets)
SELECT asset_id, count(*) AS asked, count(*) FILTER (coalesce(active AND has_kem, false)) AS sent FROM q LEFT JOIN users USING (user_id) GROUP BY asset_id""")
def r18(s, d):
    a = F.col("asset_id")
    asked = reg.assets(s, d).select(a, F.array(a * 7 + 1, a * 11 + 3).alias("user_ids"), F.create_map(F.lit(-1).cast("bigint"), F.lit("")).alias("passphrases"))
    return op.dispatch_plan(asked, reg.users(s, d), "common").groupBy("asset_id").agg(F.count("*").alias("asked"), F.count_if(F.col("status") == "ready").alias("sent"))


@query("j11_prefix_file_lookup", "SELECT r.event_id, f.event_id AS file_of FROM releases r JOIN releases f ON substr(r.receipt_id, 1, 16) = regexp_extract(f.marked_path, '([0-9a-f]{16})', 1) WHERE f.marked_path IS NOT NULL")
def j11(s, d):
    r = reg.releases(s, d)
    files = r.filter("marked_path IS NOT NULL").select(F.col("event_id").alias("file_of"), F.regexp_extract("marked_path", "([0-9a-f]{16})", 1).alias("k"))
    return r.select("event_id", F.substring("receipt_id", 1, 16).alias("k")).join(files, "k").select("event_id", "file_of")


@query("j12_investigation_release", "SELECT investigation_id, event_id, user_id FROM investigations LEFT JOIN releases ON top_receipt_id = receipt_id")
def j12(s, d):
    r = reg.releases(s, d).select("receipt_id", "event_id", "user_id")
    return reg.investigations(s, d).join(r, F.col("top_receipt_id") == F.col("receipt_id"), "left").select("investigation_id", "event_id", "user_id")


@query("j14_missing_encapsulation", "SELECT DISTINCT a.asset_id, u.user_id FROM assets a JOIN users u ON u.user_id = a.asset_id WHERE u.has_kem AND NOT EXISTS (SELECT 1 FROM encapsulations e WHERE e.asset_id = a.asset_id AND e.user_id = u.user_id)")
def j14(s, d):
    wanted = reg.users(s, d).filter("has_kem").select(F.col("user_id").alias("asset_id"), "user_id").join(reg.assets(s, d).select("asset_id"), "asset_id", "left_semi")
    return wanted.join(reg.encapsulations(s, d), ["asset_id", "user_id"], "left_anti").select("asset_id", "user_id")


@query("j15_allotment_list", "SELECT asset_id, user_id, name, passphrase IS NOT NULL AS has_passphrase FROM encapsulations JOIN users USING (user_id)")
def j15(s, d):
    return reg.encapsulations(s, d).join(reg.users(s, d), "user_id").select("asset_id", "user_id", "name", F.col("passphrase").isNotNull().alias("has_passphrase"))


@query("j19_release_list", "SELECT event_id, asset_id, name, coalesce(device_label, 'UNKNOWN') AS device, floor(psnr_db * 10 + 0.5) / 10 AS psnr, marked_path IS NOT NULL AS has_marked_file, row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, event_id DESC) AS place FROM releases JOIN users USING (user_id)")
def j19(s, d):
    rows = reg.releases(s, d).join(reg.users(s, d).select("user_id", "name"), "user_id")
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy(*op.newest_first()))
    return rows.select("event_id", "asset_id", "name", F.coalesce("device_label", F.lit("UNKNOWN")).alias("device"), bits.half_up(F.col("psnr_db"), 1).alias("psnr"), F.col("marked_path").isNotNull().alias("has_marked_file"), place.alias("place"))


@query("r1_asset_roll_up", """SELECT asset_id, (SELECT count(*) FROM releases r WHERE r.asset_id = a.asset_id) AS n_releases, (SELECT count(*) FROM encapsulations e WHERE e.asset_id = a.asset_id) AS n_encapsulations,
coalesce((SELECT string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) FROM encapsulations e WHERE e.asset_id = a.asset_id), '') AS recipients FROM assets a""")
def r1(s, d):
    return op.roll_up(reg.assets(s, d), reg.releases(s, d), reg.encapsulations(s, d))


@query("r2_registry_overview", "SELECT count(*) AS documents, count(*) FILTER (classification = 'SECRET') AS secret, (SELECT count(*) FROM releases JOIN assets USING (asset_id)) AS releases FROM assets")
def r2(s, d):
    a = op.roll_up(reg.assets(s, d), reg.releases(s, d), reg.encapsulations(s, d)).join(reg.assets(s, d).select("asset_id", "classification"), "asset_id")
    return a.agg(F.count("*").alias("documents"), F.count_if(F.col("classification") == "SECRET").alias("secret"), F.sum("n_releases").alias("releases"))


@query("r3_page_envelope", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM releases")
def r3(s, d):
    return op.envelope(reg.releases(s, d), 50)


_RECENT = ", n AS (SELECT * FROM releases ORDER BY created_at DESC, event_id DESC LIMIT 50), m AS (SELECT * FROM n WHERE psnr_db > 0 AND isfinite(psnr_db))"


@query("r4_fidelity_telemetry", _RECENT + """ SELECT (SELECT count(*) FROM n) AS sample_count, (SELECT count(*) FROM m) AS measured_count, coalesce((SELECT floor(avg(psnr_db) * 10 + 0.5) / 10 FROM m), 0) AS avg_psnr,
(SELECT floor(min(psnr_db) * 10 + 0.5) / 10 FROM m) AS min_psnr, (SELECT floor(max(psnr_db) * 10 + 0.5) / 10 FROM m) AS max_psnr, (SELECT min(delta_used) FROM n) AS min_delta, (SELECT max(delta_used) FROM n) AS max_delta, (SELECT count(*) FROM releases) AS total""")
def r4(s, d):
    return op.telemetry(reg.releases(s, d))


@query("r5_key_enrolment", "SELECT count(*) FILTER (has_kem AND has_dsa) AS enrolled, count(*) FILTER (NOT (has_kem AND has_dsa)) AS pending FROM users")
def r5(s, d):
    both = F.col("has_kem") & F.col("has_dsa")
    return reg.users(s, d).agg(F.count_if(both).alias("enrolled"), F.count_if(~both).alias("pending"))


@query("r12_receipts_per_asset", "SELECT asset_id, count(*) AS n, md5(string_agg(receipt_id, ',' ORDER BY receipt_id)) AS digest, sum(count(*)) OVER () AS total FROM (SELECT DISTINCT asset_id, receipt_id FROM ledger) GROUP BY asset_id")
def r12(s, d):
    rows = reg.ledger(s, d).select("asset_id", "receipt_id").distinct()
    per = rows.groupBy("asset_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("receipt_id")), ",")).alias("digest"))
    return per.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("r15_index_stats", "SELECT count(*) AS releases, count(p_hash) AS p, count(d_hash) AS d, count(a_hash) AS a, (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM assets) AS assets FROM releases")
def r15(s, d):
    r = reg.releases(s, d).agg(F.count("*").alias("releases"), F.count("p_hash").alias("p"), F.count("d_hash").alias("d"), F.count("a_hash").alias("a"))
    return r.crossJoin(reg.users(s, d).agg(F.count("*").alias("users"))).crossJoin(reg.assets(s, d).agg(F.count("*").alias("assets")))


@query("r20_upper_median", ", g AS (SELECT tile_id, list_sort(px) AS p FROM tiles) SELECT tile_id, p[len(p) // 2 + 1] AS median, p[CAST(floor(0.9 * (len(p) - 1)) AS BIGINT) + 1] AS q90 FROM g")
def r20(s, d):
    t = reg.tiles(s, d).select("tile_id", F.sort_array("px").alias("p"))
    return t.select("tile_id", F.col("p")[F.floor(F.size("p") / 2).cast("int")].alias("median"), F.col("p")[F.floor(0.9 * (F.size("p") - 1)).cast("int")].alias("q90"))


@query("w3_newest_n", "SELECT * FROM (SELECT event_id, asset_id, row_number() OVER (ORDER BY created_at DESC, event_id DESC) AS place FROM releases) WHERE place <= 50")
def w3(s, d):
    return op.newest(reg.releases(s, d).select("event_id", "asset_id", "created_at"), 50).select("event_id", "asset_id", F.row_number().over(Window.orderBy(*op.newest_first())).alias("place"))


@query("w4_telemetry_series", _RECENT + " SELECT row_number() OVER (ORDER BY created_at, event_id) AS idx, event_id, floor(psnr_db * 10 + 0.5) / 10 AS psnr, delta_used AS delta FROM m")
def w4(s, d):
    return op.series(reg.releases(s, d))


@query("w5_latest_per_key", """, up AS (SELECT asset_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'new-' || event_id END AS pw, row_number() OVER (PARTITION BY asset_id, user_id ORDER BY created_at DESC, event_id DESC) AS n FROM releases)
SELECT asset_id, user_id, coalesce(pw, passphrase) AS passphrase FROM encapsulations JOIN up USING (asset_id, user_id) WHERE n = 1""")
def w5(s, d):
    r = reg.releases(s, d).select("asset_id", "user_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("new-"), F.col("event_id").cast("string"))).alias("passphrase"), "created_at", "event_id")
    new = op.latest(r, ["asset_id", "user_id"], op.newest_first())
    return op.upsert(reg.encapsulations(s, d), new, ["asset_id", "user_id"], "passphrase")


@query("w6_first_by_priority", ", f AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY priority, copy, seq) AS n FROM ledger) SELECT receipt_id, priority, asset_id, seq FROM f WHERE n = 1")
def w6(s, d):
    best = F.min(F.struct("priority", "copy", "seq", "asset_id")).alias("b")
    return reg.ledger(s, d).groupBy("receipt_id").agg(best).select("receipt_id", "b.priority", "b.asset_id", "b.seq")


@query("o1_offset_paging", "SELECT event_id, created_at FROM releases ORDER BY created_at DESC, event_id DESC LIMIT 50 OFFSET 100")
def o1(s, d):
    return op.page(reg.releases(s, d).select("event_id", "created_at"), 3, 50)


@query("o2_ordered_listing", "SELECT user_id, row_number() OVER (PARTITION BY dept ORDER BY user_id) AS place, dept FROM users")
def o2(s, d):
    return reg.users(s, d).select("user_id", F.row_number().over(Window.partitionBy("dept").orderBy("user_id")).alias("place"), "dept")


@query("o4_five_way_sort", """, i AS (SELECT investigation_id, created_at, verdict, coalesce(confidence, 0) AS c FROM investigations WHERE verdict = 'ATTRIBUTED')
SELECT * FROM (SELECT 'newest' AS way, investigation_id, row_number() OVER (ORDER BY created_at DESC, investigation_id) AS place FROM i UNION ALL SELECT 'oldest', investigation_id, row_number() OVER (ORDER BY created_at, investigation_id) FROM i
UNION ALL SELECT 'confidence-desc', investigation_id, row_number() OVER (ORDER BY c DESC, investigation_id) FROM i UNION ALL SELECT 'confidence-asc', investigation_id, row_number() OVER (ORDER BY c, investigation_id) FROM i
UNION ALL SELECT 'verdict', investigation_id, row_number() OVER (ORDER BY verdict, investigation_id) FROM i) WHERE place <= 25""")
def o4(s, d):
    i, out = reg.investigations(s, d).filter("verdict = 'ATTRIBUTED'"), None
    for way in ("newest", "oldest", "confidence-desc", "confidence-asc", "verdict"):
        top = i.orderBy(*op.five_ways(way)).limit(25)  # the list shows 25
        rows = top.select(F.lit(way).alias("way"), "investigation_id", F.row_number().over(Window.orderBy(*op.five_ways(way))).alias("place"))
        out = rows if out is None else out.union(rows)
    return out


@query("v1_classification_outside", "SELECT asset_id, classification FROM assets WHERE classification NOT IN ('RESTRICTED', 'CONFIDENTIAL', 'SECRET')")
def v1(s, d):
    return reg.assets(s, d).filter(~F.col("classification").isin(*reg.CLASSIFICATIONS)).select("asset_id", "classification")


@query("v2_stored_ids", """, x AS (SELECT event_id, CAST('0x' || substr(receipt_id, 1, 9) AS BIGINT) AS want, CASE WHEN event_id % 97 = 0 THEN short_id + 1 ELSE short_id END AS have, CASE WHEN event_id % 89 = 0 THEN xor(payload, 16) ELSE payload END AS payload FROM releases)
SELECT event_id, have <> want AS wrong_id, CAST(""" + reg.SQL_CRC.format(x="(payload >> 12)") + """ AS BIGINT) <> ((payload >> 4) & 255) AS wrong_crc FROM x WHERE have <> want OR CAST(""" + reg.SQL_CRC.format(x="(payload >> 12)") + """ AS BIGINT) <> ((payload >> 4) & 255)""")
def v2(s, d):
    k = F.col("event_id")
    x = reg.releases(s, d).select("event_id", bits.short_id(F.col("receipt_id")).alias("want"), F.when(k % 97 == 0, F.col("short_id") + 1).otherwise(F.col("short_id")).alias("have"), F.when(k % 89 == 0, F.col("payload").bitwiseXOR(F.lit(16))).otherwise(F.col("payload")).alias("payload"))
    wrong = bits.crc8(bits.payload_id(F.col("payload"))) != bits.payload_crc(F.col("payload"))
    found = F.struct("event_id", (F.col("have") != F.col("want")).alias("wrong_id"), wrong.alias("wrong_crc"))
    return x.select(F.inline(F.array(found))).filter("wrong_id OR wrong_crc")  # a row for a row: the filter stays above


@query("v3_unmeasured_fidelity", "SELECT event_id, asset_id FROM releases JOIN assets USING (asset_id) WHERE psnr_db <= 0 AND mime_type = 'application/pdf'")
def v3(s, d):
    return reg.releases(s, d).join(reg.assets(s, d).filter("mime_type = 'application/pdf'").select("asset_id"), "asset_id", "left_semi").filter("psnr_db <= 0").select("event_id", "asset_id")


@query("v4_uniqueness", "SELECT 'receipt_id' AS col, receipt_id AS value, count(*) AS n FROM ledger GROUP BY receipt_id HAVING count(*) > 1 UNION ALL SELECT 'short_id', CAST(short_id AS VARCHAR), count(*) FROM releases GROUP BY short_id HAVING count(*) > 1 UNION ALL SELECT 'pair', asset_id || '/' || user_id, count(*) FROM releases GROUP BY asset_id, user_id HAVING count(*) > 1 UNION ALL SELECT 'email', email, count(*) FROM users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1")
def v4(s, d):
    r = reg.releases(s, d)
    each = {"receipt_id": (reg.ledger(s, d), F.col("receipt_id")), "short_id": (r, F.col("short_id").cast("string")), "pair": (r, F.concat_ws("/", F.col("asset_id").cast("string"), F.col("user_id").cast("string"))), "email": (reg.users(s, d).filter("email IS NOT NULL"), F.col("email"))}
    out = None
    for name, (rows, value) in each.items():
        twice = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("col"), "value", "n")
        out = twice if out is None else out.union(twice)
    return out
