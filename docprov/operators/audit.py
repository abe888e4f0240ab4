"""Register audits: filters, joins, roll-ups, windows and paging over the register's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.sources import register as reg

_REF_SALT = "docprov"


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("event_id")]


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The n newest rows; equal times by falling event_id."""
    return rows.orderBy(*newest_first()).limit(n)


def audit_filter(rows: DataFrame, user_id=None, asset_id=None, classification=None, since=None, until=None) -> DataFrame:
    """All given conditions together; one that is None adds nothing. Both time limits are inclusive."""
    for name, value in (("user_id", user_id), ("asset_id", asset_id), ("classification", classification)):
        if value is not None and not (name == "classification" and value == "ALL"):
            rows = rows.filter(F.col(name) == value)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.filter(F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
    return rows


def star(releases: DataFrame, users: DataFrame, assets: DataFrame) -> DataFrame:
    """Releases with their user's and asset's columns."""
    return releases.join(users, "user_id").join(assets, "asset_id")


def page(rows: DataFrame, number: int = 1, limit: int = 50) -> DataFrame:
    """A page of rows, newest first; number from 1, limit 1 to 200."""
    if number < 1 or not 1 <= limit <= 200:
        raise ValueError("page from 1, limit 1 to 200")
    return rows.orderBy(*newest_first()).offset((number - 1) * limit).limit(limit)


def envelope(rows: DataFrame, limit: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / limit).cast("long").alias("pages"))


def normal_role(role: Column) -> Column:
    """Aliases resolved; null is a tactical officer."""
    aliases = F.create_map(*(F.lit(x) for kv in reg.ALIASES.items() for x in kv))
    upper = F.upper(F.coalesce(role, F.lit("TACTICAL_OFFICER")))
    return F.coalesce(aliases[upper], upper)


def can(role: Column, holders: tuple[str, ...]) -> Column:
    return F.coalesce(normal_role(role).isin(*holders) | role.isin(*holders), F.lit(False))


def scoped(rows: DataFrame, viewers: DataFrame) -> DataFrame:
    """(viewer, row) pairs a viewer may see in brief: who holds audit:read sees all, others their own; as counts of rows.

    viewers: user_id, role. The all-seeing get one number, so no pairs are made.
    """
    own = rows.groupBy("user_id").agg(F.count("*").alias("own"))
    total = rows.agg(F.count("*").alias("every"))
    seen = viewers.select("user_id", can(F.col("role"), reg.AUDIT_READ).alias("sees_all")).join(own, "user_id", "left")
    return seen.join(F.broadcast(total)).select(F.col("user_id").alias("viewer_id"), "sees_all", F.when(F.col("sees_all"), F.col("every")).otherwise(F.coalesce("own", F.lit(0))).alias("visible"))


def device_anomaly(label: Column) -> Column:
    upper = F.upper(F.coalesce(label, F.lit("")))
    return (upper == "") | upper.rlike("UNKNOWN|EXTERNAL|MOBILE")


def anomalies(label: Column) -> Column:
    """The list of warnings about a device; empty if there is none."""
    shown = F.when(F.coalesce(label, F.lit("")) == "", "UNKNOWN").otherwise(label)
    return F.array_compact(F.array(F.when(device_anomaly(label), F.concat(F.lit("Unverified endpoint hardware ("), shown, F.lit(")")))))


def explorer_link(tx: Column, mode: Column) -> Column:
    """Null unless there is a transaction on a public network."""
    return F.when(tx.isNotNull() & (mode == "sepolia"), F.concat(F.lit("https://sepolia.etherscan.io/tx/0x"), tx))


def masked(users: DataFrame, viewer_may_write: bool) -> DataFrame:
    """Users with the columns that only a writer may see null for others."""
    own = F.col("email") if viewer_may_write else F.lit(None).cast("string")
    return users.select("user_id", "name", "role", own.alias("email"), F.when(F.lit(viewer_may_write), F.col("email").isNotNull()).alias("can_sign_in"))


def roll_up(assets: DataFrame, releases: DataFrame, encapsulations: DataFrame) -> DataFrame:
    """Per asset its releases, encapsulations and recipients; each side is gathered before the joins."""
    r = releases.groupBy("asset_id").agg(F.count("*").alias("n_releases"))
    e = encapsulations.groupBy("asset_id").agg(F.count("*").alias("n_encapsulations"), F.sort_array(F.collect_set("user_id")).alias("ids"))
    joined = assets.join(r, "asset_id", "left").join(e, "asset_id", "left")
    return joined.select("asset_id", F.coalesce("n_releases", F.lit(0)).alias("n_releases"), F.coalesce("n_encapsulations", F.lit(0)).alias("n_encapsulations"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("recipients"))


def telemetry(rows: DataFrame, newest_n: int = 50, default_delta: int = 12) -> DataFrame:
    """Fidelity over the newest rows: averages only of measured ones, strengths of all; total over all rows."""
    recent = newest(rows.select("event_id", "created_at", "psnr_db", "delta_used"), newest_n)
    known = F.when((F.col("psnr_db") > 0) & (F.col("psnr_db") < float("inf")), F.col("psnr_db"))
    few = recent.agg(
        F.count("*").alias("sample_count"),
        F.count(known).alias("measured_count"),
        F.coalesce(bits.half_up(F.avg(known), 1), F.lit(0.0)).alias("avg_psnr"),
        bits.half_up(F.min(known), 1).alias("min_psnr"),
        bits.half_up(F.max(known), 1).alias("max_psnr"),
        F.coalesce(F.min("delta_used"), F.lit(default_delta)).alias("min_delta"),
        F.coalesce(F.max("delta_used"), F.lit(default_delta)).alias("max_delta"),
    )
    return few.crossJoin(rows.agg(F.count("*").alias("total")))


def series(rows: DataFrame, newest_n: int = 50) -> DataFrame:
    """Measured rows of the newest, numbered in order of time."""
    recent = newest(rows.select("event_id", "created_at", "psnr_db", "delta_used"), newest_n).filter("psnr_db > 0")
    return recent.select(F.row_number().over(Window.orderBy("created_at", "event_id")).alias("idx"), "event_id", bits.half_up(F.col("psnr_db"), 1).alias("psnr"), F.col("delta_used").alias("delta"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: str) -> DataFrame:
    """old with the rows of new put over those of equal key; a null `keep` in new leaves the old value."""
    a, b = old.select(*key, F.col(keep).alias("_old")), new.select(*key, F.col(keep).alias("_new"))
    return a.join(b, key, "full").select(*key, F.coalesce("_new", "_old").alias(keep))


def validated(rows: DataFrame) -> DataFrame:
    """Raw text columns coerced, defaulted and checked; reasons lists what is wrong (an empty list passes)."""
    page_no, limit = F.coalesce(F.expr("try_cast(page AS INT)"), F.when(F.col("page").isNull(), 1)), F.coalesce(F.expr("try_cast(lim AS INT)"), F.when(F.col("lim").isNull(), 50))
    why = F.array_compact(F.array(
        F.when(page_no.isNull() | (page_no < 1), "page"),
        F.when(limit.isNull() | ~limit.between(1, 200), "limit"),
        F.when(F.col("classification").isNotNull() & ~F.col("classification").isin(*reg.CLASSIFICATIONS, "ALL"), "classification"),
    ))
    return rows.select("id", page_no.alias("page"), limit.alias("lim"), F.array_join(why, ",").alias("reasons"))


def recipients(text: Column) -> Column:
    """Positive integers of a JSON array or a comma list; null if nothing can be read."""
    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<int>")).otherwise(F.transform(F.split(text, ","), lambda x: x.try_cast("int")))
    good = F.filter(listed, lambda x: x > 0)
    return F.when(F.size(good) > 0, good)


def dispatch_plan(requests: DataFrame, users: DataFrame, common: str | None) -> DataFrame:
    """Each wanted recipient with a status: unknown, inactive, no key, no passphrase, or ready.

    requests: asset_id, user_ids (array), passphrases (map of user_id to text).
    """
    wanted = requests.select("asset_id", F.explode("user_ids").alias("user_id"), "passphrases")
    joined = wanted.join(users.select("user_id", "active", "has_kem"), "user_id", "left")
    secret = F.trim(F.coalesce(F.col("passphrases")[F.col("user_id")], F.lit(common)))
    status = F.when(F.col("active").isNull(), "unknown").when(~F.col("active"), "inactive").when(F.coalesce(secret, F.lit("")) == "", "no passphrase").when(~F.col("has_kem"), "no key").otherwise("ready")
    return joined.select("asset_id", "user_id", status.alias("status"))


def reference(kind: str, value: Column) -> Column:
    """Pseudonym of a value; null counts as `unknown`."""
    return F.sha2(F.concat_ws(":", F.lit(kind), F.coalesce(value.cast("string"), F.lit("unknown")), F.lit(_REF_SALT)), 256)


def search(rows: DataFrame, term: str) -> DataFrame:
    """Investigations whose number, verdict or date holds the term, case aside."""
    digits = F.col("investigation_id").cast("string")
    number = F.concat(F.lit("inv-"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))  # lpad cuts longer ones
    hay = (number, F.lower("verdict"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    want = term.strip().lower()
    found = hay[0].contains(want) | hay[1].contains(want) | hay[2].contains(want)
    return rows.filter(found) if want else rows


def within_days(rows: DataFrame, as_of: str, days: int | None) -> DataFrame:
    return rows if days is None else rows.filter(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS"))


def five_ways(by: str) -> list[Column]:
    """Sort columns of an investigations list."""
    sure = F.coalesce("confidence", F.lit(0.0))
    ways = {"newest": F.desc("created_at"), "oldest": F.asc("created_at"), "confidence-desc": sure.desc(), "confidence-asc": sure.asc(), "verdict": F.asc("verdict")}
    return [ways[by], F.asc("investigation_id")]
