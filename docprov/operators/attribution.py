"""Attribution of leaks: Hamming radius joins, ranking, margin rule, confidence, redaction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.operators import near
from docprov.sources.files import written
from docprov.sources.register import verdict

RADIUS, WIDER, WIDEST = 12, 28, 34
#: Up to this radius bands ask for some thousand values a leak; beyond it nearly any two hashes match.
NARROW = 15
#: Pairs that a task of a nested loop compares, and how many tasks there are at most.
TASK_PAIRS, MOST_TASKS = 50_000_000, 4096
_HASHES = ("p_hash", "d_hash", "a_hash")


def _shares(rows: DataFrame, most: int) -> bool:
    """True if rows has at most `most` rows; no more are read than that takes."""
    return rows.limit(most + 1).count() <= most


def _loops(leaks: DataFrame, register: DataFrame, most: int, most_pairs: int = 1_000_000_000) -> bool:
    """True if a nested loop is cheap: leaks few enough to broadcast, and so few pairs that comparing all costs less than bands."""
    return _shares(leaks, most) and leaks.count() * register.count() <= most_pairs


def nested(leaks: DataFrame, register: DataFrame, near: Column, most: int = 100_000) -> DataFrame:
    """Pairs for which near holds: leaks, counted first, are broadcast; a larger side is dealt in blocks. The register is dealt to tasks
    by the number of pairs, as a small file would be one task's however many leaks it meets."""
    if not _shares(leaks, most):
        return gridded(leaks, register, near)
    tasks = min(MOST_TASKS, leaks.count() * register.count() // TASK_PAIRS)
    return (register.repartition(tasks, "event_id") if tasks > 1 else register).join(F.broadcast(leaks), near)


def gridded(leaks: DataFrame, register: DataFrame, near: Column, block_rows: int = 50_000, shard_rows: int = 500_000) -> DataFrame:
    """Pairs for which near holds, of any number of leaks: each block of leaks meets each shard of the register in a join on
    the two numbers, so that neither side is broadcast and no task holds more than one of each."""
    blocks, shards = (max(1, math.ceil(rows.count() / most)) for rows, most in ((leaks, block_rows), (register, shard_rows)))
    a = leaks.withColumn("_block", F.pmod(F.xxhash64("leak_id"), F.lit(blocks)).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    b = register.withColumn("_of_shard", F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int")).withColumn("_of_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return b.join(a, (F.col("_block") == F.col("_of_block")) & (F.col("_shard") == F.col("_of_shard")) & near).drop("_block", "_shard", "_of_block", "_of_shard")


def banded(leaks: DataFrame, register: DataFrame, hash_of_leak: str, hash_of_release: str, radius: int) -> DataFrame:
    """leak_id, event_id and distance of pairs within radius, each once: see near.pairs()."""
    of = leaks.select("leak_id", F.col(hash_of_leak).alias("h")), register.withColumn("h", F.col(hash_of_release))
    return near.pairs(*of, ("h",), radius).drop("kind")


def as_leaks(leaks: DataFrame) -> DataFrame:
    """leaks with hashes renamed, to stand beside a register."""
    return leaks.select("leak_id", "read_bits", *(F.col(h).alias(f"leak_{h}") for h in _HASHES))


def radius_join(leaks: DataFrame, register: DataFrame, radius: int = RADIUS, most: int = 100_000) -> DataFrame:
    """leak_id, event_id, distance of pHashes within radius: a nested loop while leaks are few; beyond, bands or (wide) blocks."""
    a = as_leaks(leaks).filter("leak_p_hash IS NOT NULL").select("leak_id", "leak_p_hash")
    b = register.filter("p_hash IS NOT NULL").select("event_id", "p_hash")
    far = bits.hamming(F.col("leak_p_hash"), F.col("p_hash"))
    if radius > NARROW or _loops(a, b, most):
        return nested(a, b, far <= radius, most).select("leak_id", "event_id", far.alias("distance"))
    return banded(a, register, "leak_p_hash", "p_hash", radius)


def three_way(leaks: DataFrame, register: DataFrame, radius: int = RADIUS, most: int = 100_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates that any hash has within radius; a distance outside it is null; best is the least.

    A nested loop while leaks and pairs are few. Beyond, a narrow radius is joined in bands, hash by hash, and the first hash that
    finds a pair tells all its distances; a wide one in blocks. carry: columns of the register that come along, with the leak's read_bits.
    """
    names = ("p_dist", "d_dist", "a_dist")
    if radius <= NARROW and not _loops(leaks, register, most):
        own = ("read_bits",) if carry else ()
        return near.candidates(leaks, register, _HASHES, names, radius, carry, own).withColumn("best", F.least(*names))
    far = {h: bits.hamming(F.col(f"leak_{h}"), F.col(h)) for h in _HASHES}
    close = [F.coalesce(far[h] <= radius, F.lit(False)) for h in _HASHES]
    a, b = as_leaks(leaks), register.select("event_id", *_HASHES, *carry)
    along = [*carry, "read_bits"] if carry else []
    a = a if carry else a.drop("read_bits")
    pairs = nested(a, b, close[0] | close[1] | close[2], most)
    kept = [F.when(far[h] <= radius, far[h]).alias(n) for h, n in zip(_HASHES, names, strict=True)]
    return pairs.select("leak_id", "event_id", *kept, *along).withColumn("best", F.least("p_dist", "d_dist", "a_dist"))


def tiered(leaks: DataFrame, register: DataFrame, tiers: tuple[int, ...] = (RADIUS, WIDER, WIDEST)) -> DataFrame:
    """three_way at the first tier that finds anything for a leak; a wider tier only sees the leaks still empty.

    The leaks left for the next tier are written, so that no tier is searched again for each wider one, and so are both sides, whose
    derivation would make the loop's code too long to be compiled, and the pairs of a narrow tier, which are few.
    """
    alike = [c for c in register.columns if c == "asset_id"]
    out, rest, register = None, written(leaks.select("leak_id", "read_bits", *_HASHES), "leaks"), written(register.select("event_id", *alike, *_HASHES), "register")
    for radius in tiers:
        found = three_way(rest, register, radius).withColumn("tier", F.lit(radius))
        found = written(found, "found") if radius <= NARROW else found
        out = found if out is None else out.unionByName(found)
        if radius != tiers[-1]:
            rest = written(rest.join(found.select("leak_id").distinct(), "leak_id", "left_anti"), "rest")
    return out


def named_exactly(leaks: DataFrame, register: DataFrame, repair: bool = False) -> DataFrame:
    """Every leak with the release its bits name, if their CRC holds; null else."""
    read = bits.repaired(F.col("read_bits")) if repair else F.col("read_bits")
    known = leaks.select("leak_id", read.alias("payload_read")).select("leak_id", F.inline(F.array(F.struct("payload_read"))))
    own = known.select("leak_id", bits.payload_id(F.col("payload_read")).alias("own"), bits.crc_ok(F.col("payload_read")).alias("crc_ok"))
    r = register.select(F.col("short_id"), F.col("event_id"), F.col("user_id"))
    return own.join(r, (F.col("own") == F.col("short_id")) & F.col("crc_ok"), "left").select("leak_id", "crc_ok", "event_id", "user_id")


def pool(leaks: DataFrame, register: DataFrame, candidates: DataFrame, newest: int = 50, once: bool = True) -> DataFrame:
    """Each leak's candidates and the newest releases, with the bits that agree; `once` drops repeats, which maxima don't need."""
    recent = register.orderBy(F.desc("created_at"), F.desc("event_id")).limit(newest).select("event_id")
    wide = leaks.select("leak_id").join(F.broadcast(recent))  # newest is a constant: so many rows for each leak
    ids = wide.union(candidates.select("leak_id", "event_id"))
    ids = ids.dropDuplicates(["leak_id", "event_id"]) if once else ids
    r = register.select("event_id", "user_id", "created_at", "payload")
    return ids.join(leaks.select("leak_id", "read_bits"), "leak_id").join(r, "event_id").select("leak_id", "event_id", "user_id", "created_at", bits.matching(F.col("read_bits"), F.col("payload")).alias("matches"))


def pooled(leaks: DataFrame, register: DataFrame, newest: int = 50) -> DataFrame:
    """pool() of three_way()'s candidates: releases' columns come along with the pairs, each of which is found once, so that none of
    these rows, as many as leaks times releases ask for, is moved: only the newest releases are taken out of the candidates."""
    columns = ("user_id", "created_at", "payload")
    alike = [c for c in register.columns if c == "asset_id"]
    register, leaks = written(register.select("event_id", *alike, *columns, *_HASHES), "register"), written(leaks.select("leak_id", "read_bits", *_HASHES), "leaks")
    recent = F.broadcast(written(register.orderBy(F.desc("created_at"), F.desc("event_id")).limit(newest).select("event_id", *columns), "recent"))
    late = leaks.select("leak_id", "read_bits").join(recent)  # newest is a constant: so many rows for each leak
    older = three_way(leaks, register, carry=columns).join(recent.select("event_id"), "event_id", "left_anti")
    rows = ("leak_id", "event_id", "user_id", "created_at", bits.matching(F.col("read_bits"), F.col("payload")).alias("matches"))
    return late.select(*rows).union(older.select(*rows))


def _order() -> list[Column]:
    return [F.desc(c) for c in ("matches", "created_at", "event_id")]


def suspects(pooled: DataFrame, n: int = 5) -> DataFrame:
    """The n best per leak, by user id only."""
    place = F.row_number().over(Window.partitionBy("leak_id").orderBy(*_order()))
    pct = bits.half_up(F.col("matches") / 48 * 100).cast("long")
    level = F.when(F.col("matches") >= 34, "HIGH").when(F.col("matches") >= 26, "MEDIUM").otherwise("LOW")
    return pooled.withColumn("place", place).filter(F.col("place") <= n).select("leak_id", "place", "event_id", "user_id", "matches", pct.alias("pct"), level.alias("level"))


_TIME_BITS = 57


def packed(matches: Column, created_at: Column, event_id: Column) -> Column:
    """(matches, created_at, event_id) as one number of the same order, decimal(38,0): maxima of it stay in hash aggregates. Times are
    microseconds from 1970 on, null and earlier ones counting as its start; ids are not negative."""
    micros = F.coalesce(F.unix_micros(created_at.cast("timestamp")), F.lit(0))
    high = matches.cast("long") * (1 << _TIME_BITS) + F.greatest(F.lit(0), F.least(F.lit((1 << _TIME_BITS) - 1), micros))
    return (high.cast("decimal(19,0)") * F.expr("CAST('10000000000000000000' AS DECIMAL(20,0))")).cast("decimal(38,0)") + event_id.cast("decimal(19,0)")


def matches_of(best: str) -> Column:
    return F.shiftright(F.expr(f"{best} div 10000000000000000000"), _TIME_BITS).cast("int")


def event_of(best: str) -> Column:
    return F.expr(f"CAST({best} % 10000000000000000000 AS BIGINT)")


def best_of_users(leaks: DataFrame, register: DataFrame, tiers: tuple[int, ...] = (RADIUS,), newest: int = 50, least: int = 0) -> DataFrame:
    """leak_id, user_id and b: of each user's candidates (at the first tier that finds any) and newest releases the one with the
    most agreeing bits, as packed().

    Releases' columns come along with the pairs, so that pairs are reduced in the task that finds them, by hash: what moves is a row
    per leak and user, however many candidates a wide tier has. least: candidates of fewer bits only tell that their tier found
    something; with 29, whatever the margin rule decides is decided alike, as it takes no top below 30 and a rival of 28 or
    fewer leaves such a top its margin.
    """
    columns = ("user_id", "created_at", "payload")
    # both are written: how they are derived would make the loop's code too long to be compiled, and tiers read them again
    alike = [c for c in register.columns if c == "asset_id"]
    register, leaks = written(register.select("event_id", *alike, *columns, *_HASHES), "register"), written(leaks.select("leak_id", "read_bits", *_HASHES), "leaks")
    matching = bits.matching(F.col("read_bits"), F.col("payload"))
    some, b = (matching >= least).alias("some"), packed(matching, F.col("created_at"), F.col("event_id"))
    own = F.when(matching >= least, F.col("user_id")).alias("user_id")
    recent = register.orderBy(F.desc("created_at"), F.desc("event_id")).limit(newest).select("event_id", *columns)
    late = leaks.select("leak_id", "read_bits").join(F.broadcast(recent))  # newest is a constant: so many rows for each leak
    out, rest = late.filter(matching >= least).groupBy("leak_id", "user_id").agg(F.max(b).alias("b")), leaks
    for radius in tiers:
        pairs = three_way(rest, register, radius, carry=columns)
        found = pairs.select("leak_id", some, own, F.when(matching >= least, b).alias("b")).groupBy("leak_id", "some", "user_id").agg(F.max("b").alias("b"))
        if radius != tiers[-1]:
            found = written(found, "best")
            rest = written(rest.join(found.select("leak_id").distinct(), "leak_id", "left_anti"), "rest")
        out = out.unionByName(found.filter("some").drop("some"))
    return out.groupBy("leak_id", "user_id").agg(F.max("b").alias("b"))


def top_and_rival(pooled: DataFrame) -> DataFrame:
    """Per leak the best row, and the most bits that another user's has; users are reduced before they are compared."""
    best = packed(F.col("matches"), F.col("created_at"), F.col("event_id"))
    return ranked_users(pooled.groupBy("leak_id", "user_id").agg(F.max(best).alias("b")))


def ranked_users(per_user: DataFrame) -> DataFrame:
    """The best of rows (leak_id, user_id, b: packed()) per leak, the next user's, and how many users there are; by maxima, without a
    sort. A b holds its event, so that no two users tie."""
    rows = written(per_user, "users")
    tops = rows.groupBy("leak_id").agg(F.max("b").alias("top"), F.max_by("user_id", "b").alias("user_id"), F.count("*").alias("officers"))
    tops = written(tops, "tops")
    others = rows.join(tops.select("leak_id", F.col("user_id").alias("best")), "leak_id").filter(~F.col("user_id").eqNullSafe(F.col("best")))
    second = others.groupBy("leak_id").agg(F.max("b").alias("next"), F.max_by("user_id", "b").alias("rival_user"))
    both = tops.join(second, "leak_id", "left")
    return both.select("leak_id", event_of("top").alias("event_id"), "user_id", matches_of("top").alias("matches"), matches_of("next").alias("rival"), "rival_user", "officers")


def accepted(read_bits: Column, matches: Column, rival: Column, p_dist: Column) -> Column:
    """The margin rule."""
    margin = matches - F.coalesce(rival, F.lit(0))
    enough = matches >= F.when(margin >= 2, 30).otherwise(32)
    return ~bits.degenerate(read_bits) & enough & (margin >= 1) & ((matches >= 36) | F.coalesce(p_dist <= 12, F.lit(False)))


def score(agreement: Column, p: Column, d: Column, a: Column, chain: Column) -> Column:
    """The confidence score; null signals count as 0 bits, distance 64 and no receipt."""
    agreement, chain = F.coalesce(agreement, F.lit(0.0)), F.coalesce(chain, F.lit(False)).cast("double")
    p, d, a = (F.coalesce(x, F.lit(64)) for x in (p, d, a))
    shot = ((p > 16) | (d > 16)) & (agreement >= 0.6)
    seen = 0.72 * agreement + 0.13 * (1 - F.least(p, d) / 64) + 0.15 * chain
    plain = 0.45 * agreement + 0.25 * (1 - p / 64) + 0.15 * (1 - d / 64) + 0.1 * (1 - a / 64) + 0.05 * chain
    return F.when(shot, seen).otherwise(plain)


def reasons(agreement: Column, p: Column, d: Column, chain: Column) -> Column:
    """Sentences for a score's signals; a null chain (no receipt) is not a failed one."""
    p, d = F.coalesce(p, F.lit(64)), F.coalesce(d, F.lit(64))

    def of(name: str, x: Column, words: tuple[str, str, str]) -> Column:
        kind = F.when(x <= 8, words[0]).when(x <= 16, words[1]).otherwise(words[2])
        return F.concat(F.lit(f"{name} distance "), x.cast("string"), F.lit("/64 — "), kind)

    return F.array_compact(F.array(
        F.when(((p > 16) | (d > 16)) & (F.coalesce(agreement, F.lit(0.0)) >= 0.6), "Display frame / screenshot transformation detected — watermark frequency content preserved"),
        of("dHash", d, ("strong visual match", "moderate visual match", "poor visual match")),
        of("pHash", p, ("near-identical frequency content", "similar frequency content", "different frequency content")),
        F.when(chain.isNull(), "No receipt identified to verify on chain").when(chain, "On-chain receipt verified").otherwise("Chain verification unavailable or failed"),
    ))


def attribute(leaks: DataFrame, register: DataFrame, users: DataFrame, ledger: DataFrame, tiers: tuple[int, ...] = (RADIUS, WIDER, WIDEST)) -> DataFrame:
    """A row per leak: the accepted release, its signals, score and verdict; the person only where evidence allows."""
    exact = named_exactly(leaks, register, repair=True).filter("event_id IS NOT NULL").select("leak_id", F.col("event_id").alias("exact_id"))
    best = ranked_users(best_of_users(leaks, register, tiers, least=29))
    near = register.select("event_id", F.col("p_hash").alias("own_p_hash"))
    joined = leaks.join(best.join(near, "event_id", "left"), "leak_id", "left").join(exact, "leak_id", "left")
    ok = accepted(F.col("read_bits"), F.col("matches"), F.col("rival"), bits.hamming(F.col("p_hash"), F.col("own_p_hash")))
    chosen = joined.select("leak_id", "read_bits", *(F.col(h).alias(f"leak_{h}") for h in _HASHES), F.coalesce("exact_id", F.when(ok, F.col("event_id"))).alias("event_id"))
    r = register.select("event_id", "user_id", "receipt_id", "payload", *_HASHES)
    on_chain = ledger.select(F.col("receipt_id").alias("on_ledger")).distinct()
    checked = chosen.join(r, "event_id", "left").join(on_chain, F.col("receipt_id") == F.col("on_ledger"), "left")
    # a distance within the radius is the distance: what candidates left out is filled in by the same
    filled = [F.coalesce(bits.hamming(F.col(f"leak_{h}"), F.col(h)), F.lit(64)).alias(n) for h, n in zip(_HASHES, ("p_dist", "d_dist", "a_dist"), strict=True)]
    chain = F.when(F.col("event_id").isNotNull(), F.col("on_ledger").isNotNull())
    share = F.when(F.col("event_id").isNotNull(), bits.matching(F.col("read_bits"), F.col("payload")) / 48)
    signals = checked.select("leak_id", "event_id", "user_id", share.alias("agreement"), *filled, chain.alias("chain"))
    scored = signals.withColumn("score", score(F.col("agreement"), F.col("p_dist"), F.col("d_dist"), F.col("a_dist"), F.col("chain")))
    judged = scored.select("*", verdict(F.col("score")).alias("verdict"))
    return redacted(judged, users)


def redacted(judged: DataFrame, users: DataFrame) -> DataFrame:
    """Names only for ATTRIBUTED and PROBABLE with a release."""
    shown = F.col("verdict").isin("ATTRIBUTED", "PROBABLE") & F.col("event_id").isNotNull()
    named = judged.join(users.select("user_id", "name", "dept"), "user_id", "left")
    return named.select("leak_id", bits.half_up(F.col("score"), 6).alias("score"), "verdict", F.col("chain").alias("verified"), F.when(shown, F.col("event_id")).alias("event_id"), F.when(shown, F.col("name")).alias("name"), F.when(shown, F.col("dept")).alias("dept"))
