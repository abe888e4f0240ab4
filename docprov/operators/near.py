"""Pairs of hashes within a narrow Hamming radius, by bands, with releases of one asset held together."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions import bits
from docprov.functions.workers import ship
from docprov.sources.files import written

BANDS = 5
#: Numbers of bands to choose from: fewer and wider ones leave fewer pairs to compare, and have more values to look up.
_CHOICES = (5, 4, 3)
#: What looking up a near value of a band costs, and what each value of the register's costs beside, in comparisons of two hashes.
_LOOKUP, _VALUE = 12, 30_000
#: Copies of one asset within this distance of their majority are looked for by that.
SLACK = 1
#: Releases of one asset that one row holds at most: those whose ids are the same but for the last six bits.
_CHUNK = 64
_BLOCK = 1 << 16  # pairs compared at once
FOUND = "leak_id long, event_id long, kind int, distance int"


def thresholds(radius: int, bands: int = BANDS) -> list[int]:
    """Of hashes within radius, at least one band b differs in thresholds[b] bits at most: each could else take one more, and they
    sum up to more than the radius. -1: a band that isn't needed."""
    each, more = divmod(radius + 1, bands)
    return [each - 1 + (b < more) for b in range(bands)]


def _edges(width: int, bands: int) -> list[int]:
    return [width * b // bands for b in range(bands + 1)]


def fitting(width: int, radius: int, n_asked: int, n_held: int) -> int:
    """The number of bands with the least work for so many leaks and clusters of a kind."""

    def work(bands: int) -> float:
        edges, cost = _edges(width, bands), 0.0
        for lo, hi, most in zip(edges, edges[1:], thresholds(radius, bands)):
            values = sum(comb(hi - lo, k) for k in range(min(hi - lo, most) + 1))
            cost += n_asked * n_held * values / (1 << hi - lo) + min(n_held, 1 << hi - lo) * (values * _LOOKUP + _VALUE) * (most >= 0)
        return cost

    return min(_CHOICES, key=work)


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(min(width, most) + 1) for c in combinations(range(width), k)]


def _together(register: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """all: the event_ids and columns of the releases of an asset_id (and of near ids), if there is such a column, else of one each."""
    one = F.struct("event_id", *columns)
    if "asset_id" not in register.columns:
        return register.select(F.array(one).alias("all"))
    return register.groupBy("asset_id", F.floor(F.col("event_id") / _CHUNK)).agg(F.collect_list(one).alias("all")).select("all")


def _majority(x: Column, y: Column, z: Column) -> Column:
    """The bits that two of three have; x if there are fewer."""
    return F.coalesce(x.bitwiseAND(y).bitwiseOR(x.bitwiseAND(z)).bitwiseOR(y.bitwiseAND(z)), x)


def clusters(register: DataFrame, hashes: tuple[str, ...]) -> DataFrame:
    """kind (the number of a hash), rep, ids and hs (hashes): releases of an asset_id, if there is such a column, whose hashes are
    SLACK from rep at most; others stand alone. Of three releases rep has the bits that two of them have: the asset's own hash, if
    each is a bit from it. Null hashes are left out."""
    rows = _together(register, hashes)

    def of(k: int, h: str) -> Column:
        own = F.filter(F.transform("all", lambda x: F.struct(x["event_id"].alias("id"), x[h].alias("h"))), lambda x: x["h"].isNotNull())
        return F.struct(F.lit(k).alias("kind"), own.alias("own"))

    rows = rows.select(F.inline(F.array(*(of(k, h) for k, h in enumerate(hashes))))).filter(F.size("own") > 0)
    rows = rows.select("kind", "own", _majority(*(F.get("own", F.lit(i))["h"] for i in range(3))).alias("rep"))
    within = lambda x: bits.hamming(x["h"], F.col("rep")) <= SLACK
    together = F.filter(F.array(F.struct("rep", F.filter("own", within).alias("m"))), lambda c: F.size(c["m"]) > 0)
    alone = F.transform(F.filter("own", lambda x: ~within(x)), lambda x: F.struct(x["h"].alias("rep"), F.array(x).alias("m")))
    rows = rows.select("kind", F.inline(F.concat(together, alone)))
    return rows.select("kind", "rep", F.col("m.id").alias("ids"), F.col("m.h").alias("hs"))


def pairs(leaks: DataFrame, register: DataFrame | None, hashes: tuple[str, ...], radius: int, most: int = 4_000_000, least_bits: int = 3, held: DataFrame | None = None) -> DataFrame:
    """leak_id, event_id, kind and distance of every leak and release whose hash number `kind` is within radius; each once.

    By pigeonhole some band of a leak and of a cluster's rep, which are within radius + SLACK, is near; the number of bands follows from
    the tables' sizes (fitting()), as leaks times releases grow faster than both. Clusters are grouped by band and the first bits of its value, a leak goes to the groups whose bits are near its own, and a group's task compares the two by the
    whole of the band's value first, then by the hash. The number of bits follows from the tables' sizes, so that a group has
    about `most` releases; one that has more, as many hashes are alike, is cut, and its leaks meet each of the cuts. held: the
    clusters() of a register, if they are stored.
    """
    held = held if held is not None else written(clusters(register, hashes), "clusters")
    asked = written(_asked(leaks, hashes), "asked")
    return _compared(asked, held.select("rep", "ids", "hs", "kind"), len(hashes), radius, most, least_bits, FOUND)


def _asked(leaks: DataFrame, hashes: tuple[str, ...], own: tuple[str, ...] = ()) -> DataFrame:
    """A row for each leak and hash, not null, number `kind`."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(h).alias("h")) for k, h in enumerate(hashes)))
    return leaks.select("leak_id", *own, F.inline(kinds)).filter("h IS NOT NULL")


def candidates(leaks: DataFrame, register: DataFrame, hashes: tuple[str, ...], names: tuple[str, ...], radius: int, carry: tuple[str, ...] = (), own: tuple[str, ...] = (), most: int = 4_000_000, least_bits: int = 3) -> DataFrame:
    """leak_id, event_id and a distance (one of names) for each hash, null outside radius, of every leak and release of which any hash is
    within radius; each once. carry: columns of the register that come along; own: columns of leaks.

    Of an asset's releases only the reps of clusters() are compared, as in pairs(). An asset that any of its reps names for a leak is
    taken once, and its releases, with all that comes along, stand in one row that is joined to it and looked at whole: so a release
    isn't moved for each hash and band, and no row of the result is moved at all."""
    sets = written(_together(register, (*hashes, *carry)).select(F.monotonically_increasing_id().alias("gid"), "all", F.array_distinct(F.flatten(F.array(*(_reps(k, h) for k, h in enumerate(hashes))))).alias("reps")), "sets")
    held = written(sets.select("gid", F.inline("reps")), "reps")
    mine = {h: f"_leak_{h}" for h in hashes}
    asked = written(_asked(leaks.select("leak_id", *hashes, *own, *(F.col(h).alias(m) for h, m in mine.items())), hashes, (*own, *mine.values())), "asked")
    along = [f for f in asked.schema if f.name not in ("kind", "h", "leak_id")]
    schema = ", ".join(["leak_id long, gid long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in along)])
    hits = _compared(asked, held, len(hashes), radius, most, least_bits, schema, [f.name for f in along])
    hits = hits.repartition("gid").dropDuplicates(["gid", "leak_id"])
    each = hits.join(sets.select("gid", "all").hint("merge"), "gid").select("leak_id", *own, *mine.values(), F.inline("all"))
    far = [bits.hamming(F.col(m), F.col(h)) for h, m in mine.items()]
    near = [F.coalesce(f <= radius, F.lit(False)) for f in far]
    any_ = near[0]
    for x in near[1:]:
        any_ = any_ | x
    return each.filter(any_).select("leak_id", "event_id", *(F.when(f <= radius, f).alias(n) for f, n in zip(far, names, strict=True)), *carry, *own)


def _reps(k: int, h: str) -> Column:
    """(kind, rep) of `all`: the majority of the first three hashes number k, if any is SLACK from it, and each that is further."""
    own = F.filter(F.transform("all", lambda x: x[h]), lambda x: x.isNotNull())

    def of(own: Column) -> Column:
        rep = _majority(*(F.get(own, F.lit(i)) for i in range(3)))
        return F.transform(own, lambda x: F.struct(F.lit(k).alias("kind"), F.when(bits.hamming(x, rep) <= SLACK, rep).otherwise(x).alias("rep")))

    return F.flatten(F.transform(F.array(own), of))


def _compared(asked: DataFrame, held: DataFrame, kinds: int, radius: int, most: int, least_bits: int, schema: str, along: list[str] | None = None) -> DataFrame:
    """asked (leak_id, kind, h) against clusters() by groups, both written: see pairs(). along: of reps alone, with a gid, and columns of
    asked; leak_id and gid within radius + SLACK."""
    size = F.size("ids") if along is None else F.lit(1)
    n, n_held, ones = held.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*"), F.coalesce(F.bit_or("rep"), F.lit(0))).first()
    n_asked, ones_asked = asked.agg(F.count("*"), F.coalesce(F.bit_or("h"), F.lit(0))).first()
    width = ((ones | ones_asked) % (1 << 64)).bit_length()  # bits beyond are 0 in all reps and leaks
    bands = fitting(width, radius + SLACK, n_asked // kinds, n_held // kinds)
    edges, near = _edges(width, bands), thresholds(radius + SLACK, bands)
    used = [b for b in range(bands) if near[b] >= 0]
    first = max(least_bits, (max(n, n_asked) // kinds // most).bit_length())
    first = [min(first, edges[b + 1] - edges[b]) for b in range(bands)]

    def keyed(rows: DataFrame, h: str, flips: dict[int, list[int]]) -> DataFrame:
        """rows once for each used band and each of its flips, with the key: kind, band and the band's first bits but for the flip."""
        one = [F.struct(F.lit(b).alias("b"), F.lit(edges[b + 1] - first[b]).alias("by"), F.lit((1 << first[b]) - 1).cast("long").alias("ones"), F.lit(f).cast("long").alias("flip")) for b in used for f in flips[b]]
        part = F.call_function("shiftrightunsigned", F.col(h), F.col("by")).bitwiseAND(F.col("ones"))
        key = (F.col("kind") * bands + F.col("b")) * 65536 + part.bitwiseXOR(F.col("flip")).cast("int")
        return rows.select("*", F.inline(F.array(*one))).withColumn("key", key).drop("b", "by", "ones", "flip")

    plain, near_flips = {b: [0] for b in used}, {b: _flips(first[b], near[b]) for b in used}
    # counted by the leak's own bits; those of the groups it goes to are added up here: a number for each band and first bits
    here, own = ({r["key"]: r["n"] for r in keyed(rows, h, plain).groupBy("key").agg(many.alias("n")).collect()} for rows, h, many in ((held, "rep", F.sum(size)), (asked, "h", F.count("*"))))
    there = {key: sum(own.get(key ^ f, 0) for f in near_flips[key // 65536 % bands]) for key in here}
    large = [{key: -(-n // most) for key, n in of.items() if n > 2 * most} for of in (here, there)]  # rarely one
    stored = keyed(held, "rep", plain).drop("kind")
    probes = keyed(asked, "h", near_flips).drop("kind")

    def cuts(of: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col("key")], F.lit(1)) if of else F.lit(1)

    def dealt(df: DataFrame, own: dict, other: dict, id_: Column, names: tuple[str, str]) -> DataFrame:
        df = df.withColumn(names[0], F.pmod(F.xxhash64(id_), cuts(own)).cast("int"))
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), cuts(other) - 1)) if other else F.lit(0))

    stored = dealt(stored, large[0], large[1], F.element_at("ids", 1) if along is None else F.col("gid"), ("cut", "block"))
    probes = dealt(probes, large[1], large[0], F.col("leak_id"), ("block", "cut"))
    ship(asked.sparkSession)
    run = _comparison(edges, near, radius, along)
    return probes.groupBy("key", "cut", "block").cogroup(stored.groupBy("key", "cut", "block")).applyInArrow(run, schema)


def _taken(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i] to start[i] + n[i] - 1 of every i, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _true(flags: np.ndarray) -> np.ndarray:
    """Where flags, few of them true, are: they are looked through eight at a time."""
    whole = len(flags) // 8 * 8
    some = (np.flatnonzero(flags[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[flags[some]], np.flatnonzero(flags[whole:]) + whole])


def _within(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a and b are within radius, as numbers of both; block by block."""
    if len(a) > len(b):
        return _within(b, a, radius)[::-1]
    out = [], []
    for j in range(0, len(b), _BLOCK):
        some = b[j : j + _BLOCK]
        step = max(1, _BLOCK // max(1, len(some)))
        for i in range(0, len(a), step):
            far = np.bitwise_count(a[i : i + step, None] ^ some[None, :])
            hit = _true((far <= radius).ravel())
            if len(hit):
                out[0].append(hit // len(some) + i)
                out[1].append(hit % len(some) + j)
    return tuple(np.concatenate(o) if o else np.empty(0, np.int64) for o in out)


def _comparison(edges: list[int], near: list[int], radius: int, along: list[str] | None = None):
    """The function of a group of leaks (leak_id, h, key) and one of clusters (rep, ids, hs, key); with along, of reps (rep, gid, key)."""

    def part(h: np.ndarray, b: int) -> np.ndarray:
        return (h >> np.uint64(edges[b])) & np.uint64((1 << edges[b + 1] - edges[b]) - 1) if edges[b + 1] > edges[b] else np.zeros_like(h)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        kind = 0
        if asked.num_rows and held.num_rows:
            kind, band = divmod(asked.column("key")[0].as_py() // 65536, len(near))
            leak, h = (asked.column(c).to_numpy() for c in ("leak_id", "h"))
            h, rep = h.view(np.uint64), held.column("rep").to_numpy().view(np.uint64)
            if along is None:
                ids, hs = (held.column(c).combine_chunks() for c in ("ids", "hs"))
                n = ids.value_lengths().to_numpy().astype(np.int64)
                at, ids, hs = np.cumsum(n) - n, ids.flatten().to_numpy(), hs.flatten().to_numpy().view(np.uint64)

            def members(i: np.ndarray, j: np.ndarray) -> None:
                """Adds the members of clusters j that are within radius of leaks i, if this is the first band that tells."""
                ok = np.bitwise_count(part(h[i], band) ^ part(rep[j], band)) <= near[band]
                for b in range(band):
                    ok &= np.bitwise_count(part(h[i], b) ^ part(rep[j], b)).astype(np.int64) > near[b]
                i, j = i[ok], j[ok]
                if along is not None:
                    found[0].append(i)
                    found[1].append(j)
                    return
                who, i = _taken(at[j], n[j]), np.repeat(i, n[j])
                far = np.bitwise_count(h[i] ^ hs[who])
                ok = far <= radius
                for f, x in zip(found, (leak[i[ok]], ids[who[ok]], far[ok].astype(np.int32)), strict=True):
                    f.append(x)

            if len(h) * len(rep) <= 64 * _BLOCK:
                members(*_within(h, rep, radius + SLACK))
            else:
                own, stored = part(h, band).astype(np.int64), part(rep, band).astype(np.int64)
                order, of = np.argsort(own, kind="stable"), np.argsort(stored, kind="stable")
                sorted_h, size = h[order], 1 << edges[band + 1] - edges[band]
                count, flips = np.bincount(own, minlength=size), np.array(_flips(edges[band + 1] - edges[band], near[band]))
                start = np.cumsum(count) - count
                values, begin = np.unique(stored[of], return_index=True)
                waiting, wait = [], 0
                for v, lo, hi in zip(values, begin, [*begin[1:], len(of)], strict=True):
                    some = v ^ flips
                    some = some[count[some] > 0]
                    which, js = _taken(start[some], count[some]), of[lo:hi]
                    i, j = _within(sorted_h[which], rep[js], radius + SLACK)
                    if len(i):
                        waiting.append((order[which[i]], js[j]))
                        wait += len(i)
                    if wait > 4 * _BLOCK:
                        members(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                        waiting, wait = [], 0
                if waiting:
                    members(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        a, b, d = (np.concatenate(f) for f in found)
        if along is not None:
            i, j = pa.array(a), pa.array(b)
            return pa.table({"leak_id": asked.column("leak_id").take(i), "gid": held.column("gid").take(j)} | {c: asked.column(c).take(i) for c in along})
        return pa.table({"leak_id": a, "event_id": b, "kind": np.full(len(a), kind, np.int32), "distance": d})

    return run
