"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain. The index is split
by document: a row's postings, one bit for each trigram that the rules ask for, stay with the row, so that intersecting them
moves no text. Rows where a rule's postings intersect are its candidates, and only these are searched with the
expression. A rule without mandatory trigrams searches every text.

Work grows with a text's length and its matches, not with their product: matches are found once, and their places are sums
over pieces of the list of matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.operators.raster import held


@dataclass(frozen=True)
class Rule:
    """kind: name in results. regex: for Java and Python alike. group, least: matches whose group is shorter go."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: Fixed patterns of the three kinds, in the order that ties of their starts have. A run of hexadecimal digits or of
#: key characters is matched whole or not at all, so its least length can stand in the pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)

_MOST = 64


def trigram_query(regex: str) -> frozenset[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams that any match contains, or None if there is none that all contain."""
    parts: list[frozenset[frozenset[str]]] = []

    def flush(run: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if sets and all(sets):
            parts.append(frozenset(a for a in sets if not any(b < a for b in sets)))

    def strings(tree) -> set[str] | None:
        """All the strings that tree matches, if they are few."""
        run = {""}
        for op, arg in tree:
            more = one(str(op), arg)
            if more is None or len(run) * len(more) > _MOST:
                return None
            run = {a + b for a, b in product(run, more)}
        return run

    def one(op: str, arg) -> set[str] | None:
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN" and len(arg) <= 4 and all(str(k) == "LITERAL" for k, _ in arg):
            return {chr(c).lower() for _, c in arg}
        if op == "BRANCH":
            each = [strings(x) for x in arg[1]]
            return None if None in each else set().union(*each)
        if op == "SUBPATTERN":
            return strings(arg[3])
        if op == "MAX_REPEAT" and arg[1] == 1:
            found = strings(arg[2])
            return None if found is None else found | ({""} if arg[0] == 0 else set())
        return None

    run = {""}
    for op, arg in re._parser.parse(regex):
        more = one(str(op), arg)
        if more is None or len(run) * len(more) > _MOST:
            flush(run)
            run = more if more is not None else {""}
        else:
            run = {a + b for a, b in product(run, more)}
    flush(run)
    # of several parts that must all hold, the one with the longest trigram lists is asked
    return max(parts, key=lambda p: (min(map(len, p)), sorted(map(sorted, p))), default=None)


def grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.regex) or () for g in clause})


def _packed(names: list[str]) -> Column:
    """The columns of these names as one: none of them can clash with a column of this module."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in names))


def postings(text: Column, names: list[str]) -> Column:
    """The bits of the trigrams (names) that the lower-cased text holds, as bigints of 62 bits."""
    low = F.lower(text)
    bits = [F.when(F.contains(low, F.lit(g)), F.lit(1 << i % 62)).otherwise(F.lit(0)).cast("bigint") for i, g in enumerate(names)]
    return F.array(*(reduce(lambda a, b: a.bitwiseOR(b), bits[i : i + 62]) for i in range(0, len(bits), 62))).cast("array<bigint>")


def candidates(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """An array of boolean, true for each rule whose query holds of postings(), and for rules without a query."""
    at = {g: i for i, g in enumerate(grams(rules))}

    def holds(clause: frozenset[str]) -> Column:
        every = F.lit(True)
        for k in sorted({at[g] // 62 for g in clause}):
            need = F.lit(sum(1 << at[g] % 62 for g in clause if at[g] // 62 == k)).cast("bigint")
            every = every & (found[k].bitwiseAND(need) == need)
        return every

    def asks(query: frozenset[frozenset[str]] | None) -> Column:
        return F.lit(True) if query is None else reduce(lambda a, b: a | b, map(holds, sorted(query, key=sorted)), F.lit(False))

    return F.array(*(asks(trigram_query(r.regex)) for r in rules))


_SPANS = "array<struct<start:int,kind:int,end:int,first:int,stop:int>>"
_EACH = 256


def _pieces(v: str | Column, each: int = _EACH) -> Column:
    """The array v (a column, or its name) in pieces of `each` items."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.floor((F.size(v) - 1) / each).cast("int")
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), n), lambda j: F.slice(v, j * each + 1, F.lit(each))))


def _parts(gaps: Column, raw: Column, base: Column, each: int) -> Column:
    """gaps in pieces, each with the part of raw (which starts at byte `base` of the text) that it lies in: what cuts a piece's gaps
    then copies that part, not all of raw."""

    def one(p: Column) -> Column:
        first = p[0]["a"]
        part = F.substring(raw, (first - base + 1).cast("int"), (F.element_at(p, -1)["b"] - first).cast("int"))
        return F.struct(p.alias("gaps"), part.alias("part"), first.alias("base"))

    return F.transform(_pieces(gaps, each), one)


def _matches(text: Column, rule: Rule) -> Column:
    """Of each leftmost match that doesn't overlap: the lengths of what is before it and of itself, in code points and in bytes,
    and of its group in code points."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("size")))

    def lengths(x: Column, gap: Column) -> Column:
        return F.struct(F.length(gap).alias("gap"), F.octet_length(gap).alias("gap_bytes"), F.length(x["m"]).alias("n"), F.octet_length(x["m"]).alias("bytes"), x["size"].alias("size"))

    return F.filter(F.zip_with(pairs, F.split(text, rule.regex, -1), lengths), lambda x: x["n"].isNotNull())  # one gap is behind the last


def _placed(v: str, kind: int) -> Column:
    """Of each piece of _matches() (the column v): the bytes and code points it covers, and its matches' places in it."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,first:int,stop:int,size:int>>")

    def step(acc: Column, x: Column) -> Column:
        start, first = acc["at"] + x["gap"], acc["byte"] + x["gap_bytes"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).alias("end"), first.alias("first"), (first + x["bytes"]).alias("stop"), x["size"].alias("size"))
        return F.struct((start + x["n"]).alias("at"), (first + x["bytes"]).alias("byte"), F.concat(acc["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), none.alias("out"))
    return F.transform(_pieces(v), lambda piece: F.aggregate(piece, zero, step))


def _spans(v: str, rule: Rule) -> Column:
    """Places in the whole text of what _placed() gave (the column v), without matches whose group is too short."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), F.array().cast("array<struct<at:int,byte:int>>").alias("out"))
    before = F.aggregate(F.col(v), zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), (acc["byte"] + x["byte"]).alias("byte"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["byte"].alias("byte")))).alias("out")), lambda acc: acc["out"])

    def moved(x: Column, b: Column) -> Column:
        return F.struct((x["start"] + b["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + b["at"]).alias("end"), (x["first"] + b["byte"]).alias("first"), (x["stop"] + b["byte"]).alias("stop"))

    each = F.zip_with(F.col(v), before, lambda p, b: F.transform(F.filter(p["out"], lambda x: x["size"] >= rule.least), lambda x: moved(x, b)))
    return F.coalesce(F.flatten(each), F.array().cast(_SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column secrets added: array of (start, kind, end, first, stop) by start, then by rule; kind numbers rules;
    start and end count code points, first and stop bytes; end and stop are exclusive.

    Whole texts are searched; null counts as empty. Each row is searched on its own: rows that repeat another, or a doc_id, get
    the same secrets for the same text. Other columns may have any name; one named secrets is replaced. An empty table gives
    no rows.
    """
    names, kept = grams(rules), [c for c in docs.columns if c != "secrets"]
    text = F.coalesce(F.col("row").getField("text"), F.lit(""))
    found = postings(text, names) if names else F.array().cast("array<bigint>")
    rows = held(docs.select(_packed(kept).alias("row")).select("row", found.alias("found")))
    rows = held(rows.select("row", candidates(F.col("found"), rules).alias("cand")))
    rows = held(rows.select("row", *(F.when(F.col("cand")[i], _matches(text, r)).otherwise(F.array()).alias(f"m{i}") for i, r in enumerate(rules))))
    rows = held(rows.select("row", *(_placed(f"m{i}", i).alias(f"p{i}") for i in range(len(rules)))))
    secrets = F.array_sort(F.flatten(F.array(*(_spans(f"p{i}", r) for i, r in enumerate(rules)))))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), secrets.alias("secrets"))


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count n_<kind> for each rule, base_sha256 and spans of what scan() gave."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    said = scanned.select("doc_id", "secrets", F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))

    def count(kind: int) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    return said.select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


def redact(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """What scan() gave, without secrets but with each of them replaced by mask in text; overlapping ones are replaced as one.

    Null texts and those without secrets stay as they are; an empty table gives no rows. Other columns may have any name. A long text
    is cut in two steps, so that time grows with its length and its secrets, not with their product.
    """
    kept = [c for c in scanned.columns if c != "secrets"]
    rows = scanned.select(_packed(kept).alias("row"), "secrets")
    rows = held(rows.select("row", _pieces("secrets").alias("pieces"), F.when(F.size("secrets") > 0, F.col("row").getField("text").cast("binary")).alias("raw")))
    # how far the secrets before each piece of the list reach
    zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("out"))
    reach = F.aggregate("pieces", zero, lambda acc, p: F.struct(F.greatest(acc["to"], F.array_max(F.transform(p, lambda x: x["stop"]))).alias("to"), F.concat(acc["out"], F.array(acc["to"])).alias("out")))
    rows = held(rows.select("row", "raw", "pieces", reach.alias("reach")))

    def step(acc: Column, x: Column) -> Column:
        gap = F.struct(acc["to"].alias("a"), x["first"].alias("b"))
        return F.struct(F.greatest(acc["to"], x["stop"]).alias("to"), F.concat(acc["out"], F.array(gap)).alias("out"))

    def gaps(piece: Column, to: Column) -> Column:
        zero = F.struct(to.alias("to"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
        return F.aggregate(piece, zero, step, lambda acc: F.filter(acc["out"], lambda g: g["b"] >= g["a"]))

    last = F.array(F.struct(F.col("reach.to").alias("a"), F.octet_length("raw").alias("b")))
    rows = held(rows.select("row", "raw", F.concat(F.flatten(F.zip_with("pieces", F.col("reach.out"), gaps)), last).alias("gaps")))
    rows = held(rows.select("row", "raw", _parts(F.col("gaps"), F.col("raw"), F.lit(0), _EACH * _EACH).alias("wide")))
    rows = held(rows.select("row", F.col("raw").isNotNull().alias("some"), F.flatten(F.transform("wide", lambda x: _parts(x["gaps"], x["part"], x["base"], _EACH))).alias("near")))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["gaps"], lambda g: F.substring(x["part"], g["a"] - x["base"] + 1, g["b"] - g["a"]).cast("string")), mask)

    masked = F.array_join(F.transform("near", joined), mask)
    text = F.when(F.col("some"), masked).otherwise(F.col("row").getField("text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rules AS (
  SELECT * FROM (VALUES
    (0, 'assign', '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
    (1, 'access', '(AKIA)([A-Z0-9]+)', 12),
    (2, 'hex', '()([0-9a-f]+)', 32)) t(kind, name, re, least)),
m AS (
  SELECT doc_id, 0 AS kind, string_split_regex(text, (SELECT re FROM rules WHERE kind = 0)) AS gaps,
    regexp_extract_all(text, (SELECT re FROM rules WHERE kind = 0), 0) AS found,
    regexp_extract_all(text, (SELECT re FROM rules WHERE kind = 0), 2) AS part FROM d
  UNION ALL
  SELECT doc_id, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA([A-Z0-9]+)', 1) FROM d
  UNION ALL
  SELECT doc_id, 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0) FROM d),
e AS (SELECT doc_id, kind, unnest(gaps[:len(found)]) AS gap, unnest(found) AS found, unnest(part) AS part, unnest(range(len(found))) AS i FROM m WHERE len(found) > 0),
p AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM e),
s AS (
  SELECT p.doc_id, p.kind, r.name, CAST(stop - length(found) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM p JOIN rules r ON p.kind = r.kind WHERE length(part) >= r.least),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
