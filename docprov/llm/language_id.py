"""Language ID by words first, then by ever shorter character n-grams.

A word that the training texts hold adds its log frequency in each language. Any other word is covered by character n-grams:
at each of its places the longest known n-gram counts, from `longest` down to one character, and the word adds their mean.
Words and n-grams are tables and nothing is left out of them. Each different word of the corpus gets its logs once; the most
frequent words are broadcast (a bounded number) and summed where the texts are read, all others are joined. Logs are whole
numbers of 1 / UNIT, so that sums don't depend on their order nor on which words are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

UNKNOWN = "und"
#: A word: a run of letters.
WORD = r"\p{L}+"
UNIT = 1 << 20
#: Bytes that one broadcast of words or n-grams may take: fewer rows go the more languages there are.
MOST_BYTES = 48 << 20


def _fitting(rows: int, languages: int) -> int:
    """`rows`, or as many of an item (about 64 bytes) and a log for each language as MOST_BYTES hold."""
    return min(rows, MOST_BYTES // (64 + 8 * languages))


@dataclass(frozen=True)
class Model:
    """words, grams: tables of an item and its logs l0, l1, ... in languages; `longest` is the longest n-gram."""

    languages: tuple[str, ...]
    words: DataFrame
    grams: DataFrame
    longest: int

    @property
    def logs(self) -> list[str]:
        return [f"l{i}" for i in range(len(self.languages))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: Column) -> Column:
    """The lower-case words of a text; none of null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def count_words(docs: DataFrame) -> DataFrame:
    """A written table of word, lang (null where docs has none) and n, over every word of every text."""
    words = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    return written(words.groupBy("word", "lang").agg(F.count("*").alias("n")), "words")


def _logs(counts: list[Column], sums: list[int], size: int) -> list[Column]:
    """Smoothed log frequencies, in whole numbers."""
    return [F.round((F.log(F.coalesce(c, F.lit(0)) + 0.5) - F.log(F.lit(s + 0.5 * size))) * UNIT).cast("long").alias(f"l{i}") for i, (c, s) in enumerate(zip(counts, sums, strict=True))]


def _grams(framed: Column, n: int) -> Column:
    """The n-grams of a framed word, in order."""
    return F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _framed(word: str) -> Column:
    return F.concat(F.lit("^"), F.col(word), F.lit("$"))


def train(counts: DataFrame, longest: int = 4) -> Model:
    """A model of count_words()'s rows that have a language: every word, and every n-gram of up to `longest` characters.

    n-grams see a word between ^ and $, and are counted for each different word of a language. Only one row per language is
    collected.
    """
    known = counts.filter(F.col("lang").isNotNull())
    sums = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(sums))
    of = [F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"c{i}") for i, x in enumerate(languages)]
    words = written(known.groupBy("word").agg(F.lit(1).alias("any"), *of), "word_counts")
    each = [F.count(f"c{i}").alias(f"c{i}") for i in range(len(languages))]
    every = F.explode(F.concat(*(_grams(_framed("word"), n) for n in range(1, longest + 1))))
    grams = words.select(every.alias("gram"), *(c for c in words.columns if c not in ("word", "any")))
    grams = written(grams.groupBy("gram").agg(F.lit(1).alias("any"), *each), "gram_counts")
    total = grams.agg(F.lit(0), *(F.sum(f"c{i}") for i in range(len(languages)))).first()[1:]

    def table(counted: DataFrame, item: str, sizes: list[int]) -> DataFrame:
        return counted.select(item, *_logs([F.col(f"c{i}") for i in range(len(languages))], sizes, counted.count()))

    return Model(languages, table(words, "word", [sums[x] for x in languages]), table(grams, "gram", [n or 0 for n in total]), longest)


def backoff(words: DataFrame, model: Model, most: int = 500_000) -> DataFrame:
    """word and its logs, from n-grams alone, for every row of words (word). A word without any known n-gram has logs of 0.

    n-grams of one length are broadcast if they are at most `most` and MOST_BYTES, else joined like any other table.
    """
    most = _fitting(most, len(model.languages))
    places = words.select("word", _framed("word").alias("w"))
    places = places.select("word", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("at"))
    sizes = range(model.longest, 0, -1)
    cut = places.select("word", *(F.when(F.col("at") + n - 1 <= F.length("w"), F.substring("w", F.col("at"), F.lit(n))).alias(f"g{n}") for n in sizes))
    grams = written(model.grams.withColumn("n", F.length("gram")), "grams")
    count = {r["n"]: r["count"] for r in grams.groupBy("n").count().collect()}
    for n in sizes:
        own = grams.filter(F.col("n") == n).select(F.col("gram").alias(f"k{n}"), F.array(*model.logs).alias(f"a{n}"))
        cut = cut.join(F.broadcast(own) if count.get(n, 0) <= most else own, F.col(f"g{n}") == F.col(f"k{n}"), "left")
    found = cut.select("word", F.coalesce(*(F.col(f"a{n}") for n in sizes)).alias("a"))
    means = [F.coalesce(F.round(F.sum(F.col("a")[i]) / F.count("a")), F.lit(0)).cast("long").alias(x) for i, x in enumerate(model.logs)]
    return found.groupBy("word").agg(*means)


def word_logs(counts: DataFrame, model: Model) -> DataFrame:
    """A written table of every different word of counts: word, total and its logs, the model's or backoff()'s."""
    totals = counts.groupBy("word").agg(F.sum("n").alias("total"))
    known = written(totals.join(model.words, "word", "left"), "known")
    unseen = known.filter(F.col(model.logs[0]).isNull())
    logs = backoff(unseen.select("word"), model)
    return written(known.filter(F.col(model.logs[0]).isNotNull()).unionByName(unseen.select("word", "total").join(logs, "word")), "word_logs")


def most_frequent(totals: DataFrame, most: int) -> DataFrame:
    """The rows of the largest totals, `most` at most; what ties in size with rows beyond is left out as well."""
    share = F.floor(F.log2("total") * 64)  # 64 for each doubling
    shares = totals.groupBy(share.alias("share")).count().collect()
    kept, least = 0, 1 << 31
    for at, n in sorted(((r["share"], r["count"]) for r in shares), reverse=True):
        kept += n
        if kept > most:
            break
        least = at
    return totals.filter(share >= least)


def predict(docs: DataFrame, model: Model, counts: DataFrame, most_broadcast: int = 300_000, number: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior under even priors, 0 for UNKNOWN) of every row of docs.

    counts: count_words() of docs, whatever its languages. most_broadcast: words that are broadcast (MOST_BYTES at most); any number
    gives the same rows. number: a column of different longs that names the rows in the result, as row; without it row is any number.
    """
    row = F.col(number) if number else F.monotonically_increasing_id()
    base = docs.select(row.alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), words_of(F.col("text")).alias("words"))
    if not model.languages:
        return base.select("row", "doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    logs = model.logs
    every = word_logs(counts, model)
    head = most_frequent(every, _fitting(most_broadcast, len(model.languages))).select(F.col("word").alias("w"), *logs)
    tokens = base.select("row", "doc_id", "held_out", F.explode(F.concat(F.array(F.lit("")), "words")).alias("word"))  # "": a row for each text
    joined = tokens.join(F.broadcast(head), F.col("word") == F.col("w"), "left")
    rest = F.when(F.col("w").isNull() & (F.col("word") != ""), F.col("word"))
    own = [F.max(F.when(rest.isNull(), F.col(c))).alias(c) for c in ("doc_id", "held_out")]
    parts = joined.groupBy("row", rest.alias("rest")).agg(*own, F.count("*").alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in logs))
    parts = written(parts, "parts")
    tail = parts.filter(F.col("rest").isNotNull()).select("row", "rest", "n").join(every.select(F.col("word").alias("rest"), *logs), "rest")
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out")]
    tail = tail.select("row", *none, "n", *((F.col("n") * F.col(x)).alias(x) for x in logs))
    both = parts.filter(F.col("rest").isNull()).drop("rest").unionByName(tail)
    sums = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), (F.sum("n") - 1).alias("n"), F.array(*(F.sum(x) for x in logs)).alias("sums"))
    best = F.array_max("sums")
    odds = F.aggregate("sums", F.lit(0.0), lambda acc, x: acc + F.exp(F.greatest((x - best) / F.lit(float(UNIT)), F.lit(-700.0))))
    lang = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("sums", best).cast("int"))
    some = F.col("n") > 0
    return sums.select("row", "doc_id", "held_out", F.when(some, lang).otherwise(UNKNOWN).alias("lang_pred"), F.when(some, 1 / odds).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, longest: int = 4, most_broadcast: int = 300_000, number: str | None = None) -> DataFrame:
    """predict() with a model of those rows of docs that aren't held out.

    docs needs doc_id, text and lang; other columns are ignored. A row is held out if crc32 of its doc_id as text is 1
    modulo 3; a null doc_id is never held out. UNKNOWN with score 0 is given for null texts and texts without letters, and
    for all if no row has a language. Ties go to the language that sorts first. Rows that repeat another count and are
    predicted each. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.when(~held_out(F.col("doc_id")), F.col("lang")).alias("lang"), *([number] if number else []))
    counts = count_words(rows)
    return predict(rows, train(counts, longest), counts, most_broadcast, number)
