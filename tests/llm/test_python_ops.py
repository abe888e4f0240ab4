"""Archives, near-duplicates and language ID against brute force."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash
from docprov.llm import components, language_id, simhash, warc
from pyarrow import fs
from pyspark.sql import functions as F

PAGES = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u%41", "<p>é</p>"), (5, "u", "long " * 90000), (6, "u", "<p>\r\n\r\n</p>"), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS sha1", "1 AS size").repartition(2)


@pytest.mark.parametrize("least", [0, 1])
def test_archives_round_trip(spark, least):
    files = warc.write_archives(pages(spark), least, frame_bytes=300, bundle_bytes=2000)
    rows = warc.read_archives(files).collect()
    assert sorted((r["page_id"], r["url"]) for r in rows if r["url"]) == sorted((p, u) for p, u, _ in PAGES if u)
    top = {}
    for page_id, _, html in PAGES:
        top[html or ""] = max(page_id, top.get(html or "", 0))
    want = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        again = len(body) >= least and page_id != top[html or ""]
        sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page_id, len(body), sha1, "revisit" if again else "response", top[html or ""] if again else None, None if again else body))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages(spark).filter("false"))).count() == 0
    path = files.first()["path"]
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        reader = warc.Reader(f)
        name = reader.index[-1][0]
        assert warc._uri(warc.parse(reader.get(name))[0]) == name and reader.get("<urn:page:99>") is None


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").translate(str.maketrans("\t\n\r", "   ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_near_duplicates(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(300)) for _ in range(12)]
    texts = [None, "", "One", "one", "one two", "A\x0bB c d", *base]
    for t in base[:6]:
        for _ in range(8):
            w = t.split()
            w[r.randrange(300)] = "new"
            texts.append(" ".join(w))
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = {x["doc_id"]: x for x in simhash.near_duplicates(df).collect()}
    rows.sort()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    label = brute_components(fps)
    assert len(set(label)) < len(rows)
    for (doc_id, _, _), fp, k in zip(rows, fps, label, strict=True):
        assert (got[doc_id]["fp"] % 2**64, got[doc_id]["component_id"]) == (fp, rows[k][0])
    assert simhash.near_duplicates(df.filter("false")).count() == 0


def test_links_in_tiles_lose_nothing(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for c in rng.integers(0, 2**63, 20, dtype=np.uint64):
        for _ in range(25):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    label = brute_components([x % 2**64 for x in fps])
    for tile, small in ((1024, 64), (4, 64), (4, 0)):
        got = {r["node"]: r["component"] for r in components.components(simhash.links(df, 3, tile, small)).collect()}
        assert [got.get(x, x) for x in fps] == [fps[k] for k in label]


def test_more_blocks_find_the_same(spark):
    for n, m in ((10, 4), (1 << 25, 5), (1 << 40, 6)):
        assert simhash.blocks_for(n, 3) == m


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert components.components(df.filter("false")).count() == 0


ODD_LANGUAGES = [(2, None, "en"), (3, " 12 !", None), (None, "the of and", "en"), (5, "der und das", "de"), (5, "der und das", "de"), (5, "xyz " * 9000 + "z" * 30000, None), (6, "ab ba", "b"), (7, "ab ba", "a"), (8, "ba ab qq ß日本", None), (9, "\U0001f600 naïve _x_", "en")]


def brute_languages(rows, longest=4):
    """(doc_id, held_out, lang, score) of rows (doc_id, text, lang), word by word."""
    out = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    words = [regex.findall(r"\p{L}+", (t or "").lower()) for _, t, _ in rows]
    counts = {}
    for held, ws, (_, t, lang) in zip(out, words, rows, strict=True):
        if not held and lang is not None:
            for w in ws:
                counts.setdefault(w, {}).setdefault(lang, 0)
                counts[w][lang] += 1
    languages = sorted({x for c in counts.values() for x in c})
    grams = {}
    for w, c in counts.items():
        for n in range(1, longest + 1):
            for i in range(len(w) + 3 - n):
                for lang in c:
                    of = grams.setdefault(f"^{w}$"[i : i + n], {})
                    of[lang] = of.get(lang, 0) + 1

    def logs(table):
        sums = {x: sum(c.get(x, 0) for c in table.values()) for x in languages}
        return {k: [round((math.log(c.get(x, 0) + 0.5) - math.log(sums[x] + 0.5 * len(table))) * 2**20) for x in languages] for k, c in table.items()}

    word_logs, gram_logs = logs(counts), logs(grams)

    def of(w):
        if w in word_logs:
            return word_logs[w]
        framed, found = f"^{w}$", []
        for i in range(len(framed)):
            for n in range(longest, 0, -1):
                if i + n <= len(framed) and framed[i : i + n] in gram_logs:
                    found.append(gram_logs[framed[i : i + n]])
                    break
        return [math.floor(sum(x) / len(found) + 0.5) if sum(x) > 0 else math.ceil(sum(x) / len(found) - 0.5) for x in zip(*found)] if found else [0] * len(languages)

    known, want = {}, []
    for held, ws, (doc_id, _, _) in zip(out, words, rows, strict=True):
        if not ws or not languages:
            want.append((doc_id, held, "und", 0.0))
            continue
        total = [0] * len(languages)
        for w in ws:
            if w not in known:
                known[w] = of(w)
            total = [a + b for a, b in zip(total, known[w], strict=True)]
        best = max(total)
        want.append((doc_id, held, languages[total.index(best)], 1 / sum(math.exp(max((x - best) / 2**20, -700)) for x in total)))
    return want


def same_languages(got, want):
    key = lambda r: tuple(map(str, r[:3]))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in got]
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-4, atol=1e-9)


def test_language_id(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.identify(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [k for k, r in got.items() if r["held_out"]]
    assert len(out) > 30 and np.mean([got[k]["lang_pred"] == langs[k] for k in out]) >= 0.97
    same_languages(rows, brute_languages([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]))


def test_language_id_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD_LANGUAGES, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "2 AS word", "3 AS l0", "4 AS row", "5 AS held_out")
    rows = [sorted(language_id.identify(odd, most_broadcast=n).drop("row").collect(), key=str) for n in (0, 3, 300_000)]
    assert rows[0] == rows[1] == rows[2]
    same_languages(rows[0], brute_languages(ODD_LANGUAGES))
    assert language_id.identify(odd.filter("false")).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", odd["lang"].substr(9, 0)).filter("lang is null")).collect()} <= {"und"}


def test_no_word_is_dropped(spark):
    """600 words of one count; which of them are broadcast is of no effect on what is known."""
    rows = [(10, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(600)), "a"), (9, "zzz", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = language_id.count_words(docs)
    model = language_id.train(counts)
    assert model.words.count() == 601
    totals = counts.select("word", F.col("n").alias("total"))
    assert [language_id.most_frequent(totals, n).count() for n in (601, 600)] == [601, 0]
    for most in (601, 600):
        same_languages(language_id.predict(docs, model, counts, most).collect(), brute_languages(rows))


def test_broadcasts_are_bounded_by_bytes():
    for languages in (1, 4, 100, 10_000):
        for rows in (300_000, 500_000):
            fit = language_id._fitting(rows, languages)
            assert fit <= rows and fit * (64 + 8 * languages) <= 48 << 20
    assert language_id._fitting(300_000, 4) == 300_000 and language_id._fitting(500_000, 4) == 500_000


def test_backoff_takes_the_longest_ngram(spark):
    words = spark.createDataFrame([("known", -1, -2)], "word string, l0 long, l1 long")
    grams = spark.createDataFrame([("^x", -10, -20), ("xy", -30, -10), ("y", -50, -51)], "gram string, l0 long, l1 long")
    model = language_id.Model(("a", "b"), words, grams, 3)
    asked = spark.createDataFrame([("xy",), ("q",)], "word string")
    for most in (0, 500_000):
        assert sorted(map(tuple, language_id.backoff(asked, model, most).collect())) == [("q", 0, 0), ("xy", -30, -27)]
