"""The file source judges pages one by one."""

import json
import pathlib

from docprov.sources import files
from pyspark.sql import functions as F


HEADS = {"a.png": b"\x89PNG\r\n\x1a\n", "b.PNG": b"\x89PNG\r\n\x1a\n", "c.jpg": b"\xff\xd8\xff", "d.jpeg": b"\xff\xd8\xff", "e.webp": b"RIFF\0\0\0\0WEBP", "f.webp": b"RIFF\0\0\0\0WAVE", "g.bmp": b"BM", "h.tiff": b"II*\0", "i.tiff": b"MM\0*", "j.pdf": b"%PDF-1", "k.pdf": b" %PDF-1", "l.png": b"%PDF-1", "m.exe": b"MZ", "n.png": b"", "o.png": None, "p.png": b"\x89PN"}


def test_files_are_judged_by_their_own_bytes(spark):
    folder = files.shared_path(spark, "up")
    rows = spark.createDataFrame(list(HEADS.items()), "name string, content binary").withColumn("other", F.lit(1)).repartition(3)
    assert files.put_files(rows, folder) == len(HEADS) == files.put_files(rows, folder)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.uploads(spark, folder).collect()}
    assert set(got) == set(HEADS) - {"m.exe", "b.PNG", "n.png", "o.png"}  # the glob is of one case, as are the extensions given out
    assert {n for n, r in got.items() if r["accepted"]} == {"a.png", "c.jpg", "d.jpeg", "e.webp", "g.bmp", "h.tiff", "i.tiff", "j.pdf"}
    assert (got["l.png"]["declared"], got["l.png"]["found"]) == ("image/png", "application/pdf")
    assert files.put_files(rows.filter("false"), files.shared_path(spark, "none")) == 0


def test_the_largest_upload(spark):
    most, folder = files.MOST_BYTES, files.shared_path(spark, "large")
    rows = spark.createDataFrame([("at.bmp", most), ("over.bmp", most + 1)], "name string, n int")
    files.put_files(rows.select("name", F.concat(F.lit("BM"), F.repeat(F.lit("x"), F.col("n") - 2)).cast("binary").alias("content")), folder)
    got = {r["path"].rsplit("/", 1)[1]: (r["n_bytes"], r["found"], r["accepted"]) for r in files.uploads(spark, folder).collect()}
    assert got == {"at.bmp": (most, "image/bmp", True), "over.bmp": (most + 1, None, False)}
    plan = files.uploads(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [LessThanOrEqual(length" in plan or "LessThanOrEqual(length" in plan


def test_intermediate_tables_have_full_paths_and_are_cleared(spark, tmp_path, monkeypatch):
    """A bare path is on the default file system, here that of the machine."""
    monkeypatch.setattr(files, "_made", [])
    monkeypatch.setattr(files, "_own", [str(tmp_path)])
    table = files.written(spark.range(3), "kept")
    (made,) = files._made
    base = spark.conf.get("spark.checkpoint.dir", None) or str(tmp_path)
    assert made.startswith("file:///") and made.removeprefix("file://").startswith(base.removeprefix("file://").rstrip("/"))
    place = pathlib.Path(made.removeprefix("file://"))
    assert table.count() == 3 and (place / "kept").is_dir()
    files.clear(spark)
    assert not place.exists() and not files._made


def test_a_scope_deletes_what_was_made_inside(spark):
    kept = files.written(spark.range(3), "kept")
    with files.scope(spark):
        inner = files.written(spark.range(4), "inner")
        place = pathlib.Path(inner.inputFiles()[0].removeprefix("file://")).parents[1]
        with files.scope(spark):
            files.written(spark.range(5), "innermost")
        assert inner.count() == 4 and place.exists()
    assert not place.exists() and kept.count() == 3


def test_upserts_replace_by_key_and_leave_other_buckets(spark):
    old = spark.createDataFrame([(i, "a") for i in range(200)] + [(None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (300, "C"), (None, "N")], "k long, v string")
    path = files.shared_path(spark, "keyed")
    place = pathlib.Path(path.removeprefix("file://"))
    files.put_table(old, "k", path, 16)
    names = lambda: {str(p.relative_to(place)) for p in place.rglob("*.parquet")}
    before, want = names(), {i: "a" for i in range(200)} | {2: "B", 300: "C", None: "N"}
    for _ in range(2):  # the same batch again changes nothing
        files.upsert(new, "k", path, 16)
        rows = spark.read.schema(old.schema).parquet(path).select("k", "v").collect()
        assert len(rows) == len(want) and dict(map(tuple, rows)) == want
    touched = {r[0] for r in new.select(files._bucket("k", 16)).collect()}
    assert {n.split("/")[0] for n in before - names()} == {f"_bucket={b}" for b in touched} and len(touched) < 4
    after = names()
    files.upsert(new.filter("false"), "k", path, 16)
    assert names() == after


def test_investigations_are_appended(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "investigation_id long, t string").selectExpr("investigation_id", "cast(t as timestamp_ntz) created_at")
    path = files.shared_path(spark, "inv")
    for k in (1, 2, 2):
        files.append_investigations(rows.filter(F.col("investigation_id") <= k), path)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(path).filter("created_date = '2024-01-02'").count() == 2


def test_suite_metrics_are_written_as_one_record_and_read_back(spark):
    rows = spark.createDataFrame([("curve", "8", 8, None, 48, 48.2, None), ("curve", "4", 4, None, 48, 54.22, None), ("attack", "blur 12", 12, False, 39, 44.68, 40)], "kind string, name string, delta int, survived boolean, bits int, psnr double, target int")
    path = files.write_metrics(rows)
    (line,) = [r["value"] for r in spark.read.text(path).collect()]
    assert json.loads(line) == {
        "source": "suite",
        "generatedAt": "1970-01-01",
        "attacks": [{"name": "blur 12", "survived": False, "bitsRecovered": 39, "psnrDb": 44.68, "target": 40}],
        "psnrCurve": [{"delta": 4, "psnrDb": 54.22, "bitsRecovered": 48}, {"delta": 8, "psnrDb": 48.2, "bitsRecovered": 48}],
    }
    got = sorted(map(tuple, files.read_metrics(spark, path).collect()), key=str)
    assert got == sorted([("suite", "attack", "blur 12", 39, 44.68), ("suite", "curve", "4", 48, 54.22), ("suite", "curve", "8", 48, 48.2)], key=str)
    assert [r["source"] for r in files.read_metrics(spark, None).collect()] == ["not-run"]
