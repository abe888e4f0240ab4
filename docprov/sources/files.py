"""File and JSON sources and sinks, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.functions.workers import ship

#: Accepted types and their extensions, the largest upload.
EXTENSIONS = {"application/pdf": ".pdf", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/webp": ".webp", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/png": ".png"}
MOST_BYTES = 25 * 1024 * 1024
METRICS = "source string, generatedAt string, attacks array<struct<name:string,survived:boolean,bitsRecovered:int,psnrDb:double,target:int>>, psnrCurve array<struct<delta:int,psnrDb:double,bitsRecovered:int>>"

_own: list[str] = []
_made: list[str] = []
_scoped: ContextVar[list[str] | None] = ContextVar("_scoped", default=None)


def _at(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration: a bare path is on its default file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path (a URI) below spark.checkpoint.dir; a local session that sets none gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        base = _own[0]
    if "://" not in base:
        store, at = _at(spark, base)
        base = re.sub("^file:/+", "file:///", store.makeQualified(at).toString())
    made, scoped = f"{base.rstrip('/')}/{uuid.uuid4().hex}", _scoped.get()
    (_made if scoped is None else scoped).append(made)
    return f"{made}/{name}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made inside, by this thread, at the end: for a caller that by then has read, or written
    elsewhere, what it asked for. Those of other queries and threads stay."""
    own: list[str] = []
    before = _scoped.set(own)
    try:
        yield
    finally:
        _scoped.reset(before)
        for path in own:
            store, at = _at(spark, path)
            store.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables that no scope() has: for a session that is done with all its queries."""
    while _made:
        store, at = _at(spark, _made.pop())
        store.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder, and read from it: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extension(mime: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.coalesce(known[mime], F.lit(".png"))


def magic(content: Column) -> Column:
    """The accepted type that a file's first bytes are those of; null for others. All names of a type count as one."""
    first = F.hex(F.substring(content, 1, 12))

    def starts(*heads: str) -> Column:
        found = F.lit(False)
        for h in heads:
            found = found | first.startswith(h)
        return found

    # fixed values: the formats' signatures
    return (
        F.when(starts("89504E470D0A1A0A"), "image/png")
        .when(starts("FFD8FF"), "image/jpeg")
        .when(starts("25504446"), "application/pdf")
        .when(starts("424D"), "image/bmp")
        .when(starts("49492A00", "4D4D002A"), "image/tiff")
        .when(starts("52494646") & (F.substring(first, 17, 8) == "57454250"), "image/webp")
    )


def put_files(rows: DataFrame, folder: str) -> int:
    """Writes content (binary; null: empty) of rows as a file each, named name, below folder (shared_path()); returns how many.

    Tasks write on their own; a task that runs again writes the same files anew. An empty table writes none.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def uploads(spark: SparkSession, folder: str, most: int = MOST_BYTES) -> DataFrame:
    """path, declared (the type of the file's extension), found (magic()), n_bytes and accepted of the files below folder.

    Only files with an accepted extension are listed; of those above `most` bytes no content is read (the length is in the
    listing), and found is null. Empty files aren't listed at all. A file is accepted if its bytes are of the type that it declares.
    """
    glob = "*.{" + ",".join(sorted({e[1:] for e in (*EXTENSIONS.values(), ".jpeg")})) + "}"
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    declared = declared_type(F.regexp_extract("path", r"\.(\w+)$", 1))
    small = listed.filter(F.col("length") <= most).select("path", declared.alias("declared"), magic(F.col("content")).alias("found"), F.col("length").alias("n_bytes"))
    large = listed.filter(F.col("length") > most).select("path", declared.alias("declared"), F.lit(None).cast("string").alias("found"), F.col("length").alias("n_bytes"))
    return small.unionByName(large).withColumn("accepted", F.coalesce(F.col("found") == F.col("declared"), F.lit(False)))


def declared_type(extension_: Column) -> Column:
    """The accepted type of a file name's extension, in either case; null for others."""
    types = {"jpeg": "image/jpeg"} | {e[1:]: m for m, e in EXTENSIONS.items() if m != "image/jpg"}
    known = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))
    return known[F.lower(extension_)]


def write_metrics(rows: DataFrame) -> str:
    """One JSON record of a robustness table (kind, name, delta, bits, psnr, target, survived); returns its path."""
    attacks = F.sort_array(F.collect_list(F.when(F.col("kind") == "attack", F.struct("name", "survived", F.col("bits").alias("bitsRecovered"), F.col("psnr").alias("psnrDb"), "target"))))
    curve = F.sort_array(F.collect_list(F.when(F.col("kind") == "curve", F.struct("delta", F.col("psnr").alias("psnrDb"), F.col("bits").alias("bitsRecovered")))))
    path = shared_path(rows.sparkSession, "metrics")
    rows.agg(attacks.alias("attacks"), curve.alias("psnrCurve")).select(F.lit("suite").alias("source"), F.lit("1970-01-01").alias("generatedAt"), "attacks", "psnrCurve").write.json(path)
    return path


def read_metrics(spark: SparkSession, path: str | None) -> DataFrame:
    """The record's attacks and curve as rows; without a file one row says `not-run`."""
    if path is None:
        return spark.createDataFrame([("not-run", None, None, None, None)], "source string, kind string, name string, bits int, psnr double")
    m = spark.read.schema(METRICS).option("multiLine", "true").json(path)
    source = F.coalesce("source", F.lit("unknown")).alias("source")
    a = m.select(source, F.explode(F.coalesce("attacks", F.array())).alias("x")).select("source", F.lit("attack").alias("kind"), "x.name", F.col("x.bitsRecovered").alias("bits"), F.col("x.psnrDb").alias("psnr"))
    c = m.select(source, F.explode(F.coalesce("psnrCurve", F.array())).alias("x")).select("source", F.lit("curve"), F.col("x.delta").cast("string"), "x.bitsRecovered", "x.psnrDb")
    return a.union(c)


def append_investigations(rows: DataFrame, path: str) -> None:
    """Appends rows to the table at path, partitioned by date; what is there stays."""
    rows.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("created_date").parquet(path)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def put_table(rows: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """A table at path for upsert(): rows in folders by the bucket of their key."""
    rows.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def upsert(rows: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """Puts rows into put_table()'s table under their keys; null keys are equal, and a key comes once in rows.

    Only the buckets of rows' keys are read and written, by dynamic partition overwrite; others keep their files. Doing the same
    again changes nothing, so a batch may be retried. New buckets are written aside first, as they are made of what they replace.
    """
    spark = rows.sparkSession
    fresh = written(rows.withColumn("_bucket", _bucket(key, buckets)), "fresh")
    touched = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]  # `buckets` at most
    if not touched:
        return
    old = spark.read.schema(fresh.schema).parquet(path).filter(F.col("_bucket").isin(touched))
    kept = old.join(fresh.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    whole = written(kept.unionByName(fresh), "buckets")
    whole.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
