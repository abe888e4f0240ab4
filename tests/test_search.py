"""Free-text search over numbers of any length."""

from docprov.operators import audit
from pyspark.sql import functions as F


def test_numbers_of_six_digits_are_found_whole(spark):
    ids = spark.createDataFrame([(7,), (12345,), (123456,)], "investigation_id long")
    rows = ids.select("investigation_id", F.lit("none").alias("verdict"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    found = lambda term: sorted(r["investigation_id"] for r in audit.search(rows, term).collect())
    assert found("INV-123456") == [123456] and found("inv-00007") == [7] and found("inv-12345") == [12345, 123456]
