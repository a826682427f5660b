"""Visits keep the content of a row once, and hashes that were just made are packed without a look at their digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions.hashing import packed_hex, packed_sha, unpacked_hex
from snapledger.plans import history
from snapledger.suite import load


def test_packed_sha_is_packed_hex_of_a_hash(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "t string").select(F.sha2("t", 256).alias("h"))
    for r in rows.select("h", packed_hex(F.col("h")).alias("a"), packed_sha(F.col("h")).alias("b"), unpacked_hex(packed_sha(F.col("h"))).alias("back")).collect():
        assert r.a == r.b and r.back == r.h


def test_visits_hold_content_once(spark, monkeypatch):
    staged = {}

    def spy(df, label):
        staged.setdefault(label, []).append(df.schema)
        return real(df, label)

    real = history.stage
    monkeypatch.setattr(history, "stage", spy)
    load()[0]["run_pipeline"](spark, "/root/testdata/sf0.001").count()
    for schema in staged["visits"]:
        assert "title" in schema["content"].dataType.names
        assert schema["first"].dataType.names == list(history.CREATED_BY)
