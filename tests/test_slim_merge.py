"""The history merge moves hashes as bytes and stages the records once."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions.hashing import packed_hex, unpacked_hex
from snapledger.plans import history
from snapledger.suite import load


def test_packed_hashes_are_half_as_long_and_come_back(spark):
    texts = ["ab" * 32, "AB" * 32, "é" * 32, "0" * 63, "g" * 64, "", "h1", "\x01x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed_hex(F.col("t")).alias("p"))
    out = [(r.t, r.back, r.n) for r in rows.select("t", unpacked_hex(F.col("p")).alias("back"), F.octet_length("p").alias("n")).collect()]
    assert [back for _t, back, _n in out] == texts
    assert out[0][2] == 33
    assert rows.where(F.col("p").isNotNull()).select("p").distinct().count() == len(texts) - 1


def test_records_are_staged_once_and_hashes_as_bytes(spark, monkeypatch):
    staged = {}

    def spy(df, label):
        staged.setdefault(label, []).append(dict(df.dtypes))
        return real(df, label)

    real = history.stage
    monkeypatch.setattr(history, "stage", spy)
    load()[0]["stream_late_runs"](spark, "/root/testdata/sf0.001").count()
    assert "standing" not in staged  # no run is lost, so the records stay where they are
    assert all(d["content_hash"] == d["dedupe_key"] == "binary" for d in staged["checked"] + staged["rows"])
    assert all(d["row_key"] == "binary" for d in staged["visits"])
