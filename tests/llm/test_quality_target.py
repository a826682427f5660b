"""The trusted target of the quality rules is every good label."""

from __future__ import annotations

import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from snapledger.llm import quality


def test_every_good_label_is_trusted(spark):
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    assert quality.trusted_ids(labels.unionByName(labels)).count() == 20_000
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert quality.trusted_ids(labels).count() == 30_000


def test_only_likely_texts_are_joined_and_counts_stay_exact(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two"), F.col("id") % 50).alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 5"))
    trusted = docs.where("doc_id % 10 = 0").select("doc_id").distinct()
    likely = quality.likely_trusted(docs, trusted)
    assert likely.join(trusted, "doc_id", "left_semi").count() == 2_001
    assert likely.count() < 2_100
    grams = quality.trusted_grams(docs, trusted, 1 << 8)
    assert grams.count() == 2_001 and grams.where("rows = 2").count() == 2
    _, raw, good = quality.bucket_weights(docs, trusted, 1 << 8, grams)
    assert (sum(raw), sum(good)) == (5 * 20_005, 5 * 2_001)
    other = trusted.select(F.col("doc_id").cast("int"))  # equal ids of another type still join
    assert quality.trusted_grams(docs, other, 1 << 8).count() == 2_001


def test_counts_run_no_lambda_per_gram_and_equal_a_plain_count(spark):
    draw = random.Random(6)
    texts = [None, "", " ", "\n\n", "one", " one\ttwo ", "\x0bone\x0c\rtwo\n\ntwo", "a\x85b c d", "#*$%&|<>", "\\^-]#a# b"]
    texts += ["".join(draw.choice(["a", "b", "é", "\U0001f600", " ", " ", "\t", "\n", "#", "|", "<"]) for _ in range(draw.randint(0, 200))) for _ in range(200)]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randint(1, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]

    def bucket(*parts):
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part.encode(), seed)
        return (seed - (1 << 64 if seed >> 63 else 0)) % (1 << 8)

    raw = quality.raw_counts(docs, 1 << 8)
    want = Counter(bucket(*g) for ws in words for g in [(w,) for w in ws] + list(zip(ws, ws[1:], strict=False)))
    assert {r["bucket"]: r["raw"] for r in raw.collect()} == want
    assert "lambda" not in raw._jdf.queryExecution().optimizedPlan().toString()

    judged = quality.judge(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "sequence(" not in plan  # a string per character, places per word
    for r in judged.collect():
        text, ws = texts[r["doc_id"]] or "", words[r["doc_id"]]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        covered = {k + d for k in range(len(ws) - 2) if windows[tuple(ws[k : k + 3])] > 1 for d in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
