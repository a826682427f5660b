"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where its top bits are zero, so borders
depend on the last ``WINDOW`` bytes only and find themselves again behind an insertion. Chunks are compared
by a 128-bit digest over the whole corpus. A chunk found at two places or more, of one document or several, is
repeated; its first place (smallest document, then position) keeps it, every other place may drop it. Adjacent
repeated chunks that are all first places, or all not, are reported as one span; stretches of adjacent repeated chunks
count from ``min_span`` bytes.

Only digests and places are shuffled. Digest counts are partial aggregates; places find their digest with a
plain equi-join, which adaptive execution splits at hot digests. No pairs of places are ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import table
from snapledger.llm.registry import query

WINDOW, MASK_BITS, MIN_CHUNK, MAX_CHUNK, MIN_SPAN = 32, 4, 16, 128, 64


def gear_table() -> np.ndarray:
    """256 mixed 32-bit numbers, from a rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


GEAR = gear_table()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``. The rolling hash is h = 2 h + gear[byte] mod 2**32, here for all places at once."""
    n = len(data)
    if n == 0:
        return []
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # h over 2 spans = h over the last span + (h over the one before) << span
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    # Only the top bits mix the whole window.
    borders = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, last = [], 0
    for end in [*borders.tolist(), n]:
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if end - last >= MIN_CHUNK or end == n and end > last:
            ends.append(end)
            last = end
    return ends


def chunks(docs: DataFrame, key: Column) -> DataFrame:
    """(key, at, size, d1, d2, flat): the chunks of every text with their byte places and digests; flat: one and the same byte."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 256):
                batch = big.slice(start, 256)
                rows, at, size, digests, flat = [], [], [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    data, last = (text or "").encode(), 0
                    for end in chunk_ends(data):
                        digests.append(hashlib.blake2b(data[last:end], digest_size=16).digest())
                        rows.append(k)
                        at.append(last)
                        size.append(end - last)
                        flat.append(data.count(data[last], last, end) == end - last)
                        last = end
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                keys = batch.column(0).take(pa.array(rows, pa.int64()))
                cols = [keys, pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(flat, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "at", "size", "d1", "d2", "flat"])

    return docs.select(key.alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, at int, size int, d1 bigint, d2 bigint, flat boolean")


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """Spans of every text that are found elsewhere too, in other documents or at other places of the same one.

    (doc_id, start, length, n_chunks, first_doc, n_places, is_first): bytes of the UTF-8 text; ``first_doc`` is the
    smallest document with one of the span's chunks, ``n_places`` the most places that share one, and
    ``is_first`` whether the chunks of the span have their first place here (so that the span stays); a span is
    all first or not at all, and a stretch of repeated chunks with both is cut where that changes. ``min_span`` holds
    for the whole stretch, so that no piece of a long one is lost by the cut. Null or empty texts have no spans; rows
    that share a ``doc_id`` are one document (equal places of such rows are one place) and rows without one are
    left out. Chunks of one and the same byte count only if several documents hold them: a run of it, such as a ruler, is
    no passage that comes again. An empty table gives no rows.
    """
    # Chunks are made twice, once to count them and once to look them up: cheaper than keeping them on disk.
    placed = chunks(docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), F.col("doc_id"))
    at = F.when(~F.col("flat"), F.col("at"))
    digests = placed.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("places")
    ).filter((F.col("first_doc") < F.col("last_doc")) | (F.col("low") < F.col("high"))).select("d1", "d2", "first_doc", "places")
    # One exchange by document serves the windows over its digests and over its places.
    found = placed.drop("flat").join(digests, ["d1", "d2"]).repartition("doc_id")
    lowest = F.min("at").over(Window.partitionBy("doc_id", "d1", "d2"))
    found = found.withColumn("is_first", (F.col("first_doc") == F.col("doc_id")) & (F.col("at") == lowest))
    by_doc = Window.partitionBy("doc_id").orderBy("at", "size", "d1", "d2")
    apart = F.coalesce(F.col("at") > F.lag(F.col("at") + F.col("size")).over(by_doc), F.lit(True))
    turned = apart | (F.col("is_first") != F.lag("is_first").over(by_doc))
    marked = found.withColumn("apart", apart.cast("int")).withColumn("turned", turned.cast("int"))
    runs = marked.withColumn("stretch", F.sum("apart").over(by_doc)).withColumn("run", F.sum("turned").over(by_doc))
    end = F.max(F.col("at") + F.col("size"))
    spans = runs.groupBy("doc_id", "stretch", "run").agg(
        F.min("at").cast("bigint").alias("start"),
        (end - F.min("at")).cast("bigint").alias("length"),
        F.count("*").alias("n_chunks"),
        F.min("first_doc").alias("first_doc"),
        F.max("places").alias("n_places"),
        F.first("is_first").alias("is_first"),
    )
    whole = Window.partitionBy("doc_id", "stretch")
    stretch = F.max(F.col("start") + F.col("length")).over(whole) - F.min("start").over(whole)
    return spans.withColumn("_whole", stretch).filter(F.col("_whole") >= min_span).drop("stretch", "run", "_whole")


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents"))
