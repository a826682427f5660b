"""Best-fit packing of token sequences by minimum bin slack.

1. Texts become ids, an end id closes each document, and documents longer than ``room`` are cut into pieces: whole ones,
   but for the first, which takes what is left over. One pass, staged; each task numbers its pieces of equal length.
2. Only lengths matter for packing, and there are at most ``room`` of them, so the packing works on the number of pieces
   per length. For each bin the longest piece left is set, and a bitset subset-sum over the lengths left (bit s: a sum of
   s tokens can be made) finds the fullest feasible combination, which is then removed. The combination stays the
   fullest as long as its lengths last, since what is left only shrinks, so it is removed as many times as they last.
3. The k-th piece of a length takes the k-th place that the combinations have for that length. The number k is a piece's
   number in its task plus the pieces of that length in the tasks before: sums per (task, length), no window over pieces.

The driver holds ``room`` counts and the combinations, at most about room * ln(room) of them, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.bpe import vocabulary
from snapledger.llm.common import stage, table
from snapledger.llm.pieces import LibraryPieces, slices
from snapledger.llm.registry import query

ROOM, END_ID = 1024, 2


@lru_cache(maxsize=2)
def coder(path: str) -> LibraryPieces:
    return LibraryPieces(path)


def fullest(left: dict[int, int], free: int) -> dict[int, int]:
    """Copies per length, within ``left``, whose sum is the largest one up to ``free``; long lengths first on ties.

    Bit s of ``sums`` says that s can be made. Up to c copies of a length are tried as 1, 2, 4, ... and a rest.
    """
    sums, mask, steps = 1, (1 << free + 1) - 1, []
    for length in sorted((x for x, n in left.items() if n and x <= free), reverse=True):
        copies, chunk = min(left[length], free // length), 1
        while copies and not sums >> free & 1:
            taken = min(chunk, copies)
            steps.append((length, taken, sums))
            sums |= sums << taken * length & mask
            copies -= taken
            chunk *= 2
    at, found = sums.bit_length() - 1, {}
    for length, taken, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + taken
            at -= taken * length
    return found


def combinations(counts: dict[int, int], room: int = ROOM) -> list[tuple[dict[int, int], int]]:
    """Bins as (copies per length, how many such bins), until nothing is left."""
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        bin_ = fullest(left, room - longest)
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[x] // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((bin_, times))
    return out


def cut_documents(docs: DataFrame, path: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): pieces with their ids (little-endian unsigned 32-bit), and the
    number of each among the pieces of its length in its task. Write it before use: ``task`` counts partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen, task = coder(path), np.zeros(room + 1, np.int64), TaskContext.get().partitionId()
        for big in batches:
            for at, to in slices(big.column(1)):
                ids, ends = pieces.encode(big.column(1).slice(at, to - at))
                ids = np.insert(ids, ends[1:], end_id)
                sizes = np.diff(ends) + 1
                number = -(-sizes // room)
                doc = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                first = sizes - (number - 1) * room
                length = np.where(piece == 0, first[doc], room)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * room)
                order = np.argsort(length, kind="stable")
                found, begins = np.unique(length[order], return_index=True)
                per = np.diff(np.append(begins, len(order)))
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(begins, per) + np.repeat(seen[found], per)
                seen[found] += per
                places = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32 if 4 * len(ids) < 1 << 31 else np.int64)
                kind = pa.binary() if places.dtype == np.int32 else pa.large_binary()
                raw = pa.Array.from_buffers(kind, len(doc), [None, pa.py_buffer(places), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [big.column(0).slice(at, to - at).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                     raw.cast(pa.binary()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids", "task", "nth"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, task int, nth bigint")


def place(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """``pieces`` (with ``length``, ``task``, ``nth``) with ``sequence_id`` and ``offset`` in place of task and number."""
    spark = pieces.sparkSession
    per_task = stage(pieces.groupBy("task", "length").agg(F.count("*").alias("_n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # ``room`` rows at most
    places: dict[int, list] = {x: [] for x in counts}
    used, sequence = dict.fromkeys(counts, 0), 0
    for bin_, times in combinations(counts, room):
        offset = 0
        for x in sorted(bin_, reverse=True):
            places[x].append((used[x], sequence, bin_[x], offset))
            used[x] += bin_[x] * times
            offset += x * bin_[x]
        sequence += times
    schema = "length bigint, _places array<struct<since: bigint, sequence: bigint, copies: bigint, offset: bigint>>"
    plan = spark.createDataFrame(list(places.items()), schema)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per_task.select("task", "length", before.alias("_before"))
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    numbered = pieces.join(base, ["task", "length"]).join(plan, "length").withColumn("_nth", F.col("_before") + F.col("nth"))
    taken = F.element_at(F.filter("_places", lambda p: p["since"] <= F.col("_nth")), -1)
    found = numbered.withColumn("_place", taken).withColumn("_in", F.col("_nth") - F.col("_place.since"))
    copies = F.col("_place.copies")
    return found.select(
        *kept,
        (F.col("_place.sequence") + F.floor(F.col("_in") / copies)).cast("bigint").alias("sequence_id"),
        (F.col("_place.offset") + F.col("length") * (F.col("_in") % copies)).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece and its place.

    Only ``doc_id`` and ``text`` are read, so other columns can't clash. Null or empty text is the end id alone; a row
    without ``doc_id`` is packed like any other, under null; repeated rows are packed each; an empty table gives no rows. Texts
    of any length are cut whole. Sequences are filled without gaps; equal lengths take places in any order.
    """
    return place(stage(cut_documents(docs, path or vocabulary(), room, end_id), "pieces"), room)


@query("op12_best_fit")
def op12_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(table(spark, folder, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
