"""Token ids in a file format: canonical length-limited Huffman codes, decoded by table in independent blocks.

1. Texts become ids once, staged as 16- or 32-bit integers; global id counts come from partial aggregates.
2. Code lengths are limited to ``MAX_BITS`` by package-merge and made canonical, so the header is the list
   of lengths (as many numbers as the vocabulary has ids: a fixed bound).
3. Each document's ids are one block of bits. A block has a checkpoint, the bit offset of its next segment,
   for every ``SEGMENT`` ids, so a reader can start at any segment without the ones before it.
4. Blocks are dealt to range parts of ``doc_id`` and sorted: the files hold all ids in ascending document
   order. A document's start is its offset in the part plus the totals of the parts before it.

The part borders come from quantiles of the id column alone, so nothing is encoded twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.bpe import vocabulary
from snapledger.llm.common import stage, table
from snapledger.llm.pieces import LibraryPieces, slices
from snapledger.llm.registry import query
from snapledger.staging import staging_dir

MAX_BITS, SEGMENT, END_ID = 18, 512, 0
BATCH, DECODE_BATCH = 64, 1024


@lru_cache(maxsize=2)
def library_coder(path: str) -> LibraryPieces:
    return LibraryPieces(path)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code length per id, none above ``limit``, by package-merge; ids without count get 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < len(leaves))
        merged = both[sort]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    take = 2 * (len(leaves) - 1)
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        lengths[order[:n_leaves]] += 1
        take = 2 * (take - n_leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): the lengths alone give them back."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for i in sorted(np.flatnonzero(lengths), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every ``MAX_BITS`` bits ahead: the id that starts there and its code length."""
    codes = canonical_codes(lengths)
    ids, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.int64)
    for i in np.flatnonzero(lengths):
        free = MAX_BITS - int(lengths[i])
        ids[int(codes[i]) << free : (int(codes[i]) + 1) << free] = i
        sizes[int(codes[i]) << free : (int(codes[i]) + 1) << free] = lengths[i]
    return ids, sizes


def pack(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, list[int]]]:
    """Bits and checkpoints of each document's ids."""
    if not docs:
        return []
    ids, sizes = np.concatenate(docs), [len(d) for d in docs]
    width = lengths[ids]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    bits = np.add.reduceat(width, first)
    base = np.concatenate([[0], np.cumsum((bits + 7) // 8)]).astype(np.int64) * 8  # each document starts at a byte
    place = np.cumsum(width) - width
    place += np.repeat(base[:-1] - place[first], sizes)
    word, shift = place >> 5, 64 - (place & 31) - width
    value = codes[ids] << shift.astype(np.uint64)
    n = int(base[-1] + 31) // 32 + 2
    words = np.bincount(word, (value >> np.uint64(32)).astype(float), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), n)
    raw = words.astype(">u4").tobytes()
    marks = [(place[f : f + s : SEGMENT] - b).tolist() for f, s, b in zip(first, sizes, base[:-1], strict=True)]
    return [(raw[b // 8 : e // 8], m) for b, e, m in zip(base[:-1].tolist(), base[1:].tolist(), marks, strict=True)]


def unpack(blocks: list[tuple[bytes, list[int], int]], ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Ids of blocks (bits, checkpoints, number of ids): all segments step forward together."""
    raw = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8).astype(np.uint32)
    at, left, bit = [], [], 0
    for bits, marks, n in blocks:
        at += [bit + m for m in marks]
        left += [min(SEGMENT, n - SEGMENT * k) for k in range(len(marks))]
        bit += 8 * len(bits)
    left_, at_ = np.asarray(left, np.int64), np.asarray(at, np.int64)
    starts = np.cumsum(left_) - left_
    order = np.argsort(-left_, kind="stable")
    place, where, counts = at_[order], starts[order], left_[order]
    out = np.empty(int(left_.sum()), np.uint32)
    for step in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -step, "left"))  # segments with more than ``step`` ids come first
        p = place[:live]
        byte = p >> 3
        ahead = (raw[byte] << 24) | (raw[byte + 1] << 16) | (raw[byte + 2] << 8) | raw[byte + 3]
        key = (ahead << (p & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[where[:live] + step] = ids[key]
        place[:live] = p + sizes[key]
    ends = np.cumsum([n for _, _, n in blocks])
    return np.split(out, ends[:-1]) if blocks else []


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with the end id appended; ids as 16-bit integers where the vocabulary fits, else 32-bit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(path)
        kind = np.dtype(id_type(coder.tokenizer.get_vocab_size()))
        for big in batches:
            for at, to in slices(big.column(1)):
                ids, ends = coder.encode(big.column(1).slice(at, to - at))
                ids = np.insert(ids, ends[1:], END_ID).astype(kind)
                offsets = kind.itemsize * (ends + np.arange(len(ends)))
                raw = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([big.column(0).slice(at, to - at), raw.cast(pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, ids binary")


def id_type(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    kind = id_type(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, kind), minlength=size) if len(x) > size else 0
                if len(x) <= size:
                    np.add.at(total, np.frombuffer(x, kind), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def write_ids(docs: DataFrame, folder: str, path: str | None = None, part_rows: int = 20_000) -> str:
    """Write the ids of ``docs`` to ``folder``; return it.

    Rows without ``doc_id`` have no place in the order and sort first, null like any id; null or empty text
    is the end id alone; repeated rows are written each, one behind the other. An empty table gives
    a folder with a header and no blocks.
    """
    from tokenizers import Tokenizer

    path, spark = path or vocabulary(), docs.sparkSession
    size = Tokenizer.from_file(path).get_vocab_size()
    kind = id_type(size)
    tokens = stage(token_rows(docs, path), "token-ids")
    lengths = code_lengths(id_counts(tokens, size))
    n_rows = tokens.count()
    parts = max(1, -(-n_rows // part_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    borders = tokens.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 and n_rows else []
    borders = sorted({int(b) for b in borders})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                batch = big.slice(at, BATCH)
                ids = [np.frombuffer(x, kind).astype(np.int64) for x in batch.column(1).to_pylist()]
                packed = pack(ids, lengths, codes)
                keys = batch.column(0)
                known = keys.fill_null(np.iinfo(np.int64).min).to_numpy()
                part = np.where(keys.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(borders, known, "right"), 0)
                cols = [pa.array(part, pa.int32()), keys, pa.array([len(x) for x in ids], pa.int64()), pa.array([b for b, _ in packed], pa.binary()), pa.array([m for _, m in packed], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "n_tokens", "bits", "checkpoints"])

    blocks = tokens.mapInArrow(work, "part int, doc_id bigint, n_tokens bigint, bits binary, checkpoints array<bigint>")
    placed = blocks.repartitionById(len(borders) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    placed.mapInArrow(_number, "part int, doc_id bigint, start bigint, n_tokens bigint, bits binary, checkpoints array<bigint>").write.option("compression", "none").partitionBy("part").parquet(f"{folder}/blocks")
    header = spark.createDataFrame([(size, lengths.astype("<u1").tobytes())], "size int, lengths binary")
    header.coalesce(1).write.parquet(f"{folder}/header")
    return folder


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running totals of ids within each part, over rows in file order."""
    running: dict[int, int] = {}
    for batch in batches:
        starts = []
        for part, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            starts.append(running.get(part, 0))
            running[part] = starts[-1] + n
        cols = [batch.column(0), batch.column(1), pa.array(starts, pa.int64()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "start", "n_tokens", "bits", "checkpoints"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files, ids as little-endian unsigned 32-bit.

    Blocks decode on their own, wherever a file is split; a start is its offset in the part plus the parts before.
    """
    head = spark.read.parquet(f"{folder}/header").first()
    lengths = np.frombuffer(head["lengths"], np.uint8).astype(np.int64)
    schema = "doc_id bigint, start bigint, n_tokens bigint, bits binary, checkpoints array<bigint>, part int"
    files = spark.read.schema(schema).parquet(f"{folder}/blocks")
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")  # a row per part
    before = dict(zip(totals["part"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist(), strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes = decode_table(lengths)
        for big in batches:
            for at in range(0, big.num_rows, DECODE_BATCH):  # many segments step together
                batch = big.slice(at, DECODE_BATCH)
                n = batch.column(2).to_pylist()
                starts = [s + before[p] for s, p in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                blocks = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), n, strict=True))
                found = [x.astype("<u4").tobytes() for x in unpack(blocks, ids, sizes)]
                cols = [batch.column(0), pa.array(starts, pa.int64()), batch.column(2), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


@query("op5_token_output")
def op5_token_output(spark: SparkSession, folder: str) -> DataFrame:
    out = write_ids(table(spark, folder, "documents"), f"{staging_dir(spark)}/token-files-{uuid.uuid4().hex}")
    return read_ids(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
