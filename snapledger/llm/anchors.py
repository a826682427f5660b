"""Alignment of two tokenizers over the same texts by whitespace-token anchors.

1. Both tokenizers encode the whole text (A: byte-level BPE of a space and the text; B: a sentencepiece model, which adds
   the space itself). The bytes of each side must join to the text, or the text has no tokens.
2. Byte places where both sides start a token marked by a space are shared ends: the anchors. They split a text into
   windows of token ids; a window's alignment depends on its two id tuples alone, so it is computed once per pair of
   tuples and remembered in a bounded table.
3. A link is an A and a B token that end together; one is then a suffix of the other. So the pairs that can ever occur
   follow from the two vocabularies (``Vocabularies.pairs``, 324,302 of the two files used), whatever the corpus: corpus-wide counts are one
   vector of that size, and no link crosses the network.

Stages: encode and align (staged), count per pair, judge each document's links by the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.bpe import byte_letters, vocabulary
from snapledger.llm.common import stage, table
from snapledger.llm.pieces import LibraryPieces, PieceTable, gather, learn_side_by_side, slices, stands_alone, text_bytes
from snapledger.llm.registry import query

#: The sentencepiece stand-in for a space.
MARK = "▁"
#: Stretches per tokenizer and windows remembered per worker, and bytes of the longest window that is.
MOST_PIECES, MOST_WINDOWS, LONGEST_WINDOW = 120_000, 120_000, 256


class Side:
    """Bytes of every id of one vocabulary."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.marked = np.fromiter((t[:1] == b" " for t in self.tokens), bool, len(self.tokens))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.raw, self.starts[ids], self.sizes[ids])


class SentencePieces(PieceTable):
    """Stretches that begin with a space, encoded by a sentencepiece model that adds it.

    No token of such a model may hold the space mark behind another character: then no merge reaches over a stretch.
    """

    def __init__(self, path: str, **bounds: int) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("a token of this model spans a space")
        self.side = Side({i: bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)})
        super().__init__(self._encode, **bounds)

    def _one(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text[1:], num_threads=1), np.uint32)

    def _encode(self, new: list[str]) -> list[bytes]:
        joinable = lambda p: stands_alone(p) and MARK not in p
        return learn_side_by_side(new, joinable, self._one, lambda texts: list(map(self._one, texts)), self.side.sizes)


class Vocabularies:
    """Both tokenizers, and all id pairs whose tokens can end together, as sorted codes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a_pieces = LibraryPieces(a_path, plain_special=True, most=MOST_PIECES)
        self.b_pieces = SentencePieces(b_path, most=MOST_PIECES)
        letters, special = byte_letters(), self.a_pieces.tokenizer.get_added_tokens_decoder()
        raw = lambda t: bytes(letters[c] for c in t)
        self.a = Side({i: special[i].content.encode() if i in special else raw(t) for t, i in self.a_pieces.tokenizer.get_vocab().items()})
        self.b = self.b_pieces.side
        named = [f"{i}{end}" for side, last in ((self.a, "|"), (self.b, ";")) for i in range(len(side.tokens)) for end in (",", last)]
        self.names = Side(dict(enumerate(map(str.encode, named))))
        self.width = len(self.b.tokens)
        of_a, of_b = _by_bytes(self.a), _by_bytes(self.b)
        codes = {i * self.width + j for i, t in enumerate(self.a.tokens) for k in range(len(t)) for j in of_b.get(t[k:], ())}
        codes |= {i * self.width + j for j, t in enumerate(self.b.tokens) for k in range(len(t)) for i in of_a.get(t[k:], ())}
        self.pairs = np.array(sorted(codes), np.int64)
        self.windows: dict[bytes, tuple[str, bytes]] = {}

    def align(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Alignments of windows, given as ids of A and of B one behind the other and how many each window has.

        Groups of each window as text (``a1,a2|b1;a3|b2``), numbers of the pairs that end its groups, and how many.
        """
        a_end, b_end = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])  # the sides of a window cover the same bytes
        ends = np.zeros((2, int(a_end[-1]) + 1), bool)
        ends[0, a_end] = ends[1, b_end] = True
        a_last, b_last = ends[1, a_end], ends[0, b_end]
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_upto, b_upto = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]] = 2 * a + a_last
        written[np.arange(len(b)) + a_upto[b_group]] = 2 * (len(self.a.tokens) + b.astype(np.int64)) + b_last
        text = self.names.bytes_of(written).tobytes().decode("ascii")
        last_token = np.cumsum(a_size + b_size) - 1
        text_end = np.cumsum(self.names.sizes[written])[last_token].tolist()
        texts = [text[s : e - 1] for s, e in zip([0, *text_end[:-1]], text_end, strict=True)]
        codes = a[a_last].astype(np.int64) * self.width + b[b_last]
        per = np.diff(np.concatenate([[0], np.cumsum(a_last)])[np.concatenate([[0], np.cumsum(a_size)])])
        return texts, np.searchsorted(self.pairs, codes), per

    def windows_of(self, keys: list[bytes]) -> list[tuple[str, bytes]]:
        """Groups and pair numbers (little-endian 32-bit) of windows, each given as one string of 32-bit numbers: how
        many ids of A, then A's ids, then B's."""
        known = self.windows
        new = [k for k in keys if k not in known]
        if len(known) + len(new) > MOST_WINDOWS:
            known.clear()
            new = keys
        if new:
            ids = np.frombuffer(b"".join(new), "<u4")
            size = np.fromiter(map(len, new), np.int64, len(new)) // 4
            first = np.cumsum(size) - size
            a_size = ids[first].astype(np.int64)
            place = np.arange(len(ids)) - np.repeat(first, size)
            of_a = place <= np.repeat(a_size, size)
            texts, pairs, per = self.align(ids[of_a & (place > 0)], ids[~of_a], a_size, size - 1 - a_size)
            raw, ends = pairs.astype("<i4").tobytes(), (4 * np.cumsum(per)).tolist()
            known.update(zip(new, zip(texts, [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)], strict=True), strict=True))
        found = [known[key] for key in keys]
        for key in new:
            if len(key) > LONGEST_WINDOW:
                del known[key]
        return found


def _by_bytes(side: Side) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, token in enumerate(side.tokens):
        out.setdefault(token, []).append(i)
    return out


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def _same(side: Side, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Per text: whether its ids' bytes join to the text."""
    reach = np.concatenate([[0], np.cumsum(side.sizes[ids])])[ends]
    same = np.diff(reach) == np.diff(text_ends)
    tokens, chars = np.repeat(same, np.diff(ends)), np.repeat(same, np.diff(text_ends))
    wrong = np.flatnonzero(side.bytes_of(ids[tokens]) != raw[chars])
    places = np.flatnonzero(chars)[wrong]
    same[np.searchsorted(text_ends, places, "right") - 1] = False
    return same


def _aligned(texts: pa.Array, v: Vocabularies) -> tuple[list, list, list, list, list]:
    """n_a, n_b, n_groups, groups and pair numbers (little-endian 32-bit) of every text."""
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.fill_null(""), pa.scalar("")).cast(texts.type)
    raw, text_ends = text_bytes(spaced)
    (a, a_ends), (b, b_ends) = v.a_pieces.encode(spaced), v.b_pieces.encode(spaced)
    good = (np.diff(text_ends) > 1) & _same(v.a, a, a_ends, raw, text_ends) & _same(v.b, b, b_ends, raw, text_ends)
    n_a, n_b = np.where(good, np.diff(a_ends), 0), np.where(good, np.diff(b_ends), 0)
    a, b = a[np.repeat(good, np.diff(a_ends))], b[np.repeat(good, np.diff(b_ends))]
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    n_texts = len(good)
    if not len(a):
        return n_a.tolist(), n_b.tolist(), [0] * n_texts, [""] * n_texts, [b""] * n_texts
    a_start, b_start = (np.cumsum(s.sizes[x]) - s.sizes[x] for s, x in ((v.a, a), (v.b, b)))
    # Anchors: starts of texts, and shared token ends before tokens that both sides mark by a space.
    here = np.zeros(int(a_start[-1] + v.a.sizes[a[-1]]) + 1, np.uint8)
    here[a_start[v.a.marked[a]]] |= 1
    here[b_start[v.b.marked[b]]] |= 2
    here[a_start[a_first[good]]] = 3
    a_cut, b_cut = np.flatnonzero(here[a_start] == 3), np.flatnonzero(here[b_start] == 3)
    a_size, b_size = np.diff(np.append(a_cut, len(a))), np.diff(np.append(b_cut, len(b)))
    # One string of ids per window: how many of A, then A's, then B's.
    n = len(a_cut)
    first = np.arange(n) + a_cut + b_cut
    ids = np.empty(n + len(a) + len(b), "<u4")
    ids[first] = a_size
    ids[np.arange(len(a)) + np.repeat(first + 1 - a_cut, a_size)] = a
    ids[np.arange(len(b)) + np.repeat(first + 1 + a_size - b_cut, b_size)] = b
    offsets = np.append(first, len(ids)).astype(np.int64) * 4
    coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).dictionary_encode()
    keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = v.windows_of(keys)
    which = coded.indices.to_numpy()
    per = np.fromiter((len(x) // 4 for _t, x in found), np.int64, len(found))
    links = gather(np.frombuffer(b"".join(x for _t, x in found), "<i4"), np.cumsum(per)[which] - per[which], per[which])
    names = np.array([t for t, _x in found], object)[which].tolist()
    window_ends = np.searchsorted(a_cut, a_first + n_a)
    link_ends = np.concatenate([[0], np.cumsum(per[which])])[window_ends]
    window_from, link_from = np.concatenate([[0], window_ends[:-1]]), np.concatenate([[0], link_ends[:-1]])
    groups = [";".join(names[s:e]) for s, e in zip(window_from.tolist(), window_ends.tolist(), strict=True)]
    raw_links = links.tobytes()
    pairs = [raw_links[4 * s : 4 * e] for s, e in zip(link_from.tolist(), link_ends.tolist(), strict=True)]
    return n_a.tolist(), n_b.tolist(), (link_ends - link_from).tolist(), groups, pairs


def _groups(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links[, groups]); links are numbers of ``Vocabularies.pairs``."""
    extra = ["groups"] if keep_groups else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a_path, b_path)
        for big in batches:
            for at, to in slices(big.column(1), 1 << 20):
                n_a, n_b, n_groups, groups, pairs = _aligned(big.column(1).slice(at, to - at), v)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32())
                links = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(pairs), "<i4")))
                cols = [big.column(0).slice(at, to - at), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(digests, pa.string()), links]
                names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", *extra]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(groups, pa.string())] if extra else [])], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>"
    return docs.select("doc_id", "text").mapInArrow(work, fields + (", groups string" if keep_groups else ""))


def _pair_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """Corpus-wide links per pair: a vector of ``size`` per task, then a partial aggregate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["pair", "n"])

    found = aligned.select("links").mapInArrow(work, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # ``size`` rows at most
    counts = np.zeros(size, np.int64)
    counts[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) per row of ``docs``.

    Only ``doc_id`` and ``text`` are read, so other columns can't clash. Null or empty text, and text one side
    doesn't give back byte by byte (a text with U+2581), has zeros and no groups and counts nowhere. Rows without ``doc_id``
    and repeated rows are rows like any other, counted each. An empty table gives no rows. Where counts tie for a B id, all its
    pairs are best. Memory grows with the longest text, and with the vocabularies.
    """
    a_path, b_path = a_path or vocabulary(), b_path or vocabulary("piece_bpe_32k.model")
    v = vocabularies(a_path, b_path)
    aligned = stage(_groups(docs, a_path, b_path, keep_groups), "aligned")
    counts = _pair_counts(aligned, len(v.pairs))
    highest = np.zeros(v.width, np.int64)
    np.maximum.at(highest, v.pairs % v.width, counts)
    best = (counts == highest[v.pairs % v.width]) & (counts > 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column(batch.schema.get_field_index("links"))
            flat, ends = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
            n_best, total = (np.diff(np.concatenate([[0], np.cumsum(x[flat].astype(np.int64))])[ends]) for x in (best, counts))
            kept = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "links"]
            names = [name for name in batch.schema.names if name != "links"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best), pa.array(total)], names=[*names, "n_best", "count_sum"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.drop("links").schema)
    judged = aligned.mapInArrow(work, f"{fields}, n_best bigint, count_sum bigint")
    names = ["doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"]
    return judged.select(*names, *(["groups"] if keep_groups else []))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(table(spark, folder, "documents"))
