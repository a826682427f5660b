"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

The merge list fixes how far to the right a token boundary can still depend on unread bytes. Applied in
rank order, the merge (a, b) looks from the end of ``a`` over ``b`` and over what may still change behind
``b``; one pass over the list gives ``lookahead`` (119 bytes for the 50k list). The transducer reads a
pretoken byte by byte, keeps for every end position the one token that can end there, and emits a token
once its end lies ``lookahead`` bytes back. It holds a window of bounded size, however long a pretoken is.

Texts are cut at single spaces between non-blank characters, where a pretoken always begins, so equal pieces have equal
ids; a bounded table per worker remembers those of short pieces (``pieces.py``). Decoding gathers the bytes of a run of ids
at once and passes them through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from snapledger.llm.common import table
from snapledger.llm.pieces import PieceTable, gather, slices
from snapledger.llm.registry import query

#: Fixed value: the pretoken pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ONLY_BYTES = (3, 2, 1)
MAX_PIECE, MAX_PIECES, MAX_PAIRS = 64, 300_000, 300_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the vocabulary files for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a boundary that can decide whether it stays."""
    reach: dict[bytes, int] = {}
    for a, b in merges:
        behind = reach.get(b, 0)
        reach[a + b] = behind
        reach[a] = max(reach.get(a, 0), len(b) + behind)
    return max(reach.values(), default=0)


class Bpe:
    """Encoder and decoder of one vocabulary file (tokenizers' JSON, byte-level BPE without normalizer)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:  # by the last bytes, how long tokens that end so are; a window may begin within the last three
            for last in {token[-3:], *(token[-k:] for k in (1, 2))}:
                ends.setdefault(last, set()).add(len(token))
        short = lambda last: {k for j in range(1, len(last) + 1) for k in ends.get(last[-j:], ()) if k <= j}
        found = {last: (sizes if len(last) == 3 else set()) | short(last) for last, sizes in ends.items()}
        self.lengths = {last: tuple(sorted(sizes, reverse=True)) for last, sizes in found.items()}
        self.lookahead = sufficient_lookahead(merges)
        self.joined = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.rank = {self.ids[a + b]: rank for rank, (a, b) in enumerate(merges)}
        self.parts = {self.ids[a + b]: (self.ids[a], self.ids[b]) for a, b in merges}
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._pairs: dict[tuple[int, int], bool] = {}
        self.pieces = PieceTable(lambda new: list(map(self._piece, new)))
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self._sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._starts, self._raw = np.cumsum(self._sizes) - self._sizes, np.frombuffer(b"".join(tokens), np.uint8)
        self._tokens: dict[bytes, tuple[int, ...]] = {}

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are what merging their joint bytes gives: no merge of a lower rank
        than those that built them ever reaches across the seam."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        # Undo the two tokens' merges from the last to the first. A merge across the seam would have come
        # first if its rank is below that of the merge undone last (on equal terms the left one comes first).
        undone = len(self.rank) + 1
        undone_on_left = False
        while True:
            across = self.joined.get((left, right))
            if across is not None and (across < undone or across == undone and not undone_on_left):
                return False
            l_rank, r_rank = self.rank.get(left, -1), self.rank.get(right, -1)
            if l_rank < 0 and r_rank < 0:
                return True
            if l_rank >= 0 and l_rank > r_rank or r_rank < 0:
                undone, undone_on_left = l_rank, True
                left = self.parts[left][1]
            else:
                undone, undone_on_left = r_rank, False
                right = self.parts[right][0]

    def transduce(self, chunks: Iterator[bytes]) -> Iterator[int]:
        """Ids of one pretoken that comes in chunks of bytes."""
        window, ends, before = b"", [], -1  # ends[k]: (id, length) of the token that ends behind byte k
        find, longest, pairs, stays, lengths = self.ids.get, self.longest, self._pairs, self.stays, self.lengths
        for chunk in chunks:
            window += chunk
            for n in range(len(ends) + 1, len(window) + 1):
                for length in lengths.get(window[n - 3 if n > 3 else 0 : n], ONLY_BYTES):
                    start = n - length
                    token = find(window[start:n]) if start >= 0 else None
                    if token is not None:
                        left = ends[start - 1][0] if start else before
                        if left < 0 or ((left, token) in pairs and pairs[left, token]) or stays(left, token):
                            ends.append((token, n - start))
                            break
            if len(window) > 2 * self.lookahead + longest:
                stable = [x for x in self._chain(ends) if x[1] <= len(window) - self.lookahead]
                if stable:
                    yield from (token for token, _ in stable)
                    before, done = stable[-1]
                    window = window[done:]
                    del ends[:done]
        yield from (token for token, _ in self._chain(ends))

    @staticmethod
    def _chain(ends: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Tokens of the window with their ends, in order."""
        out, at = [], len(ends)
        while at > 0:
            token, length = ends[at - 1]
            out.append((token, at))
            at -= length
        return out[::-1]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for match in self.pattern.finditer(text):
            raw = match.group().encode()
            known = self._tokens.get(raw)
            if known is None:
                known = tuple(self.transduce(raw[k : k + 4096] for k in range(0, len(raw), 4096)))
                if len(raw) <= MAX_PIECE:
                    if len(self._tokens) >= MAX_PIECES:
                        self._tokens.clear()
                    self._tokens[raw] = known
            out.extend(known)
        return out

    def _piece(self, text: str) -> bytes:
        """Ids (little-endian, 4 bytes each) of a stretch that begins and ends at a pretoken boundary."""
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self._plain(part))
        return np.asarray(out, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        return self.pieces.encode(pa.array([text], pa.string()))[0].tobytes()

    def decode_stream(self, ids: np.ndarray) -> Iterator[str]:
        """Text of ids: bytes go through an incremental UTF-8 state machine, so any cut will do."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            yield state.decode(gather(self._raw, self._starts[part], self._sizes[part]).tobytes())
        yield state.decode(b"", final=True)


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One encoder per Python worker."""
    return Bpe(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` as further columns.

    ``docs`` needs ``text``; columns of the added names are replaced. Null or empty text has no ids and
    decodes to the empty text; rows are encoded one by one, so repeated rows get equal results and an empty
    table gives an empty one. Text that spells a special token gets that token's id.
    """
    path = path or vocabulary()
    added = ("n_tokens", "ids", "decoded")
    own = docs.select(*[f"`{c}`" for c in docs.columns if c not in added])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for big in batches:
            texts = big.column(big.schema.get_field_index("text"))
            for at, to in slices(texts):
                batch = big.slice(at, to - at)
                ids, ends = coder.pieces.encode(texts.slice(at, to - at))
                decoded = ["".join(coder.decode_stream(ids[s:e])) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                raw = pa.Array.from_buffers(pa.large_binary(), len(decoded), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids.astype("<u4"))])
                extra = [pa.array(np.diff(ends), pa.int64()), raw.cast(pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(work, f"{fields}, n_tokens bigint, ids binary, decoded string")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    coded = encode_documents(table(spark, folder, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
