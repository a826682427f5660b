"""Ids of many texts at once: texts are cut where a pretoken always begins, every distinct stretch is encoded
once and remembered in a bounded table, and the ids of all texts are gathered by numpy.

A pretoken of the byte-level pattern always begins at a single space between two characters that are no white
space. Space is always one byte in UTF-8, so the cut works on the raw bytes of an Arrow column. Where the bytes
next to a space may belong to wider white space, no cut is made: a missing cut only makes a stretch longer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21
#: Stretches longer than this are never remembered; the table starts anew beyond ``MOST`` stretches.
LONGEST, MOST = 64, 400_000

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Lead bytes of every multi-byte character with the property White_Space (and of many others).
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts in them); null counts as empty."""
    wide = texts.fill_null("").cast(pa.large_string())
    _valid, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows with about ``most`` bytes of text each."""
    _raw, ends = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def cut_places(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted byte places where a stretch begins: every non-empty text, and every space between non-blank neighbours."""
    edge = np.zeros(len(raw) + 2, bool)
    edge[ends] = True
    spaces = np.flatnonzero(raw == 32)
    spaces = spaces[~edge[spaces] & ~edge[spaces + 1]]
    before, after = raw[spaces - 1], raw[spaces + 1]
    second, third = raw[np.maximum(spaces - 2, 0)], raw[np.maximum(spaces - 3, 0)]
    wide = (before >= 0x80) & (_WIDE[second] | (second >= 0x80) & _WIDE[third])
    spaces = spaces[~(_BLANK[before] | _BLANK[after] | wide | _WIDE[after])]
    edge[spaces] = True
    edge[len(raw) :] = False
    return np.flatnonzero(edge)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]`` one behind the other."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - first, sizes) + np.arange(total)]


class PieceTable:
    """Bounded memory of encoded stretches. ``learn`` gives the ids of new ones, each as little-endian 32-bit bytes."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int = MOST, longest: int = LONGEST) -> None:
        self.learn, self.most, self.longest, self.known = learn, most, longest, {}

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = pieces
        known.update(zip(new, self.learn(new), strict=True))
        found = [known[p] for p in pieces]
        for piece in new:
            if len(piece) > self.longest:
                del known[piece]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        raw, ends = text_bytes(texts)
        cuts = cut_places(raw, ends)
        if not len(cuts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        offsets = np.append(cuts, len(raw))
        if len(raw) < 1 << 31:
            pieces = pa.Array.from_buffers(pa.string(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
        else:
            pieces = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        found = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        ids = gather(np.frombuffer(b"".join(found), "<u4"), starts[which], sizes[which])
        places = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids, places[np.searchsorted(cuts, ends)]


#: Matches a stretch that begins with one space and ends without white space, so that it may stand beside others.
stands_alone = re.compile(r" \S(?:.{0,62}\S)?", re.DOTALL).fullmatch


def learn_side_by_side(
    pieces: list[str], joinable: Callable[[str], object], together: Callable[[str], np.ndarray],
    single: Callable[[list[str]], list[np.ndarray]], sizes: np.ndarray,
) -> list[bytes]:
    """Ids of each stretch. Those that may stand beside others are encoded as one text and told apart by the bytes
    of the ids (``sizes``); the others one by one, and all of them where the bytes don't add up."""
    out: list[bytes] = [b""] * len(pieces)
    able = list(map(joinable, pieces))
    rest = [k for k, yes in enumerate(able) if not yes]
    beside = [k for k, yes in enumerate(able) if yes]
    if beside:
        ids = np.asarray(together("".join([pieces[k] for k in beside])), "<u4")
        ends = np.cumsum([len(pieces[k].encode()) for k in beside])
        reach = np.cumsum(sizes[ids])
        if len(reach) and reach[-1] == ends[-1]:
            raw, at = ids.tobytes(), 0
            for k, cut in zip(beside, (4 * (np.searchsorted(reach, ends) + 1)).tolist(), strict=True):
                out[k] = raw[at:cut]
                at = cut
        else:
            rest = list(range(len(pieces)))
    for k, found in zip(rest, single([pieces[k] for k in rest]), strict=True):
        out[k] = np.asarray(found, "<u4").tobytes()
    return out


class LibraryPieces(PieceTable):
    """Stretches encoded as the tokenizers library does, without special tokens around the text.

    ``plain_special``: strings of special tokens inside a text are ordinary text. Short stretches go through tiktoken,
    which is faster, where the file is byte-level BPE whose ids are the merge ranks, so that both give the same ids.
    """

    def __init__(self, path: str, plain_special: bool = False, **bounds: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_special
        added = self.tokenizer.get_added_tokens_decoder()
        special = {i: len(t.content.encode()) for i, t in added.items()}
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab().items()} | special  # a letter of a token is a byte
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        marks = "|".join(re.escape(t.content) for t in added.values())
        self.mark = re.compile(marks).search if marks and not plain_special else None
        self.together = _by_ranks(path) or self._one
        super().__init__(self._encode, **bounds)

    def _one(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _single(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, new: list[str]) -> list[bytes]:
        mark = self.mark
        joinable = (lambda p: stands_alone(p) and not mark(p)) if mark else stands_alone
        return learn_side_by_side(new, joinable, self.together, self._single, self.sizes)


def _by_ranks(path: str) -> Callable[[str], np.ndarray] | None:
    """tiktoken's encoder of the file, or None where its ids are no merge ranks."""
    import tiktoken

    from snapledger.llm.bpe import PATTERN, byte_letters

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
    raw = lambda s: bytes(letters[c] for c in s)
    ranks = {raw(token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [ranks[raw("".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(ranks):
        return None
    encoding = tiktoken.Encoding("by-ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_to_numpy if hasattr(encoding, "encode_to_numpy") else lambda text: np.asarray(encoding.encode_ordinary(text))
