"""Divergence audit, packing and alignment against brute force, and their odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from snapledger.llm.anchors import align_documents, vocabularies
from snapledger.llm.bin_slack import combinations, fullest, pack_documents
from snapledger.llm.bpe import byte_letters, vocabulary
from snapledger.llm.iceberg import audit
from snapledger.llm.pieces import LibraryPieces, slices

JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [*" \n\t aé'sB1.-<|>\x85 　—日x\x1c\x00▁ﬁ", "<|endoftext|>", "  ", " a", " the", "<unk>", "<0x41>", " "]


def odd_texts(n: int, longest: int = 30, seed: int = 5) -> list[str | None]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, longest))) for _ in range(n)] + [None, "", "a" * 5000, " " * 5000, "x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.mark.parametrize("plain", [False, True])
def test_pieces_give_the_library_s_ids(library, plain):
    texts = odd_texts(3000)
    library.encode_special_tokens = plain
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    table, column, got = LibraryPieces(JSON, plain, most=500), pa.array(texts), []
    for at, to in slices(column, 2000):  # the table starts anew now and then
        ids, ends = table.encode(column.slice(at, to - at))
        got += [ids[s:e].tolist() for s, e in zip(ends, ends[1:])]
    library.encode_special_tokens = False
    assert got == want


# --- packing


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=6), st.integers(0, 25))
@settings(max_examples=200, deadline=None)
def test_fullest_is_the_best_sum(left, free):
    found = fullest(left, free)
    assert all(0 < n <= left[x] for x, n in found.items())
    sums = {0}
    for x, n in left.items():
        sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= free}
    assert sum(x * n for x, n in found.items()) == max(sums)


def test_combinations_repeat_what_single_bins_find():
    rnd = random.Random(1)
    for _ in range(20):
        counts = {rnd.randint(1, 64): rnd.randint(1, 9) for _ in range(rnd.randint(1, 20))}
        together, left = combinations(counts, 64), dict(counts)
        single = []
        while any(left.values()):
            longest = max(x for x, n in left.items() if n)
            left[longest] -= 1
            bin_ = fullest(left, 64 - longest)
            for x, n in bin_.items():
                left[x] -= n
            single.append(bin_ | {longest: bin_.get(longest, 0) + 1})
        assert [b for b, times in together for _ in range(times)] == single


def check_packing(rows, docs, library, room, end_id):
    want = []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % room
        cuts = ([first] if first else []) + [room] * (len(ids) // room)
        start = 0
        for piece, length in enumerate(cuts):
            want.append((doc_id, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start += length
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(x for _, x in places[:k]) for k in range(len(places))]
        assert sum(x for _, x in places) <= room
    return len(sequences)


def test_packing(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = pack_documents(docs.repartition(3)).collect()
    bins = check_packing(rows, [tuple(r) for r in docs.collect()], library, 1024, 2)
    assert bins <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_packing_of_odd_rows(spark, library):
    docs = [(k % 40 if k % 7 else None, t, k, k) for k, t in enumerate(odd_texts(300) * 2)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, sequence_id int, length int")
    rows = pack_documents(frame, room=16, end_id=7).collect()
    check_packing(rows, [d[:2] for d in docs], library, 16, 7)
    assert pack_documents(frame.limit(0)).collect() == []


# --- alignment


def brute_alignment(docs):
    import sentencepiece

    library, model = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    letters, names = byte_letters(), {i: t for t, i in library.get_vocab().items()}
    a_bytes = lambda i: bytes(letters[c] for c in names[i])
    b_bytes = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc_id, text in docs:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            whole = (" " + text).encode()
            if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
                a, b = [], []
            a_ends, b_ends = np.cumsum([len(a_bytes(i)) for i in a]), np.cumsum([len(b_bytes(i)) for i in b])
            i = j = 0
            for end in sorted(set(a_ends) & set(b_ends)):
                k, m = list(a_ends).index(end) + 1, list(b_ends).index(end) + 1
                groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
                links.append((a[k - 1], b[m - 1]))
                i, j = k, m
        counts.update(links)
        found.append((doc_id, a, b, groups, links))
    best = {}
    for (_a, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, a, b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(counts[x] == best[x[1]] for x in links)
        out.append((doc_id, len(a), len(b), len(groups), len(links), n_best, sum(counts[x] for x in links), digest))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def test_alignment_of_odd_texts(spark):
    docs = [(k % 200 if k % 9 else None, t) for k, t in enumerate(odd_texts(700, 25))]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, n_a int, links string").repartition(3)
    assert by_text(align_documents(frame).collect()) == by_text(brute_alignment(docs))
    assert align_documents(frame.limit(0)).collect() == []


def test_alignment_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    assert by_text(align_documents(docs).collect()) == by_text(brute_alignment([tuple(r) for r in docs.collect()]))


def test_groups_as_text(spark):
    row = align_documents(spark.createDataFrame([(1, "unhappiness is  odd")], "doc_id bigint, text string"), keep_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1


def test_every_linked_pair_is_foreseen():
    v = vocabularies(vocabulary(), vocabulary("piece_bpe_32k.model"))
    for text in (" the", " unhappiness", " 日本", " x1", " éclair"):
        a, b = (t.encode(pa.array([text]))[0] for t in (v.a_pieces, v.b_pieces))
        groups, links, per = v.align(a, b, np.array([len(a)]), np.array([len(b)]))
        ends = [tuple(int(side.split(",")[-1]) for side in group.split("|")) for group in groups[0].split(";")]
        assert [x * v.width + y for x, y in ends] == v.pairs[links].tolist()
        assert per.tolist() == [len(ends)]


# --- divergence


def brute_audit(docs, least, top):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for k, (text, lang, source) in enumerate(docs):
        text, lang, source = (x or "" for x in (text, lang, source))
        groups.add((lang, source))
        for word in terms.findall(text):
            word = word.translate(low)
            seen[lang, word].add(k)
            counts[lang, source][word] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (of, w), who in seen.items() if of == lang and len(who) >= least]
        sources = sorted(s for of, s in groups if of == lang)
        whole = Counter()
        for s in sources:
            whole.update({w: counts[lang, s][w] for w in kept})
        def share(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(gap(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            marked = [(-gap(p[s][w], q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(marked)[:top])):
                out += [(lang, s, part, x[2], -x[0], k + 1) for k, x in enumerate(rows)]
    return sorted(out)


def test_audit(spark):
    rnd = random.Random(4)
    words = ["a", "ab", "abc", "Abcd", "abcde", "abcdefghijklmnop", "abcdefghijklmnopq", "é", "éé", "日本語日本語", "x" * 300, "x" * 301, "z z", "Zz9zz", "__", "b"]
    docs = []
    for _ in range(400):
        text = None if rnd.random() < 0.05 else rnd.choice([" ", ",", "\n", "1"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))
        docs.append((text, rnd.choice(["en", "de", None, "xx"]), rnd.choice(["s1", "s2", "S1", "é", None])))
    docs += [("rare once", "zz", "only"), ("", "yy", "p"), (None, "yy", "q"), docs[0], docs[0]]
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "text string, lang string, source string, n int, term string").repartition(5)
    for least in (1, 10, 60):
        assert sorted(map(tuple, audit(frame, least).collect())) == brute_audit(docs, least, 10)
    assert audit(frame.limit(0)).collect() == []


def test_audit_of_one_very_long_text(spark):
    text = " ".join(f"w{chr(97 + k % 26)}{'q' * (k % 50)}" for k in range(200_000))
    docs = [(text, "en", "a"), *[("wb wc q", "en", "b")] * 3]
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(map(tuple, audit(frame, 2).collect())) == brute_audit(docs, 2, 10)
