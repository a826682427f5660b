"""N-gram Jaccard join with prefix filters under several global token orders.

A document is its set of 5-word shingles (64-bit hashes). Under any fixed order of all shingles, two sets of
similarity t share a shingle among the first n - ceil(t n) + 1 of each, and at least
min(p_a - n_a, p_b - n_b) + overlap of them. Candidates must pass this filter under every order:

* order 0, which makes the candidates, puts frequent shingles last. Frequencies are counted over the whole
  corpus in ``BUCKETS`` hash buckets (a bounded table); ties go by hash. Any order is correct, so a rough
  count costs nothing but candidates.
* order 1 (by hash) and order 2 (by another mix of the hash) are tested on a candidate's two sets before
  the full sets are compared.

The first shingle that two linked sets share under order 0 leaves at least the needed overlap behind it in both,
which bounds its place in each (positional filter). The parities of a set's shingles in ``PARITY_WORDS`` 64-bit
words bound the symmetric difference of two sets from below (bitmap filter). Both drop pairs that can't link,
and no others. Shingles in the prefixes of the very same documents act as one of their joint weight.

Documents with the same set are one class from the start. To keep a large group of near copies from making
all its pairs, candidates come in rounds: first only pairs with one hub per shared shingle; verified links
are merged into components; then other hubs; at last every remaining pair of documents that share enough
prefix shingles and are not yet in one component. A pair inside a component can't change the result, so
nothing is lost, and pairs are verified exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import stage, table
from snapledger.llm.registry import query

WORDS, PERCENT, BUCKETS, HUB_ROUNDS = 5, 80, 1 << 20, 2
HINT_BITS, HINT_BLOCKS, SALTS = 1 << 24, 64, 64
PARITY_WORDS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes: words are runs of non-blanks with A-Z lowered; short texts are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    s = h[:n].copy()
    for k in range(1, width):
        s = mixed(s) + h[k : k + n]
    return np.unique(mixed(s))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of shingles falls on each of 64 * ``PARITY_WORDS`` bits."""
    bits = 64 * PARITY_WORDS
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Filters under the further orders, then the exact test 100 * |a & b| >= percent * |a | b|."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    p, q = prefix_length(len(a), percent), prefix_length(len(b), percent)
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    enough = max(1, min(p - len(a), q - len(b)) + need)
    if len(np.intersect1d(a[:p], b[:q], True)) < enough:
        return False
    x, y = np.sort(mixed(a)), np.sort(mixed(b))
    if len(np.intersect1d(x[:p], y[:q], True)) < enough:
        return False
    both = len(np.intersect1d(a, b, True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2) of every document, and (block, salt, counts) of every task: shingle counts by hash bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "n", "d1", "d2", "block", "salt", "counts"]
        salt = 0
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            if sets:
                seen += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            d = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
            none = pa.nulls(len(sets), pa.int64())
            salt = int(d[0, 0]) % SALTS if len(d) else salt
            cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), none, none, pa.nulls(len(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if seen.any():
            none = pa.nulls(HINT_BLOCKS, pa.int64())
            blocks = [x.astype("<u4").tobytes() for x in seen.reshape(HINT_BLOCKS, -1)]
            cols = [none, none, none, none, pa.array(range(HINT_BLOCKS), pa.int64()), pa.array([salt] * HINT_BLOCKS, pa.int64()), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(work, "doc_id bigint, n bigint, d1 bigint, d2 bigint, block bigint, salt bigint, counts binary")


def _blockwise(rows: DataFrame, keys: list[str], width: str, out: str, fold) -> DataFrame:
    """Fold the equally long arrays in ``rows.counts`` (``width``) of every key into one (``out``), batch by batch."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                new = np.frombuffer(x, width).astype(out)
                total = new if total is None else fold(total, new)
        cols = [pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=[*keys, "counts"])

    kind = "".join(f"{k} bigint, " for k in keys) + "counts binary"
    return rows.select(*keys, "counts").groupBy(*keys).applyInArrow(work, kind)


def frequency_levels(summaries: DataFrame) -> np.ndarray:
    """For every bucket, how far its count is above the mean, in half powers of two: ``BUCKETS`` small numbers."""
    tasks = summaries.filter("block IS NOT NULL")
    sums = _blockwise(_blockwise(tasks, ["block", "salt"], "<u4", "<i8", np.add), ["block"], "<i8", "<i8", np.add)
    seen = np.zeros((HINT_BLOCKS, BUCKETS // HINT_BLOCKS))
    for row in sums.collect():  # ``BUCKETS`` numbers in all
        seen[row["block"]] = np.frombuffer(row["counts"], "<i8")
    seen = seen.reshape(-1)
    mean = seen.mean()
    chance = 4.0 * mean**0.5 + 4.0  # what rare shingles that share a bucket by chance may add to the mean
    return np.maximum(0, np.floor(1 + 2 * np.log2(np.maximum(seen - mean, 1e-9) / chance))).astype(np.uint64)


def _prefixes(docs: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, tokens, parity): the prefix of every document under order 0, in order, and its set's parities."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, parity = [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                parity.append(parities(s))
                order = np.lexsort((s, levels[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                out.append(s[order[: prefix_length(len(s), percent)]].view(np.int64) if len(s) else s.view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(parity, kind)], names=["doc_id", "tokens", "parity"])

    return docs.mapInArrow(work, "doc_id bigint, tokens array<bigint>, parity array<bigint>")


def _slots(ids: pa.Array) -> np.ndarray:
    return (mixed(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(HINT_BITS - 1)).astype(np.int64)


def _hinted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most of those that are not in ``ids``: a bitmap of ``HINT_BITS`` id hashes goes to the scan.

    It only saves shuffling texts; the join that follows decides. The bitmap's size is fixed; it is put
    together by blocks from the tasks' bitmaps.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(HINT_BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0))] = True
        blocks = np.packbits(bits).reshape(HINT_BLOCKS, -1)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([blocks[k].tobytes() for k in used], pa.binary())], names=["block", "counts"])

    marked = ids.mapInArrow(mark, "block bigint, counts binary")
    found = _blockwise(marked, ["block"], "<u1", "<u1", np.bitwise_or).collect()  # HINT_BITS / 8 bytes in all
    packed = np.zeros((HINT_BLOCKS, HINT_BITS // 8 // HINT_BLOCKS), np.uint8)
    for row in found:
        packed[row["block"]] = np.frombuffer(row["counts"], np.uint8)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed.reshape(-1)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[_slots(batch.column(0))]))

    return docs.select("doc_id", "text").mapInArrow(sift, "doc_id bigint, text string")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Texts of the documents in pairs are joined to them; a text is looked at whole."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = _hinted(docs, ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = (
        pairs.select("a", "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=64)(shingles)
        for batch in batches:
            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = pa.array([linked(known(x), known(y), percent) for x, y in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a bigint, b bigint")


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label reachable by ``edges`` (a, b) for every row of ``labels`` (doc_id, label).

    Works on labels: every label hooks to the smallest neighbour, then pointers are halved, until nothing moves.
    """
    of = lambda side: labels.select(F.col("doc_id").alias(side), F.col("label").alias(f"label_{side}"))
    links = edges.join(of("a"), "a").join(of("b"), "b").filter("label_a <> label_b")
    links = links.select(F.col("label_a").alias("u"), F.col("label_b").alias("v"))
    links = stage(links.union(links.select("v", "u")).distinct(), "links")
    if links.isEmpty():
        return labels
    roots = links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("root"))
    while True:
        roots = stage(roots, "roots")
        up = roots.select(F.col("u").alias("root"), F.col("root").alias("above"))
        halved = stage(roots.join(up, "root", "left").select("u", F.coalesce("above", "root").alias("root")), "roots")
        at = lambda name, root: halved.select(F.col("u").alias(name), F.col("root").alias(root))
        seen = links.join(at("v", "root_v"), "v").groupBy("u").agg(F.min("root_v").alias("near"))
        # The root of a node hears of the nearest root too, so that whole trees move.
        moved = halved.join(seen, "u").select("u", "root", F.least("root", "near").alias("near"))
        hooks = moved.groupBy("root").agg(F.min("near").alias("hook"))
        hooked = stage(
            moved.join(hooks.withColumnRenamed("root", "u"), "u", "left").select(
                "u", F.least("near", F.coalesce("hook", "near")).alias("new"), F.col("root").alias("old")
            ),
            "roots",
        )
        changed = not hooked.filter("new <> old").isEmpty() or not halved.join(roots.withColumnRenamed("root", "was"), "u").filter("root <> was").isEmpty()
        roots = hooked.select("u", F.col("new").alias("root"))
        if not changed:
            break
    to = roots.select(F.col("u").alias("label"), "root")
    return stage(labels.join(to, "label", "left").select("doc_id", F.coalesce("root", "label").alias("label")), "labels")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document.

    Documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more are linked;
    ``component_id`` is the smallest id reachable by links. Null, empty or blank texts have no shingles and
    are alone. A document id stands for one document: of several rows with one id, the one with the smallest
    text (null first) counts; rows without an id are left out. An empty table gives no rows.
    """
    ids = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = stage(_summaries(ids), "shingle-sets")
    own = found.filter("block IS NULL").groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("s")).select("doc_id", "s.*")
    classes = own.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = stage(own.join(classes, ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = member.filter("n > 0 AND doc_id = rep").select("doc_id", "n")

    levels = frequency_levels(found)
    prefix = _prefixes(ids, levels, percent).join(reps, "doc_id").dropDuplicates(["doc_id"])
    rows = stage(prefix.select("doc_id", F.col("n").cast("int").alias("n"), "tokens", "parity"), "prefixes")
    hits = stage(_shared_prefixes(rows), "shared-prefixes")

    labels = stage(reps.select("doc_id", F.col("doc_id").alias("label")), "labels")
    for turn in range(HUB_ROUNDS):
        pairs = stage(_hub_pairs(hits, labels, turn, percent), "hub-pairs")
        labels = components(labels, stage(_verified(pairs, ids, percent), "links-found"))
    pairs = stage(_rest_pairs(hits, labels, rows.select("doc_id", "parity"), percent), "rest-pairs")
    labels = components(labels, stage(_verified(pairs, ids, percent), "links-found"))
    lowest = member.join(labels.select(F.col("doc_id").alias("rep"), "label"), "rep", "left")
    return lowest.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))


def _shared_prefixes(rows: DataFrame) -> DataFrame:
    """(token, doc_id, n, pos, weight): prefix shingles found in two documents or more.

    Shingles of the very same documents (known by two 64-bit sums of their ids' hashes and their number) get one
    ``token``; ``weight`` is how many they are and ``pos`` the first one's place in the document's order.
    """
    each = rows.select(F.posexplode("tokens").alias("pos", "shingle"), "doc_id", "n")
    holders = each.groupBy("shingle").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "doc_id")).alias("y")
    )
    token = F.xxhash64("c", "x", "y").alias("token")
    shared = each.join(holders.filter("c > 1").select("shingle", token), "shingle")
    return shared.groupBy("token", "doc_id").agg(F.first("n").alias("n"), F.min("pos").alias("pos"), F.count("*").alias("weight"))


def _needed(a: str, b: str, percent: int) -> Column:
    """Shingles that two linked sets of these sizes share at least."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _enough(a: str, b: str, percent: int) -> Column:
    """Prefix shingles that a pair must share at least."""
    need = _needed(a, b, percent)
    short = lambda n: 1 - F.ceil(percent * F.col(n) / F.lit(100))
    return F.greatest(F.lit(1), F.least(short(a), short(b)) + need)


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _open_hits(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of shingles whose documents are not all in one component yet."""
    marked = hits.join(labels, "doc_id")
    open_ = marked.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("token")
    return marked.join(open_, "token")


def _hub_pairs(hits: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each document with the hub of its open shingles, if they share at least half of what a link needs.

    A hub is the first document of a shingle by id, in later turns by a hash of the id. This only
    decides which links are found early.
    """
    rows = stage(_open_hits(hits, labels), "open-prefixes")
    first = F.struct((F.xxhash64(F.lit(turn), "doc_id") if turn else F.col("doc_id")).alias("by"), F.col("doc_id").alias("hub"), F.col("n").alias("n_hub"), F.col("label").alias("label_hub"))
    hubs = rows.groupBy("token").agg(F.min(first).alias("h")).select("token", "h.hub", "h.n_hub", "h.label_hub")
    met = rows.join(hubs, "token").filter((F.col("label") != F.col("label_hub")) & _sizes_fit("n", "n_hub", percent))
    counted = met.groupBy(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).agg(
        F.sum("weight").alias("c"), F.first("n").alias("n"), F.first("n_hub").alias("n_hub")
    )
    return counted.filter(2 * F.col("c") >= _enough("n", "n_hub", percent)).select("a", "b")


def _rest_pairs(hits: DataFrame, labels: DataFrame, parity: DataFrame, percent: int) -> DataFrame:
    """Every pair in different components that passes the positional and the bitmap filter and shares as many
    prefix shingles as a link must."""
    rows = stage(_open_hits(hits, labels), "open-prefixes").join(parity, "doc_id")
    side = lambda s: rows.select("token", F.col("doc_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "label", "pos", "parity")])
    need = _needed("n_a", "n_b", percent)
    in_place = (F.col("pos_a") <= F.col("n_a") - need) & (F.col("pos_b") <= F.col("n_b") - need)
    odd = F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(odd, F.lit(0), lambda total, x: total + x)
    near = differ <= F.col("n_a") + F.col("n_b") - 2 * need
    apart = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _sizes_fit("n_a", "n_b", percent)
    found = side("a").join(side("b"), ["token"]).filter(apart & in_place & near).select("a", "b", "n_a", "n_b").distinct()
    bags = hits.groupBy("doc_id").agg(F.collect_list(F.struct("token", "weight")).alias("bag"))  # at most its own prefix
    bag = lambda s: bags.select(F.col("doc_id").alias(s), F.col("bag").alias(f"bag_{s}"))
    common = F.aggregate(F.array_intersect("bag_a", "bag_b"), F.lit(0).cast("bigint"), lambda total, x: total + x["weight"])
    return found.join(bag("a"), "a").join(bag("b"), "b").filter(common >= _enough("n_a", "n_b", percent)).select("a", "b")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 80 * (m.n + n.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r USING (doc_id) GROUP BY ALL
"""


@query("op9_jaccard_join", OP9_SQL)
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))
