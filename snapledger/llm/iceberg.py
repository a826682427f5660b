"""Source divergence audit: frequent terms by iceberg prefix refinement, then exact divergences between sources.

1. One pass turns each document into its distinct terms in byte order. ``since`` says from which level on a term's prefix
   differs from that of the term before it in the same document, so a document has a prefix at a level once, for the one term
   with ``since`` <= level, and the number of distinct documents of any prefix is a plain sum: no set of documents is held
   or shuffled. Per slice of text, equal (lang, term, since) become one row with the occurrences per source as an array.
2. Refinement: prefixes of 4 bytes are counted per lang; those found in fewer than ``least`` documents are discarded with
   all their terms; those kept are extended to 8, 16, ... bytes, each level reading only rows whose prefix survived
   the one before. A term shorter than the level stands for itself and is done; it ends when no longer prefix is left.
3. Counts of the kept terms per source, and from them the divergences in exact integers.

Terms not counted in a source all have one and the same p there. A pair's sum over all kept terms therefore is: the terms both
sources count, plus, per source, its terms by count against the other's p of uncounted terms, minus the terms counted twice, plus
the rest times a constant. No row is made for a term that a source doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import stage, table
from snapledger.llm.pieces import slices, text_bytes
from snapledger.llm.registry import query

LEAST_DOCUMENTS, TOP_TERMS, FIRST_LEVEL = 10, 10, 4
#: Text bytes of a slice, within which equal rows add up.
SLICE = 8 << 20

#: Levels up to the longest text there can be.
LEVELS = FIRST_LEVEL << np.arange(30, dtype=np.int64)

_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _shared_bytes(terms: list[bytes]) -> np.ndarray:
    """Bytes that each of the sorted, distinct terms shares with the one before it."""
    raw, sizes = np.frombuffer(b"".join(terms), np.uint8), np.fromiter(map(len, terms), np.int64, len(terms))
    starts = np.cumsum(sizes) - sizes
    shared, open_ = np.zeros(len(terms), np.int64), np.arange(1, len(terms))
    while len(open_):  # one step per byte, for the terms still alike
        at = shared[open_]
        open_ = open_[(at < sizes[open_ - 1]) & (at < sizes[open_])]
        at = shared[open_]
        open_ = open_[raw[starts[open_] + at] == raw[starts[open_ - 1] + at]]
        shared[open_] += 1
    return shared


def _least_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of ``values[left + 1 : right + 1]`` per pair, by a table of minima over runs of 2^k."""
    levels = [values]
    span = right - left
    while 1 << len(levels) <= int(span.max(initial=1)):
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-step], last[step:]) if len(last) > step else last[:0])
    power = np.log2(span).astype(np.int64)
    out = np.empty(len(span), np.int64)
    for k, level in enumerate(levels):
        of = np.flatnonzero(power == k)
        out[of] = np.minimum(level[left[of] + 1], level[right[of] + 1 - (1 << k)])
    return out


def _term_rows(texts: pa.Array, lang: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (lang, term, since) of a slice: lang, term, since, documents, end of its run of (source, occurrences); and the runs."""
    raw, ends = text_bytes(texts)
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _TERM[raw]
    upper = (raw >= 65) & (raw <= 90)
    lower = raw + (upper * np.uint8(32)).astype(np.uint8)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[ends[:-1][ends[:-1] < len(raw)]] |= inside[ends[:-1][ends[:-1] < len(raw)]]
    start = np.flatnonzero(begins[:-1])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    closes = np.flatnonzero(inside[:-1] & ~inside[1:] | inside[:-1] & np.isin(np.arange(1, len(raw) + 1), ends)) + 1
    # Terms and the gaps between them alternate in one array of strings; only the terms are read.
    offsets = np.empty(2 * len(start) + 1, np.int64)
    offsets[:-1:2], offsets[1::2], offsets[-1] = start, closes, closes[-1]
    every = pa.Array.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(offsets), pa.py_buffer(lower)])
    coded = every.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(words, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    terms = words[order].tolist()  # sorted
    doc = np.searchsorted(ends, start, "right") - 1
    key, count = np.unique(doc * len(terms) + rank[coded.indices.to_numpy()], return_counts=True)
    doc, term = key // len(terms), key % len(terms)
    shared = np.zeros(len(key), np.int64)
    after = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    if len(after):
        shared[after] = _least_between(_shared_bytes(terms), term[after - 1], term[after])
    since = np.searchsorted(LEVELS, shared, "right")
    n_sources = int(source.max()) + 1
    whole = ((lang[doc] * len(terms) + term) * len(LEVELS) + since) * n_sources + source[doc]
    rows, where, n_docs = np.unique(whole, return_inverse=True, return_counts=True)
    n = np.bincount(where, count, len(rows)).astype(np.int64)
    outer = rows // n_sources
    first = np.flatnonzero(np.append(True, outer[1:] != outer[:-1]))
    row = outer[first]
    named = words[order][row // len(LEVELS) % len(terms)]
    return row // len(LEVELS) // len(terms), named, LEVELS[row % len(LEVELS)], np.add.reduceat(n_docs, first), np.append(first[1:], len(rows)), rows % n_sources, n


def term_rows(docs: DataFrame) -> DataFrame:
    """(lang, term, since, docs, sources, n): partial sums, not yet added up; ``sources`` and ``n`` run side by side."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at, to in slices(big.column(2), SLICE):
                batch = big.slice(at, to - at)
                langs, sources = (c.dictionary_encode() for c in batch.columns[:2])
                codes = [c.indices.to_numpy().astype(np.int64) for c in (langs, sources)]
                lang, terms, since, n_docs, ends, source, n = _term_rows(batch.column(2), *codes)
                offsets = pa.array(np.append(0, ends), pa.int32())
                cols = [
                    langs.dictionary.take(pa.array(lang)).cast(pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(since, pa.int64()), pa.array(n_docs, pa.int64()),
                    pa.ListArray.from_arrays(offsets, sources.dictionary.take(pa.array(source)).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "term", "since", "docs", "sources", "n"])

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(work, "lang string, term string, since bigint, docs bigint, sources array<string>, n array<bigint>")


def _prefix(level: int) -> Column:
    return F.substring(F.col("term").cast("binary"), 1, level)


def frequent_terms(rows: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) found in at least ``least`` documents of the lang; ``rows`` is a written table of ``term_rows``."""
    alive, level, done = rows, FIRST_LEVEL, []
    while True:
        found = alive.where(F.col("since") <= level).groupBy("lang", _prefix(level).alias("_prefix")).agg(F.sum("docs").alias("_docs"))
        kept = stage(found.where(F.col("_docs") >= least).select("lang", "_prefix"), f"prefixes-{level}")
        open_ = F.octet_length("_prefix") >= level
        done.append(kept.where(~open_).select("lang", F.col("_prefix").cast("string").alias("term")))
        if kept.where(open_).isEmpty():
            return stage(reduce(DataFrame.unionByName, done), "kept-terms")
        longer = rows.where(F.octet_length("term") >= level).withColumn("_prefix", _prefix(level))
        alive = longer.join(kept.where(open_), ["lang", "_prefix"], "left_semi").drop("_prefix")
        level *= 2


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), exactly."""
    big = lambda c: c.cast("decimal(20,0)")
    divide = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (big(count) + 2).cast("decimal(20,0)"), (big(total) + 2 * big(kept)).cast("decimal(28,0)"))
    return F.lit(1) + divide


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) per the module's docstring; ``part`` is ``pair`` or ``term``.

    ``docs`` needs ``text``, ``lang`` and ``source``; other columns are not read. Null counts as '' in each. A repeated
    row is a document of its own. A group without terms, or a lang without kept terms, has pairs with value 0 and no
    terms. Ties go to the smaller item by UTF-8 bytes. An empty table gives no rows. Terms of any length are whole.
    """
    rows = stage(term_rows(docs), "term-rows")
    kept = frequent_terms(rows, least)
    each = rows.join(kept, ["lang", "term"], "left_semi").select("lang", "term", F.explode(F.arrays_zip("sources", "n")).alias("_of"))
    counts = stage(each.groupBy("lang", F.col("_of.sources").alias("source"), "term").agg(F.sum("_of.n").alias("n")), "term-counts")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    known = stage(
        groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "total", "terms"])
        .withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v")))),
        "groups",
    )
    shares = stage(
        counts.join(known, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
        .select("lang", "source", "term", "n", "p", "p0"),
        "shares",
    )
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return _pairs(known, shares).select(*columns).unionByName(_terms(counts, sizes, shares, top).select(*columns))


def _pairs(known: DataFrame, shares: DataFrame) -> DataFrame:
    mine, other = known.alias("a"), known.alias("b")
    both = mine.join(other, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select(
        F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.v").alias("v"),
        (F.col("a.terms") + F.col("b.terms")).alias("_terms"), _gap(F.col("a.p0"), F.col("b.p0")).alias("_rest"),
    )
    # A source's terms against the p of terms the other doesn't count: one row per distinct count.
    by_count = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("_n")).alias("a").join(
        other, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))
    )
    alone = by_count.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(
        F.sum(F.col("_n") * _gap(F.col("a.p"), F.col("b.p0"))).alias("_alone")
    )
    # Terms that both count: the sum so far has taken them against the uncounted p of either side. The sources of a term
    # are at most those of its lang; each task adds pairs up, so only one row per pair leaves it.
    holders = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("_who"))
    met = holders.select("lang", F.explode("_who").alias("x"), "_who").select("lang", "x", F.explode("_who").alias("y"))
    x, y = F.col("x"), F.col("y")
    fix = _gap(x["p"], y["p"]) - _gap(x["p"], y["p0"]) - _gap(x["p0"], y["p"]) + _gap(x["p0"], y["p0"])
    shared = met.where(x["source"] < y["source"]).groupBy("lang", x["source"].alias("source"), y["source"].alias("item")).agg(F.sum(fix).alias("_fix"))
    swapped = shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "_fix")
    keys = ["lang", "source", "item"]
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("_alone").alias("_back"))
    summed = both.join(alone, keys, "left").join(back, keys, "left").join(shared.unionByName(swapped), keys, "left")
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ("_alone", "_back", "_fix")]
    # Every kept term once: v - terms(a) - terms(b) + terms both count is the rest; the last is inside ``_fix``.
    rest = F.coalesce((F.col("v") - F.col("_terms")) * F.col("_rest"), F.lit(0))
    valued = summed.select(*keys, F.lit("pair").alias("part"), (parts[0] + parts[1] + parts[2] + rest).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return valued.withColumn("rank", F.row_number().over(order))


def _terms(counts: DataFrame, sizes: DataFrame, shares: DataFrame, top: int) -> DataFrame:
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes, "lang")
    q = whole.join(langs, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    above = shares.join(q, ["lang", "term"]).where("p > q")
    valued = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT d, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT d, lang, source, unnest(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+')) AS w FROM docs)),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM docs) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS HUGEINT) AS p
  FROM counts JOIN sizes USING (lang)),
wholes AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM shares JOIN wholes USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op11_divergence", SQL)
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"))
