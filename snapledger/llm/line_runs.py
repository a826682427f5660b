"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch's line keys are counted per key (documents that hold it), anti-joined
with the keys that the runs have already settled, and written as a run sorted by hash. When a level holds
``fanout`` runs they are compacted into one run of the next level, so a key's count is read from
O(fanout * log(batches)) files. A key found in ``min_docs`` documents is settled: it stays that way, so
later batches need not add it again. In the end the lines whose key is settled leave every document.

Only hashes and counts pass through the runs; line texts stay in their documents. Counts are partial
aggregates, the join on hashes is a plain equi-join (adaptive execution splits a hot key), and a
document's dropped positions are at most its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import BLANKS, ascii_lower, let, packed, pair_hash, stage, table, unpack_replacing
from snapledger.llm.registry import query


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """The runs: ``levels[i]`` holds the sorted runs of level i, each a table (h1, h2, n_docs)."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def totals(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else None

    def settled(self) -> DataFrame | None:
        """Keys found in ``min_docs`` documents or more so far."""
        total = self.totals()
        return None if total is None else total.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")

    def add(self, counts: DataFrame) -> None:
        """Anti-join one batch (h1, h2, n_docs) with what is settled, then add it as a run of level 0."""
        known = self.settled()
        if known is not None:
            counts = counts.join(known, ["h1", "h2"], "left_anti")
        self._put(0, counts)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(stage(run.sortWithinPartitions("h1", "h2"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows if len(runs) == 1 else rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_key: int = 1, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop every line whose key occurs in ``min_docs`` documents or more; add ``n_lines`` and ``n_dropped``.

    ``docs`` needs ``doc_id`` and ``text``; other columns pass through (columns named ``n_lines`` or
    ``n_dropped`` are replaced). Keys shorter than ``min_key`` code points are never dropped.
    Null or empty text is one empty line and stays as it is. A document whose lines all go gets an empty
    text. Rows that repeat a document in full (same id and text) count as one document and lose the
    same lines; a null id is an id like any other. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    r1, r2 = pair_hash(F.col("doc_id"), F.col("text"))
    h1, h2 = pair_hash(F.col("key"))
    lines = docs.select(
        r1.alias("r1"), r2.alias("r2"), F.pmod(F.hash("doc_id"), F.lit(batches)).alias("batch"),
        F.posexplode(F.transform(split_lines(F.col("text")), line_key)).alias("pos", "key"),
    ).filter(F.char_length("key") >= max(min_key, 1))
    landed = stage(lines.select("batch", "r1", "r2", "pos", h1.alias("h1"), h2.alias("h2")), "line-keys")
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        once = landed.filter(F.col("batch") == batch).groupBy("h1", "h2", "r1", "r2").agg(F.lit(1).alias("one"))
        runs.add(once.groupBy("h1", "h2").agg(F.count("one").alias("n_docs")))
    common = stage(runs.settled(), "common-lines")
    gone = (
        landed.join(common, ["h1", "h2"])
        .groupBy("r1", "r2")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    keyed = docs.select(packed(docs), r1.alias("r1"), r2.alias("r2"))
    both = keyed.join(gone, ["r1", "r2"], "left")
    text = F.col("_row")["text"]
    n_lines = F.size(split_lines(text)).cast("bigint")
    kept = F.when(F.col("gone").isNull(), text).otherwise(_without(split_lines(text), F.col("gone")))
    return both.select(
        *unpack_replacing(both, columns, {"text": kept}),
        n_lines.alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """Join the lines between the dropped positions: one slice per gap, linear in the lines."""

    def cut(all_lines: Column, ends: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(1), F.size(ends) - 1),
            lambda i: F.slice(all_lines, F.get(ends, i - 1) + 2, F.get(ends, i) - F.get(ends, i - 1) - 1),
        )
        return F.array_join(F.flatten(gaps), "\n")

    return let(
        lines,
        lambda rows: let(F.concat(F.array(F.lit(-1)), gone, F.array(F.size(rows))), lambda ends: cut(rows, ends)),
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""


@query("op10_line_dedup", OP10_SQL)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_common_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )
