"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.staging import stage  # noqa: F401  (re-exported)

#: The white space of the line and word rules: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\u000b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in, which is the same for them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression: ``body`` may read it many times at no extra cost."""
    return F.transform(F.array(value), body)[0]


def pair_hash(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: 128 bits that identify a value."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def packed(docs: DataFrame, name: str = "_row") -> Column:
    """All columns of a row as one struct, so that helper columns can't clash with names the caller uses."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name)


def unpack_replacing(frame: DataFrame, columns: list[str], replaced: dict[str, Column], row: str = "_row") -> list[Column]:
    """The columns of ``_row`` again, in order, some of them replaced."""
    return [(replaced[c] if c in replaced else F.col(row)[c]).alias(c) for c in columns]
