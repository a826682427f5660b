"""Raw payload readers: JSON arrays of records and search-provider responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import bind


def _kind(value: Column) -> Column:
    """Name of the value's type, without what it holds."""
    outer = F.substring_index(F.schema_of_variant(value), "<", 1)
    return F.coalesce(F.substring_index(outer, "(", 1), F.lit("VOID"))


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def whole_json(df: DataFrame, body: str, schema: str, out: str) -> DataFrame:
    """Adds ``out`` (value of ``schema``) and ``_whole`` (the body is one JSON value with nothing behind it), parsed once per row.

    A body may be far larger than a variant can be: only what ``schema`` says becomes variants, so in ``array<variant>``
    the limit is that of one item. The body is read as a member between two others; text behind it breaks that object.
    """
    framed = F.concat(F.lit('{"a":'), F.col(body), F.lit(',"z":1}'))
    both = F.struct(F.from_json(framed, f"a {schema}, z int", _STRICT).alias("v"), F.json_object_keys(framed).alias("k"))
    parsed = bind(df, "_parsed", both)
    whole = (F.col("_parsed.v.z") == 1) & (F.col("_parsed.k") == F.array(F.lit("a"), F.lit("z")))
    whole = F.coalesce(whole, F.lit(False))
    return parsed.withColumns({out: F.when(whole, F.col("_parsed.v.a")), "_whole": whole}).drop("_parsed")


def json_array(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``_items`` of an array body and ``_root``, its error: ``bad_json`` or ``root_not_array`` where there are no items."""
    parsed = whole_json(df, body, "array<variant>", "_items")
    items, opens = F.col("_items"), F.ltrim(F.translate(F.col(body), "\t\r\n", "   ")).startswith("[")
    error = F.when(~F.col("_whole") | (items.isNull() & opens), F.lit("bad_json")).when(items.isNull(), F.lit("root_not_array"))
    return parsed.withColumn("_root", error).drop("_whole")


def read_snapshot_records(bodies: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, verdicts): a JSON array of objects per body; anything else fails the whole body."""
    staged = json_array(bodies).withColumn(
        "fetch_error", F.coalesce("_root", F.when(F.exists("_items", lambda v: _kind(v) != "OBJECT"), F.lit("item_not_object")))
    )
    records = staged.where(F.col("fetch_error").isNull()).select(*keys, F.posexplode("_items").alias("_at", "_item")).select(
        *keys, F.col("_at").cast("bigint").alias("record_index"), F.to_json("_item").alias("payload")
    )
    return records, staged.select(*keys, "fetch_error")


def read_search_results(bodies: DataFrame, keys: list[str], limit: int, web: bool = False) -> DataFrame:
    """Result rows of provider responses: first ``limit`` items, objects with a text URL only."""
    root = "$.web.results" if web else "$.results"
    listed = bodies.select(*keys, F.try_variant_get(F.try_parse_json("body"), root, "array<variant>").alias("_items"))
    item = F.col("_item")
    text = lambda name: F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))
    url = F.try_variant_get(item, "$.url", "variant")
    score = F.try_variant_get(item, "$.score", "variant")
    numeric = _kind(score).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    return (
        listed.select(*keys, F.posexplode("_items").alias("position", "_item"))
        .where((F.col("position") < limit) & (_kind(item) == "OBJECT") & (_kind(url) == "STRING"))
        .select(
            *keys, "position", text("title").alias("title"), F.try_variant_get(item, "$.url", "string").alias("url"),
            text("description" if web else "content").alias("description"),
            (F.lit(None).cast("double") if web else F.when(numeric, F.try_variant_get(item, "$.score", "double"))).alias("score"),
        )
    )
