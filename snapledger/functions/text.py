"""Text, date, list and label functions as Column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters the normalizer treats as whitespace. Java's \s is narrower. The two ranges in front hold all of
# them: a letter is turned down by these, not by every range behind them.
WS_CHARS = (
    r"\x09-\x20\x85-\x{3000}&&"
    r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_LIST = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
_WS_NO_LF = WS_CHARS.replace(r"\x09-\x0d", r"\x09\x0b-\x0d")


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    The optimizer inlines plain columns into every later filter that reads them, which repeats
    costly expressions many times over. Exploding a one-element array keeps rows one to one and
    stops that, without leaving the JVM and without a shuffle.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def rebind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace a column by a value computed exactly once per row (see ``bind``)."""
    return bind(df, "_rebound", value).drop(name).withColumnRenamed("_rebound", name)


def strip_ws(value: Column) -> Column:
    return F.btrim(value, F.lit(WS_LIST))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def norm_text(value: Column) -> Column:
    """Collapse every whitespace run to one space, trim, blank to null."""
    return blank_to_null(F.trim(F.regexp_replace(value, rf"[{WS_CHARS}]+", " ")))


def norm_description(value: Column) -> Column:
    """Unify line ends, strip each line and the whole, keep inner blank lines."""
    unified = F.regexp_replace(value, r"\r\n?", "\n")
    lines = F.regexp_replace(unified, rf"[{_WS_NO_LF}]*\n[{_WS_NO_LF}]*", "\n")
    return blank_to_null(strip_ws(lines))


def parse_iso_ts(value: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; no offset means UTC; anything else is null."""
    zulu = F.replace(value, F.lit("Z"), F.lit("+00:00"))
    dashed = F.regexp_replace(zulu, r"\A(\d{4})(\d{2})(\d{2})(?=\z|\D)", "$1-$2-$3")
    timed = F.regexp_replace(
        dashed, r"\A(\d{4}-\d{2}-\d{2}).(\d{2})(\d{2})(\d{2})?(?=\z|[.,+-])", "$1T$2:$3:$4"
    )
    shaped = (
        r"(?s)\A(\d{4}-\d{2}-\d{2})(?:.(\d{2})(?::(\d{2})(?::(\d{2})?(?:[.,](\d+))?)?)?"
        r"(?:([+-]\d{2}):?(\d{2})(?::\d{2})?)?)?\z"
    )

    def build(x: Column) -> Column:
        group = lambda n: F.regexp_extract(x, shaped, n)
        zero = lambda n: F.coalesce(blank_to_null(group(n)), F.lit("00"))
        text = F.concat(
            group(1), F.lit("T"), zero(2), F.lit(":"), zero(3), F.lit(":"), zero(4), F.lit("."),
            F.substring(F.rpad(group(5), 6, "0"), 1, 6),
            F.coalesce(blank_to_null(group(6)), F.lit("+00")), F.lit(":"), zero(7),
        )
        return F.when(x.rlike(shaped), F.try_to_timestamp(text))

    return F.get(F.transform(F.array(timed), build), F.lit(0))


def norm_timestamp(value: Column) -> Column:
    """Zone-less timestamps are read as UTC (the session zone is pinned to UTC)."""
    return value.cast("timestamp")


def iso_format(ts: Column) -> Column:
    """UTC ISO text with six fraction digits only when the fraction is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(whole, fraction, F.lit("+00:00"))


def epoch_ts(value: Column, unit: str = "auto") -> Column:
    """Epoch number to timestamp; ``auto`` reads values above 1e10 as milliseconds."""
    millis = F.timestamp_millis(value.cast("bigint"))
    if unit == "ms":
        return millis
    return F.when(value > 10_000_000_000, millis).otherwise(
        F.timestamp_seconds(value.cast("bigint"))
    )


def duration_seconds(started: Column, finished: Column) -> Column:
    micros = F.unix_micros(finished) - F.unix_micros(started)
    return F.round(micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)"), 3).cast(
        "decimal(12,3)"
    )


def title_case(value: Column) -> Column:
    """Upper-case the first letter of every letter run (``full-time`` gives ``Full-Time``)."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


# Single-character full case folds that plain lower-casing misses.
_FOLDS = {"ß": "ss", "ſ": "s", "ς": "σ", "ẞ": "ss", "ŉ": "ʼn", "ﬁ": "fi", "ﬂ": "fl"}


def casefold(value: Column) -> Column:
    """Lower-case plus the multi-character folds identity comparison relies on."""
    folded = F.lower(value)
    odd = folded
    for char, plain in _FOLDS.items():
        odd = F.replace(odd, F.lit(char), F.lit(plain))
    return F.when(folded.rlike("[" + "".join(_FOLDS) + "]"), odd).otherwise(folded)


def identity_tokens(value: Column) -> Column:
    return F.regexp_extract_all(casefold(value), F.lit("([a-z0-9]+)"), F.lit(1))


def label_norm(value: Column) -> Column:
    return F.array_join(identity_tokens(value), " ")


def identity_norm(value: Column) -> Column:
    """Letters and digits of any script, nothing else."""
    return F.regexp_replace(casefold(value), r"[^\p{L}\p{N}]+", "")


def identity_phrase(text: Column, phrase: Column) -> Column:
    """All words of ``phrase`` occur in order, next to each other, on word boundaries."""
    pad = lambda c: F.concat(F.lit(" "), label_norm(c), F.lit(" "))
    return F.coalesce((label_norm(phrase) != "") & pad(text).contains(pad(phrase)), F.lit(False))


def distinct_fold(values: Column) -> Column:
    """Ordered distinct strings, compared case-insensitively; the first spelling stays."""
    clean = F.filter(F.transform(values, norm_text), lambda v: v.isNotNull())
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def join_locations(values: Column, separator: str = ", ") -> Column:
    return blank_to_null(F.array_join(distinct_fold(values), separator))


def employment_list(values: Column) -> Column:
    spaced = F.transform(values, lambda v: title_case(norm_text(F.replace(v, F.lit("_"), F.lit(" ")))))
    return blank_to_null(F.array_join(F.filter(spaced, lambda v: v.isNotNull()), ", "))


def number_text(value: Column) -> Column:
    """Numbers without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0+\z", "")


def salary_text(low: Column, high: Column, currency: Column) -> Column:
    """``min-max CUR``; equal bounds print once; no bound gives null."""
    lo, hi = number_text(low), number_text(high)
    bounds = F.array_distinct(F.filter(F.array(lo, hi), lambda v: v.isNotNull()))
    amount = blank_to_null(F.array_join(bounds, "-"))
    return F.when(amount.isNotNull(), F.concat_ws(" ", amount, norm_text(currency)))


def concat_description(parts: list[Column]) -> Column:
    kept = F.filter(F.array(*[strip_ws(p) for p in parts]), lambda v: v.isNotNull() & (v != ""))
    return blank_to_null(F.array_join(kept, "\n\n"))


# The allowed workplace types.
WORKPLACE_TYPES = ("remote", "hybrid", "onsite")

# Source spellings of the workplace types.
WORKPLACE_WORDS = {
    "remote": "remote",
    "hybrid": "hybrid",
    "onsite": "onsite",
    "on-site": "onsite",
    "on site": "onsite",
    "telecommute": "remote",
    "in_office": "onsite",
}


def workplace_map(value: Column) -> Column:
    pairs = [F.lit(item) for pair in WORKPLACE_WORDS.items() for item in pair]
    return F.create_map(*pairs)[F.lower(norm_text(value))]


def bounded_query(value: Column) -> Column:
    """First 50 words, then first 400 characters."""
    words = F.split(F.trim(F.regexp_replace(value, rf"[{WS_CHARS}]+", " ")), " ")
    return F.substring(F.array_join(F.slice(words, 1, 50), " "), 1, 400)


def embedded_urls(text: Column, chars: int | None = None, limit: int | None = None) -> Column:
    """Distinct URLs, trailing punctuation removed; of the first ``chars`` characters and ``limit`` matches, if given."""
    seen = text if chars is None else F.substring(text, 1, chars)
    found = F.regexp_extract_all(seen, F.lit(r"""(?i)(https?://[^\s<>"']+)"""), F.lit(1))
    first = found if limit is None else F.slice(found, 1, limit)
    return F.array_distinct(F.transform(first, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+\z", "")))

