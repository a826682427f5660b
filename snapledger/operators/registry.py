"""Registered source keys and what each may be used for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.text import casefold, strip_ws

# Fixed values.
REGISTERED = ("darwinbox", "dreamjobs", "fixture", "generic", "jazzhr", "lever", "zoho_recruit")
USER_SELECTABLE = ("darwinbox", "dreamjobs", "jazzhr", "lever", "zoho_recruit")
USER_DELETABLE = ("darwinbox", "dreamjobs", "generic", "jazzhr", "lever", "zoho_recruit")
EXECUTION_BLOCKED: tuple[str, ...] = ()


def source_key(value: Column) -> Column:
    return casefold(strip_ws(value))


def executable(source: Column) -> Column:
    allowed = [key for key in REGISTERED if key not in EXECUTION_BLOCKED]
    return source_key(source).isin(*allowed)
