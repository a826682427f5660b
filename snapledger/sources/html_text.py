"""HTML fragments to text: entity decoding, plain lines, and sanitized markup (Arrow batches)."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags kept without attributes, tags removed with their content, line-making tags.
ALLOWED_TAGS = frozenset("b br em h2 h3 h4 i li ol p strong u ul".split())
DROPPED_TAGS = frozenset("embed form iframe math noscript object script style svg template".split())
LINE_TAGS = frozenset("p li div h1 h2 h3 br".split())
_VOID = frozenset(("br", "embed", "img", "input", "hr", "meta", "link", "area", "base", "col", "source", "wbr"))


@F.pandas_udf(T.StringType())
def html_unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


class _Lines(HTMLParser):
    """Collect text with a line break after every block element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in LINE_TAGS and tag != "br":
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


class _Clean(HTMLParser):
    """Re-emit allowed tags bare, unwrap others, skip dropped ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.skip = 0
        self.tags = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in DROPPED_TAGS:
            self.skip += tag not in _VOID
        elif not self.skip and tag in ALLOWED_TAGS:
            self.out.append(f"<{tag}>")
            if tag not in _VOID:
                self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED_TAGS:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_comment(self, data: str) -> None:
        self.tags += 1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(html.escape(data, quote=False))

    def finish(self) -> str:
        self.close()
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def _to_lines(value: str) -> str | None:
    parser = _Lines()
    parser.feed(value)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).splitlines())
    return "\n".join(line for line in lines if line) or None


def _sanitize(value: str) -> str:
    if not value:
        return ""
    parser = _Clean()
    parser.feed(value)
    done = parser.finish()
    if parser.tags:
        return done
    plain = value.replace("\r\n", "\n").replace("\r", "\n")
    return html.escape(plain, quote=True).replace("\n", "<br>\n")


def _mapped(df: DataFrame, column: str, out: str, work) -> DataFrame:
    """Only the one column goes through Python."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else work(v) for v in values], dtype=object)

    return df.withColumn(out, run(F.col(column)))


def html_to_lines(df: DataFrame, column: str, out: str) -> DataFrame:
    """Fragment text as clean non-empty lines."""
    return _mapped(df, column, out, _to_lines)


def sanitize_descriptions(df: DataFrame, column: str = "description", out: str = "description_html") -> DataFrame:
    """Minimal safe markup: 13 tags without attributes, 10 removed with content, others unwrapped."""
    return _mapped(df.withColumn(column, F.coalesce(F.col(column), F.lit(""))), column, out, _sanitize)
