"""URL splitting and the four URL normal forms.

One regex pass splits a URL; the parts become columns of their own projection, so every later
expression reads plain columns and stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import bind, blank_to_null, rebind, strip_ws, title_case

_SEP = "\ufdd0"
_URL = (
    r"(?si)\A(https?)://(?:([^/?#]*)(@))?(\[[^\]/?#@]*\]|[^:/?#@\[\]]*)(?::([0-9]*))?"
    r"(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?\z"
)
_PARTS = ("scheme", "userinfo", "at", "host", "port", "path", "query")


def split_url(url: Column) -> Column:
    """Array of the seven parts, or an array of size one when the text is not an HTTP(S) URL."""
    clean = strip_ws(url)
    for char in "\t\r\n":
        clean = F.replace(clean, F.lit(char), F.lit(""))
    return F.split(F.regexp_replace(clean, _URL, _SEP.join(f"${i}" for i in range(1, 8))), _SEP)


def with_parts(df: DataFrame, url: Column | str, prefix: str, crawl: bool = False) -> DataFrame:
    """Add ``<prefix>{ok,scheme,userinfo,at,host,port,path,query}``.

    ``crawl`` applies the crawl rules: no credentials, no trailing host dot, path never empty.
    """
    column = F.col(url) if isinstance(url, str) else url
    array, whole = f"{prefix}parts", f"{prefix}all"
    staged = bind(df, array, split_url(column))
    part = lambda i: F.get(F.col(array), F.lit(i))
    port = F.try_to_number(blank_to_null(part(4)), F.lit("9999999999")).cast("bigint")
    port_ok = (part(4) == "") | ((F.length(part(4)) <= 10) & (port <= 65535))
    host, path = F.lower(part(3)), part(5)
    ok = (F.size(array) == 7) & part(3).rlike(r"[^\[\].]") & port_ok
    if crawl:
        host = F.regexp_replace(host, r"\.+\z", "")
        path = F.when(path == "", F.lit("/")).otherwise(path)
        ok = ok & (part(2) != "@")
    parts = F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"), F.lower(part(0)).alias("scheme"),
        part(1).alias("userinfo"), part(2).alias("at"), host.alias("host"), port.alias("port"),
        path.alias("path"), part(6).alias("query"),
    )
    return (
        bind(staged, whole, parts)
        .withColumns({prefix + name: F.col(f"{whole}.{name}") for name in ("ok", *_PARTS)})
        .drop(array, whole)
    )


def part_names(prefix: str) -> list[str]:
    return [f"{prefix}{name}" for name in ("ok", *_PARTS)]


def _query_suffix(query: Column) -> Column:
    return F.when(F.coalesce(query, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit("?"), query)
    )


def add_source_url(df: DataFrame, url: str, out: str) -> DataFrame:
    """Posting URL: default port and fragment go, userinfo stays. ``<out>_bad`` marks rejects."""
    p = "_su_"
    c = lambda name: F.col(p + name)
    default_port = ((c("scheme") == "http") & (c("port") == 80)) | (
        (c("scheme") == "https") & (c("port") == 443)
    )
    port = F.when(c("port").isNull() | default_port, F.lit("")).otherwise(
        F.concat(F.lit(":"), c("port").cast("string"))
    )
    userinfo = F.when(c("at") == "@", F.concat(c("userinfo"), F.lit("@"))).otherwise(F.lit(""))
    canonical = F.concat(
        c("scheme"), F.lit("://"), userinfo, c("host"), port, c("path"), _query_suffix(c("query"))
    )
    given = F.coalesce(strip_ws(F.col(url)) != "", F.lit(False))
    return (
        with_parts(df, url, p)
        .withColumns({"_su_out": F.when(c("ok"), canonical), "_su_flag": given & ~c("ok")})
        .drop(*part_names(p), out, f"{out}_bad")
        .withColumnsRenamed({"_su_out": out, "_su_flag": f"{out}_bad"})
    )


def _netloc(p: str) -> Column:
    port = F.col(p + "port")
    return F.concat(
        F.col(p + "host"),
        F.when(port.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string"))),
    )


def add_canonical_url(df: DataFrame, url: str, out: str, keep: str | None = None) -> DataFrame:
    """Crawl URL: explicit ports stay, credentials reject, empty path becomes ``/``.

    ``keep`` names a prefix under which the parts (host, path, query ...) stay available.
    """
    p = keep or "_cu_"
    c = lambda name: F.col(p + name)
    canonical = F.concat(
        c("scheme"), F.lit("://"), _netloc(p), c("path"), _query_suffix(c("query"))
    )
    staged = bind(with_parts(df, url, p, crawl=True), "_cu_out", F.when(c("ok"), canonical))
    if keep is None:
        staged = staged.drop(*part_names(p))
    return staged.drop(out).withColumnRenamed("_cu_out", out)


# Click identifiers dropped from queries, and words that mark a listing address.
TRACKING_KEYS = ("dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")
LISTING_MARKERS = ("career", "job", "opening", "position", "vacan")
# Last path segments that name a listing page.
DIRECT_LISTING_SEGMENTS = (
    "career", "careers", "job", "jobs", "opening", "openings", "positions", "vacancies",
)

_LISTING_RE = "(?i)" + "|".join(LISTING_MARKERS)
_PAGE_SUFFIX = r"(?i)\A(.*)/page/[1-9][0-9]*\z"


def decode_component(value: Column) -> Column:
    """Form-decode; a stray ``%`` is kept as it is."""
    return F.url_decode(F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25"))


def encode_component(value: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def query_pairs(query: Column) -> Column:
    """Array of (key, value) in order; blank values stay, empty pieces go."""
    pieces = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            decode_component(F.substring_index(x, "=", 1)).alias("key"),
            decode_component(
                F.when(x.contains("="), F.regexp_replace(x, r"(?s)\A[^=]*=", "")).otherwise("")
            ).alias("value"),
        ),
    )


def add_candidate_url(df: DataFrame, url: str, out: str, keep: str | None = None) -> DataFrame:
    """Candidate URL: crawl form without tracking keys, listing pagination and trailing slash."""
    p = keep or "_ku_"
    c = lambda name: F.col(p + name)
    trim_slash = lambda x: F.regexp_replace(x, r"/+\z", "")
    base = F.regexp_extract(c("path"), _PAGE_SUFFIX, 1)
    drop_page = c("path").rlike(_PAGE_SUFFIX) & F.concat(c("host"), F.lit(" "), base).rlike(_LISTING_RE)
    path_listing = c("path").rlike(_LISTING_RE)
    listing = F.concat(c("host"), F.lit(" "), c("path")).rlike(_LISTING_RE)

    def kept(pair: Column) -> Column:
        key = F.lower(pair["key"])
        tracking = key.startswith("utm_") | key.isin(*TRACKING_KEYS)
        paging = (((key == "page") & listing) | ((key == "p") & path_listing)) & pair["value"].rlike(
            r"\A[1-9][0-9]*\z"
        )
        return ~tracking & ~paging

    encoded = F.array_join(
        F.transform(
            F.filter(query_pairs(c("query")), kept),
            lambda kv: F.concat(encode_component(kv["key"]), F.lit("="), encode_component(kv["value"])),
        ),
        "&",
    )
    staged = rebind(with_parts(df, url, p, crawl=True), p + "path", trim_slash(c("path")))
    final = F.when(drop_page, trim_slash(base)).otherwise(c("path"))
    staged = rebind(staged, p + "path", F.when(final == "", F.lit("/")).otherwise(final))
    staged = rebind(staged, p + "query", F.when(c("query") == "", F.lit("")).otherwise(encoded))
    staged = bind(
        staged, "_ku_out",
        F.when(
            c("ok"),
            F.concat(c("scheme"), F.lit("://"), _netloc(p), c("path"), _query_suffix(c("query"))),
        ),
    )
    if keep is None:
        staged = staged.drop(*part_names(p))
    return staged.drop(out).withColumnRenamed("_ku_out", out)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``[a.b.c, b.c, c]``: turns "is under host" into an equi-join."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def host_under(host: Column, roots: tuple[str, ...]) -> Column:
    """Host equals, or is a subdomain of, one of a fixed list of roots."""
    exact = host.isin(*roots)
    below = F.lit(False)
    for root in roots:
        below = below | host.endswith("." + root)
    return exact | below


def candidate_id(canonical_url: Column) -> Column:
    return F.substring(F.sha2(canonical_url, 256), 1, 32)


def resolve_href(page_url: Column, href: Column) -> Column:
    """Absolute form of a link for the four common shapes (absolute, //, /, relative)."""
    origin = F.regexp_extract(page_url, r"(?i)\A(https?://[^/?#]*)", 1)
    scheme = F.regexp_extract(page_url, r"(?i)\A(https?):", 1)
    no_query = F.regexp_replace(page_url, r"[?#].*\z", "")
    folder = F.regexp_replace(F.regexp_extract(no_query, r"(?i)\Ahttps?://[^/]*(/.*)?\z", 1), r"[^/]*\z", "")
    link = strip_ws(href)
    return (
        F.when(link == "", page_url)
        .when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, drop_dots(link)))
        .when(link.startswith("?"), F.concat(no_query, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(page_url, r"#.*\z", ""), link))
        .otherwise(
            F.concat(
                origin,
                drop_dots(
                    F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link)
                ),
            )
        )
    )


def drop_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; rows without them skip the work."""
    bare = F.regexp_extract(path, r"(?s)\A([^?#]*)", 1)
    rest = F.regexp_extract(path, r"(?s)\A[^?#]*(.*)\z", 1)
    pieces = F.slice(F.split(bare, "/"), 2, F.size(F.split(bare, "/")))
    folded = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(
        bare.rlike(r"/\.{1,2}\z"), F.concat(folded, F.array(F.lit("")))
    ).otherwise(folded)
    return F.when(
        path.contains("/.") & bare.rlike(r"/\.{1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(closed, "/"), rest)
    ).otherwise(path)


def title_from_slug(path: Column) -> Column:
    """Last path segment as words; null unless every word is alphanumeric."""
    last = F.try_element_at(segments(path), F.lit(-1))
    decoded = decode_component(F.replace(last, F.lit("+"), F.lit("%2B")))
    words = F.split(decoded, r"[-_]+")
    usable = F.forall(words, lambda w: w.rlike(r"\A[\p{L}\p{N}]+\z"))
    return F.when(usable, F.array_join(F.transform(words, title_case), " "))


def origin(prefix: str) -> Column:
    return F.concat(F.col(prefix + "scheme"), F.lit("://"), _netloc(prefix))

