"""Column functions against plain Python on generated inputs; unique cards against brute force."""

from __future__ import annotations

import hashlib
import html
import json
import random
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import functions as F

from snapledger.functions import text as tx
from snapledger.functions import urls
from snapledger.functions.hashing import canonical_json
from snapledger.operators.complete import unique_cards
from snapledger.operators.pages import detail_metadata, jsonld_postings
from snapledger.operators.scan import carry_last
from snapledger.sources.html_text import html_to_lines, sanitize_descriptions

ALPHABET = list("aB \t\n\r\x0b\x1c\x85\xa0 　é#/?&=%+~*._-") + ["ß", "\x0e", '"', "\\"]


def words(rng, low, high):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(low, high)))


def test_text_matches_python(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 0, 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, v string")
    got = df.select("i", tx.norm_text(F.col("v")).alias("a"), tx.norm_description(F.col("v")).alias("b"),
                    canonical_json({"k": F.col("v"), "n": F.lit(None).cast("string")}).alias("j")).collect()
    values = dict(rows)
    for row in got:
        raw = values[row.i]
        assert row.a == (" ".join(raw.split()) or None)
        lines = raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert row.b == ("\n".join(x.strip() for x in lines).strip() or None)
        assert row.j == json.dumps({"k": raw, "n": None}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_query_round_trip_matches_python(spark):
    rng = random.Random(2)
    alphabet = list("abc&==%+~*. é") + ["%20", "%C3%A9"]
    rows = [(i, "x=" + "".join(rng.choice(alphabet) for _ in range(12)).replace(" ", "")) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, q string")
    pairs = F.transform(
        urls.query_pairs(F.col("q")),
        lambda kv: F.concat(urls.encode_component(kv["key"]), F.lit("="), urls.encode_component(kv["value"])),
    )
    got = {r.i: r.e for r in df.select("i", F.array_join(pairs, "&").alias("e")).collect()}
    for i, q in rows:
        assert got[i] == urlencode(parse_qsl(q, keep_blank_values=True)), q


def test_canonical_and_href(spark):
    bases = ["https://a.example/x/y?z=1", "http://B.example:81", "https://c.example/x/"]
    refs = ["", "/p", "p/q", "../up", "./here", "?k=v", "#f", "//d.example/z", "https://e.example", "a/../b", "mailto:x@y"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", urls.resolve_href(F.col("b"), F.col("r")).alias("o")).collect():
        want = urljoin(row.b, row.r)
        assert row.o == want or urlunsplit(urlsplit(row.o)) == want or (row.o, want) == (row.b, row.b), (row, want)


def test_title_case_matches_python(spark):
    values = ["full-time", "PART time", "été à midi", "3d artist", "c++ dev"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", tx.title_case(F.col("v")).alias("t")).collect():
        assert row.t == row.v.title()


def test_candidate_id(spark):
    url = "https://a.example/x"
    got = spark.range(1).select(urls.candidate_id(F.lit(url)).alias("c")).first().c
    assert got == hashlib.sha256(url.encode()).hexdigest()[:32]


def test_carry_last_over_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, "x", "y", "z"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v string")
    got = {(r.k, r.i): r.prev for r in carry_last(df, ["k"], F.col("i"), F.col("v"), "prev", block=7).collect()}
    last = {}
    for k, i, v in rows:
        assert got[k, i] == last.get(k)
        if v is not None:
            last[k] = v


def test_unique_cards_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.randint(1, 3), i, rng.choice([None, "1", "2", "3", "4"]), rng.choice([None, "u", "v", "w", "x"])) for i in range(120)]
    kept, seen = set(), {}
    for run, seq, card, url in rows:
        keys = {k for k in (card and f"id:{card}", url and f"url:{url}") if k}
        if not keys or seen.setdefault(run, set()).isdisjoint(keys):
            kept.add((run, seq))
            seen.setdefault(run, set()).update(keys)
    df = spark.createDataFrame(rows, "run_id long, seq long, card_id string, url string")
    assert {(r.run_id, r.seq) for r in unique_cards(df).collect()} == kept


def test_fragments(spark):
    rows = [(1, "<div>One<br>two &amp; <b>three</b></div><p> </p><li>four</li>"), (2, 'a < b & "c"\nd'), (3, "<i>x<script>bad</script></i>")]
    df = spark.createDataFrame(rows, "i int, description string")
    lines = {r.i: r.out for r in html_to_lines(df, "description", "out").collect()}
    assert lines[1] == "One\ntwo & three\nfour"
    clean = {r.i: r.description_html for r in sanitize_descriptions(df).collect()}
    assert clean[1] == "One<br>two &amp; <b>three</b><p> </p><li>four</li>"
    assert clean[2] == html.escape(rows[1][1]).replace("\n", "<br>\n").replace("&#x27;", "&#39;")
    assert clean[3] == "<i>x</i>"


def test_details_and_nested_jsonld(spark):
    graph = '{"@graph":[{"@type":["Thing","JobPosting"],"title":"A"},{"@graph":[{"@type":"JobPosting","title":"B"}]}]}'
    pages = spark.createDataFrame(
        [(1, f'<script type="application/ld+json">{graph}</script>'),
         (2, "<header><p>Location: No</p></header><h1>T</h1><p>Location: Vienna</p><p>Location: Graz</p>")],
        "k int, html string",
    )
    assert jsonld_postings(pages, ["k"]).count() == 2
    row = detail_metadata(pages, ["k"]).where("k = 2").first()
    assert (row.title, row.location) == ("T", "Vienna")
