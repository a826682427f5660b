"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Base rules and wider patterns give candidate spans with code-point places and a little context. Texts
   without an at sign, a digit or a title never meet the patterns.
2. Labelers (regex, gazetteer and context rules) vote yes, no or nothing on every candidate.
3. Expectation-maximisation over the counts per kind and votes estimates how often each labeler says yes, no or nothing of
   true and of false spans. Kinds are estimated apart, so documents without a kind never touch its verdicts. Matches of a base
   pattern anchor their kind: those that keep the rules are yes; a failed check is a no. Priors fix what yes means, and a
   vote never counts against what it says (``WEIGHTS``).
4. A logistic span classifier is trained on the probabilities. It reads features of its own: layout, check digits, the cue word
   before the span, what the span touches. ``SEEDS`` tie cue words to the labels, as the labelers' word lists do.
5. Base spans always stay; other candidates join if the classifier says so and they don't overlap a base span.

Everything over rows is DataFrame expressions. A text is scanned once; only matches are shuffled.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import pair_hash, stage, table
from snapledger.llm.registry import query

#: Base patterns. Matches are the same as those of the stated rules; look-behinds and possessive groups only
#: keep long runs from being scanned again and again. ``\G`` is where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns whose matches need the classifier.
WIDER = {
    "email": r"\b[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?\b",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?",
}
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "name"]
#: Gazetteers: top-level domains, first names, and words that speak for or against a kind nearby.
DOMAINS = "com org net edu gov io de fr es uk eu info"
NAMES = "James Mary John Anna Maria Peter Paul Laura Julia Thomas Sarah David Daniel Michael Robert Linda Hans Pierre Carlos Sofia"
FOR = {
    "email": "mail|e-mail|email|contact|write|reach", "ip": "ip|host|server|login|address", "card": "card|visa|master|amex|credit|pay",
    "phone": "phone|tel|call|mobile|fax|contact", "ssn": "ssn|social|security", "iban": "iban|account|bank|konto", "name": "dear|by|from|with",
}
AGAINST = "version|release|build|isbn|order|invoice|serial|model|rfc|section|figure|no\\.|id"
#: Words passed over on the way from a span to its cue word.
PASSED = "is are at me my our your the a an on of to no nr number us him her them code and or was be can may please"
CONTEXT = 30
LABELERS = ["strict", "context", "gazetteer", "against", "glued"]


def _scan(docs: DataFrame) -> DataFrame:
    """(r1, r2, kind, base, start, end, match, left, right) of every candidate, valid or not."""
    text = F.coalesce(F.col("text"), F.lit(""))
    r1, r2 = pair_hash(F.col("doc_id"), F.col("text"))
    digit, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    needs = {"email": at, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    wider = {"email": text.rlike(r"\(at\)|\[at\]"), "name": text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b")}

    def found(kind: str, pattern: str, base: bool, test: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("hits"),
            F.when(test, F.split(text, pattern, -1)).otherwise(none).alias("gaps"),
        )

    scans = [found(k, p, True, needs[k]) for k, p in BASE.items()] + [found(k, p, False, wider.get(k, digit)) for k, p in WIDER.items()]
    some = docs.filter(digit | at | F.contains(text, F.lit("+")) | wider["email"] | wider["name"])
    per_kind = some.select(r1.alias("r1"), r2.alias("r2"), F.explode(F.array(*scans)).alias("s")).filter(F.size("s.hits") > 0)
    zipped = F.transform(
        F.col("s.hits"),
        lambda hit, i: F.struct(
            hit.alias("hit"), F.char_length(F.get(F.col("s.gaps"), i)).alias("gap"),
            F.right(F.get(F.col("s.gaps"), i), F.lit(CONTEXT)).alias("left"), F.left(F.get(F.col("s.gaps"), i + 1), F.lit(CONTEXT)).alias("right"),
        ),
    )
    rows = per_kind.select("r1", "r2", "s.kind", "s.base", F.posexplode(zipped).alias("pos", "m"))
    before = Window.partitionBy("r1", "r2", "kind", "base").orderBy("pos")
    end = F.sum(F.col("m.gap") + F.char_length("m.hit")).over(before)
    # Rows that repeat a document in full have the same matches: one copy is enough.
    once = rows.dropDuplicates(["r1", "r2", "kind", "base", "pos"]).withColumn("end", end.cast("bigint"))
    return once.select("r1", "r2", "kind", "base", (F.col("end") - F.char_length("m.hit")).alias("start"), "end", F.col("m.hit").alias("hit"), F.col("m.left").alias("left"), F.col("m.right").alias("right"))


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    """The rules that a base match must keep besides its pattern."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.char_length(digits)
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", hit.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _iban_passes(hit: Column) -> Column:
    """Whether an account number's check digits are right: moved to the end, letters as 10 to 35, the rest by 97 is 1."""
    plain = F.replace(hit, F.lit(" "))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _votes(c: DataFrame) -> DataFrame:
    """One column of votes (1 yes, -1 no, 0 none) per labeler, and the classifier's features (``FEATURES``)."""
    kind, hit, near = F.col("kind"), F.col("hit"), F.lower(F.concat_ws(" ", "left", "right"))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    named = F.lit(False)
    for k, words in FOR.items():
        named = named | ((kind == k) & near.rlike(rf"\b(?:{words})\b"))
    listed = (
        ((kind == "email") & hit.rlike(rf"(?i)(?:{DOMAINS.replace(' ', '|')})$"))
        | ((kind == "card") & hit.rlike("^(?:4|5[1-5]|3[47]|6011)"))
        | ((kind == "name") & hit.rlike(rf"\b(?:{NAMES.replace(' ', '|')})\b"))
    )
    iban = (kind == "iban") & ~F.col("base")
    unissued = (kind == "ssn") & hit.rlike("^(?:000|666|9)|-00-|-0000$")
    touches = F.col("left").rlike("[A-Za-z0-9_/=]$") | F.col("right").rlike("^[A-Za-z0-9_/=]")
    words = F.regexp_replace(F.lower("left"), rf"\b(?:{PASSED.replace(' ', '|')})\b|[0-9.]+", " ")
    layout = F.regexp_replace(F.regexp_replace(hit, "[A-Za-z]+", "a"), "[0-9]", "9")
    return c.withColumns({
        "strict": F.when(F.col("base"), vote(F.col("valid"), ~F.col("valid"))).when(iban, F.when(_iban_passes(hit), 1).otherwise(-1))
            .otherwise(vote(F.lit(False), unissued)),
        "context": vote(named, F.lit(False)),
        "gazetteer": vote(listed, (kind == "email") & ~hit.rlike(r"[A-Za-z]{2,}$")),
        "against": vote(F.lit(False), F.lower("left").rlike(rf"\b(?:{AGAINST})[ :#]*(?:(?:is|no\.?|nr\.?|number)[ :#]*)?$")),
        "glued": vote(F.lit(False), touches),
        "layout": (F.crc32(layout) % LAYOUTS).cast("int"),
        "cue": (F.crc32(F.regexp_extract(words, r"([\p{L}-]+)[^\p{L}]*$", 1)) % CUES).cast("int"),
    }).withColumns({"check": F.col("strict") + 1, "touch": F.when(touches, 1).otherwise(0)})


#: Features of the classifier and how many values each has; with the kind they bound the table that reaches the driver.
LAYOUTS, CUES = 16, 256
FEATURES = {"layout": LAYOUTS, "cue": CUES, "check": 3, "touch": 2}
#: Shares of votes (yes, nothing, no) that the labelers are expected to give to true and to false spans, and how many observations
#: this expectation counts.
PRIORS = {
    "strict": ((0.60, 0.35, 0.05), (0.05, 0.45, 0.50)), "context": ((0.70, 0.29, 0.01), (0.15, 0.84, 0.01)),
    "gazetteer": ((0.50, 0.45, 0.05), (0.10, 0.50, 0.40)), "against": ((0.01, 0.96, 0.03), (0.01, 0.54, 0.45)),
    "glued": ((0.01, 0.97, 0.02), (0.01, 0.54, 0.45)),
}
PRIOR_ROWS = 50.0
#: Bounds of the evidence (log odds) of a yes, of silence, of a no.
WEIGHTS = {1: (0.3, 4.0), 0: (-0.5, 0.5), -1: (-4.0, -0.3)}
#: Weight and probability of the rows that tie cue words to labels before any data.
SEED_ROWS, SEED_YES, SEED_NO = 2.0, 0.95, 0.05
#: Weight of the row that ties a failed check to no.
FAILED_ROWS = 50.0
_PLAIN = ((0.6, 0.1, 0.3), (0.3, 0.1, 0.6))


def expectation_maximisation(
    patterns: list[tuple[tuple[int | None, ...], float]], rounds: int = 50, anchors: list[float | None] | None = None,
    priors: list[tuple[tuple[float, ...], tuple[float, ...]]] | None = None,
) -> tuple[list[float], list[tuple[float, float]]]:
    """Probability of each vote pattern (votes, weight), and per labeler P(right | yes), P(right | no) where it votes.

    Votes are 1, 0 (abstains, which is evidence too), -1, or None (does not take part), independent given the class. ``anchors`` are known
    probabilities (None: to be estimated); they teach the labelers, but not the share of yes. No patterns: no probabilities.
    """
    n_labelers = len(patterns[0][0]) if patterns else 0
    anchors = anchors or [None] * len(patterns)
    priors = priors or [_PLAIN] * n_labelers
    column = {1: 0, 0: 1, -1: 2}
    shares = [tuple(list(side) for side in prior) for prior in priors]
    share = 0.5

    def judge() -> list[float]:
        out = []
        for (votes, _), known in zip(patterns, anchors, strict=True):
            odds = math.log(share / (1 - share))
            for v, (true, false) in zip(votes, shares, strict=True):
                if v is not None:
                    low, high = WEIGHTS[v]
                    odds += max(low, min(high, math.log(true[column[v]] / false[column[v]])))
            out.append(known if known is not None else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        return out

    prob = judge()
    for _ in range(rounds if patterns else 0):
        for k, prior in enumerate(priors):
            counts = [[PRIOR_ROWS * x for x in side] for side in prior]
            for (votes, w), p in zip(patterns, prob, strict=True):
                if votes[k] is not None:
                    counts[0][column[votes[k]]] += w * p
                    counts[1][column[votes[k]]] += w * (1 - p)
            shares[k] = tuple([x / sum(side) for x in side] for side in counts)
        free = [(w, p) for (_, w), p, known in zip(patterns, prob, anchors, strict=True) if known is None]
        share = (PRIOR_ROWS / 2 + sum(w * p for w, p in free)) / (PRIOR_ROWS + sum(w for w, _ in free))
        prob = judge()
    return prob, [(true[0] / (true[0] + true[2]), false[2] / (false[0] + false[2])) for true, false in shares]


def train_classifier(rows: list[tuple[tuple[str, ...], float, float]], steps: int = 300) -> dict[str, float]:
    """Logistic weights of named features from (features, probability, weight) rows.

    Damped Newton steps per feature with a ridge of one row, so rows that share no feature don't influence each other.
    """
    names = sorted({f for features, _, _ in rows for f in features})
    place = {f: i for i, f in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(features) for features, _, _ in rows])
    col = np.array([place[f] for features, _, _ in rows for f in features], dtype=np.int64)
    p, n = (np.array([r[i] for r in rows], dtype=np.float64) for i in (1, 2))
    weights, damp = np.zeros(len(names)), 1.0 / max((len(f) for f, _, _ in rows), default=1)
    for _ in range(steps if rows else 0):
        said = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[col], len(rows)), -30, 30)))
        slope = np.bincount(col, (n * (p - said))[row], len(names)) - weights
        bend = np.bincount(col, (n * said * (1 - said))[row], len(names)) + 1.0
        weights += damp * slope / bend
    return dict(zip(names, weights.tolist(), strict=True))


def _named(kind: str, values: dict[str, int]) -> tuple[str, ...]:
    return (kind, *(f"{kind}/{name}={value}" for name, value in values.items()))


def _seeds() -> list[tuple[tuple[str, ...], float, float]]:
    bucket = lambda word: zlib.crc32(word.replace("\\.", "").encode()) % CUES
    rows = []
    for kind in KINDS:
        for words, p in ((FOR[kind], SEED_YES), (AGAINST, SEED_NO)):
            rows += [(_named(kind, {"cue": bucket(w)}), p, SEED_ROWS) for w in words.split("|")]
        rows.append((_named(kind, {"check": 0}), SEED_NO, FAILED_ROWS))
    return rows


def _probabilities(counts: list) -> list[tuple[str, bool, tuple[int, ...], float]]:
    """(kind, base, votes, probability) of every counted combination; base matches and failed checks are anchors."""
    out = []
    for kind in KINDS:
        mine = [r for r in counts if r["kind"] == kind]
        patterns = [((None if r["base"] else r["strict"], *(r[k] for k in LABELERS[1:])), float(r["n"])) for r in mine]
        anchors = [0.0 if r["strict"] < 0 else 1.0 if r["base"] else None for r in mine]
        prob, _ = expectation_maximisation(patterns, anchors=anchors, priors=[PRIORS[k] for k in LABELERS])
        out += [(kind, r["base"], tuple(r[k] for k in LABELERS), p) for r, p in zip(mine, prob, strict=True)]
    return out


def _score(weights: dict[str, float]) -> Column:
    """The classifier's log odds of a candidate row."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    score = F.get(F.array(*[F.lit(weights.get(k, 0.0)) for k in KINDS]), kind)
    for name, size in FEATURES.items():
        values = F.array(*[F.lit(weights.get(f"{k}/{name}={v}", 0.0)) for k in KINDS for v in range(size)])
        score = score + F.get(values, kind * size + F.col(name))
    return score


def _fit(spans: DataFrame) -> dict[str, float]:
    """Classifier weights from candidate rows; the driver gets counts, at most 2 x 3^5 and 24,576 per kind."""
    key = ["kind", "base", *LABELERS]
    known = _probabilities(spans.groupBy(*key).agg(F.count("*").alias("n")).collect())
    schema = "kind string, base boolean, " + ", ".join(f"{k} int" for k in LABELERS) + ", p double"
    table_ = spans.sparkSession.createDataFrame([(kind, base, *votes, p) for kind, base, votes, p in known], schema)
    seen = (
        spans.join(table_, key).groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), F.avg("p").alias("p")).collect()
    )
    rows = [(_named(r["kind"], {f: r[f] for f in FEATURES}), r["p"], float(r["n"])) for r in seen]
    return train_classifier(sorted(rows) + _seeds())


def find_pii(docs: DataFrame) -> DataFrame:
    """(r1, r2, spans): array of (start, place of kind, kind, end, base) per document that has any, in order.

    ``docs`` needs ``doc_id`` and ``text``; r1, r2 are ``pair_hash(doc_id, text)``, which repeated rows share.
    Null or empty texts have no spans; an empty table gives no rows.
    """
    scanned = _scan(docs.select("doc_id", "text"))
    judged = _votes(scanned.withColumn("valid", _valid(F.col("kind"), F.col("hit"))))
    spans = stage(judged.select("r1", "r2", "kind", "base", "start", "end", "valid", *LABELERS, *FEATURES), "pii-candidates")
    more = spans.filter("NOT base")
    if not more.isEmpty():
        more = more.filter(_score(_fit(spans)) >= 0)
    base = spans.filter("base AND valid")
    cover = base.groupBy("r1", "r2").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    free = more.join(cover, ["r1", "r2"], "left").filter(
        ~F.exists(F.coalesce("taken", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda t: (t["start"] < F.col("end")) & (F.col("start") < t["end"]))
    )
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("place")
    columns = ["r1", "r2", "start", place, "kind", "end", "base"]
    return base.select(*columns).union(free.select(*columns)).groupBy("r1", "r2").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end", "base"))).alias("spans")
    )


@query("op3_pii")
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    r1, r2 = pair_hash(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", r1.alias("r1"), r2.alias("r2")).join(find_pii(docs), ["r1", "r2"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint,base:boolean>>"))
    text = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(text(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"), text(spans).alias("spans"))
