"""Snapshot merge against a step-by-step restatement of the rules on small random batches."""

from __future__ import annotations

import hashlib
import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.functions.hashing import CONTENT_FIELDS
from snapledger.operators.merge import POSTING_COLUMNS
from snapledger.operators.reconcile import miss_timeline, replay
from snapledger.operators.validate import RECORD_FIELDS
from snapledger.plans.ingest import run_snapshots
from snapledger.schemas import BATCHES, POSTINGS, RAW_RECORDS, SOURCES

T0 = datetime(2024, 1, 1, tzinfo=UTC)
OWNERS = [(1, 10, "lever", "https://jobs.lever.co/a", "approved", True),
          (2, 10, "generic", "https://a.example/jobs", "approved", True),
          (3, 11, "lever", None, "approved", True)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def content(record: dict) -> dict:
    return {name: record.get(name) for name in CONTENT_FIELDS}


def content_hash(record: dict) -> str:
    return sha(json.dumps(content(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def key(record: dict) -> str:
    if record.get("source_job_id"):
        return sha(f"id\0{record['source']}\0{record['source_job_id']}")
    return sha(f"url\0{record['source']}\0{record['source_job_url']}")


def step(rows: list[dict], batch: list[dict], when: datetime, threshold: int, recover: bool):
    """One source, one batch, record by record. Returns (rows, run, counters)."""
    state = [dict(r) for r in rows]
    seen, tally, failed = set(), {"created": 0, "updated": 0, "unchanged": 0}, 0
    for record in batch:
        if record.get("workplace_type") not in (None, "remote", "hybrid", "onsite") or not (
            record.get("source_job_id") or record.get("source_job_url")
        ):
            failed += 1
            continue
        upgrade = False
        if record.get("source_job_id") is None:
            hit = next((r for r in state if r["dedupe_key"] == key(record)), None)
        else:
            hit = next((r for r in state if r["source_job_id"] == record["source_job_id"]), None)
            loose = [r for r in state if r["source_job_id"] is None and record.get("source_job_url")
                     and r["source_job_url"] == record["source_job_url"]]
            if hit is not None and loose:
                failed += 1
                continue
            if hit is None and loose:
                hit, upgrade = loose[0], True
        digest = content_hash(record)
        if hit is None:
            state.append({**content(record), "compensation_text": record.get("compensation_text"),
                          "source_job_id": record.get("source_job_id"), "content_hash": digest,
                          "dedupe_key": key(record), "status": "active", "first": when, "last": when,
                          "misses": 0})
            tally["created"] += 1
            seen.add(id(state[-1]))
            continue
        changed = upgrade
        if upgrade:
            hit["source_job_id"], hit["dedupe_key"] = record["source_job_id"], key(record)
        if hit["content_hash"] != digest:
            hit.update(content(record), compensation_text=record.get("compensation_text"), content_hash=digest)
            changed = True
        if hit["status"] == "not_found":
            hit["status"], changed = "active", True
        hit["last"], hit["misses"] = when, 0
        seen.add(id(hit))
        tally["updated" if changed else "unchanged"] += 1
    if failed and (not recover or sum(tally.values()) == 0):
        return rows, "failed", {"found": 0, "created": 0, "updated": 0}
    status = "partial" if failed else "success"
    if status == "success":
        for row in state:
            if id(row) in seen:
                continue
            if row["status"] == "active":
                if row["misses"] + 1 >= threshold:
                    row["status"] = "not_found"
                row["misses"] = min(row["misses"] + 1, threshold)
            elif row["status"] == "not_found":
                row["misses"] = threshold
    return state, status, {"found": len(batch), "created": tally["created"], "updated": tally["updated"]}


def random_batch(rng: random.Random, source: str) -> list[dict]:
    batch = []
    for _ in range(rng.choice([0, 1, 5, 14])):
        record = {"source": source, "title": rng.choice(["a", "b", "c"]),
                  "compensation_text": rng.choice([None, "1", "2"])}
        kind = rng.random()
        if kind < 0.65:
            record["source_job_id"] = str(rng.randint(1, 4))
        if kind > 0.4:
            record["source_job_url"] = f"https://x.example/{rng.randint(1, 3)}"
        if rng.random() < 0.06:
            record["workplace_type"] = "moon"
        if rng.random() < 0.03:
            record.pop("source_job_id", None), record.pop("source_job_url", None)
        batch.append(record)
    return batch


@pytest.mark.parametrize("recover", [True, False])
def test_random_histories(spark, recover):
    rng = random.Random(7 if recover else 8)
    sources = spark.createDataFrame(OWNERS, SOURCES)
    worlds = 14
    # Many independent "sources" in one call: the plan handles all of them together.
    owners = [(w * 10 + o[0], o[1], o[2], o[3], o[4], o[5]) for w in range(worlds) for o in OWNERS]
    sources = spark.createDataFrame(owners, SOURCES)
    expected: dict[int, list[dict]] = {o[0]: [] for o in owners}
    postings = spark.createDataFrame([], POSTINGS)
    for round_no in range(4):
        when = T0 + timedelta(days=round_no)
        records, batches, ledger = [], [], {}
        for owner in owners:
            batch = random_batch(rng, owner[2])
            run_id = round_no * 1000 + owner[0]
            batches.append((run_id, owner[0], when, when + timedelta(seconds=3), 2, None))
            for index, record in enumerate(batch):
                records.append((run_id, owner[0], index, *[record.get(f) for f in RECORD_FIELDS]))
            expected[owner[0]], status, counts = step(
                expected[owner[0]], batch, when + timedelta(seconds=3), 2, recover
            )
            ledger[owner[0]] = (status, counts)
        result = run_snapshots(
            spark.createDataFrame(records, RAW_RECORDS), spark.createDataFrame(batches, BATCHES),
            sources, postings, recover=recover, block=3,
        )
        got = [r.asDict() for r in result.postings.collect()]
        for run in result.runs.collect():
            status, counts = ledger[run.company_source_id]
            assert run.status == status
            assert (run.jobs_found, run.jobs_created, run.jobs_updated) == (
                counts["found"], counts["created"], counts["updated"])
        shape = lambda r, sid, first, last, misses: (
            sid, r["dedupe_key"], r["source_job_id"], r["title"], r["source_job_url"], r["compensation_text"],
            r["content_hash"], r["status"], first, last, misses)
        utc = lambda t: t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)
        have = sorted(map(str, (shape(r, r["company_source_id"], utc(r["first_seen_at"]), utc(r["last_seen_at"]),
                                      r["consecutive_successful_misses"]) for r in got)))
        want = sorted(map(str, (shape(r, sid, r["first"], r["last"], r["misses"])
                                for sid, rows in expected.items() for r in rows)))
        assert have == want
        assert len({r["id"] for r in got}) == len(got)
        postings = spark.createDataFrame([tuple(r[c] for c in POSTING_COLUMNS) for r in got], POSTINGS)


def test_input_order_does_not_matter(spark):
    rng = random.Random(3)
    sources = spark.createDataFrame(OWNERS, SOURCES)
    batch = random_batch(rng, "lever") + random_batch(rng, "lever") + random_batch(rng, "lever")
    rows = [(1, 1, i, *[r.get(f) for f in RECORD_FIELDS]) for i, r in enumerate(batch)]
    batches = spark.createDataFrame([(1, 1, T0, T0, 1, None)], BATCHES)
    empty = spark.createDataFrame([], POSTINGS)
    results = []
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, RAW_RECORDS).repartition(3 + seed)
        out = run_snapshots(frame, batches, sources, empty).postings
        results.append(sorted(map(str, out.collect())))
    assert results[0] == results[1]


def test_replay_equals_timeline_end(spark):
    rng = random.Random(5)
    runs, seen = [], []
    for source in range(12):
        for seq in range(9):
            runs.append((source, seq, rng.choice(["success", "success", "partial", "failed"])))
            seen += [(source, k, seq) for k in "abc" if rng.random() < 0.3]
    runs_df = spark.createDataFrame(runs, "company_source_id long, run_seq long, status string")
    seen_df = spark.createDataFrame(seen, "company_source_id long, key string, run_seq long")
    state = {}
    for source, seq, status in runs:
        if status == "failed":
            continue
        hit = {k for s, k, q in seen if (s, q) == (source, seq)}
        for k in hit:
            state[source, k] = (0, "active")
        if status == "success":
            for (s, k), (misses, _) in list(state.items()):
                if s == source and k not in hit:
                    n = min(misses + 1, 2)
                    state[s, k] = (n, "not_found" if n >= 2 else "active")
    final = {(r.company_source_id, r.key): (r.misses, r.status) for r in replay(seen_df, runs_df).collect()}
    assert final == state
    last = {}
    for r in miss_timeline(seen_df, runs_df).orderBy("run_seq").collect():
        last[r.company_source_id, r.key] = (r.misses, r.status)
    assert last == state


def test_schema_types(spark):
    assert [f.name for f in POSTINGS.fields] == list(POSTING_COLUMNS)
    assert isinstance(POSTINGS["first_seen_at"].dataType, T.TimestampType)
    assert spark.range(1).select(F.lit(1)).count() == 1
