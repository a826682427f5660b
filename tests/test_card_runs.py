"""Unique cards of short and long runs, and rows that name no card."""

from __future__ import annotations

import random

import pytest

from snapledger.operators import complete

SCHEMA = "run_id long, seq long, card_id string, url string"


def test_short_and_long_runs_agree(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randint(1, 8), rng.randint(1, 14), rng.choice([None, "1", "2", "3", "4", "5"]), rng.choice([None, *"uvwxyz"])) for _ in range(90)]
    cards = spark.createDataFrame(rows, SCHEMA)
    inside = sorted(map(str, complete.unique_cards(cards).collect()))
    monkeypatch.setattr(complete, "SHORT_RUN", 0)
    assert sorted(map(str, complete.unique_cards(cards).collect())) == inside
    monkeypatch.setattr(complete, "SHORT_RUN", 11)
    assert sorted(map(str, complete.unique_cards(cards).collect())) == inside
    assert 0 < len(inside) < 90


def test_short_runs_need_no_rounds(spark, monkeypatch):
    staged = []
    real = complete.stage
    monkeypatch.setattr(complete, "stage", lambda df, label: staged.append(label) or real(df, label))
    cards = spark.createDataFrame([(1, 1, "a", "u"), (1, 2, "a", "v"), (1, 3, "b", "v"), (None, 1, "a", "u"), (1, None, "c", "w")], SCHEMA)
    assert [r.seq for r in complete.unique_cards(cards).orderBy("seq").collect()] == [1, 3]
    assert staged == ["long-runs"]


@pytest.mark.parametrize("short", [0, 200])
def test_empty(spark, monkeypatch, short):
    monkeypatch.setattr(complete, "SHORT_RUN", short)
    assert complete.unique_cards(spark.createDataFrame([], SCHEMA)).count() == 0
