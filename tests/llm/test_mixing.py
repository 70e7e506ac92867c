"""Mixes against their definition on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, sizes):
    rows = [(i, s, "a" + " a" * (n - 1) if n else None) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("copy", F.lit("clash")).withColumn("demand", F.lit(1))


def test_shares_caps_and_curriculum(spark):
    docs = documents(spark, [("big", 50)] * 400 + [("small", 20)] * 30 + [(None, 9)] * 5 + [("other", 9)] * 5 + [("small", 0)] * 3)
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 4), ("gone", 0.0, 2)], TARGETS)
    mix = mixing.Mix(docs, targets)
    rows = mix.documents.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and 0 < rows[0]["position"] and rows[-1]["position"] <= 1
    uses = {}
    for r in rows:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    assert max(n for d, n in uses.items() if d < 400) == 1 and max(uses.values()) == 4 and all(d < 430 for d in uses)
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert shares["small"]["reached_share"] == pytest.approx(0.3, abs=0.01) and shares["small"]["tokens"] == 4 * 600
    assert shares["big"]["reached_share"] == pytest.approx(0.7, abs=0.01) and shares["gone"]["tokens"] == 0
    early = sum(r["n_tokens"] for r in rows if r["source"] == "small" and r["position"] <= 0.5)
    assert early == pytest.approx(2400 * (0.5 - 0.25 * mixing.RAMP), abs=60)  # t + ramp * (t * t - t) at one half
    assert [tuple(r) for r in mixing.Mix(docs, targets).documents.collect()] == [tuple(r) for r in rows]


def test_given_size_and_schedule(spark):
    docs = documents(spark, [("a", 10)] * 200 + [("b", 10)] * 10)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2)], TARGETS)
    mix = mixing.Mix(docs, targets, total_tokens=1000, schedule={"a": [(0, 1), (0.5, 0), (1, 0)]})
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert shares["a"]["tokens"] == 500 and shares["b"]["tokens"] == 200  # b is capped
    assert all(r["position"] <= 0.5 for r in mix.documents.where("source = 'a'").collect())
    with pytest.raises(ValueError):
        mixing.Mix(docs, targets, schedule={"a": [(0, 1), (0.5, 1)]})


def test_many_ranges_agree_with_one(spark, monkeypatch):
    docs = documents(spark, [("a", 3)] * 300)
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    one = [tuple(r) for r in mixing.Mix(docs, targets).documents.collect()]
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    assert [tuple(r) for r in mixing.Mix(docs, targets).documents.collect()] == one and len(one) == 600


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 1.0, 2)], TARGETS)
    mix = mixing.Mix(documents(spark, [("a", 3)]).limit(0), targets)
    assert mix.documents.collect() == [] and [r["reached_share"] for r in mix.shares().collect()] == [None]
    assert mixing.Mix(documents(spark, [("a", 3)]), targets.limit(0)).documents.collect() == []
