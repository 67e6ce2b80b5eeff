"""Findings of round 5: what the quality rules move between tasks to know the trusted texts."""

from __future__ import annotations

import random

import pytest

from quantloom.llm import common, quality_rules

from .test_findings_r03 import shuffled


def marked(spark, rows, trusted):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    target = spark.createDataFrame([(i,) for i in trusted], "doc_id long").localCheckpoint()
    return shuffled(spark, lambda: sorted(map(tuple, quality_rules.marked_texts(docs, target).collect()), key=str))


def test_trusted_texts_stay_where_they_are(spark, monkeypatch):
    """Half of the texts are trusted, among them those of an id that a fifth of the rows hold: their ids meet the trusted ones, the texts do not."""
    monkeypatch.setattr(common, "FILTER_WORDS", 1 << 10)
    draw = random.Random(9)
    rows = [(7 if k % 5 == 0 else 1000 + k, " ".join(f"w{draw.randrange(10**9)}" for _ in range(600))) for k in range(300)]
    trusted = {i for i, _ in rows if i % 2}
    got, moved = marked(spark, rows, trusted)
    assert got == sorted(((t, i in trusted) for i, t in rows), key=str)
    assert moved < sum(len(t) for _, t in rows) / 10


@pytest.mark.parametrize("words", [1, 2, 1 << 10])
def test_trust_by_filters_of_any_size(spark, monkeypatch, words):
    """Filters of 64 bits let nearly all ids pass, sparse ones hardly any: null and repeated ids and texts, and labels that come twice or have no document, give the same."""
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    rows = [(k % 150, f"text {k}") for k in range(250)] + [(None, "no id"), (None, None), (3, None), (4, ""), (4, ""), (-5, "below zero"), (5000, "alone")]
    trusted = [*range(0, 150, 3), 0, 3, 3, None, None, 5000, 7000, 7001]
    got, _ = marked(spark, rows, trusted)
    assert got == sorted(((t, i is not None and i in set(trusted)) for i, t in rows), key=str)


def test_nothing_trusted_and_no_rows(spark):
    assert marked(spark, [(1, "a"), (None, "b")], [])[0] == [("a", False), ("b", False)]
    assert marked(spark, [(1, "a"), (None, "b")], [None])[0] == [("a", False), ("b", False)]
    assert marked(spark, [], [1, 2])[0] == []
