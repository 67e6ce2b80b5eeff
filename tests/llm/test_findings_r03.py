"""Findings of round 3: what the near-duplicate stage moves between tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import common, near_dup

from .test_advice_r01 import _edited


def shuffled(spark, run):
    """What run() gives, and the bytes that its stages wrote for other stages."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(k) for k in range(found.size()))}

    before = set(stages())
    out = run()
    return out, sum(v for k, v in stages().items() if k not in before)


def test_near_duplicates_move_few_texts(spark, monkeypatch):
    """Texts that no other may be near to, and rows that stay, meet nothing: neither they nor their keys are dealt out more than once."""
    monkeypatch.setattr(common, "FILTER_WORDS", 1 << 10, raising=False)
    draw = random.Random(3)
    each = [[f"w{draw.randrange(10**9)}" for _ in range(600)] for _ in range(150)]
    rows = [(k, " ".join(w)) for k, w in enumerate(each)] + [(200 + k, _edited(draw, w, 1 + k)) for k, w in enumerate(each[:4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    kept, moved = shuffled(spark, lambda: sorted(r.doc_id for r in near_dup.keep_one(docs).collect()))
    assert kept == list(range(150))
    assert moved < sum(len(t) for _, t in rows) / 2


@pytest.mark.parametrize("words", [1, 1 << 10])
def test_full_bit_filters_lose_nothing(spark, monkeypatch, words):
    """A filter of 64 bits, nearly all of them set, gives the rows that a sparse one gives: copies, near copies, repeated and null ids."""
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    draw = random.Random(8)
    each = [[f"w{draw.randrange(4000)}" for _ in range(80)] for _ in range(120)]
    rows = [(k, " ".join(w), k) for k, w in enumerate(each)] + [(300 + k, _edited(draw, w, 1), 300 + k) for k, w in enumerate(each[::2])]
    rows += [(7, "b other words", 900), (8, rows[8][1], 1008), (9, None, 901), (None, rows[0][1], 902), (None, None, 903), (500, "", 904), (501, " ", 905), (400, rows[1][1], 906), (400, rows[3][1], 907)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long").repartition(3)
    got = sorted(r.k for r in corpus_pipeline.near_dup_stage(spark, docs, "").collect())
    # of rows that repeat an id the least text stays, null before all, then the least other columns as JSON
    assert got == [*(k for k in range(120) if k not in (7, 8, 9)), 900, 901, 902, 903, 1008]


def test_bit_filters_hold_every_value(spark):
    values = spark.range(0, 3000, 3).toDF("v")
    rows = spark.range(3000).select("id", common.may_hold(values, F.col("id")).alias("near")).collect()
    assert all(r.near for r in rows if r.id % 3 == 0) and sum(r.near for r in rows) < 1010


def plan_sizes(spark, run):
    """What run() gives, and the number of nodes of each plan that it executed."""
    sc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()

    def plans():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = store.executionsList()
        return [found.apply(k).executionId() for k in range(found.size())]

    before = set(plans())
    out = run()
    return out, [store.planGraph(k).allNodes().size() for k in plans() if k not in before]


def test_candidates_in_small_plans(spark, monkeypatch):
    """The driver holds each plan while it runs: that of the keys does not take in, several times, those of the SimHash links."""
    draw = random.Random(5)
    each = [[f"w{draw.randrange(4000)}" for _ in range(80)] for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(each)] + [(300 + k, _edited(draw, w, 1)) for k, w in enumerate(each[::2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_dup, "meet", lambda keys, *_: keys)
    prints = common.cut_lineage(near_dup.sketches(docs))
    keys, sizes = plan_sizes(spark, lambda: near_dup.similar(prints, docs))
    assert keys.select("sid").distinct().count() == 60
    assert max(sizes) <= 80, sizes
