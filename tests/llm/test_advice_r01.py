"""What the review of round 1 found missing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quantloom.llm import license_scan, near_dup, quality_classifier, queries, url_filter

from . import brute

SCHEMA = "doc_id long, text string"


def _shingles(text, n=5):
    w = brute.words(brute.lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def _by_similarity(rows, least=0.8):
    """doc_id and the least doc_id of its group, over all pairs that are similar."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                root[find(a)] = find(b)
    return {i: min(rows[b][0] for b in range(len(rows)) if find(b) == find(a)) for a, (i, _) in enumerate(rows)}


def _edited(draw, words, places):
    out = list(words)
    for k in draw.sample(range(5, len(words) - 5), places):
        out[k] = f"new{draw.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_by_similarity(spark):
    """Edits of one and a few words are linked down to 0.8, over all pairs and in one large group."""
    draw = random.Random(8)
    text = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    rows = [(1000, "one two"), (1001, "one two"), (1002, "")]
    for k, n in enumerate((60, 64, 120, 200, 246, 400, 1500)):
        base = text(n)
        rows += [(10 * k, " ".join(base)), *((10 * k + j, _edited(draw, base, p)) for j, p in enumerate((1, 1 + n // 50, 1 + n // 40, n // 25, n // 10), 1))]
    base = text(150)
    rows += [(2000 + k, _edited(draw, base, 1 + k % 3)) for k in range(80)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = _by_similarity(rows)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == expected
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(expected.values())


def test_pipeline_drops_similar_texts(spark):
    import corpus_pipeline

    draw = random.Random(2)
    base = [f"w{draw.randrange(4000)}" for _ in range(150)]
    rows = [(1, " ".join(base)), (2, _edited(draw, base, 1)), (3, _edited(draw, base, 3)), (4, " ".join(reversed(base)))]
    out = corpus_pipeline.near_dup_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 4]


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (2, None), (3, "a b c d e f g"), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(near_dup.near_duplicates(df).collect(), key=str) == sorted(near_dup.simhash.simhash_components(df, 5).drop("fp").collect(), key=str)
    assert near_dup.keep_one(df).count() == 4 and near_dup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_quality_verdict_at_all_sizes(spark, size):
    """Unlabelled documents that pass the base rules are kept, and labelled bad ones are not, whatever the size."""
    folder = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    passed = queries.op1_quality_rules(spark, folder).where("not base_failed").join(labels, "doc_id", "left")
    share = {r.quality: r.share for r in passed.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[None] > 0.8 and share[1] > 0.98 and share[0] < 0.2


def test_whole_licences(spark):
    whole = dict(license_scan.whole_texts())
    rows = [(1, "MIT License\n\nCopyright (c) 2020 A\n\n" + whole["MIT"].removeprefix("MIT License")), (2, whole["Apache-2.0"].upper()), (3, whole["MPL-2.0"].replace(" ", "  ")), (4, whole["BSD-2-Clause"]), (5, whole["GPL-2.0"]), (6, "All rights reserved."), (7, "Copyright 2021 B\n" + whole["ISC"])]
    got = {r.doc_id: r.whole_license for r in license_scan.license_scan(spark.createDataFrame(rows, SCHEMA), license_scan.known_texts(spark)).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "MPL-2.0", 4: "BSD-2-Clause", 5: "GPL-2.0", 6: "All-rights-reserved", 7: "ISC"}


def test_whole_licences_wrapped_anew(spark):
    """Line ends, case, spelling and owner lines may differ; a word may not."""
    import textwrap

    whole = dict(license_scan.whole_texts())
    wrapped = {n: "\n".join(textwrap.wrap(" ".join(x for x in t.splitlines()), 31)) for n, t in whole.items() if n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    rows = [(k, "Copyright (c) 1999 Someone Else\n\n" + t.replace("license", "LICENCE").upper()) for k, t in enumerate(wrapped.values())] + [(9, whole["MIT"].replace("without restriction", "with restriction"))]
    got = {r.doc_id: r.whole_license for r in license_scan.license_scan(spark.createDataFrame(rows, SCHEMA), license_scan.known_texts(spark)).collect()}
    assert [got[k] for k in range(len(wrapped))] == list(wrapped) and got[9] is None


def test_parent_domains_of_any_length(spark):
    day = F.lit("2024-02-01").cast("date")
    pages = spark.createDataFrame([("https://x.a.b.c.d.e.f.com/",), ("https://y.x.a.b.c.d.e.g.com/",)], "url string").withColumn("fetch_date", day)
    entries = spark.createDataFrame([("a.b.c.d.e.f.com", "spam"), ("g.com", "spam"), ("a.b.c.d.e.g.com", "allow")], "key string, category string").withColumns({"action": F.lit("add"), "entry_date": day})
    assert {r.host: r.blocked for r in url_filter.url_filter(pages, entries).collect()} == {"x.a.b.c.d.e.f.com": True, "y.x.a.b.c.d.e.g.com": False}


def test_classifier_uses_whole_texts(spark, monkeypatch):
    rows = [(k, " ".join(f"v{k}x{i}" for i in range(15_000))) for k in range(2)]
    seen = []
    monkeypatch.setattr(quality_classifier, "Model", lambda rows, labels, dim_bits: seen.extend(rows))
    labels = spark.createDataFrame([(k, k) for k in range(2)], "doc_id long, quality int")
    taken = labels.where(quality_classifier.fold_of("doc_id") != 0).orderBy("doc_id").collect()
    quality_classifier.fit(spark.createDataFrame(rows, SCHEMA), labels)
    whole = sorted(len(quality_classifier.Features().of(rows[r.doc_id][1])) for r in taken)
    assert len(taken) > 0 and min(whole) > 20_000 and sorted(map(len, seen)) == whole
