"""Every pipeline stage and every registered query on awkward tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import common, decontaminate, near_dup, quality_classifier, quality_rules, queries, simhash

from . import brute
from .test_advice_r01 import _edited, _shingles
from .test_llm import ITEMS, SCHEMA, corpus, texts, tokenizer  # noqa: F401

NAMES = ("n_words", "spans", "items", "n_lines", "n_dropped", "__w", "__f", "w", "f", "rest", "row", "h", "keep", "tag", "count", "_", "__", "fp", "sid", "th", "keys", "early", "id", "docs", "ids", "kept", "score", "n_tokens", "component_id", "doc_id_", "text_", "a.b", "Rest")


@pytest.fixture(scope="module")
def rows():
    """The awkward corpus, with a passage of the benchmark, near copies and repeated rows."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(4000)}" for _ in range(150)]
    more = [" ".join(base), _edited(draw, base, 1), _edited(draw, base, 3), " ".join(base[:70]) + " x. the of And thé straße it's x. don't naïve word Word the of " + " ".join(base[70:])]
    return [*corpus(), *((500 + k, t, "en", "s9", len(t)) for k, t in enumerate(more)), (500, more[1], "en", "s8", 3)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows) if k % 3], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def awkward(spark, rows):
    """The corpus with columns of clashing names and of several types; k tells the rows apart."""
    df = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "k int, doc_id long, text string").repartition(4)
    kinds = (F.concat(F.lit("v"), F.col("k").cast("string")), F.col("k") * 2, F.array(F.col("k")), F.create_map(F.lit("x"), F.col("k")), F.when(F.col("k") % 2 == 0, F.struct(F.col("k").alias("z"))))
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, kinds[i % len(kinds)])
    return df


def untouched(before, after):
    """Names, types and values of all columns but text are as they were."""
    assert after.columns == before.columns and [t for _, t in after.dtypes] == [t for _, t in before.dtypes]
    old = {r["k"]: r for r in before.collect()}
    for r in after.collect():
        for i, c in enumerate(before.columns):
            assert c == "text" or r[i] == old[r["k"]][i]


def kept(df):
    return {r["k"]: r["text"] for r in df.collect()}


def empty_stays_empty(spark, stage, docs, folder):
    out = stage(spark, docs.limit(0), folder)
    assert out.count() == 0 and out.columns == docs.columns


def plain_scores(spark, rows, target, order, buckets, prior):
    """Scores from plain counts of n-grams of 1 to order words, with Spark's own hash of a word list."""
    grams = lambda w: [tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)]
    each = [grams(brute.words(t)) for _, t in rows]
    known = sorted(set().union(*each))
    word = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {x for g in known for x in g}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = [(i, word[g[0]], word[g[1]]) for i, g in enumerate(known) if len(g) == 2]
    found = {r.i: r.h for r in spark.createDataFrame(pairs, "i long, a long, b long").select("i", F.xxhash64("a", "b").alias("h")).collect()} if pairs else {}
    bucket = {g: (word[g[0]] if len(g) == 1 else found[i]) % buckets for i, g in enumerate(known)}
    raw, tgt = Counter(), Counter()
    for (i, _), g in zip(rows, each, strict=True):
        for x in g:
            raw[bucket[x]] += 1
            tgt[bucket[x]] += i is not None and i in target
    n_raw, n_tgt = sum(raw.values()), sum(tgt.values())
    weight = {b: float(np.log((tgt[b] + prior) / (n_tgt * raw[b] / n_raw + prior))) for b in raw}
    return [float(np.mean([weight[bucket[x]] for x in g])) if g else 0.0 for g in each]


def test_quality_stage(spark, rows, folder):
    docs = awkward(spark, rows)
    out = corpus_pipeline.quality_stage(spark, docs, folder)
    untouched(docs, out)
    target = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1 and doc_id is not null").collect()}
    p = quality_rules.PRODUCTION
    scores = plain_scores(spark, texts(rows), target, p["order"], p["buckets"], p["prior"])
    sure = {k: s >= p["min_score"] for k, s in enumerate(scores) if abs(s - p["min_score"]) > 1e-9}
    expected = {k for k, (_, t) in enumerate(texts(rows)) if not brute.base_figures(t)[-1] and sure.get(k, True)}
    assert set(kept(out)) == expected and 3 < len(expected) < len(rows)
    empty_stays_empty(spark, corpus_pipeline.quality_stage, docs, folder)


def test_line_stage(spark, rows, folder):
    docs = awkward(spark, rows)
    out = corpus_pipeline.line_stage(spark, docs, folder)
    untouched(docs, out)
    got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str)
    assert got == sorted(((i, t) for i, _, _, t in brute.line_dedup(texts(rows))), key=str)
    assert [k for k, t in kept(out).items() if t is None] == [k for k, (_, t) in sorted(enumerate(texts(rows)), key=lambda x: list(kept(out)).index(x[0])) if t is None]
    empty_stays_empty(spark, corpus_pipeline.line_stage, docs, folder)


def groups(rows, least=0.8):
    """The smallest doc_id of each row's group, over all pairs."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least):
                root[find(a)] = find(b)
    smallest: dict = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(a)] = min(smallest.get(find(a), i), i)
    return [smallest.get(find(a)) for a in range(len(rows))]


def test_near_dup_stage(spark, rows, folder):
    docs = awkward(spark, rows)
    out = corpus_pipeline.near_dup_stage(spark, docs, folder)
    untouched(docs, out)
    firsts = {g for g in groups(texts(rows)) if g is not None}
    expected = {k for k, (i, _) in enumerate(texts(rows)) if i is None}
    for d in firsts:
        same = [(t is not None, t or "", k) for k, (i, t) in enumerate(texts(rows)) if i == d]
        expected.add(min(same, key=lambda x: (x[0], x[1].encode(), len(str(x[2])), str(x[2])))[2] if len({s[:2] for s in same}) == len(same) else None)
    got = set(kept(out))
    assert {k for k in got if rows[k][0] is None} == {k for k in expected if k is not None and rows[k][0] is None}
    assert sorted(rows[k][0] for k in got if rows[k][0] is not None) == sorted(firsts)
    assert {k for k in expected if k is not None} <= got
    again = kept(corpus_pipeline.near_dup_stage(spark, docs.repartition(7), folder))
    assert set(again) == got
    empty_stays_empty(spark, corpus_pipeline.near_dup_stage, docs, folder)


def uncontaminated(docs):
    """For each place in docs (id, text) that stays: its text, or the words that are left of it; and how many were hit."""
    pattern, expected, hits = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}, 0
    windows = set()
    for _, t in ITEMS:
        w = pattern.findall(brute.lower(t))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    for k, (_, t) in enumerate(docs):
        w, hit = pattern.findall(brute.lower(t)), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
        hits += bool(hit)
        if 2 * len(hit) <= len(w):
            expected[k] = [x for j, x in enumerate(w) if j not in hit] if hit else t
    return expected, hits


def test_benchmark_stage(spark, rows, folder):
    docs = awkward(spark, rows)
    out = corpus_pipeline.benchmark_stage(spark, docs, folder)
    untouched(docs, out)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected, hits = uncontaminated(texts(rows))
    got = kept(out)
    assert got.keys() == expected.keys() and hits > 3
    for k, t in got.items():
        assert (pattern.findall(brute.lower(t)) if isinstance(expected[k], list) else t) == expected[k]
    empty_stays_empty(spark, corpus_pipeline.benchmark_stage, docs, folder)


def digests(tokenizer, t):  # noqa: F811
    ids = brute.tokens(tokenizer, t)
    return len(ids), brute.sha(ids.tobytes()), brute.sha(tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode())


def test_token_stage(spark, rows, folder, tokenizer):  # noqa: F811
    docs = awkward(spark, rows)
    got = sorted((tuple(r) for r in corpus_pipeline.token_stage(spark, docs, folder).collect()), key=str)
    assert got == sorted(((i, *digests(tokenizer, t)) for i, t in texts(rows)), key=str)
    assert corpus_pipeline.token_stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_rereads_what_it_wrote(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 2


def test_whole_run_by_brute_force(spark, rows, tokenizer, tmp_path):  # noqa: F811
    """All five stages one after the other, each restated plainly on what the one before it left."""
    draw = random.Random(12)
    item = "x. the of And thé straße it's x. don't naïve word Word the of"
    docs = dict(texts([r for r in rows if r[0] is not None]))
    for k in range(30):
        words = [f"v{draw.randrange(900)}" for _ in range(120)]
        docs |= {3000 + 10 * k: " ".join(words), 3001 + 10 * k: _edited(draw, words, 1), 3002 + 10 * k: " ".join(words[:80]) + f"\n one line that {k % 4} documents share\n" + (item if k % 3 else "") + " ".join(words[80:][::-1])}
    docs = sorted(docs.items())
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    target = {i for i, _ in docs if i % 2}
    spark.createDataFrame([(i, int(i in target), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    p = quality_rules.PRODUCTION
    scores = plain_scores(spark, docs, target, p["order"], p["buckets"], p["prior"])
    assert min(abs(s - p["min_score"]) for s in scores) > 1e-9
    left = [(i, t) for (i, t), s in zip(docs, scores, strict=True) if not brute.base_figures(t)[-1] and s >= p["min_score"]]
    left = sorted((i, t) for i, _, _, t in brute.line_dedup(left))
    left = [d for d, g in zip(left, groups(left), strict=True) if d[0] == g]
    expected, hits = uncontaminated(left)
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == {left[k][0] for k in expected} and 20 < len(got) < len(docs) and hits > 5
    for k, t in expected.items():
        if not isinstance(t, list):
            assert got[left[k][0]] == digests(tokenizer, t)
        else:
            assert got[left[k][0]][0] > 0 and got[left[k][0]] != digests(tokenizer, left[k][1])


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_simhash", "op3_bpe", "op5_decontaminate", "op6_line_dedup", "op7_token_files", "op10_substring_dedup"])
def test_registered_query(spark, rows, folder, tokenizer, name):  # noqa: F811
    """Columns, types, hashes and hex digits as the contract states them, on the whole awkward table."""
    docs = texts(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if name == "op1_quality_rules":
        columns, expected = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], [(i, *brute.base_figures(t)) for i, t in docs]
    elif name == "op2_simhash":
        columns, expected = ["doc_id", "fingerprint", "component_id"], [(i, f"{fp:016x}", c) for i, fp, c in brute.components(docs)]
    elif name == "op3_bpe":
        columns, expected = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [(i, *digests(tokenizer, t)) for i, t in docs]
    elif name == "op5_decontaminate":
        columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        expected = [(i, n, hit, len(items), sha(",".join(items)), hit > 0) for i, n, hit, items in brute.contamination(docs, ITEMS)]
    elif name == "op6_line_dedup":
        columns, expected = ["doc_id", "n_lines", "n_dropped", "kept_sha256"], [(i, n, d, sha(t)) for i, n, d, t in brute.line_dedup(docs)]
    elif name == "op7_token_files":
        columns, expected, start = ["doc_id", "start", "n_tokens", "ids_crc32"], [], 0
        for i, t in sorted(docs, key=lambda x: (brute.NULL_FIRST(x[0]), x[1] is not None, x[1] or "")):
            ids = np.append(brute.tokens(tokenizer, t), 0).astype("<u4")
            expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    else:
        columns, expected = ["doc_id", "n_words", "n_removed", "kept_sha256"], [(i, n, g, sha(t)) for i, n, g, t in brute.substring_dedup(docs)]
    out = queries.queries()[name](spark, folder)
    assert set(columns) <= set(out.columns)
    kinds = dict(out.dtypes)
    assert all(kinds[c] == {"fingerprint": "string", "base_failed": "boolean", "contaminated": "boolean"}.get(c, "string" if c.endswith("sha256") else "bigint") for c in columns)
    assert sorted((tuple(r) for r in out.select(*columns).collect()), key=str) == sorted(expected, key=str)


def test_classifier_query(spark, folder, rows):
    out = queries.op9_quality_classifier(spark, folder)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_dual_descent_against_a_plain_solver():
    """The primal squared-hinge problem by Newton steps."""
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 24, 8)) for _ in range(60)]
    labels = (np.array([r[0] < 3 for r in rows])).astype(int)
    ratios = draw.normal(size=24)
    x = np.zeros((60, 24))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.sqrt((ratios[r] ** 2).sum())
    y = np.where(labels == 1, 1.0, -1.0)
    cost = len(y) / (2.0 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w = np.zeros(24)
    for _ in range(60):
        gap = np.maximum(1 - y * (x @ w), 0)
        grad = w - 2 * x.T @ (cost * y * gap)
        hess = np.eye(24) + 2 * (x * (cost * (gap > 0))[:, None]).T @ x
        w = w - np.linalg.solve(hess, grad)
    assert np.abs(grad).max() < 1e-8
    assert np.allclose(quality_classifier.descend(rows, labels, ratios, rounds=3000), w, atol=1e-5)


def test_sample_of_the_fit_is_bounded_by_rows_and_features(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "Model", lambda rows, labels, dim_bits: seen.append(sum(map(len, rows))))
    docs = spark.createDataFrame([(k, " ".join(f"v{k}x{i}" for i in range(200))) for k in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    for limit in (10_000, 2_000):
        quality_classifier.fit(docs, labels, fit_features=limit)
    assert 9_000 < seen[0] <= 10_000 and 1_500 < seen[1] <= 2_000


def test_score_of_word_pairs(spark, rows):
    docs, target = texts(rows), {35, 1, 8, 15, 500}
    p = {"buckets": 1 << 12, "order": 2, "prior": 3.0}
    expected = plain_scores(spark, docs, target, p["order"], p["buckets"], p["prior"])
    out = quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i,) for i in target], "doc_id long"), **p)
    got = sorted((str(r.doc_id), r.n_words, round(r.score, 9)) for r in out.collect())
    assert got == sorted((str(i), len(brute.words(t)), round(s, 9)) for (i, t), s in zip(docs, expected, strict=True))


def test_placement_is_even_whatever_the_ids_are(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows, id_ = 64 * 4096, F.col("id")
        for ids in (((id_ % 64) * (1 << 33) + F.floor(id_ / 64)), F.xxhash64("id"), F.when(id_ % 3 > 0, id_)):
            table = spark.range(rows).select(ids.alias("doc_id"))
            place = common.placement(table)
            got = table.toPandas().doc_id
            got = np.where(got.isna(), common.NO_ID, got.fillna(0)).astype(np.int64) if got.isna().any() else got.to_numpy()
            part = place.chunks(got, np.arange(rows) * 2654435761 % (1 << 32)) // place.parts
            assert place.ranges == 64 and np.bincount(part, minlength=64).max() < 2 * rows / 64
        assert common.placement(spark.range(5000).withColumnRenamed("id", "doc_id")).ranges == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_one_automaton_in_a_stage(spark, rows):
    docs, items = spark.createDataFrame(texts(rows), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.contamination(docs, items, shard_words=3)
    assert len(list(decontaminate._shards(items, 3))) >= 6
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_automaton_keeps_to_its_bound():
    """Bytes of an automaton's arrays and dictionaries, beside its words."""
    draw = random.Random(1)
    words = [[f"w{draw.randrange(20_000)}".encode() for _ in range(200)] for _ in range(100)]
    a = decontaminate.Automaton([(str(k), w) for k, w in enumerate(words)])
    arrays = sum(x.itemsize * len(x) for x in (a.word, a.to, a.link, a.length, a.item))
    assert arrays < 60 * 20_000 and len(a.more) < 0.7 * 20_000 + 100 and len(a.items) < 100


def test_large_groups_are_dealt_out(spark, monkeypatch):
    """Groups of many blocks give the components of all pairs."""
    draw = random.Random(5)
    text = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    base, other = text(120), text(90)
    rows = [(k, _edited(draw, base, 1 + k % 4)) for k in range(70)] + [(100 + k, _edited(draw, base, 14)) for k in range(10)] + [(200 + k, _edited(draw, other, 1)) for k in range(20)] + [(300 + k, " ".join(text(60))) for k in range(10)] + [(400, ""), (401, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = common.cut_lineage(near_dup.sketches(df))
    expected = groups(rows)
    for size in (1 << 22, 600):
        check_components(prints, near_dup.similar(prints, df, block_hashes=size), rows, expected)


def check_components(prints, edges, rows, expected):
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    found = [(r.doc_id, roots.get(r.sid, r.sid)) for r in prints.collect()]
    least: dict = {}
    for i, root in found:
        least[root] = min(least.get(root, i), i)
    assert {i: least[root] for i, root in found} == {i: g for (i, _), g in zip(rows, expected, strict=True)}


def test_strangers_under_one_key_are_sent_apart(spark, monkeypatch):
    """A key that many texts share which are not near each other: only those that share a rare element meet, and no pair is lost."""
    draw = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    each = [[f"d{k}x{j}" for j in range(60)] for k in range(40)]
    rows = [(k, " ".join(passage + w)) for k, w in enumerate(each)] + [(100 + k, _edited(draw, passage + w, 1 + k % 3)) for k, w in enumerate(each[:15])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = common.cut_lineage(near_dup.sketches(df))
    sets = near_dup._shingle_sets(df, prints, prints.select("sid").distinct(), 5)
    keys = prints.select(F.lit(0).cast("long").alias("band"), F.lit(7).cast("long").alias("key"), F.col("sid").alias("fp"), "sid", "size")
    kept = near_dup.rarest(keys, sets, 0.8)
    groups_of = [r[0] for r in kept.groupBy("band", "key").count().select("count").collect()]
    assert 2 <= max(groups_of) <= 4  # all 55 members share the passage, and none meets by it
    compared = []
    plain = near_dup._edges
    monkeypatch.setattr(near_dup, "_edges", lambda members, *more: compared.append(members.where("not right").groupBy("band", "key", "block", "chunk").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]) or plain(members, *more))
    edges = near_dup.meet(keys, lambda _: sets, None, block_hashes=700)
    check_components(prints, edges, rows, groups(rows))
    assert sum(x or 0 for x in compared) < 55 * 55 / 2


def test_simhash_links_below_the_similarity_are_no_links(spark):
    """Fingerprints at most two bits apart of texts that are not similar: found among many short texts."""
    rows = [(k, " ".join(f"{a}" for a in (k % 7, k // 7 % 7, k // 49, "x", "y", "z"))) for k in range(200)]
    df = spark.createDataFrame([*rows, (900, rows[5][1].upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == dict(zip((i for i, _ in [*rows, (900, "")]), groups([*rows, (900, rows[5][1])]), strict=True))


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
