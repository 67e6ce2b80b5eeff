"""The training-data operators against brute force on small, awkward tables."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, license_scan, line_dedup, quality_classifier, quality_rules, queries, simhash, substring_dedup, token_files, url_filter, wordpieces

from ..conftest import SF
from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    draw = random.Random(3)
    vocabulary = ["the", "of", "And", "thé", "straße", "it's", "x.", "don't", "1,000", "😀", "###", "foo<|endoftext|>bar", "naïve", "word", "Word", "ne xt"]
    sentence = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", "", "s", ",", "."]) for _ in range(n))
    base = [sentence(n) for n in (3, 12, 40, 90, 200)]
    passage = sentence(30)
    texts = [
        None, "", " ", "\n", "one", "two words", *base, base[2], base[2].upper(), base[3] + " tail", "Head " + base[3], f"{passage} {sentence(25)} {passage}", f"{sentence(7)} {passage} {sentence(9)}",
        "\n".join([base[1], "a shared line here", "  A SHARED line here ", base[2]]), "a shared line here\nshort\nshort\nother line of some length", "\t\x0b mixed \x0c white\r\nspace wide  double   runs \n\n", "spam " * 300,
        sentence(6000), "a b c d e f g h i j k l", "<|endoftext|>", "trailing space ", "''s ''S 'll\n's", "café́ x y\x1cz\x85", passage.replace(" ", "\n"), "x" * 5000,
    ]
    rows = [(i * 7 % 41 if i % 9 else i * 1000, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, base[3], None, None, None), (None, None, None, None, None), rows[8], (rows[9][0], base[4] + " more", "en", "s0", 1), (-5, base[4], "en", "s0", 1)]


ITEMS = [(1, "x. the of And thé straße it's x. don't naïve word Word the of"), (2, "a B c"), (3, None), (4, ""), (5, "spam spam spam"), (None, "one"), (6, "?!"), (7, "a b c d e f g h i j k l m"), (2, "two words")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries._byte_bpe())
    t.no_truncation()
    t.no_padding()
    return t


def clashing(df):
    """df with columns whose names the operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in ("n_words", "spans", "items", "n_lines", "n_dropped", "tag", "fp", "count", "h", "kept", "score", "__w1", "ids", "digest", "license")})


def texts(rows):
    return [(r[0], r[1]) for r in rows]


def test_quality_figures(docs, rows, empty, spark):
    target = spark.createDataFrame([(35,), (8,), (None,), (35,)], "doc_id long")
    got = quality_rules.quality_rules(clashing(docs), target)
    figures = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()], key=str)
    assert figures == sorted([(i, *brute.base_figures(t)) for i, t in texts(rows)], key=str)
    assert not any(r.kept and r.base_failed for r in got.collect())
    kept = quality_rules.filter_documents(clashing(docs), target)
    assert kept.columns == clashing(docs).columns and kept.count() == got.where("kept").count()
    assert quality_rules.quality_rules(empty, target).count() == 0
    assert {r.score for r in quality_rules.quality_rules(docs, target.limit(0)).collect()} == {0.0}


def test_quality_score(docs, rows, spark):
    """The score from plain counts of Spark's own word hashes."""
    target = {35, 1, 8, 15}
    got = {(r.doc_id, r.n_words): r.score for r in quality_rules.quality_rules(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}
    h = {r.w: r.b for r in spark.createDataFrame([(w,) for _, t in texts(rows) for w in brute.words(t)], "w string").distinct().select("w", F.pmod(F.xxhash64("w"), F.lit(quality_rules.BUCKETS)).alias("b")).collect()}
    raw, tgt = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    for i, t in texts(rows):
        for w in brute.words(t):
            raw[h[w]] += 1
            tgt[h[w]] += i in target
    weight = np.log(tgt / tgt.sum()) - np.log(raw / raw.sum())
    for i, t in texts(rows):
        w = brute.words(t)
        assert got[(i, len(w))] == pytest.approx(np.mean([weight[h[x]] for x in w]) if w else 0.0, abs=1e-9)


def test_simhash(docs, rows, empty):
    for bits, shingle in ((2, 3), (2, 5), (3, 3), (1, 3)):
        got = simhash.simhash_components(clashing(docs), shingle, bits)
        assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()], key=str) == brute.components(texts(rows), bits, shingle)
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for i, _, c in brute.components(texts(rows)) if i is not None})


def test_hot_blocks_lose_no_link(spark):
    """Keys over the pair limit give the same components as all pairs."""
    draw = random.Random(1)
    centre = draw.getrandbits(64)
    points = {centre} | {centre ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(150)} | {draw.getrandbits(64) for _ in range(50)}
    signed = [p - 2**64 if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {limit: {tuple(sorted(x)) for x in _groups(simhash.components(simhash.links(df, 2, limit)))} for limit in (2, 10_000)}
    assert found[2] == found[10_000]


def _groups(roots):
    groups: dict = {}
    for r in roots.collect():
        groups.setdefault(r.root, {r.root}).add(r.node)
    return groups.values()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {i: 0 for i in range(1, 41)} | {101: 100}


def test_encode_and_decode(docs, rows, empty, tokenizer):
    path = queries._byte_bpe()
    coded = wordpieces.encode_documents(clashing(docs), path)
    both = wordpieces.decode_documents(coded.withColumn("text", F.lit("old")), path)
    got = sorted([(r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in both.collect()], key=str)
    expected = []
    for i, t in texts(rows):
        ids = brute.tokens(tokenizer, t)
        expected.append((i, len(ids), ids.tobytes(), tokenizer.decode(ids.tolist(), skip_special_tokens=False)))
    assert got == sorted(expected, key=str)
    again = wordpieces.recode_documents(clashing(docs), path)
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in again.collect()], key=str) == got
    assert wordpieces.encode_documents(empty, path).count() == 0 and wordpieces.recode_documents(empty, path).count() == 0
    assert wordpieces.decode_documents(docs.select("doc_id", F.lit(None).cast("binary").alias("ids")), path).where("text is not null").count() == 0
    with pytest.raises(Exception, match="no such id"):
        wordpieces.decode_documents(docs.select("doc_id", F.lit(b"\x40\x42\x0f\x00").alias("ids")), path).collect()


def test_word_parts(tokenizer, rows):
    tokens = wordpieces.Tokens(wordpieces.read_tokenizer(queries._byte_bpe()))
    for _, text in texts(rows):
        for word in wordpieces.split_words(text or ""):
            found = wordpieces.parts(word, tokens.special)
            assert "".join(found) == word
            assert [i for p in found for i in brute.tokens(tokenizer, p)] == list(brute.tokens(tokenizer, word))


def test_contamination(docs, rows, empty, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = brute.contamination(texts(rows), ITEMS)
    for shard in (500_000, 15):
        got = decontaminate.contamination(clashing(docs), items, shard_words=shard)
        assert sorted([(r.doc_id, r.n_words, sum(b - a for a, b in r.spans), sorted(r["items"])) for r in got.collect()], key=str) == expected
    assert decontaminate.contamination(docs, items.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    cut = decontaminate.remove_spans(clashing(docs), items, max_share=1.0)
    assert cut.columns == clashing(docs).columns and cut.count() == len(rows)
    assert decontaminate.contamination(docs.limit(0).unionByName(cut.select(*docs.columns)), items.where("item_id = 1")).where("size(spans) > 0").count() == 0


def test_automaton_on_random_words():
    draw = random.Random(9)
    for _ in range(60):
        items = [(str(k), [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randrange(0, 9))]) for k in range(4)]
        document = [draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        window = draw.randrange(1, 6)
        spans, found = decontaminate.Automaton(items, window).search(document)
        hit, names = set(), set()
        for name, w in items:
            n = min(window, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for j in range(len(document) - n + 1):
                    if document[j : j + n] == w[k : k + n]:
                        hit |= set(range(j, j + n))
                        names.add(name)
        assert {x for a, b in spans for x in range(a, b)} == hit and found == names


def test_line_dedup(docs, rows, empty, monkeypatch):
    expected = brute.line_dedup(texts(rows))
    for heavy in (1_000, 1):
        monkeypatch.setattr(line_dedup, "HEAVY_ROWS", heavy)
        bitmaps = line_dedup.line_dedup(clashing(docs))
        kept = line_dedup.apply_bitmaps(clashing(docs), bitmaps)
        assert kept.columns == [c for c in clashing(docs).columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
        assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in kept.collect()], key=str) == expected
    assert line_dedup.line_dedup(empty).count() == 0


def test_token_files(docs, rows, empty, spark, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(clashing(docs), folder, queries._byte_bpe(), sequence=64)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()]
    start, expected = 0, []
    for i, t in sorted(texts(rows), key=lambda x: (brute.NULL_FIRST(x[0]), x[1] is not None, x[1] or "")):
        ids = np.append(brute.tokens(tokenizer, t), 0).astype("<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(expected, key=str)
    one = token_files.TokenFile(manifest.orderBy("part").first().path)
    ids, mask = one.sequence(0)
    assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16 and list(ids[: mask.sum()]) == list(one.tokens(0, int(mask.sum())))
    assert token_files.read_token_files(token_files.write_token_files(empty, f"file://{tmp_path}/none", queries._byte_bpe())).count() == 0


def test_substring_dedup(spark, docs, rows, empty, monkeypatch):
    once = list({r[0]: r for r in rows}.values())
    for held, part in ((2_000_000, rows), (50, rows), (50, once)):
        monkeypatch.setattr(substring_dedup, "HELD", held)
        table = docs if part is rows else spark.createDataFrame(part, SCHEMA)
        got = substring_dedup.substring_dedup(clashing(table))
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()], key=str) == brute.substring_dedup(texts(part))
    assert substring_dedup.substring_dedup(empty).count() == 0
    for shard in (500_000, 300):
        got = substring_dedup.by_automata(clashing(docs), shard_words=shard)
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()], key=str) == brute.substring_dedup(texts(rows))
    assert substring_dedup.by_automata(empty).count() == 0


def test_license_scan(docs, empty, spark):
    known = license_scan.known_texts(spark)
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame([(1, "Copyright 2020 A\nReleased under the  MIT-licence!"), (2, "prose\nAll rights reserved.\nall RIGHTS reserved"), (3, None), (4, ""), (None, "SPDX-License-Identifier: MIT"), (2, "SPDX-License-Identifier: GPL-3.0")], "doc_id long, text string"), known).collect()}
    assert got[1].whole_license == "MIT" and got[1].n_license_lines == 1
    assert got[2].licenses == "All-rights-reserved,GPL-3.0" and got[2].n_license_lines == 3 and got[2].whole_license == "GPL-3.0"
    assert got[3].licenses == got[4].licenses == "" and got[None].whole_license == "MIT"
    assert license_scan.license_scan(clashing(docs), known).count() == docs.select("doc_id").distinct().count()
    assert license_scan.license_scan(empty, known).count() == 0


def test_url_filter(spark):
    cols = "page_id long, url string, fetch_date date, host string, blocked string"
    pages = spark.createDataFrame([(1, "HTTP://u:p@A.b.Example.com.:80/x?y#z"), (2, "https://example.com"), (3, None), (4, "no url"), (5, "https://ok.example.com/"), (6, "http://x.org/")], "page_id long, url string").withColumns({"fetch_date": F.when(F.col("page_id") != 6, F.lit("2024-02-01").cast("date")), "host": F.lit("old"), "blocked": F.lit("old")})
    day = lambda x: F.to_date(F.lit(x))
    entries = spark.createDataFrame([("example.com", "spam", "add", "2024-01-01"), ("example.com", "spam", "add", "2024-01-01"), ("ok.example.com", "allow", "add", "2024-02-01"), ("example.com", "old", "add", "2023-01-01"), ("example.com", "old", "remove", "2024-02-01"), ("x.org", "spam", "add", "2020-01-01"), (None, "spam", "add", "2020-01-01"), ("b.example.com", "late", "add", "2024-02-02")], "key string, category string, action string, d string").select("key", "category", "action", F.col("d").cast("date").alias("entry_date"))
    got = {r.page_id: r for r in url_filter.url_filter(pages, entries).collect()}
    assert got[1].host == "a.b.example.com" and got[1].categories == "spam" and got[1].blocked and got[1].n_active == 1
    assert got[2].blocked and not got[3].blocked and got[4].host is None
    assert got[5].categories == "allow,spam" and not got[5].blocked and got[6].n_active == 0
    assert url_filter.url_filter(pages, entries.limit(0)).where("blocked").count() == 0 and url_filter.url_filter(pages.limit(0), entries).count() == 0


def test_classifier(spark, docs, rows, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality_classifier.quality_scores(table, labels).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert set(got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)) == {True}
    flipped = labels.where(quality_classifier.fold_of("doc_id") == 0).withColumn("quality", 1 - F.col("quality")).unionByName(labels.where(quality_classifier.fold_of("doc_id") != 0))
    again = quality_classifier.quality_scores(table, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[got.doc_id].to_numpy(), got.score.to_numpy())
    odd = quality_classifier.quality_scores(clashing(docs), spark.createDataFrame([(None, 1), (7, None), (7, 5), (14, 1)], "doc_id long, quality int")).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, labels).count() == 0


@pytest.mark.parametrize("name", ["op4_license_scan", "op8_url_filter"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.queries()[name](spark, SF).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    names = sorted(expected.columns)
    text = lambda df: sorted(tuple("null" if v is None or v != v else str(v)[:10] if hasattr(v, "year") else str(v) for v in r) for r in df[names].itertuples(index=False))
    assert sorted(got.columns) == names and text(got) == text(expected)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert final.count() == docs.count() > 50
