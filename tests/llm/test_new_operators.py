"""Source divergence, the Jaccard join and vector codes against plain restatements."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import divergence, jaccard_join, near_dup, queries, vector_codes

from . import brute
from .test_llm import SCHEMA, corpus, texts


def plain_audit(rows, min_docs=10, top=10):
    """Rows (lang, source, part, item, value, rank) of (text, lang, source), with exact fractions."""
    group, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [brute.lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        group[lang, source].update(terms)
        docs[lang].update(set(terms))
    share = lambda c, n, v: 1 + math.floor(Fraction(10**9 * (c + 2), n + 2 * v))
    apart = lambda p, q: math.floor(Fraction((p - q) ** 2, p + q))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        p = {s: {t: share(group[lang, s][t], sum(group[lang, s][x] for x in kept), len(kept)) for t in kept} for s in sources}
        whole = Counter()
        for s in sources:
            whole.update({t: group[lang, s][t] for t in kept})
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in sources:
            parts = {"pair": [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s], "term": [(apart(p[s][t], q[t]), t) for t in kept if group[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def audit_rows():
    draw = random.Random(8)
    words = ["The", "the", "É", "é", "naïve", "x1y", "don't", "K", "日本", "a_b", "zz\x00q", "Straße", *(f"w{chr(97 + k)}" for k in range(12))]
    rows = [(" ".join(draw.choices(words[draw.randrange(8) :], k=draw.randrange(1, 30))), draw.choice(["en", "de"]), draw.choice(["s0", "s0", "s1", "s2", "ß", None])) for _ in range(150)]
    rows += [(None, "en", "only null"), ("", "en", None), ("   12 34", "fr", "a"), (None, "fr", "b"), ("the " * 20_000, "en", "long"), ("same same", None, "s0"), ("same", None, None)]
    return rows + rows[:5] + [("tie tie", "eq", s) for s in "abc" for _ in range(5)]


@pytest.mark.parametrize("broadcast", [divergence.BROADCAST_GROUPS, 0])
def test_divergence(spark, broadcast):
    rows = audit_rows()
    df = spark.createDataFrame([(t, lang, s, 1, 2) for t, lang, s in rows], "text string, lang string, source string, term int, n int").repartition(5)
    got = divergence.divergence_audit(df, broadcast_groups=broadcast)
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows)
    if broadcast:
        assert divergence.divergence_audit(df.limit(0)).count() == 0


def test_divergence_flushes_and_keeps_few(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    rows = audit_rows()[:40]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.divergence_audit(df, 2, 3).collect())) == plain_audit(rows, 2, 3)


def test_share_is_exact_beyond_doubles(spark):
    cases = [(0, 1), (1, 3), (2, 2), (10**15, 3 * 10**15 + 1), (9 * 10**15 - 7, 9 * 10**15), (123456789012345, 987654321098765)]
    got = spark.createDataFrame(cases, "c long, n long").select(divergence.share(F.col("c"), F.col("n"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * c // n for c, n in cases]


def plain_components(rows, shingle=4, percent=85):
    sets = []
    for _, t in rows:
        w = brute.words(brute.lower(t))
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(s), least.get(find(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edits(draw, words, n):
    words = list(words)
    for _ in range(n):
        at = draw.randrange(len(words))
        words[at : at + 1] = draw.choice([[words[at]] if len(words) == 1 else [], [f"e{draw.randrange(10**6)}"], [words[at], f"e{draw.randrange(10**6)}"]])
    return " ".join(words)


def join_rows():
    """Near copies of short and long texts, strangers that share a passage, ties at the bound, and the awkward corpus."""
    draw = random.Random(3)
    passage, rows = [f"p{k}" for k in range(40)], list(texts(corpus()))
    for size in (1, 3, 4, 5, 8, 9, 10, 13, 16, 20, 24, 30, 60, 150):
        base = [f"b{size}x{k}" for k in range(size)]
        rows += [(2000 + 40 * size + k, edits(draw, base, k % 4)) for k in range(9)]
    rows += [(9000 + k, edits(draw, [*(f"s{k}y{j}" for j in range(draw.randrange(4, 30))), *passage], 1)) for k in range(40)]
    # 17 of 20 shingles exactly, and 16 of 19 (one too few)
    rows += [(9500, " ".join(f"t{j}" for j in range(23))), (9501, " ".join(f"t{j}" for j in range(20))), (9502, " ".join(f"u{j}" for j in range(22))), (9503, " ".join(f"u{j}" for j in range(19)))]
    return [*rows, (9600, "The Same words HERE again"), (9601, "the same\twords here AGAIN"), (9600, "the same words here again"), (None, "the same words here again"), (None, None), (9700, ""), (9701, " \n ")]


@pytest.mark.parametrize(("max_light", "block_hashes"), [(jaccard_join.MAX_LIGHT, near_dup.BLOCK_HASHES), (0, 60), (16, 300)])
def test_jaccard_join(spark, max_light, block_hashes):
    rows = join_rows()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, size int, sid string, key int").repartition(4)
    got = jaccard_join.jaccard_components(df, max_light=max_light, block_hashes=block_hashes)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == plain_components(rows)
    if max_light == 16:
        assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
        assert jaccard_join.jaccard_components(df.where("doc_id = 9700")).count() == 1


def test_jaccard_small_steps(spark, monkeypatch):
    """Small pieces everywhere: many ranges, flushes, forgotten word hashes."""
    for name, value in (("CHUNK_CHARS", 500), ("RANGE_HASHES", 20), ("HELD_HASHES", 50), ("HELD_WORDS", 30)):
        monkeypatch.setattr(jaccard_join, name, value)
    draw = random.Random(5)
    rows = []
    for k in range(60):
        base = [f"{k % 12}w{j % 40}" for j in range(20 + k % 12)]
        rows.append((k, edits(draw, base, draw.randrange(3))))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)


def test_light_sets_name_subsets(spark):
    """The boundary lets short texts with common words name subsets, and these alone find their links."""
    draw = random.Random(6)
    rows = [(k, edits(draw, ["the", "cat", "sat", "on", "a", "mat", "and", "the", "dog", "ran", "to", f"town{k % 3}"], k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = jaccard_join.sketches(df)
    sets = prints.where("shingles is not null").dropDuplicates(["sid"])
    assert jaccard_join.boundary(sets) >= 9
    keys = jaccard_join.candidate_keys(sets, 40)
    assert keys.where("band = 1").count() > 0 and keys.where("band = 0 and size < 35").count() == 0
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=str) == plain_components(rows)


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error, digest) by all distances."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        found = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes, strict=True)]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, bytes(c).hex(), e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=str)


def vector_rows(draw, n, dims):
    """Clusters, with repeated rows, ties, repeated and null ids and labels, and vectors to leave out."""
    centres = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(k * 3 % n, [float(np.float32(x + draw.gauss(0, 0.2))) for x in draw.choice(centres)], draw.choice([0, 0, 0, 1, None])) for k in range(n)]
    rows += [(7, rows[0][1], 1), (7, rows[1][1], 2), (7, rows[1][1], 2), (None, rows[3][1], None), (-5, [0.0] * dims, 4), (-6, [0.0] * dims, 4)]
    bad = [(None, None, 1), (900, None, 0)] + [(901 + k, [x, *([0.5] * (dims - 1))], 0) for k, x in enumerate((None, float("nan"), float("inf"), -float("inf")))]
    return rows + bad


def coded(df, parts, entries, rounds, **more):
    rows, books = vector_codes.encode_vectors(df, parts, entries, rounds)
    full = vector_codes.with_label_error(rows, **more).select("vec_id", F.lower(F.hex("code")).alias("c"), "error", "label_error")
    return sorted(((*r, vector_codes.books_digest(books)) for r in full.collect()), key=str)


@pytest.mark.parametrize(("dims", "parts", "entries", "rounds"), [(8, 4, 25, 4), (64, 16, 64, 2), (6, 3, 1, 1), (16, 16, 12, 3)])
def test_vector_codes(spark, dims, parts, entries, rounds):
    rows = vector_rows(random.Random(dims), 150, dims)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, at int, q string").repartition(4)
    expected = plain_codes(rows, parts, entries, rounds)
    assert coded(df, parts, entries, rounds) == expected
    if dims == 8:
        assert coded(df, parts, entries, rounds, broadcast_labels=0) == expected


def test_vector_codes_small_and_refused(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = [(3, [0.5, 1.0], 1), (1, [-0.3, 0.2], None)]
    assert coded(spark.createDataFrame(few, schema), 2, 64, 2) == plain_codes(few, 2, 64, 2)
    assert coded(spark.createDataFrame([(1, None, 1)], schema), 2, 64, 2) == []
    assert coded(spark.createDataFrame([], schema), 2, 64, 2) == []
    for bad in ([(1, [1.0], 1), (2, [1.0, 2.0], 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        with pytest.raises(ValueError, match="equal parts"):
            vector_codes.encode_vectors(spark.createDataFrame(bad, schema), 2)
    with pytest.raises(Exception, match="exact error"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1e9, 0.0], 1)], schema), 2)


def test_bounds_save_scans_and_never_decide():
    """Bounded assignments equal full ones over many rounds, on integers full of ties, with fewer scans."""
    rng = np.random.default_rng(2)
    for spread, d in ((3, 2), (400, 4), (90_000_00, 3)):
        centres = rng.integers(-spread, spread + 1, (8, d))
        points = centres[rng.integers(0, 8, 600)] + rng.integers(-2, 3, (600, d))
        books = points[:30].copy()
        groups = vector_codes.entry_groups(books)
        at, upper, lower = vector_codes.first_assignment(points, books, groups)
        scanned = []
        for _ in range(6):
            before, books = books, books.copy()
            for e in range(len(books)):
                if (at == e).any():
                    books[e] = points[at == e].sum(0) // (at == e).sum()
            at, upper, lower, n = vector_codes.next_assignment(points, at, upper, lower, before, books, groups)
            scanned.append(n)
            full = ((points[:, None, :] - books[None]) ** 2).sum(2)
            assert (at == full.argmin(1)).all()
            assert (upper >= np.sqrt(full[np.arange(600), at])).all()
            full = full.astype(float)
            full[np.arange(600), at] = np.inf
            for g in range(groups.max() + 1):
                assert (lower[:, g] <= np.sqrt(full[:, groups == g].min(1))).all()
        assert scanned[-1] < 600 * (groups.max() + 1) / 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 4}", 0) for k, (i, t) in enumerate(join_rows())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    vectors = vector_rows(random.Random(1), 120, 64)
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return out, rows, vectors


def test_registered_queries(spark, folder):
    out, rows, vectors = folder
    got = queries.op11_source_divergence(spark, out).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == plain_audit([(t, lang, s) for _, t, lang, s, _ in rows])
    got = queries.op12_jaccard_join(spark, out).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == plain_components([r[:2] for r in rows])
    got = queries.op13_vector_codes(spark, out).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(vectors, 16, 64, 2)


def test_addresses_have_no_parents(spark):
    from quantloom.llm import url_filter

    hosts = {
        "http://10.1.2.3/x": ["10.1.2.3"], "http://u:p@10.1.2.3:8080/": ["10.1.2.3"], "http://[::1]:80/": ["[::1]"], "https://[2001:DB8::7]/a.b": ["[2001:db8::7]"], "http://u@[::1]": ["[::1]"],
        "https://a.b.com:443/": ["a.b.com", "b.com"], "https://1.2.3.com/": ["1.2.3.com", "2.3.com", "3.com"], "https://x.10.1.2.3.4/": ["x.10.1.2.3.4", "10.1.2.3.4", "1.2.3.4", "2.3.4", "3.4"], "http://[": None, "ftp:/x": None,
    }
    df = spark.createDataFrame([(u,) for u in hosts], "url string")
    got = {r.url: r.k for r in df.withColumn("k", url_filter.host_keys(url_filter.url_host(F.col("url")))).collect()}
    assert {u: (sorted(k) if k and k[0] else None) for u, k in got.items()} == {u: (sorted(k) if k else None) for u, k in hosts.items()}
    day = F.lit("2024-02-01").cast("date")
    entries = spark.createDataFrame([("2.3", "spam"), ("3", "spam"), ("[::1]", "malware"), ("b.com", "spam")], "key string, category string").withColumns({"action": F.lit("add"), "entry_date": day})
    found = {r.url: r.blocked for r in url_filter.url_filter(df.withColumn("fetch_date", day), entries).collect()}
    assert {u for u, b in found.items() if b} == {"http://[::1]:80/", "http://u@[::1]", "https://a.b.com:443/"}


def test_token_files_of_a_remote_store(spark, tmp_path, monkeypatch):
    """A file on a store without memory maps gives the same rows, a few batches at a time."""
    from pyarrow import fs

    from quantloom.llm import token_files

    docs = spark.createDataFrame([(r[0], r[1]) for r in corpus()], "doc_id long, text string")
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(docs, folder, queries._byte_bpe(), sequence=16)
    assert manifest.count() == 1
    remote = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    for row in manifest.collect():
        here = token_files.TokenFile(row.path)
        monkeypatch.setattr(token_files, "_filesystem", lambda path: (remote, path.split(f"{tmp_path}/")[1]))
        there = token_files.TokenFile(row.path)
        monkeypatch.undo()
        assert len(here) == len(there) == -(-row.n_tokens // 16) and len(here.places) > 4
        for a, b in zip(here.documents(), there.documents(), strict=True):
            assert a[:3] == b[:3] and all((x == y).all() for x, y in zip(a[3], b[3], strict=True))
        assert there.batch.cache_info().currsize <= token_files.HELD_BATCHES
        ids, mask = there.sequence(len(there) - 1)
        assert mask.sum() == (row.n_tokens - 1) % 16 + 1 and (ids[mask.sum() :] == 0).all()
        assert type(here.file) is not type(there.file)
