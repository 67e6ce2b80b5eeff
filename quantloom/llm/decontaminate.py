"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items become one automaton over word numbers. Documents stream past it: after
each word the automaton holds the longest suffix of the text that occurs in some item. Words
inside any match of a whole window are hit. Only runs of words that all occur in items are
walked, so most of a corpus costs one dictionary look-up a word.

The items are cut into shards of SHARD_WORDS words at most, so a broadcast automaton has a fixed size;
more items mean more passes, not a larger broadcast. Every pass but the last writes what it found, which
depends on the text alone, to the checkpoint folder by a 128-bit hash of the text, and its automaton is
dropped before the next is built. The last pass joins these finds and adds its own."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .automaton import SuffixAutomaton
from .common import cut_lineage, free_name, map_arrow, packed

WINDOW = 10
#: Words of items in one automaton at most (an item longer than this is a shard of its own).
SHARD_WORDS = 500_000
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton(SuffixAutomaton):
    """A generalised suffix automaton of items (number, words), which answers for windows.

    Only windows of several items have sets. An item number of None is hit but not named."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        super().__init__()
        self.window = window
        self.names = [item for item, _ in items]
        texts = [self.add(words) for _, words in items]
        self.item = array("i", [-1]) * len(self.length)  # by the state that stands for a window
        self.items: dict[int, set[int]] = {}  # where a window has several items
        self.whole: dict[int, list[tuple[int, int]]] = {}  # short items by their state
        for k, text in enumerate(texts):
            if not text:
                continue
            n, state, length = min(window, len(text)), 0, 0
            for i, c in enumerate(text):
                state, length = self._step(state, length, c)
                if i >= n - 1:
                    found = self._of_length(state, n)
                    if len(text) < window:
                        self.whole.setdefault(found, []).append((n, k))
                    elif self.item[found] in (-1, k):
                        self.item[found] = k
                    else:
                        self.items.setdefault(found, {self.item[found]}).add(k)
        self.shortest = min((min(window, len(t)) for t in texts if t), default=window)
        # the nearest state up the links, itself included, that is the whole of a short item
        self.up = array("i", [-1]) * (len(self.length) if self.whole else 0)
        if self.whole:
            for s in np.argsort(np.frombuffer(self.length, "i"), kind="stable").tolist():
                self.up[s] = s if s in self.whole else self.up[self.link[s]] if s else -1

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of hit words, in order and apart, and the names of the items found."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        ids = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int64, len(words))
        if len(ids) < self.shortest:
            return spans, set()
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], ids, [-1])) >= 0))
        for start, end in edges.reshape(-1, 2):
            if end - start < self.shortest:
                continue
            state = length = 0
            for i, c in enumerate(ids[start:end].tolist(), int(start)):
                state, length = self._step(state, length, c)
                if length < self.shortest:
                    continue
                hit = 0
                if length >= self.window:
                    at = self._of_length(state, self.window)
                    hit = self.window
                    if at in self.items:
                        found |= self.items[at]
                    else:
                        found.add(self.item[at])
                s = self.up[state] if self.whole else -1
                # a state up the links may be a whole short item; in its own state only if the match is that long
                while s >= 0:
                    for n, item in self.whole[s]:
                        if n <= length:
                            hit = max(hit, n)
                            found.add(item)
                    s = self.up[self.link[s]] if s else -1
                if hit:
                    if spans and spans[-1][1] >= i + 1 - hit:
                        while spans and spans[-1][0] >= i + 1 - hit:
                            spans.pop()
                        if spans and spans[-1][1] >= i + 1 - hit:
                            spans[-1] = (spans[-1][0], i + 1)
                            continue
                    spans.append((i + 1 - hit, i + 1))
        return spans, {self.names[k] for k in found if k >= 0 and self.names[k] is not None}


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(benchmark: DataFrame, shard_words: int):
    """Lists of (item_id, words) of shard_words words at most; one list at a time is on the driver."""
    shard, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        words = normal_words(row[1])
        if shard and size + len(words) > shard_words:
            yield shard
            shard, size = [], 0
        if words:
            shard.append((row[0], words))
            size += len(words)
    if shard:
        yield shard


_FOUND = "spans array<struct<start:int,end:int>>, items array<string>"
_SPANS, _ITEMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())


def _found_arrays(found: list[tuple[list, set]]) -> list[pa.Array]:
    return [pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _ in found], _SPANS), pa.array([sorted(items) for _, items in found], _ITEMS)]


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), text).alias(f"k{k}") for k in (1, 2)]


def _early_finds(docs: DataFrame, shard: list, window: int) -> DataFrame:
    """k1, k2, spans and items of the texts that a shard hits, written out."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(shard, window))

    def walk(batches):
        automaton = shared.value
        for batch in batches:
            found = [automaton.search(normal_words(t)) for t in batch.column(2).to_pylist()]
            hit = [i for i, (spans, _) in enumerate(found) if spans]
            part = batch.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_found_arrays([found[i] for i in hit])], names=["k1", "k2", "spans", "items"])

    text = F.col("text").cast("string")
    out = cut_lineage(map_arrow(docs.select(*_text_keys(text), text.alias("text")), walk, f"k1 long, k2 long, {_FOUND}"))
    shared.destroy()
    return out


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, finish, fields: list) -> DataFrame:
    """text, rest and what finish(texts, found) makes of them; found has the words' number, spans and items of each text.

    rest is a struct of all other columns of docs. finish gives (the rows to keep or None for all, a column for text
    and for each of the fields)."""
    shards = _shards(benchmark, shard_words)
    shard, early = next(shards, []), None
    for following in shards:
        found = _early_finds(docs, shard, window)
        early = found if early is None else early.unionByName(found)
        shard = following
    names = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.lit(0).alias(free_name("_", names)), *(F.col(f"`{c}`") for c in names))
    rows = docs.select(F.col("text").cast("string").alias("text"), rest.alias("rest"))
    if early is None:
        rows = rows.withColumn("early", F.lit(None).cast("array<struct<spans:array<struct<start:int,end:int>>,items:array<string>>>"))
    else:
        merged = early.groupBy("k1", "k2").agg(F.collect_set(F.struct("spans", "items")).alias("early"))
        rows = rows.select("*", *_text_keys(F.col("text"))).join(merged, ["k1", "k2"], "left").select("text", "rest", "early")
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(shard, window))

    def walk(batches):
        automaton = shared.value
        for batch in batches:
            texts, found = batch.column(0).to_pylist(), []
            for text, before in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = normal_words(text)
                spans, items = automaton.search(words)
                if before:
                    spans = merge_spans(spans + [(x["start"], x["end"]) for one in before for x in one["spans"]])
                    items = items.union(*(one["items"] for one in before))
                found.append((len(words), spans, items))
            keep, columns = finish(texts, found)
            others = batch.column(1) if keep is None else batch.column(1).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([columns[0], others, *columns[1:]], names=["text", "rest", *(f.name for f in fields)])

    return map_arrow(rows, walk, StructType([*rows.select("text", "rest").schema.fields, *fields]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with n_words, spans (array of start and end word, apart and in order) and items (sorted).

    A window is window consecutive words of an item; an item with fewer, but not none, is one
    window. Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.
    Null and empty texts have no words and no spans; items with a null text are left out, the windows
    of an item with a null id are hit but not named; repeated items and repeated rows count like any
    other. Columns of docs stay, but for those named n_words, spans and items, which are replaced.
    Without items nothing is hit."""
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    fields = StructType.fromDDL(f"n_words long, {_FOUND}").fields

    def finish(texts, found):
        return None, [pa.array(texts, pa.string()), pa.array([n for n, _, _ in found], pa.int64()), *_found_arrays([x[1:] for x in found])]

    out = _marked(docs.select(*(F.col(f"`{c}`") for c in names)), benchmark, window, shard_words, finish, fields)
    return out.select(*(F.col(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in names), "n_words", "spans", "items")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without the passages of items: hit words are cut out of the text, with all between them;
    a document with over max_share of its words hit goes as a whole. Columns as in docs, whatever their
    names; texts without a hit, and null and empty texts, stay as they are. Repeated rows are each cut."""
    rows, back = packed(docs)

    def finish(texts, found):
        keep, kept = [], []
        for i, (text, (n, spans, _)) in enumerate(zip(texts, found, strict=True)):
            if sum(b - a for a, b in spans) <= n * max_share:
                keep.append(i)
                kept.append(_cut(text, spans) if spans else text)
        return keep, [pa.array(kept, pa.string())]

    cut = _marked(rows.select("text", F.struct("doc_id", "rest").alias("r")), benchmark, window, shard_words, finish, [])
    return back(cut.select(F.col("rest.r.doc_id").alias("doc_id"), "text", F.col("rest.r.rest").alias("rest")))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_TABLE))]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : words[a][0]])
        done = words[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")
