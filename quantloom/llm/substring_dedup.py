"""Exact substring de-duplication of word windows over the whole corpus.

A window is WINDOW consecutive words of one document; the words of every window whose sequence
starts earlier as well (smaller doc_id, or the same document further left) go. by_automata() is the way of
broadcast suffix automata of reference shards. The reference is the corpus itself, so every automaton has to
reach every document after its shard: shards times documents of work, and every text passes through the driver.
substring_dedup() finds the same spans by three exchanges instead, each of them in proportion to the text:

1. Anchors. Of the ANCHOR-word sequences in each window the one with the least hash is an anchor,
   a choice that depends on the window's words alone: equal windows share an anchor. A window is a
   candidate only where its anchor occurs twice.
2. Windows. Candidate windows meet by a 96-bit hash, sorted by document and place; all but the
   first are repeats.
3. Removal. The starts of repeats meet the documents by chunk.

Skew: a map task sends each hash once (equal ones inside the task are settled there), so an anchor
or window that a third of all documents hold is one row for each task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import CHUNK_ROWS, CHUNK_SCHEMA, NO_ID, Placement, as_words, by_chunk, cut_lineage, map_arrow, meet_by_chunk, partitions, placement, text_tag, unpack_docs

WINDOW, ANCHOR = 20, 8
#: Words of one reference shard of by_automata().
SHARD_WORDS = 500_000
#: Hashes that a map task holds before it settles and sends them.
HELD = 2_000_000
#: A place in the corpus after the doc_id: the text's crc32, then the word's number in 31 bits.
_SHIFT, _LOW = 31, (1 << 31) - 1

_ROWS = "pid int, h1 long, h2 int, doc long, at long, marks binary"
_ROWS_ARROW = pa.schema([("pid", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32()), ("doc", pa.int64()), ("at", pa.int64()), ("marks", pa.binary())])


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE, _MIX = _odd(64, 1), _odd(64, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sequences(values: np.ndarray, n: int, factors: np.ndarray) -> np.ndarray:
    """A hash of each run of n values."""
    m = len(values) - n + 1
    out = values[:m] * factors[0]
    for j in range(1, n):
        out = out + values[j : j + m] * factors[j]
    return _mix(out)


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """The best (np.minimum or np.maximum) of each n values in a row."""
    step, out = 1, x
    while 2 * step <= n:
        out = best(out[:-step], out[step:])
        step *= 2
    return best(out[: len(x) - n + 1], out[n - step : n - step + len(x) - n + 1])


def anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a document with a window at least."""
    grams = _sequences(hashes, anchor, _PLACE)
    span = window - anchor + 1
    least = _sliding(grams, span, np.minimum)
    padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    places = np.flatnonzero(_sliding(padded, span, np.maximum) == grams)
    return places, _mix(grams[places] ^ _PLACE[0])  # least hashes are small: spread them again


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return _sequences(hashes, window, _MIX).view(np.int64), (_sequences(hashes, window, _PLACE[::-1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _pack_marks(docs: np.ndarray, ats: np.ndarray) -> bytes:
    order = np.lexsort((ats, docs))
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate((docs[order], ats[order])).tobytes())


def _unpack_marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _by_chunk_rows(place: Placement, docs: np.ndarray, ats: np.ndarray) -> list[tuple[int, bytes]]:
    """Marks as (chunk, packed) rows."""
    if not len(docs):
        return []
    chunk = place.chunks(docs, ats >> _SHIFT)
    order = np.argsort(chunk, kind="stable")
    cuts = np.flatnonzero(np.diff(chunk[order])) + 1
    return [(int(chunk[part[0]]), _pack_marks(docs[part], ats[part])) for part in np.split(order, cuts)]


def _sent(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, ats: np.ndarray, marks: list[tuple[int, bytes]], n_parts: int) -> pa.RecordBatch:
    """Rows for the exchange: hashes to their range, packed marks to any place."""
    n, m = len(h1), len(marks)
    pid = ((h1.view(np.uint64) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
    pid = np.concatenate((pid, np.array([c % n_parts for c, _ in marks], np.int32)))
    zero = np.zeros(m, np.int64)
    columns = [pa.array(np.concatenate((x, y))) for x, y in ((h1, zero), (h2, zero.astype(np.int32)), (docs, np.array([c for c, _ in marks], np.int64)), (ats, zero))]
    return pa.RecordBatch.from_arrays([pa.array(pid), *columns, pa.array([None] * n + [x for _, x in marks], pa.binary())], schema=_ROWS_ARROW)


def _chunk_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([[]] * len(rows), pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.binary())], schema=CHUNK_SCHEMA)


class _Held:
    """Rows (h1, h2, doc, at) that a task has gathered."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, h1: np.ndarray, h2: np.ndarray, doc: int, ats: np.ndarray) -> None:
        self.parts.append((h1, h2, np.full(len(h1), doc, np.int64), ats))
        self.n += len(h1)

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows in the order of (h1, h2, doc, at), and which of them begin a new hash."""
        h1, h2, docs, ats = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ats, docs, h2, h1))
        h1, h2, docs, ats = h1[order], h2[order], docs[order], ats[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.parts, self.n = [], 0
        return h1, h2, docs, ats, new


def _repeats(docs: np.ndarray, ats: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which rows are another place than the first of their hash."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (docs != docs[first]) | (ats != ats[first])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy() for i in range(1, 5)]


def _gathered(batches, settle, place: Placement):
    """Pass packed marks on, give the hash rows in large sorted pieces to settle; yield marks by chunk.

    A piece ends before the hash that may go on in the next one."""
    rows: list[tuple[int, bytes]] = []
    parts: list[list[np.ndarray]] = []
    n = 0
    found_docs, found_ats = [], []
    for batch in batches:
        if batch.column(5).null_count < batch.num_rows:
            passing = batch.filter(pc.is_valid(batch.column(5)))
            rows += zip(passing.column(3).to_pylist(), passing.column(5).to_pylist(), strict=True)
            batch = batch.filter(pc.is_null(batch.column(5)))
        if batch.num_rows:
            parts.append(_columns(batch))
            n += batch.num_rows
        if n >= HELD // 4:
            docs, ats, parts = settle([np.concatenate(x) for x in zip(*parts, strict=True)], False)
            n = len(parts[0][0]) if parts else 0
            found_docs.append(docs)
            found_ats.append(ats)
        if len(rows) >= 64:
            yield _chunk_batch(rows)
            rows = []
    if parts:
        docs, ats, _ = settle([np.concatenate(x) for x in zip(*parts, strict=True)], True)
        found_docs.append(docs)
        found_ats.append(ats)
    if found_docs:
        rows += _by_chunk_rows(place, np.concatenate(found_docs), np.concatenate(found_ats))
    if rows:
        yield _chunk_batch(rows)


def _last_run(columns: list[np.ndarray], last: bool) -> int:
    """Where the last hash begins; the end if nothing follows."""
    h1, h2 = columns[:2]
    if last:
        return len(h1)
    before = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
    return int(before[-1]) + 1 if len(before) else 0


def _settle_anchors(columns: list[np.ndarray], last: bool):
    """Places of hashes with two rows at least; one row of a hash goes on if the hash may."""
    end = _last_run(columns, last)
    h1, _, docs, ats = columns
    new = np.ones(len(h1), bool)
    new[1:] = h1[1:] != h1[:-1]
    alone = new & np.append(new[1:], True)
    if not last:  # the last hash is settled with what follows, unless it has two rows already
        open_run = slice(end, None)
        if len(h1) - end == 1:
            alone[end] = True
            rest = [[x[open_run] for x in columns]]
        else:
            rest = [[h1[-1:], h1[-1:] * 0, docs[-1:], np.array([-1])]]
    else:
        rest = []
    wanted = ~alone & (ats >= 0)
    return docs[wanted], ats[wanted], rest


def _settle_windows(columns: list[np.ndarray], last: bool):
    """Places of all but the first window of a hash; the first of the last hash goes on."""
    h1, h2, docs, ats = columns
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    wanted = _repeats(docs, ats, new)
    first = int(np.flatnonzero(new)[-1])
    rest = [] if last else [[x[first : first + 1] for x in columns]]
    return docs[wanted], ats[wanted], rest


class _Marks:
    """The marks of one chunk, by document."""

    def __init__(self, parts: list[bytes]):
        both = [_unpack_marks(x) for x in parts]
        docs, ats = (np.concatenate([b[k] for b in both]) if both else np.zeros(0, np.int64) for k in (0, 1))
        order = np.lexsort((ats, docs))
        self.docs, self.ats = docs[order], ats[order]

    def of(self, doc: int, tag: int) -> np.ndarray:
        """Places in the rows of this doc_id and text."""
        a, b = np.searchsorted(self.docs, [doc, doc + 1]) if doc < (1 << 63) - 1 else (np.searchsorted(self.docs, doc), len(self.docs))
        ats = self.ats[a:b]
        return np.unique(ats[ats >> _SHIFT == tag] & _LOW)


def _marked_docs(batches):
    """(doc_id or None, text, marks) of each document, in the rows of meet_by_chunk."""
    at, parts, marks = object(), [], None
    for chunk, kind, ids, data in by_chunk(batches):
        if chunk != at:
            at, parts, marks = chunk, [], None
        if kind == 0:
            parts.append(data)
            continue
        marks = marks or _Marks(parts)
        for doc_id, text in unpack_docs(ids, data):
            yield doc_id, text, marks


def ids_repeat(docs: DataFrame) -> bool:
    """Whether rows share a doc_id. If none do, places need no tag of the text, which shrinks both exchanges."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def _tag(text: str | None, tagged: bool) -> int:
    return text_tag(text) if tagged else 0


def repeated_starts(docs: DataFrame, place: Placement, tagged: bool, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Starts of the windows that also start earlier, packed by chunk (see common.CHUNK_ROWS)."""
    n_parts = partitions(docs.sparkSession)
    span = window - anchor + 1

    def find_anchors(batches):
        held, known = _Held(), WordHashes()

        def settled():
            h1, h2, ids, ats, new = held.sorted()
            alone = new & np.append(new[1:], True)
            marks = _by_chunk_rows(place, ids[~alone], ats[~alone])
            ats = np.where(alone, ats, -1)  # a hash that the task has twice is sent once, to tell the others
            return _sent(h1[new], h2[new], ids[new], ats[new], marks, n_parts)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = as_words(text)
                if len(words) >= window:
                    places, hashes = anchors(known.of(words), window, anchor)
                    held.add(hashes.view(np.int64), np.zeros(len(hashes), np.int32), NO_ID if doc_id is None else doc_id, (_tag(text, tagged) << _SHIFT) + places)
            if held.n >= HELD:
                yield settled()
        if held.n:
            yield settled()

    def candidates(batches):
        held, known = _Held(), WordHashes()

        def settled():
            h1, h2, ids, ats, new = held.sorted()
            again = _repeats(ids, ats, new)
            return _sent(h1[new], h2[new], ids[new], ats[new], _by_chunk_rows(place, ids[again], ats[again]), n_parts)

        for doc_id, text, marks in _marked_docs(batches):
            doc, tag = NO_ID if doc_id is None else doc_id, _tag(text, tagged)
            places = marks.of(doc, tag)
            if not len(places):
                continue
            hashes = known.of(as_words(text))
            n = len(hashes) - window + 1
            wanted = np.zeros(n + span + 1, np.int32)
            np.add.at(wanted, np.maximum(places - span + 1, 0), 1)
            np.add.at(wanted, np.minimum(places + 1, n), -1)
            starts = np.flatnonzero(np.cumsum(wanted)[:n] > 0)
            h1, h2 = window_hashes(hashes, window)
            held.add(h1[starts], h2[starts], doc, (tag << _SHIFT) + starts)
            if held.n >= HELD:
                yield settled()
        if held.n:
            yield settled()

    def exchanged(df, fn, settle):
        dealt = map_arrow(df, fn, _ROWS).repartitionById(n_parts, F.col("pid")).sortWithinPartitions("h1", "h2", "doc", "at")
        return map_arrow(dealt, lambda batches: _gathered(batches, settle, place), CHUNK_ROWS)

    twice = exchanged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), find_anchors, _settle_anchors)
    return exchanged(meet_by_chunk(twice, docs, place, tagged), candidates, _settle_windows)


def _without(words: list[bytes], starts: np.ndarray, window: int) -> tuple[list[bytes], list]:
    """The words outside the windows that begin at starts, and the spans [start, end) of those inside."""
    if not len(starts):
        return words, []
    edge = np.zeros(len(words) + 2, np.int32)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    gone = np.cumsum(edge)[: len(words)] > 0
    spans = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2).tolist()
    kept, done = [], 0
    for a, b in spans:
        kept += words[done:a]
        done = b
    return kept + words[done:], spans


class Reference(SuffixAutomaton):
    """The documents of a shard, added in order, which answers for windows that start earlier."""

    def __init__(self, window: int):
        super().__init__()
        self.window = window
        self.begins: dict[tuple, int] = {}

    def add_document(self, key: tuple, words: list[bytes]) -> None:
        self.begins[key] = self.n_words
        self.add(words)

    def starts(self, key: tuple, words: list[bytes]) -> list[int]:
        """Starts of the document's windows whose first occurrence in the shard lies before; all that occur where
        the document is not in the shard, since the shard's documents come before it then."""
        state = length = 0
        own, out, get = self.begins.get(key), [], self.number.get
        for i, w in enumerate(words):
            c = get(w, -1)
            if c < 0:
                state = length = 0
                continue
            state, length = self._step(state, length, c)
            if length >= self.window and (own is None or self.first[self._of_length(state, self.window)] < own + i):
                out.append(i - self.window + 1)
        return out


def by_automata(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """What substring_dedup returns, by broadcast suffix automata of reference shards.

    The documents in order are cut into shards of shard_words words at most (a longer document is a shard of its
    own). One automaton at a time is built and broadcast; the documents of its shard and those after stream past it,
    and the starts found are written out. So the work is the square of the corpus: for references of a few shards."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.coalesce("doc_id", F.lit(NO_ID))
    tagged = rows.withColumns({"o": order, "tag": F.when(F.col("text").isNull(), 0).otherwise(F.crc32(F.encode("text", "utf-8")))})
    found = None

    def passed(shard: Reference, low: tuple) -> DataFrame:
        shared = spark.sparkContext.broadcast(shard)

        def stream(batches):
            reference = shared.value
            for batch in batches:
                out = []
                for o, tag, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if got := reference.starts((o, tag), as_words(text)):
                        out.append((o, tag, got))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["o", "tag", "starts"])

        after = (F.col("o") > low[0]) | ((F.col("o") == low[0]) & (F.col("tag") >= low[1]))
        out = cut_lineage(map_arrow(tagged.where(after).select("o", "tag", "text").distinct(), stream, "o long, tag long, starts array<int>"))
        shared.destroy()
        return out

    shard, low = Reference(window), None
    for r in tagged.select("o", "tag", "text").distinct().orderBy("o", "tag").toLocalIterator():
        words = as_words(r.text)
        if shard.n_words and shard.n_words + len(words) > shard_words:
            part = passed(shard, low)
            found = part if found is None else found.unionByName(part)
            shard, low = Reference(window), None
        low = low or (r.o, r.tag)
        shard.add_document((r.o, r.tag), words)
    if low is not None:
        part = passed(shard, low)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "o long, tag long, starts array<int>")
    both = tagged.join(found.groupBy("o", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts")), ["o", "tag"], "left").select("doc_id", "text", "starts")

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, starts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = as_words(text)
                kept, spans = _without(words, np.unique(np.array(starts or [], np.int64)), window)
                out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), spans))
            yield _cut_rows(out)

    return map_arrow(both, cut, _CUT)


_CUT = "doc_id long, n_words long, n_removed long, text string, spans array<array<int>>"


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "text", "spans"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Each row of documents(doc_id, text, ...) without the words that repeat earlier windows.

    Returns doc_id, n_words, n_removed, text (the words left, joined by one space) and spans (the
    removed words, as arrays of start and end). Words are unchanged; windows are judged on the
    input. Null and empty texts have no words and give an empty text. A null doc_id is smaller than
    all others; rows that repeat a doc_id count in the order of the crc32 of their texts, and rows
    that repeat doc_id and text are one document. Other columns are ignored."""

    tagged, place = ids_repeat(docs), placement(docs)

    def cut(batches):
        rows: list[tuple] = []
        for doc_id, text, marks in _marked_docs(batches):
            words = as_words(text)
            kept, spans = _without(words, marks.of(NO_ID if doc_id is None else doc_id, _tag(text, tagged)), window)
            rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), spans))
            if len(rows) >= 256:
                yield _cut_rows(rows)
                rows = []
        if rows:
            yield _cut_rows(rows)

    return map_arrow(meet_by_chunk(repeated_starts(docs, place, tagged, window, anchor), docs, place, tagged), cut, _CUT)
