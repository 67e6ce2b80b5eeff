"""Byte-level BPE through a table of distinct words.

A word is a run of non-space characters with the white space before it. No token of byte-level BPE crosses
from a non-space into a space, so a text's ids are its words' ids in a row. Each map task lists the
distinct words of each chunk of documents; the lists meet by hash of the word, where every
distinct word of the corpus is encoded once; the coded lists and the documents meet by chunk, where
ids are joined back by position. A frequent word is one entry in each list, never a row for each use.

Words are listed by their parts (see parts()): a stem, closing punctuation and the pieces at a line
end each are a word of their own, which the tokenizer would tell apart anyway.

All lists travel packed, a row for each (task, bucket, chunk), so the exchanges move few rows. Chunks
are parts of ranges of doc_id that hold about as many documents each (common.Placement), whatever the ids are.

Decoding joins the distinct ids of each batch of documents with the table of pieces, then puts the pieces in
the ids' places. The table is a broadcast of one row for each id of the vocabulary, so ids stay in the order and
the task of their documents and need no exchange."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import CHUNK_ROWS, CHUNK_SCHEMA, Placement, by_chunk, map_arrow, meet_by_chunk, pack, placement, text_tags, unpack, unpack_docs

#: Distinct words of one chunk that a map task holds before it hands them on.
LIST_WORDS = 200_000
#: Words of one generation of a process's memory; it holds two, about 200 MB.
WORDS_KEPT = 600_000
#: Bytes of words that go through the tokenizer in one call.
CALL_BYTES = 1 << 16


_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def split_words(text: str) -> list[str]:
    """The text cut before every space that follows a non-space character. Joined, the words give the text."""
    if not ("  " in text or "\0" in text or any(c in text and c + " " in text for c in _OTHER_SPACE)):
        words = text.replace(" ", "\0 ").split("\0")
        return words if words[0] or len(words) == 1 else words[1:]
    pieces = text.split(" ")
    words = [pieces[0]]
    open_end = not pieces[0] or pieces[0][-1].isspace()
    for p in pieces[1:]:
        if open_end:
            words[-1] += " " + p
        else:
            words.append(" " + p)
        open_end = not p or p[-1].isspace()
    return words


#: Closing punctuation that is a token run of its own after a letter or digit. No apostrophe: it opens contractions.
_CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def parts(word: str, whole: tuple[str, ...] = ()) -> list[str]:
    """The word cut at single line ends and before its closing punctuation, where tokens end in any case.

    A word that holds one of the strings in whole is not cut."""
    if whole and any(x in word for x in whole):
        return [word]
    if "\n" not in word and word[-1:].isalnum():
        return [word]
    if "\n" in word:
        lines = word.split("\n")
        if all(lines) and not any(x[-1].isspace() for x in lines) and not any(x[0].isspace() for x in lines[1:]):
            out = parts(lines[0])
            for x in lines[1:]:
                out += ["\n", *parts(x)]
            return out
        return [word]
    stem = word.rstrip(_CLOSING)
    return [stem, word[len(stem) :]] if 0 < len(stem) < len(word) and stem[-1].isalnum() else [word]


class WordTable(dict):
    """Words to bytes; a word that is not listed is made of its parts, and remembered."""

    def __init__(self, whole: tuple[str, ...] = ()):
        self.whole = whole

    def __missing__(self, word: str) -> bytes:
        found = parts(word, self.whole)
        if len(found) < 2:
            raise KeyError(word)
        self[word] = out = b"".join([self[x] for x in found])
        return out


def all_parts(words: Iterable[str], whole: tuple[str, ...]) -> set[str]:
    """The distinct parts of words; most words end in an ASCII letter and are their own only part."""
    plain = {w for w in words if w and w[-1] in _PLAIN and "\n" not in w}
    return plain.union(p for w in words if w not in plain for p in parts(w, whole))


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: its own where it is one, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """A tokenizer of the tokenizers library from its JSON, which must be plain byte-level BPE."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        pieces = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        pieces |= {t["id"]: bytes(alphabet[c] for c in t["content"]) if all(c in alphabet for c in t["content"]) else t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _alone(self, word: str, special: tuple[str, ...]) -> bool:
        """Whether a word can't stand next to others in one call."""
        return not word or not word[0].isspace() or word[-1].isspace() or (special and any(s in word for s in special))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers.

        Words are encoded many to a call and told apart by the bytes that their ids stand for."""
        out: list[bytes] = [b""] * len(words)
        batch: list[int] = []
        size, joined = 0, "".join(words)
        special = tuple(x for x in self.special if x in joined)
        for i, w in enumerate(words):
            if self._alone(w, special):
                out[i] = self.encode(w).tobytes() if w else b""
                continue
            batch.append(i)
            size += len(w)
            if size >= CALL_BYTES:
                self._together(words, batch, out)
                batch, size = [], 0
        self._together(words, batch, out)
        return out

    def _together(self, words: list[str], batch: list[int], out: list[bytes]) -> None:
        if not batch:
            return
        ids = self.encode("".join([words[i] for i in batch]))
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(words[i].encode("utf-8", "surrogatepass")) for i in batch])) + 1
        raw, start = ids.tobytes(), 0
        for i, end in zip(batch, (4 * ends).tolist(), strict=True):
            out[i] = raw[start:end]
            start = end


class WordMemory:
    """Ids of the words met lately, in two generations of WORDS_KEPT at most: when the new one is full
    the old one is forgotten, and words met again move up."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.now: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}

    def of(self, texts: list[list[str]]) -> dict[str, bytes]:
        """A table that has all words of these texts."""
        if len(self.now) > WORDS_KEPT:
            self.last, self.now = self.now, {}
        now, new = self.now, []
        for w in set().union(*texts).difference(now):
            if (v := self.last.get(w)) is None:
                new.append(w)
            else:
                now[w] = v
        now.update(zip(new, self.tokens.encode_words(new), strict=True))
        return now


_LOADED: dict[int, Tokens] = {}
_KNOWN: dict[int, WordMemory] = {}


def loaded(source: str) -> Tokens:
    """The tokenizer of this JSON, loaded once in a process."""
    key = zlib.crc32(source.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokens(source)
    return _LOADED[key]


def remembered(source: str) -> WordMemory:
    """The word memory of this process for this tokenizer: later tasks find the words of earlier ones."""
    key = zlib.crc32(source.encode())
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = WordMemory(loaded(source))
    return _KNOWN[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_LISTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary())])


def word_lists(docs: DataFrame, place: Placement, n_buckets: int, whole: tuple[str, ...]) -> DataFrame:
    """(bucket, chunk, words): the distinct parts of words that a map task saw in a chunk, by hash."""

    def rows(chunk, words):
        lists: dict[int, list[bytes]] = {}
        for w in all_parts(words, whole):
            b = w.encode("utf-8", "surrogatepass")
            lists.setdefault(zlib.crc32(b) % n_buckets, []).append(b)
        buckets = list(lists)
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([chunk] * len(buckets), pa.int64()), pa.array([pack(sorted(lists[b])) for b in buckets], pa.binary())], schema=_LISTS)

    def collect(batches):
        seen: dict[int, set[str]] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for chunk, text in zip(place.of(batch.column(0).to_pylist(), text_tags(texts)).tolist(), texts, strict=True):
                if text:
                    own = seen.setdefault(chunk, set())
                    own.update(split_words(text))
                    if len(own) >= LIST_WORDS:
                        yield rows(chunk, seen.pop(chunk))
            while sum(map(len, seen.values())) > 2 * LIST_WORDS:
                most = max(seen, key=lambda c: len(seen[c]))
                yield rows(most, seen.pop(most))
        for c, own in seen.items():
            yield rows(c, own)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), collect, "bucket int, chunk long, words binary")


def _pack_coded(words: list[bytes], ids: list[bytes]) -> bytes:
    """Words and their ids; ids in two bytes where all fit."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    narrow = not len(flat) or flat.max() <= 0xFFFF
    counts = np.fromiter(map(len, ids), "<u4", len(ids)) // 4
    listed = pack(words)
    coded = zstandard.ZstdCompressor(level=3).compress(counts.astype("<u4").tobytes() + (flat.astype("<u2") if narrow else flat).tobytes())
    return struct.pack("<IIB", len(listed), len(words), bool(narrow)) + listed + coded


def _unpack_coded(data: bytes) -> tuple[list[bytes], list[bytes]]:
    size, n, narrow = struct.unpack_from("<IIB", data)
    words = unpack(data[9 : 9 + size])
    raw = zstandard.ZstdDecompressor().decompress(data[9 + size :])
    ends = 4 * np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)
    flat = np.frombuffer(raw, "<u2" if narrow else "<u4", offset=4 * n).astype("<u4").tobytes()
    out, start = [], 0
    for end in ends.tolist():
        out.append(flat[start:end])
        start = end
    return words, out


def _packed_batch(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """A batch of documents as one value, with the distinct ids in its column at."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    ids = np.unique(np.frombuffer(b"".join(x for x in batch.column(at).to_pylist() if x), "<i4"))
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([ids], pa.list_(pa.int32()))], names=["docs", "ids"])


_CODED, _PACKED = "doc_id long, n_tokens long, ids binary", "docs binary, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token ids of each row of documents(doc_id, text, ...).

    Returns doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers), equal to the
    tokenizers library's encode(text, add_special_tokens=False) without truncation and padding; the
    special tokens' strings in a text become their ids. Null and empty texts have no ids. Rows that
    repeat a doc_id each get a row; a null doc_id stays null. Other columns are ignored."""
    return _encoded(docs, tokenizer_path, False)


def recode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """encode_documents followed by decode_documents: doc_id, n_tokens, ids and text. Between the two documents
    stay in the batches that the encoding made, which saves a pass through Python."""
    return _decoded(_encoded(docs, tokenizer_path, True), tokenizer_path, 2, StructType.fromDDL(_CODED))


def _encoded(docs: DataFrame, tokenizer_path: str, packed: bool) -> DataFrame:
    """The documents with their ids, a row each or a row for each batch of them."""
    spark = docs.sparkSession
    text = read_tokenizer(tokenizer_path)
    whole = tuple(t["content"] for t in json.loads(text)["added_tokens"])
    source = spark.sparkContext.broadcast(text)
    place = placement(docs)
    n = place.ranges  # a small table has few lists, so it gets few buckets

    def encode(batches):
        """One bucket: the lists of each chunk become one, each word of the bucket is encoded once."""
        tokens = loaded(source.value)
        by_chunk_words: dict[int, set[bytes]] = {}
        for batch in batches:
            for c, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by_chunk_words.setdefault(c, set()).update(unpack(x))
        words = list(set().union(*by_chunk_words.values()))
        ids = dict(zip(words, tokens.encode_words([w.decode("utf-8", "surrogatepass") for w in words]), strict=True))
        for c, own in by_chunk_words.items():
            ordered = sorted(own)
            coded = _pack_coded(ordered, [ids[w] for w in ordered])
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([0], pa.int32()), pa.array([[]], pa.list_(pa.int64())), pa.array([coded], pa.binary())], schema=CHUNK_SCHEMA)

    coded = map_arrow(word_lists(docs, place, n, whole).repartitionById(n, F.col("bucket")), encode, CHUNK_ROWS)

    def join(batches):
        at, table = None, WordTable(whole)
        for chunk, kind, ids, data in by_chunk(batches):
            if chunk != at:
                at, table = chunk, WordTable(whole)
            if kind == 0:
                listed, values = _unpack_coded(data)
                table.update(zip((w.decode("utf-8", "surrogatepass") for w in listed), values, strict=True))
                continue
            doc_ids, found = [], []
            for doc_id, text in unpack_docs(ids, data):
                doc_ids.append(doc_id)
                found.append(b"".join(map(table.__getitem__, split_words(text))) if text else b"")
            batch = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids"])
            yield _packed_batch(batch, 2) if packed else batch

    return map_arrow(meet_by_chunk(coded, docs, place), join, _PACKED if packed else _CODED)


def piece_table(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """id and piece (its bytes) of each id of the vocabulary."""
    pieces = Tokens(read_tokenizer(tokenizer_path)).pieces
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary())}))


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded(..., ids) with a column text: the pieces of the ids, joined, as UTF-8.

    The table of pieces has one row for each id of the vocabulary, so it is broadcast. Null ids
    give a null text, no ids an empty one; bytes that are no UTF-8 become U+FFFD; an id outside the
    vocabulary fails. A column text of encoded is replaced, all others stay."""
    names = [c for c in encoded.columns if c != "text"]
    kept = encoded.select(*(F.col(f"`{c}`") for c in names))

    at = names.index("ids")

    def listed(batches):
        for batch in batches:
            if batch.num_rows:
                yield _packed_batch(batch, at)

    return _decoded(map_arrow(kept, listed, _PACKED), tokenizer_path, at, kept.schema)


def _decoded(lists: DataFrame, tokenizer_path: str, at: int, schema: StructType) -> DataFrame:
    """The documents of packed batches, of this schema with the ids in column at, and their texts."""
    pieces = lists.select("docs", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(piece_table(lists.sparkSession, tokenizer_path)), "id", "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    known = F.coalesce("piece", F.when(F.col("id").isNotNull(), F.raise_error(F.concat(F.lit("no such id: "), F.col("id").cast("string"))).cast("binary")))

    def joined(batches):
        """The rows of one batch follow each other in order, as a join with a broadcast table leaves them; their places are checked."""
        docs, table, last = None, {}, -1

        def out():
            batch = pa.ipc.open_stream(docs).read_next_batch()
            texts = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<i4").tolist())).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

        for batch in batches:
            opened = set(np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False)).tolist())
            ids, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            places = batch.column(3).to_numpy(zero_copy_only=False)
            due = np.append(last, places[:-1]) + 1
            due[sorted(opened)] = 0
            if not np.array_equal(places, due):
                raise ValueError("the pieces of a batch of documents did not stay together")
            last = places[-1] if len(places) else last
            starts = sorted({0, *opened})
            for start, end in zip(starts, [*starts[1:], len(ids)], strict=True):
                if start in opened:
                    if docs is not None:
                        yield out()
                    docs, table = batch.column(0)[start].as_py(), {}
                table.update(zip(ids[start:end], found[start:end], strict=True))
        if docs is not None:
            yield out()

    rows = pieces.select(F.when(first, F.col("docs")).alias("docs"), "id", known.alias("piece"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return map_arrow(rows, joined, StructType([*schema.fields, StructField("text", StringType())]), rows=1 << 30)
