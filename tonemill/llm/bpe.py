"""BPE encoding and decoding through a table of distinct words.

Texts are split into words; every distinct word is encoded once; ids are joined back by position. The most frequent
words, a table of bounded size, travel to the tasks and are joined there; all others are joined by word. A document
crosses the network as word ranks, a byte or two each, and is put together where its rare words arrive.

No word holds white space, so a plain text is first cut there; most pieces are words, and the others are split once while
they are remembered.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import repeat
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tonemill.llm.common import count_frame, stage

FREQUENT_WORDS = 1 << 19
FREQUENT_BYTES = 40
FLUSH = 400_000
SLICE = 256  # documents per output batch
REMEMBERED = 1 << 16  # pieces of text whose words a task remembers

# Texts of these characters only (ASCII, Latin-1 and Latin Extended-A letters and signs) are normalised and split here:
# for them lower-casing is by single characters and no composition happens. Others go through the library's splitter.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ž]*")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-ſ"
# the pattern's branches start with different characters, so the most frequent one may come first
_PLAIN_WORDS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LETTERS}0-9]+")


class WordSplitter:
    """Splits a text as a tokenizer file says: special tokens, normalisation, then the words of its pattern.

    Files must split by one pattern, map bytes to characters and use a BPE model.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        split, last = spec["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or last["type"] != "ByteLevel" or last["use_regex"] or last["add_prefix_space"] or spec["model"]["type"] != "BPE":
            raise ValueError("the tokenizer must split by a pattern, then work on bytes with a BPE model")
        self.tokenizer = Tokenizer.from_str(definition)
        pattern = split["pattern"]["Regex"]
        self.split = pre_tokenizers.Split(Regex(pattern), split["behavior"].lower(), invert=split["invert"])
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] and spec["normalizer"]["type"] == "Sequence" else []
        known = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        self.plain = _PLAIN if known else None

    def words(self, text: str | None) -> list[str]:
        """Words in order; a special token is its own word."""
        text = text or ""
        parts = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif self.plain and self.plain.fullmatch(part):
                out += _PLAIN_WORDS.findall(part.lower())
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [w for w, _ in self.split.pre_tokenize_str(normal)]
        return out

    def chunks(self, text: str | None) -> list[str] | None:
        """Lower-case pieces between white space of a plain text without special tokens, else None.

        Their words, one after another, are the text's words; a piece that is a word of any text is that word alone.
        """
        low = (text or "").lower()
        plain = self.plain and self.plain.fullmatch(text or "") and not (self.cut and (self.cut.search(text or "") or self.cut.search(low)))
        return low.split() if plain else None

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for piece, _ in self.to_bytes.pre_tokenize_str(word) for t in self.tokenizer.model.tokenize(piece)]

    def pieces(self) -> list[str]:
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]


@cache
def splitter(definition: str) -> WordSplitter:
    return WordSplitter(definition)


_HELD: WeakKeyDictionary[Broadcast, object] = WeakKeyDictionary()


def held(shared: Broadcast, make):
    """A table built once per Python worker from what was broadcast; it goes when the worker lets go of the broadcast."""
    if shared not in _HELD:
        _HELD[shared] = make(shared.value)
    return _HELD[shared]


def joined(values: pa.Array, at: np.ndarray, size: np.ndarray, between: str | bytes) -> pa.Array:
    """The values at the places ``at`` put together, ``size`` of them each."""
    offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values.take(pa.array(at))), between)


def decoded(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """Texts of id lists (32-bit, little-endian)."""
    raw = ids.to_pylist()
    return joined(pieces, np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.fromiter(map(len, raw), np.int64, len(raw)) // 4, " ")


@cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack_all(ranks: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Numbers below 2^28 as one to four bytes, seven bits each, frequent words shortest; ``count`` of them each; then compressed."""
    size = 1 + (ranks >= 1 << 7) + (ranks >= 1 << 14) + (ranks >= 1 << 21)
    end = np.cumsum(size)
    start = end - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        here = np.flatnonzero(size > k) if k else slice(None)
        out[start[here] + k] = (ranks[here] >> (7 * k)) & 127 | np.where(size[here] > k + 1, 128, 0)
    cut = np.append(0, end)[np.append(0, np.cumsum(count))].tolist()
    raw, compress = out.tobytes(), _codec()[0].compress
    return [compress(raw[a:b]) for a, b in zip(cut, cut[1:])]


def unpack_all(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``pack_all``, and how many there are of each."""
    parts = list(map(_codec()[1].decompress, data))
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = raw < 128
    last = np.flatnonzero(ends)
    start = np.append(0, last[:-1] + 1) if len(last) else last
    size = last - start + 1
    out = (raw[start] & 127).astype(np.int64)
    for k in range(1, 4):
        here = np.flatnonzero(size > k)
        out[here] |= (raw[start[here] + k].astype(np.int64) & 127) << (7 * k)
    upto = np.append(0, np.cumsum(ends))[np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64))]
    return out, np.diff(upto)


def pack(ranks: np.ndarray) -> bytes:
    return pack_all(ranks, np.array([len(ranks)]))[0]


def unpack(data: bytes) -> np.ndarray:
    return unpack_all([data])[0]


def distinct_words(docs: DataFrame, definition: str) -> DataFrame:
    """``(word, n, ids)``: every distinct word of all texts, its count, and its ids (32-bit, little-endian), encoded once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, found = splitter(definition), Counter()

        def words() -> pd.DataFrame:
            """Pieces become words; those of letters alone are one each."""
            mixed = [c for c in pieces if not c.isalpha()]
            mixed = [(c, pieces.pop(c)) for c in mixed]
            for c, n in mixed:
                for w in _PLAIN_WORDS.findall(c):
                    pieces[w] += n
            pieces.update(found)
            return count_frame(pieces)

        pieces: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                chunks = split.chunks(t)
                if chunks is None:
                    found.update(split.words(t))
                else:
                    pieces.update(chunks)
                if len(found) + len(pieces) > FLUSH:
                    yield words()
                    found.clear()
                    pieces.clear()
        yield words()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = splitter(definition).encode
        for b in batches:
            yield b.assign(ids=[np.array(one(w), "<u4").tobytes() for w in b["word"]])

    counted = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stage(counted.mapInPandas(encode, "word string, n long, ids binary"), "words")


def encode_documents(docs: DataFrame, definition: str, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, ids (32-bit, little-endian, in text order), decoded.

    definition: the tokenizer file's content. Null and empty texts have no ids and decode to an empty text; very long texts
    are encoded whole; an empty table gives no rows. Rows are told apart by id and text, so repeated rows are each returned,
    in time proportional to their number, and ids, null or not, stay as they are. Columns named in ``keep`` may have any
    name but ``ids`` and ``decoded``: pass such columns inside a struct.
    """
    cols = keep or ["doc_id"]
    words = distinct_words(docs, definition)
    often = words.where(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word", "ids").toArrow()
    context = docs.sparkSession.sparkContext
    names = context.broadcast(often["word"].combine_chunks())
    encoded = context.broadcast(often["ids"].combine_chunks().cast(pa.binary()))
    limit = often.num_rows
    rank_of = lambda words: {w: k for k, w in enumerate(words.to_pylist())}
    # kept columns travel as one struct that Python only passes on
    rows = docs.select(F.struct(*cols).alias("_doc"), F.xxhash64("doc_id", "text").alias("_u"), F.xxhash64("text", F.lit(3)).alias("_v"), F.col("text").alias("_text"))
    kept = rows.schema["_doc"]

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = held(names, rank_of), splitter(definition)
        usual: set[str] = set()  # pieces without rare words

        def unknown(text: str | None) -> list[str]:
            """Words of a text that are not among the frequent ones, in order."""
            chunks = split.chunks(text)
            if chunks is None:
                return sorted(set(split.words(text)).difference(known))
            out: set[str] = set()
            for c in set(chunks).difference(known).difference(usual):
                odd = [w for w in _PLAIN_WORDS.findall(c) if w not in known]
                out.update(odd)
                if not odd:
                    usual.add(c)
            if len(usual) > REMEMBERED:
                usual.clear()
            return sorted(out)

        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                found = [unknown(t) for t in part["_text"].to_pylist()]
                size = [len(f) for f in found]
                columns = {
                    "_u": np.repeat(part["_u"].to_numpy(), size),
                    "_v": np.repeat(part["_v"].to_numpy(), size),
                    "_at": np.concatenate([np.arange(n, dtype=np.int32) for n in size]),
                    "word": pa.array([w for f in found for w in f], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = held(names, rank_of), splitter(definition)
        pieces: dict[str, list[int]] = {}  # ranks of the words of pieces that are more than a word; -1 - k is odd[k]
        odd: dict[str, int] = {}

        def rank(word: str) -> int:
            at = known.get(word)
            return -1 - odd.setdefault(word, len(odd)) if at is None else at

        def places(text: str | None) -> list[int]:
            chunks = split.chunks(text)
            if chunks is None:
                return list(map(rank, split.words(text)))
            out: list[int] = []
            for at, c in zip(map(known.get, chunks), chunks):
                if at is not None:
                    out.append(at)
                elif c in pieces:
                    out += pieces[c]
                else:
                    pieces[c] = list(map(rank, _PLAIN_WORDS.findall(c)))
                    out += pieces[c]
            return out

        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                if len(pieces) > REMEMBERED or len(odd) > REMEMBERED:
                    pieces.clear()
                    odd.clear()
                seen = [places(t) for t in part["_text"].to_pylist()]
                count = np.array([len(s) for s in seen], np.int64)
                at = np.concatenate([np.fromiter(s, np.int64, len(s)) for s in seen])
                rare = np.flatnonzero(at < 0)
                if len(rare):
                    # a document's own words are numbered in their order behind the frequent ones
                    spelled = list(odd)
                    doc, own = np.unique(np.stack([np.repeat(np.arange(len(seen)), count)[rare], -1 - at[rare]]), axis=1, return_inverse=True)
                    pairs = list(zip(doc[0].tolist(), [spelled[k] for k in doc[1].tolist()]))
                    order = np.array(sorted(range(len(pairs)), key=pairs.__getitem__))
                    number = np.empty(len(pairs), np.int64)
                    number[order] = np.arange(len(pairs)) - np.searchsorted(doc[0], doc[0][order])
                    at[rare] = limit + number[own.ravel()]
                packed = pa.array(pack_all(at, count), pa.binary())
                yield pa.RecordBatch.from_arrays([part["_doc"], part["_u"], part["_v"], packed], names=["_doc", "_u", "_v", "_packed"])

    asked = rows.select("_u", "_v", "_text").mapInArrow(rare_words, "_u long, _v long, _at int, word string")
    # documents that repeat id and text ask for the same words: their answers are one
    answers = asked.join(words.select("word", "ids"), "word").groupBy("_u", "_v").agg(F.collect_set(F.struct("_at", "ids")).alias("_rare"))
    packed = rows.mapInArrow(ranks, StructType([kept, StructField("_u", LongType()), StructField("_v", LongType()), StructField("_packed", BinaryType())]))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(splitter(definition).pieces(), pa.string())
        ids, text = held(encoded, lambda often: (often, decoded(often, pieces)))
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                at, count = unpack_all(part["_packed"].to_pylist())
                rare = part["_rare"]
                size = rare.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = rare.flatten()
                # the documents' own words take the places behind the frequent ones
                order = np.lexsort((flat.field("_at").to_numpy(), np.repeat(np.arange(len(size)), size)))
                own = flat.field("ids").take(pa.array(order)).cast(pa.binary())
                at += np.where(at < limit, 0, np.repeat(np.cumsum(size) - size, count))
                texts = pa.concat_arrays([text, decoded(own, pieces)])
                shown = pc.binary_length(texts).to_numpy()[at] > 0
                doc = np.repeat(np.arange(len(count)), count)
                clear = joined(texts, at[shown], np.bincount(doc[shown], minlength=len(count)), " ")
                whole = joined(pa.concat_arrays([ids, own]), at, count, b"")
                yield pa.RecordBatch.from_arrays([part["_doc"], whole, clear], names=["_doc", "ids", "decoded"])

    answered = packed.join(answers, ["_u", "_v"], "left").select("_doc", "_packed", "_rare")
    done = answered.mapInArrow(put_together, StructType([kept, StructField("ids", BinaryType()), StructField("decoded", StringType())]))
    return done.select(*[F.col("_doc")[c].alias(c) for c in cols], "ids", "decoded")
