"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never applies merges one by one. An Aho-Corasick automaton gives the longest vocabulary
token that starts at each byte; a left-to-right walk takes that token if it is *compatible* with the
token before it, else shortens it to its longest prefix token, else steps back one token. Two tokens
are compatible when merging their joined bytes would leave exactly these two tokens, and a sequence
of pairwise compatible tokens is the one that the merges give. A byte position that turned out to
be a dead end is marked and never entered again, so the walk is linear in the length.

Edge cases: a null or empty text gives no ids and decodes to the empty text. Text that spells a special
token gets that token's id, as the tokenizers library does by default. Columns of the input beyond the
id and the text are ignored, so names cannot clash; rows with repeated or null ids are encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ship_package

#: The tokenizer file that the contract names.
VOCABULARY = "byte_bpe_50k.json"

#: Words that a worker remembers; the older half goes when it is full, so its memory stays bounded.
CACHED_WORDS = 250_000
CACHED_WORD_CHARS = 48

# Unicode white space as the tokenizers library sees it: Python's own \s also has U+001C to U+001F.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
# The same for texts of Latin-1 characters only, where Python's own matcher knows all classes; it is faster. No two of its
# alternatives start alike, but for white space, so their order is free.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WS1 = "\\t-\\r \\x85\\xa0"
_SPLIT_LATIN = rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{_WS1}{_LETTERS}{_NUMBERS}]+|[{_WS1}]+(?![^{_WS1}])|[{_WS1}]+"
_NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, letter to byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """Words with their ids; a word that isn't there is asked for."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self._ask = ask

    def __missing__(self, word: str) -> bytes:
        return self._ask(word)


class BytePairCodec:
    """Encoder and decoder for one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            spelled[i] = token.encode()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"  # as an array of Python's, made faster from a few ids
        self.special, self.spelled = special, spelled
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._all_words, self._latin_words = regex.compile(_SPLIT).findall, re.compile(_SPLIT_LATIN).findall
        self._length = [len(b) for b in spelled]
        self._merge: dict[tuple[int, int], int] = {}
        self._rank = [-1] * size
        self._parts: list[tuple[int, int] | None] = [None] * size
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self._merge[a, b] = rank
            if self._parts[whole] is None:
                self._parts[whole], self._rank[whole] = (a, b), rank
        self._trie = ahocorasick.Automaton()
        for i in vocab.values():
            self._trie.add_word(spelled[i].decode("latin-1"), i)
        self._trie.make_automaton()
        # The longest token that is a proper prefix of each token; -1 for single bytes.
        self._shorter = [-1] * size
        known = {spelled[i]: i for i in vocab.values()}
        for b, i in known.items():
            self._shorter[i] = next((known[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in known), -1)
        self._fits: dict[tuple[int, int], bool] = {}
        self._cache, self._older = Remembered(self._miss), Remembered(self._miss)
        self._bytes = OffsetTable(spelled)
        self._decimal = OffsetTable([b"%d," % i for i in range(size)])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again.

        Unwinds the merges on both sides of the border, latest first. A merge across the border would
        have come first if its rank is below that of the merge which next changed the piece on the left,
        and not above that of the merge which next changed the piece on the right (of equal merges the
        leftmost comes first).
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is not None:
            return known
        rank, parts, merge = self._rank, self._parts, self._merge
        left_until = right_until = _NEVER
        fits = True
        while True:
            across = merge.get((left, right))
            if across is not None and across < left_until and across <= right_until:
                fits = False
                break
            if rank[left] < 0 and rank[right] < 0:
                break
            if rank[left] > rank[right]:
                left_until, left = rank[left], parts[left][1]
            else:
                right_until, right = rank[right], parts[right][0]
        if len(self._fits) > 300_000:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word of the pre-tokenizer."""
        text = word.encode().decode("latin-1")
        whole = self._trie.get(text, -1)
        if whole >= 0:
            return [whole]
        length, shorter, compatible = self._length, self._shorter, self.compatible
        end = len(text)
        longest = [0] * end
        for last, token in self._trie.iter(text):  # by ascending end: the last write is the longest token
            longest[last + 1 - length[token]] = token
        dead = bytearray(end + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0 and (dead[at + length[token]] or (ids and not compatible(ids[-1], token))):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                if at == end:
                    return ids
                token = longest[at]
            else:
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                token = shorter[token]

    def _miss(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = array(self._code, self.encode_word(word)).tobytes()
        if len(word) <= CACHED_WORD_CHARS:
            if len(self._cache) >= CACHED_WORDS // 2:
                self._cache, self._older = Remembered(self._miss), self._cache
            self._cache[word] = ids
        return ids

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._all_words(text)
        return self._latin_words(text)

    def encode(self, text: str, specials: bool = True) -> np.ndarray:
        """The ids of a whole text; without ``specials``, special tokens that it spells are ordinary text."""
        plain = not specials or self._special_split is None or not any(s in text for s in self.special)
        pieces = [text] if plain else self._special_split.split(text)
        found: list[bytes] = []
        for piece in pieces:
            if len(pieces) > 1 and piece in self.special:
                found.append(np.array([self.special[piece]], self.dtype).tobytes())
                continue
            found += map(self._cache.__getitem__, self._words(piece))
        return np.frombuffer(b"".join(found), self.dtype)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self._bytes.join(ids)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._decimal.join(ids)[:-1]


class OffsetTable:
    """All entries in one byte array; joining a list of entries is one gather through their offsets."""

    def __init__(self, entries: list[bytes]):
        self._blob = np.frombuffer(b"".join(entries), np.uint8)
        self._length = np.array([len(b) for b in entries], np.int64)
        self._start = np.concatenate([[0], np.cumsum(self._length)[:-1]])

    def join(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self._length[ids]
        end = np.cumsum(length)
        at = np.arange(end[-1]) + np.repeat(self._start[ids] - (end - length), length)
        return self._blob[at].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec per worker process and file."""
    return BytePairCodec(path)


def id_type(path: str) -> np.dtype:
    """Little-endian integers that hold every id of a vocabulary."""
    return np.dtype(codec(path).dtype).newbyteorder("<")


@lru_cache(maxsize=2)
def quick_codec(path: str) -> BytePairCodec:
    """The same ids, with new words merged by a compiled library; for stages whose subject is not the encoder."""
    import tiktoken

    own = BytePairCodec(path)
    ranks = {own.spelled[i]: i for i in range(len(own.spelled)) if own.spelled[i].decode("utf-8", "replace") not in own.special}
    merge = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    own.encode_word = lambda word: merge(word.encode())
    return own


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256, and token_ids if asked for.

    ``token_ids`` holds the ids as little-endian integers of two bytes (four from 65,537 entries on).
    Runs map-side: no shuffle, one Arrow batch at a time; ``vocabulary`` is a path that every executor has.
    """
    ship_package(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, digests, decoded, raw = [], [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                counts.append(len(ids))
                digests.append(hashlib.sha256(own.decimal(ids)).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if with_ids:
                    raw.append(ids.tobytes())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_ids
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
