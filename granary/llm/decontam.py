"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

For a benchmark item of n words, windows of n words of a document are compared with it, at every offset. A window's fingerprint is
the 64-bit SimHash of its weighted shingles, rolled along the document: one step adds a shingle and takes one away. Candidates are the
items of that length within ``RADIUS`` bits, from an index of ``BLOCKS`` blocks: two fingerprints within 15 bits differ by 3 bits at most in
one of four blocks of 16, so looking up each block with up to 3 bits flipped meets all of them, and some 4 % of any others.
Candidates are then verified by their exact weighted shingle similarity (shared weight over joint weight), 0.8 by default.

So a window counts if its fingerprint is within the radius and its similarity suffices. At a similarity of exactly 0.8 fingerprints
differ by some ten bits, three more or less; the README has the recall that was measured, by similarity.

Fingerprints are taken only of windows whose shingles, as far as items of that length have them, weigh as much as the similarity asks of
the lightest such item. No other window can reach it; that needs one array operation over the hashed words of a text.

Shingles have five words (fewer in items shorter than that) and weigh log(1 + documents / documents with that
shingle), so that shingles that all kinds of documents share count less. The weights come from all documents. A shingle that no item has weighs one.

The benchmark is sent to the executors in blocks of at most ``ITEM_BLOCK`` items (some 50 MB); a larger benchmark takes several passes.

Edge cases: words are in lower case and end at white space and ASCII punctuation, so that marks around them don't hide a passage. Null and
empty texts match nothing, nor do items without words. A text shorter than an item is one window. Equal items all match. Null ids are kept as they
are; repeated documents each get their rows. Very long texts are fingerprinted in runs. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize, packed, ship_package, text_digest, unpacked, without

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCKS, SEED = 64, 15, 4, 42
ITEM_BLOCK = 20_000
#: Windows that are fingerprinted at a time.
RUN = 4_096
#: Weights are multiples of its inverse, so that their sums are exact in any order.
_GRAIN = 1 << 20
_PUNCTUATION = bytes(32 if 33 <= b < 127 and not chr(b).isalnum() else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in lower case, without ASCII punctuation."""
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def shingle_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def weight_of(documents: int, having: int) -> float:
    return round(math.log1p(documents / having) * _GRAIN) / _GRAIN


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class ItemIndex:
    """Items of the benchmark: places of their shingles, their fingerprints, and Hamming blocks over these."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.items = [(i, w) for i, text in items if (w := words_of(text))]
        self.length = np.array([len(w) for _, w in self.items], np.int64)
        self.width = {n: min(shingle, n) for n in self.length.tolist()}
        self.word_ids: dict[bytes, int] = {}
        for _, words in self.items:
            for word in words:
                self.word_ids.setdefault(word, len(self.word_ids) + 1)
        self.shingles: list[Counter[int]] = []
        lengths: dict[int, dict[int, set[int]]] = {}  # width, key: lengths of items with that shingle
        spelt: dict[int, dict[int, int]] = {}
        for _, words in self.items:
            n = self.width[len(words)]
            hashes = [shingle_hash(words[i : i + n]) for i in range(len(words) - n + 1)]
            self.shingles.append(Counter(hashes))
            for key, h in zip(self._rolled(self.ids(words), n).tolist(), hashes, strict=True):
                lengths.setdefault(n, {}).setdefault(key, set()).add(len(words))
                spelt.setdefault(n, {})[key] = h
        self.keys = {n: np.sort(np.array(list(k), np.uint64)) for n, k in lengths.items()}
        self.sieve = {n: self._sieve(k) for n, k in self.keys.items()}
        self.hash_of = {n: [spelt[n][k] for k in keys.tolist()] for n, keys in self.keys.items()}
        # The lengths of the k-th key stand in values[first[k]:first[k + 1]].
        self.first = {n: np.concatenate([[0], np.cumsum([len(lengths[n][k]) for k in keys.tolist()])]).astype(np.int64) for n, keys in self.keys.items()}
        self.values = {n: np.array([x for k in keys.tolist() for x in sorted(lengths[n][k])], np.int64) for n, keys in self.keys.items()}
        self.known = {h for s in self.shingles for h in s}
        self.weights: dict[int, float] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; zero stands for every word that no item has."""
        get = self.word_ids.get
        return np.fromiter((get(w, 0) for w in words), np.uint64, len(words))

    @staticmethod
    def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n word ids."""
        with np.errstate(over="ignore"):
            total = np.zeros(max(0, len(ids) - n + 1), np.uint64)
            for j in range(n):
                total = (total ^ ids[j : j + len(total)]) * _MULTIPLIER
                total ^= total >> np.uint64(29)
        return total

    @staticmethod
    def _sieve(keys: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        table[(keys >> np.uint64(44)).astype(np.int64)] = True
        return table

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, places, keys): where shingles of items stand in a text, and which."""
        for n, keys in self.keys.items():
            rolled = self._rolled(ids, n)
            maybe = np.flatnonzero(self.sieve[n][(rolled >> np.uint64(44)).astype(np.int64)] & (ids[: len(rolled)] > 0))
            if len(maybe):
                found = rolled[maybe]
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                same = keys[at] == found
                if same.any():
                    yield n, maybe[same], at[same]

    def weigh(self, weights: dict[int, float]) -> None:
        """Set the shingles' weights, and with them the items' fingerprints and blocks."""
        self.weights = weights
        self.key_weight = {n: np.array([weights.get(h, 1.0) for h in hashes]) for n, hashes in self.hash_of.items()}
        totals = [sum(weights.get(h, 1.0) * c for h, c in s.items()) for s in self.shingles]
        self.lightest: dict[int, float] = {}
        for n, total in zip(self.length.tolist(), totals, strict=True):
            self.lightest[n] = min(total, self.lightest.get(n, total))
        self.prints = np.array([self.fingerprint(s) for s in self.shingles], np.uint64)
        size, flips = BITS // BLOCKS, self.radius // BLOCKS
        self.flipped = np.array([sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(size), k)], np.int64)
        self.order, self.begin = [], []
        for block in range(BLOCKS):
            own = self._block(self.prints, block)
            self.order.append(np.argsort(own, kind="stable"))
            self.begin.append(np.searchsorted(own[self.order[-1]], np.arange((1 << size) + 1)))

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        size = BITS // BLOCKS
        return (prints >> np.uint64(block * size) & np.uint64((1 << size) - 1)).astype(np.int64)

    def fingerprint(self, shingles: Counter[int]) -> int:
        weight = np.array([self.weights.get(h, 1.0) * c for h, c in shingles.items()])
        ones = weight @ bits_of(np.fromiter(shingles, np.uint64, len(shingles)))
        return int(np.packbits(ones > weight.sum() / 2, bitorder="little").view(np.uint64)[0])

    def near(self, value: np.uint64) -> np.ndarray:
        """Items that agree with a fingerprint in a block, but for the bits that may be flipped in it."""
        found = []
        for block in range(BLOCKS):
            probes = int(self._block(np.array([value], np.uint64), block)[0]) ^ self.flipped
            low, high = self.begin[block][probes], self.begin[block][probes + 1]
            n = high - low
            if n.any():
                found.append(self.order[block][np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def candidates(self, length: int, value: np.uint64) -> np.ndarray:
        """Items of that length whose fingerprint is within the radius of ``value``."""
        met = self.near(value)
        met = met[self.length[met] == length]
        return met[np.bitwise_count(self.prints[met] ^ value) <= self.radius]

    def windows(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts): windows that hold as much of items of their length as the similarity asks for."""
        for n, places, keys in self.hits(self.ids(words)):
            first, count = self.first[n][keys], np.diff(self.first[n])[keys]
            length = self.values[n][np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
            place, weight = np.repeat(places, count), np.repeat(self.key_weight[n][keys], count)
            lengths, of = np.unique(length, return_inverse=True)
            held = np.bincount(of, weight)
            for k, size in enumerate(lengths.tolist()):
                least = self.similarity * self.lightest[size] - 1e-9
                if held[k] < least:
                    continue
                line = np.zeros(len(words) - n + 2)
                line[place[of == k] + 1] = weight[of == k]
                total = np.cumsum(line)
                starts = np.arange(max(0, len(words) - size) + 1)
                starts = starts[total[starts + min(size, len(words)) - n + 1] - total[starts] >= least]
                if len(starts):
                    yield size, starts

    def fingerprinted(self, words: list[bytes], size: int, starts: np.ndarray) -> Iterator[tuple[int, np.uint64, list[int]]]:
        """(start, fingerprint, shingles) of windows, rolled along runs of them that lie close together."""
        n = self.width[size]
        span = min(size, len(words)) - n + 1
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
            for own in np.split(run, range(RUN, len(run), RUN)):
                low = int(own[0])
                hashes = [shingle_hash(words[p : p + n]) for p in range(low, int(own[-1]) + span)]
                weight = np.array([self.weights.get(h, 1.0) for h in hashes])
                sums = np.zeros((len(hashes) + 1, BITS + 1))
                np.cumsum(np.column_stack([bits_of(np.array(hashes, np.uint64)) * weight[:, None], weight]), axis=0, out=sums[1:])
                inside = sums[own - low + span] - sums[own - low]
                prints = np.packbits(inside[:, :BITS] > inside[:, BITS:] / 2, axis=1, bitorder="little").view(np.uint64).ravel()
                for start, value in zip(own.tolist(), prints, strict=True):
                    yield start, value, hashes[start - low : start - low + span]

    def matches(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """{item: (similarity, -start, length)}: the best window for each item, the first of equal ones."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for size, starts in self.windows(words):
            for start, value, hashes in self.fingerprinted(words, size, starts):
                found = self.candidates(size, value).tolist()
                bag = Counter(hashes) if found else None
                for item in found:
                    like = self.likeness(self.shingles[item], bag)
                    if like >= self.similarity:
                        best[item] = max(best.get(item, (0.0, 0, 0)), (like, -start, size))
        return best

    def likeness(self, a: Counter[int], b: Counter[int]) -> float:
        """Exact weighted similarity of two bags of shingles."""
        get = self.weights.get
        both = sum(get(h, 1.0) * min(c, b[h]) for h, c in a.items() if h in b)
        either = sum(get(h, 1.0) * max(a[h], b[h]) for h in a.keys() | b.keys())
        return both / either if either else 0.0


def _documents_with(index, source: DataFrame) -> DataFrame:
    """(shingle, n): documents with each of the items' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, seen = index.value, 0, Counter()
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0):
                words = words_of(text.as_py())
                seen.update({shingle_hash(words[p : p + n]) for n, places, _ in own.hits(own.ids(words)) for p in places.tolist()} & own.known)
        hashes = np.array([0, *seen], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([total, *seen.values()], pa.int64())], ["shingle", "n"])

    return source.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def _matches(index, source: DataFrame, item_type: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            rows = [(k, own.items[i][0], like, -start, size) for k, text in enumerate(batch.column(1)) for i, (like, start, size) in sorted(own.matches(text.as_py()).items())]
            take = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(0).take(take)] + [pa.array([r[j] for r in rows], t) for j, t in ((1, item_type), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "item_id", "similarity", "start_word", "n_words"])

    key = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {key}, item_id {_ddl(item_type)}, similarity double, start_word bigint, n_words bigint")


def _ddl(t: pa.DataType) -> str:
    return {pa.int64(): "bigint", pa.int32(): "int"}.get(t, "string")


def _found(source: DataFrame, items: DataFrame, shingle: int, similarity: float, item_block: int) -> DataFrame:
    """(key, item_id, similarity, start_word, n_words) of rows (key, text) and items (item_id, text)."""
    spark = source.sparkSession
    ship_package(spark)
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(items.schema["item_id"].dataType.simpleString(), pa.string())
    items = items.select(F.col("item_id").cast(_ddl(kind)).alias("item_id"), "text").where(F.col("text").isNotNull())
    blocks = max(1, math.ceil(items.count() / item_block))
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = ItemIndex([(r["item_id"], r["text"]) for r in rows], shingle, similarity)
        counted = {r["shingle"]: r["n"] for r in _documents_with(spark.sparkContext.broadcast(index), source).collect()}
        total = counted.pop(0, 0)
        index.weigh({h % (1 << 64): weight_of(total, n) for h, n in counted.items()})
        part = materialize(_matches(spark.sparkContext.broadcast(index), source, kind), "leaks")
        found = part if found is None else found.unionByName(part)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each document for each item that it leaks."""
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    return _found(rows, items, shingle, similarity, item_block).withColumnRenamed("key", "doc_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``docs`` without the documents that leak an item. Rows are told apart by id and text, so null and repeated ids pull no other row along."""
    key = F.struct(F.col(id_col).alias("gone_id"), text_digest(F.col(text_col)).alias("gone_digest"))
    rows = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    gone = materialize(_found(rows, items, shingle, similarity, item_block).select("key.*").distinct(), "leaks-gone")
    return unpacked(without(packed(docs, id_col, text_col), gone))
