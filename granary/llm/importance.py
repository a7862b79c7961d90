"""Quality selection by importance resampling over hashed n-grams.

Two generative models of hashed n-grams (words, their shapes, and pairs of either) are learnt, each a smoothed distribution over ``BUCKETS`` buckets:
one of the target texts (labelled good and not toxic), one of the raw texts (all documents). A document's log importance
weight is the sum over its n-grams of log target probability less log raw probability, less a constant for each n-gram (and ``PRIOR`` more), so that
zero divides good from bad texts at any length. Adding independent Gumbel noise (times ``TEMPERATURE``) to
the log weights and taking the k largest draws k documents without replacement, at a temperature of one in proportion to their weights.
Weights are products over hundreds of n-grams, so most documents are far from even chances; those near zero are drawn by lot.

The constant is the mean weight that best tells good from bad labels in a half of the labelled sample that the target model has not seen, and
``k``, where it is not given, the number of documents whose log weight is zero or more. The noise is drawn from a hash of id and text, so a run can be repeated. The k-th
largest key is found by counting keys in ever finer ranges, never by sorting all documents in one task.

Toxic documents are not drawn from. They may be good by all other n-grams, so they have a ratio of models of their own, of words in documents labelled toxic
against all documents, which length doesn't dilute: a document's toxicity is the sum of its ``WORST`` largest log ratios. It is rejected from the cut on
that best tells toxic labels from others, again in the half that the model has not seen; clean documents that are lost weigh ``CLEAN`` times as much as toxic ones missed.

Only the target models and the cuts are fitted on a bounded sample, ``LABELLED_ROWS`` labelled documents at most; the raw models count
all documents.

Edge cases: null and empty texts have no n-grams, weight zero before the constant and no toxicity. Without target documents, every weight is zero and all are
kept; without labels of both kinds the constant is zero, and without toxic ones nothing is rejected as toxic. Rows with equal ids
and texts share their decision, so a tie at the last place draws all of them. Of a document's several labels the best quality counts, and any toxic one. Other columns pass through, whatever their names. Empty
tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.select import kth_largest
from granary.llm.common import materialize, packed, ship_package, text_digest, unpacked, without

#: A power of two.
BUCKETS = 1 << 14
#: Labelled documents that are used at most, chosen by a hash of their ids.
LABELLED_ROWS = 20_000
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.01
PRIOR = 20
TEMPERATURE = 1.0
#: Of the toxicity: largest ratios that are summed up, weight of clean documents, and added to shares of documents with a word.
WORST, CLEAN, SHARE = 2, 5.0, 0.005
#: A word of the toxic model is in at least this share of the toxic sample, and in so many of its documents.
TOXIC_SHARE, TOXIC_DOCS = 0.02, 3
SEED = 42
_CACHED = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_cache: dict[bytes, bytes] = {}
_KINDS = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in range(256))
_PUNCTUATION = bytes(32 if 33 <= b < 127 and not chr(b).isalnum() else b for b in range(256))
_run = re.compile(rb"(.)\1+", re.DOTALL).sub


def shape(word: bytes) -> bytes:
    """The kinds of characters in a word, runs taken together: ``Abc!!`` gives ``Aa!``; beyond ASCII all count as small letters."""
    return _run(rb"\1", word.translate(_KINDS))


def _hashes(word: bytes) -> bytes:
    found = xxhash.xxh64_digest(word, SEED) + xxhash.xxh64_digest(shape(word), SEED + 1)
    if len(word) <= 48:
        if len(_cache) >= _CACHED:
            _cache.clear()
        _cache[word] = found
    return found


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's words, word pairs, word shapes, and pairs of shapes with whether the words are the same."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.int64)
    known = _cache.get
    hashes = np.frombuffer(b"".join([known(w) or _hashes(w) for w in words]), ">u8").astype(np.uint64)
    one, form = hashes[::2], hashes[1::2]
    with np.errstate(over="ignore"):
        two = (one[:-1] * _MIX) ^ one[1:]
        forms = (form[:-1] * _MIX) ^ form[1:] ^ (one[:-1] == one[1:]).astype(np.uint64)
        both = np.concatenate([one, two, form, forms])
        both = (both ^ (both >> np.uint64(31))) * _MIX
    return (both >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def plain_words(text: str) -> set[bytes]:
    """The different words of a text in lower case, without ASCII punctuation."""
    return set(text.lower().encode().translate(_PUNCTUATION).split())


def _model_counts(source: DataFrame, buckets: int, watched: frozenset[bytes]) -> DataFrame:
    """(word, bucket, raw, target): n-grams of all documents, and of those that are marked as target; documents with each watched word, and all of them (word '')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        having: Counter[bytes] = Counter()

        def add() -> None:
            for chosen, parts in held.items():
                if parts:
                    counts = np.bincount(np.concatenate(parts), minlength=buckets)
                    raw[:] += counts
                    target[:] += counts * chosen
                    parts.clear()

        for batch in batches:
            size = 0
            having[b""] += batch.num_rows
            for text, chosen in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                found = features(text, buckets)
                if watched:
                    having.update(watched & plain_words(text))
                held[chosen].append(found)
                size += len(found)
                if size > 500_000:
                    add()
                    size = 0
            add()
        seen = np.flatnonzero(raw)
        words = [*having, *[None] * len(seen)]
        zeros = np.zeros(len(having), np.int64)
        columns = [np.concatenate([zeros - 1, seen]), np.concatenate([np.fromiter(having.values(), np.int64, len(having)), raw[seen]]), np.concatenate([zeros, target[seen]])]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *map(pa.array, columns)], ["word", "bucket", "raw", "target"])

    counted = source.mapInArrow(run, "word binary, bucket bigint, raw bigint, target bigint")
    return counted.groupBy("word", "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def toxic_words(texts: DataFrame) -> tuple[dict[bytes, int], int]:
    """Words in enough of the texts labelled toxic, with the number of texts that have them; and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having: Counter[bytes] = Counter()
        for batch in batches:
            having[b""] += batch.num_rows
            for text in batch.column(0):
                having.update(plain_words(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(having), pa.binary()), pa.array(list(having.values()), pa.int64())], ["word", "n"])

    counted = materialize(texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "importance-toxic")
    total = counted.where(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    enough = counted.where((F.length("word") > 0) & (F.col("n") >= max(TOXIC_DOCS, TOXIC_SHARE * total)))  # few, as a text has so many words only
    return {bytes(r["word"]): r["n"] for r in enough.collect()}, total


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log target probability less log raw probability of each bucket."""
    if not target.sum():
        return np.zeros(len(raw))
    p, q = ((c + smoothing * c.mean()) / (c + smoothing * c.mean()).sum() for c in (target.astype(float), raw.astype(float)))
    return np.log(p) - np.log(q)


def best_cut(weights: np.ndarray, good: np.ndarray, bad_weight: float = 1.0) -> float:
    """The cut that maximises the share of good at or above it plus ``bad_weight`` times that of bad below it; midway in the gap."""
    if good.all() or not good.any():
        return 0.0
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # With the cut just below place i: bad before i are out, good from i on are in.
    bad_out = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    good_in = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    valid = np.concatenate([[True], w[1:] > w[:-1], [True]])
    i = int(np.argmax(np.where(valid, bad_weight * bad_out + good_in, -1)))
    return float(w[0] if i == 0 else np.nextafter(w[-1], np.inf) if i == len(w) else (w[i - 1] + w[i]) / 2)


def gumbel_key(log_weight: Column, seed: Column, temperature: float) -> Column:
    """The log weight with Gumbel noise from a hash: the k largest keys are a draw without replacement, by weights to the power 1 / temperature."""
    uniform = (F.shiftrightunsigned(seed, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return log_weight - F.lit(temperature) * F.log(-F.log(uniform))


def importance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS, temperature: float = TEMPERATURE, buckets: int = BUCKETS, seed: int = SEED, k: int | None = None) -> DataFrame:
    """One row for each document: doc_id, log_weight, n_features, toxicity, gumbel_key, selected (and a digest of its text).

    ``labels`` has doc_id, quality and toxic. ``gumbel_key`` is null for documents rejected as toxic. ``k`` documents are drawn, all that aren't toxic if these are fewer.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_digest(F.col(text_col)).alias("digest"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    known = known.orderBy(order, "doc_id").limit(labelled_rows).select(F.col("doc_id").alias("known_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), (F.pmod(order, F.lit(2)) == 0).alias("fit"))
    known = materialize(known, "importance-labels")
    labelled = lambda rows, which: rows.join(F.broadcast(known.where(which)), F.col("doc_id") == F.col("known_id"))
    having, toxic_texts = toxic_words(labelled(source, "fit AND toxic").select("text"))
    target = F.broadcast(known.where("fit AND good AND NOT toxic").select("known_id"))
    marked = source.join(target, F.col("doc_id") == F.col("known_id"), "left").select("text", F.col("known_id").isNotNull().alias("chosen"))
    table = _model_counts(marked, buckets, frozenset(having)).toArrow()
    raw, wanted = np.zeros(buckets), np.zeros(buckets)
    at, count = table.column("bucket").to_numpy(), table.column("raw").to_numpy()
    raw[at[at >= 0]], wanted[at[at >= 0]] = count[at >= 0], table.column("target").to_numpy()[at >= 0]
    documents = {w: n for w, n in zip(table.column("word").to_pylist(), count.tolist(), strict=True) if w is not None}
    total = max(1, documents.get(b"", 0))
    worst = {w: float(np.log((n / toxic_texts + SHARE) / (documents.get(w, 0) / total + SHARE))) for w, n in having.items()}
    worst = {w: r for w, r in worst.items() if r > 0}
    model = spark.sparkContext.broadcast((log_ratio(raw, wanted), worst))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, worst = model.value
        for batch in batches:
            sums, sizes, toxicity = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                found = features(text, buckets)
                sums.append(float(ratio[found].sum()))
                sizes.append(len(found))
                toxicity.append(sum(nlargest(WORST, [worst[w] for w in worst.keys() & plain_words(text)])) if worst else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64()), pa.array(toxicity, pa.float64())], ["doc_id", "digest", "total", "n_features", "toxicity"])

    scored = source.mapInArrow(run, f"doc_id {id_type}, digest binary, total double, n_features bigint, toxicity double")
    scored = materialize(scored.withColumn("mean", F.col("total") / (F.col("n_features") + PRIOR)), "importance")
    unseen = labelled(scored, "NOT fit").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "digest").limit(labelled_rows)  # ids may be repeated
    unseen = unseen.select("mean", "toxicity", "good", "toxic").toArrow()
    mean, toxicity = (unseen.column(c).to_numpy() for c in ("mean", "toxicity"))
    good, toxic = (unseen.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic"))
    cut = best_cut(mean[~toxic], good[~toxic])
    limit = best_cut(toxicity, toxic, CLEAN) if worst and toxic.any() else np.inf

    weighed = scored.withColumn("log_weight", F.col("total") - F.lit(cut) * (F.col("n_features") + PRIOR))
    drawn = gumbel_key(F.col("log_weight"), F.xxhash64(F.col("doc_id"), F.col("digest"), F.lit(seed)), temperature)
    keyed = weighed.withColumn("key", F.when(F.col("toxicity") < F.lit(float(limit)), drawn))
    able = keyed.where("key IS NOT NULL")
    drawn_rows = able.where("log_weight >= 0").count() if k is None else min(k, able.count())
    threshold = kth_largest(keyed, "key", drawn_rows) if drawn_rows else None
    selected = F.lit(False) if threshold is None else F.coalesce(F.col("key") >= F.lit(threshold), F.lit(False))
    return keyed.select("doc_id", "log_weight", "n_features", "toxicity", F.col("key").alias("gumbel_key"), selected.alias("selected"), "digest")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that were not drawn; rows are told apart by id and text."""
    gone = importance(docs, labels, id_col, text_col, **options).where("NOT selected").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    return unpacked(without(packed(docs, id_col, text_col), materialize(gone, "importance-gone")))
