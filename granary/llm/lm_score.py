"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model of all n-grams of the training documents, without a cut: it grows with the corpus. With ``c`` for counts,

    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))        p(w | h) = (c(h w) + PRIOR p(w | h')) / (c(h) + PRIOR)

where ``h'`` is the history without its first word; over the known words and one class of all unknown ones it adds up to one. The
n-grams form a weighted automaton: a state for each history, an arc for each n-gram, and a failure arc, which weighs
PRIOR / (c(h) + PRIOR), to the state of ``h'``. Scoring is one left-to-right traversal that carries the state.

No task holds the model. The texts are written once as chunks of token ids. Each chunk sends the hashes of its different n-grams, sorted and as
differences, to the tasks that count a range of hashes; these answer with the counts that differ from the chunk's own, by position. With them each
chunk builds the part of the automaton that its own texts can reach, and traverses it. So what a task holds is bounded by the size of a chunk or of a range, and
as each chunk sends an n-gram once, no n-gram is hot.

A chunk cuts its n-grams into at most ``FAN`` ranges. Where more are needed they are divided in rounds: teams of chunks first add up their n-grams of a wide range, and
send the sums on to the narrower ones within it; answers come back the same way. So the rows sent are a constant number for each chunk and round.

Words are told apart by 64 bits of hash. The hashes of bigrams and trigrams have ``SPARE_BITS`` bits more than it takes to number the tokens, so that at any size
an n-gram shares its hash with another in fewer than one of a million cases.

Edge cases: a null or empty text is one end token. Null ids count as the empty text for the fold. Repeated
rows are scored and counted each. With no training document every probability is one. An empty table gives an empty result. Other columns are
ignored. A text that is longer than a chunk is a chunk of its own, held whole by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fold, materialize, ship_package

#: Weight of the shorter history's distribution, in occurrences: the best of eight from 4 to 400, each fold of the training documents of sf0.01 scored by a model of the others.
PRIOR = 100.0
#: Tokens from which a chunk is closed, and tokens for each range of hashes.
CHUNK_TOKENS, RANGE_TOKENS = 1_500_000, 4_000_000
#: Ranges into which a range of hashes is divided at most, so that a chunk or team sends and reads no more rows.
FAN = 128
#: Bits of an n-gram's hash beyond those that number the tokens.
SPARE_BITS = 20
#: Tokens that a lane of the traversal goes through; longer texts take several lanes.
LANE = 512
#: Bytes of text that are hashed at a time, at least.
BLOCK = 1 << 20

_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2 ** 64
_UNBASE = pow(_BASE, -1, 1 << 64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 2 * BLOCK), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps)
    return known[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of ``h``."""
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(32))


#: Hashes of the end and the start of a text.
END, START = _mixed(np.array([1, 2], np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of ``data``, by differences of one polynomial hash of all bytes."""
    hashes, firsts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        space = _WHITE.search(data, min(at + BLOCK, len(data)))
        until = space.start() if space else len(data)
        block = np.frombuffer(data, np.uint8, until - at, at)
        inside = np.zeros(len(block) + 2, np.int8)
        inside[1:-1] = (block != 32) & ((block < 9) | (block > 13))
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(block)), out=sums[1:])
        own = (sums[last] - sums[first]) * _power(_UNBASE, len(block) + 1)[first]
        hashes.append(_mixed(own + (last - first).astype(np.uint64)))
        firsts.append(first + at)
        at = until + 1
    return np.concatenate(hashes), np.concatenate(firsts)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, the lowest first, as many as the largest needs."""
    values = values.astype(np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    width, values = data[0], np.zeros((n, 8), np.uint8)
    if width:
        planes = pa.Codec("zstd", 1).decompress(data[1:], n * width, asbytes=True)
        values[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return values.view(np.uint64).reshape(-1)


def encoded_chunks(source: DataFrame, id_type: str, chunk_tokens: int) -> DataFrame:
    """One row for each chunk of texts: ids and folds of its documents, their numbers of words, hashes of its different words, the words as places among these."""
    names = ["chunk", "doc_ids", "held", "lengths", "hashes", "words", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        held: list[pa.Array] = []
        found: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        tokens = 0

        def out() -> pa.RecordBatch:
            hashes, place, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # frequent words have small numbers, which compress well
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            row = [chunk, pa.concat_arrays(ids), pa.concat_arrays(held), np.concatenate(lengths), hashes[order].tobytes(), pack(rank[place.reshape(-1)]), tokens]
            types = [pa.int64(), pa.list_(ids[0].type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) if pa.types.is_list(t) else pa.array([v], t) for v, t in zip(row, types, strict=True)]
            return pa.RecordBatch.from_arrays(lists, names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, first = [], 0, at
                while at < batch.num_rows and size < BLOCK:
                    texts.append(batch.column(1)[at].as_py().encode().lower())
                    size += len(texts[-1]) + 1
                    at += 1
                begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
                hashes, places = word_hashes(b"\n".join(texts))
                found.append(hashes)
                lengths.append(np.bincount(np.searchsorted(begins, places, "right") - 1, minlength=len(texts)))
                ids.append(batch.column(0).slice(first, at - first))
                held.append(batch.column(2).slice(first, at - first))
                tokens += len(hashes) + len(texts)
                if tokens >= chunk_tokens:
                    yield out()
                    chunk, tokens = chunk + 1, 0
                    for part in (ids, held, found, lengths):
                        part.clear()
        if tokens:
            yield out()

    schema = f"chunk bigint, doc_ids array<{id_type}>, held array<boolean>, lengths array<bigint>, hashes binary, words binary, n_tokens bigint"
    return materialize(source.mapInArrow(run, schema), "lm-chunks")


class Chunk:
    """The texts of a chunk with start and end, and for n from 1 to 3 the different n-grams: ``keys``, ``hashes`` and ``counts`` in its training texts.

    Words are numbers below ``size``, the last two are the end and the start. A bigram's key is first * size + second, a trigram's the place of its first two among the bigrams * size + third.
    """

    def __init__(self, row: dict, bits: int):
        words = np.frombuffer(row["hashes"], np.uint64)
        self.size = size = len(words) + 2
        self.end, self.start = size - 2, size - 1
        lengths = np.array(row["lengths"], np.int64)
        self.held = np.array(row["held"], bool)
        self.last = np.cumsum(lengths + 2) - 1  # where each text's end is
        self.first = self.last - lengths - 1
        self.tokens = np.full(len(self.held) * 2 + int(lengths.sum()), -1, np.int64)
        self.tokens[self.first], self.tokens[self.last] = self.start, self.end
        self.tokens[self.tokens < 0] = unpack(row["words"], int(lengths.sum())).astype(np.int64)

        learnt = np.repeat(~self.held, lengths + 2)
        second = self.tokens != self.start
        pair = np.flatnonzero(second)
        triple = pair[second[pair - 1]]
        two, at = np.unique(self.tokens[pair - 1] * size + self.tokens[pair], return_inverse=True)
        place = np.zeros(len(self.tokens), np.int64)
        place[pair] = at
        three, at3 = np.unique(place[triple - 1] * size + self.tokens[triple], return_inverse=True)
        count = lambda at, keep, n: np.bincount(at[keep], minlength=n)
        self.keys = {1: np.arange(size), 2: two, 3: three}
        self.counts = {1: count(self.tokens, learnt, size), 2: count(at, learnt[pair], len(two)), 3: count(at3, learnt[triple], len(three))}

        own = np.concatenate([words, [END, START]])
        shift = np.uint64(64 - bits)
        pairs = _mixed(own[two // size] * _ODD + own[two % size])
        self.hashes = {1: own, 2: pairs >> shift, 3: _mixed(pairs[three // size] * _ODD + own[three % size]) >> shift}

    def ranges(self, n: int, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the n-grams by hash, and where in it each range begins, with the end."""
        order = np.argsort(self.hashes[n], kind="stable")
        width = 64 if n == 1 else bits
        bounds = np.array([(i << width) // parts for i in range(1, parts)], np.uint64)
        return order, np.concatenate([[0], np.searchsorted(self.hashes[n][order], bounds), [len(order)]])


#: Rows in which n-grams travel: of ``n`` words, within the range ``part`` of hashes, of the chunk or team ``unit``; ``size`` different ones.
SENT = "n int, part int, unit bigint, size bigint, keys binary, counts binary"
#: Answers to them: which counts differ, and those; on one row of each range the numbers of its n-grams and of their occurrences.
ANSWER = "n int, part int, unit bigint, changed binary, counts binary, types bigint, tokens bigint"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["n", "part", "unit", "size", "keys", "counts"])


def _cut(n: int, first: int, unit: int, hashes: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> list[tuple]:
    """Sorted hashes and their counts as rows, one for each range that isn't empty, numbered from ``first``."""
    spans = enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), first)
    return [(n, p, unit, b - a, pack(np.diff(hashes[a:b], prepend=np.uint64(0))), pack(counts[a:b])) for p, (a, b) in spans if b > a]


def sent_grams(chunks: DataFrame, bits: int, parts: int) -> DataFrame:
    """(n, part, unit, size, keys, counts): each chunk's n-grams within each range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, bits)
                for n in (1, 2, 3):
                    order, cuts = chunk.ranges(n, bits, parts)
                    rows = _cut(n, 0, row["chunk"], chunk.hashes[n][order], chunk.counts[n][order], cuts)
                    if rows:  # texts of one word have no trigram
                        yield _sent(rows)

    return chunks.mapInArrow(run, SENT)


class Pool:
    """The n-grams that several units have in one range: their keys and counts one after the other, and the sum of each different one's counts."""

    def __init__(self, sent: pa.Table):
        self.n, self.part, self.units = sent["n"][0].as_py(), sent["part"][0].as_py(), sent["unit"].to_pylist()
        self.sizes = sent["size"].to_pylist()
        self.keys = np.concatenate([np.cumsum(unpack(k, s), dtype=np.uint64) for k, s in zip(sent["keys"].to_pylist(), self.sizes, strict=True)])
        self.counts = np.concatenate([unpack(c, s) for c, s in zip(sent["counts"].to_pylist(), self.sizes, strict=True)]).astype(np.int64)
        self.order = np.argsort(self.keys, kind="stable")
        self.begins = np.flatnonzero(np.diff(self.keys[self.order], prepend=~self.keys[self.order[:1]]))
        self.sums = np.add.reduceat(self.counts[self.order], self.begins)

    def narrower(self, bits: int, parts: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
        """The different keys, and where in them each of the ``fan`` ranges begins into which this one of ``parts`` is divided, with the end."""
        own, width = self.keys[self.order[self.begins]], 64 if self.n == 1 else bits
        bounds = np.array([((self.part * fan + i) << width) // (parts * fan) for i in range(1, fan)], np.uint64)
        return own, np.concatenate([[0], np.searchsorted(own, bounds), [len(own)]])

    def answers(self, sums: np.ndarray, types: int, tokens: int) -> pa.Table:
        """To each unit: which of its counts differ from ``sums``, and those sums."""
        totals = np.empty_like(self.counts)
        totals[self.order] = np.repeat(sums, np.diff(self.begins, append=len(self.order)))
        changed, ends = totals != self.counts, np.cumsum(self.sizes)
        spans = list(zip((ends - self.sizes).tolist(), ends.tolist(), strict=True))
        rest = [0] * (len(spans) - 1)
        return pa.table({
            "n": pa.array([self.n] * len(spans), pa.int32()), "part": pa.array([self.part] * len(spans), pa.int32()), "unit": pa.array(self.units, pa.int64()),
            "changed": pa.array([np.packbits(changed[a:b]).tobytes() for a, b in spans], pa.binary()), "counts": pa.array([pack(totals[a:b][changed[a:b]]) for a, b in spans], pa.binary()),
            "types": pa.array([types, *rest], pa.int64()), "tokens": pa.array([tokens, *rest], pa.int64()),
        })


def _corrected(counts: np.ndarray, answer: dict) -> np.ndarray:
    """Counts that were sent, with those in their place that the answer has."""
    changed = np.unpackbits(np.frombuffer(answer["changed"], np.uint8), count=len(counts)).astype(bool)
    counts = counts.copy()
    counts[changed] = unpack(answer["counts"], int(changed.sum())).astype(np.int64)
    return counts


def _answer(sent: pa.Table) -> pa.Table:
    """Answers of a range that isn't divided any more: the sums over all units."""
    pool = Pool(sent)
    return pool.answers(pool.sums, int((pool.sums > 0).sum()), int(pool.sums.sum()))


def rounds_of(parts: int, most: int) -> tuple[int, int]:
    """(rounds, fan): the fewest rounds in which ranges are divided by at most ``most``, and by how many so that there are ``parts`` of them or more."""
    rounds = 1
    while most**rounds < parts:
        rounds += 1
    fan = 1
    while fan**rounds < parts:
        fan += 1
    return rounds, fan


def pooled(sent: DataFrame, bits: int, parts: int, fan: int) -> DataFrame:
    """The rows ``sent`` (with ``team``) of each range and team as one set of n-grams, cut into the ``fan`` ranges within; their unit is the team."""

    def run(table: pa.Table) -> pa.Table:
        pool = Pool(table)
        own, cuts = pool.narrower(bits, parts, fan)
        return pa.Table.from_batches([_sent(_cut(pool.n, pool.part * fan, table["team"][0].as_py(), own, pool.sums, cuts))])

    return sent.groupBy("n", "part", "team").applyInArrow(run, SENT)


def counted(sent: DataFrame, units: int, bits: int, parts: int, fan: int, rounds: int) -> DataFrame:
    """Answers to all rows ``sent`` of ``units`` chunks or teams in ``parts`` ranges, after ``rounds`` - 1 more divisions of the ranges.

    In each round some ``fan`` units form a team. One task adds up a team's n-grams of one range, as many as one chunk has, and sends these on to the
    ranges within it, of which it gets ``fan`` answers back. So each round has ``fan`` rows for each chunk, and the rounds grow with the logarithm of the corpus.
    """
    if rounds == 1:
        return sent.groupBy("n", "part").applyInArrow(_answer, ANSWER)
    teams = -(-units // fan) or 1
    sent = materialize(sent.withColumn("team", F.pmod(F.xxhash64("unit", F.lit(rounds)), F.lit(teams))), "lm-sent")
    below = counted(pooled(sent, bits, parts, fan), teams, bits, parts * fan, fan, rounds - 1)
    below = below.withColumn("within", F.expr(f"cast(part div {fan} as int)"))

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        pool = Pool(table)
        cuts, sums = pool.narrower(bits, parts, fan)[1], pool.sums.copy()
        for answer in answers.to_pylist():
            i = answer["part"] - pool.part * fan
            sums[cuts[i] : cuts[i + 1]] = _corrected(sums[cuts[i] : cuts[i + 1]], answer)
        return pool.answers(sums, sum(answers["types"].to_pylist()), sum(answers["tokens"].to_pylist()))

    return sent.groupBy("n", "part", "team").cogroup(below.groupBy("n", "within", "unit")).applyInArrow(run, ANSWER)


class BackoffAutomaton:
    """States, arcs and failure arcs of the n-grams of a chunk, with the counts of the whole corpus.

    State 0 is the root, 1 + w that of a word, 1 + size + i that of the i-th bigram; those that no training text has are not entered.
    """

    def __init__(self, chunk: Chunk, unigrams: np.ndarray, prior: float = PRIOR):
        """unigrams: probability of each word; chunk: with its counts made those of the corpus, the start's being the number of texts."""
        size, one, two, three = chunk.size, *(chunk.counts[n].astype(np.float64) for n in (1, 2, 3))
        pairs, triples = chunk.keys[2], chunk.keys[3]
        p2 = (two + prior * unigrams[pairs % size]) / (one[pairs // size] + prior)
        have2, have3 = np.flatnonzero(two), np.flatnonzero(three)
        history, word = triples[have3] // size, triples[have3] % size
        shorter = np.searchsorted(pairs, pairs[history] % size * size + word)
        p3 = (three[have3] + prior * p2[shorter]) / (two[history] + prior)
        self.size, self.unigrams = size, np.log10(unigrams)
        self.arcs = np.concatenate([pairs[have2] + size, triples[have3] + (1 + size) * size, [np.iinfo(np.int64).max]])  # state * size + word, sorted; the last one is never met
        self.weight = np.log10(np.concatenate([p2[have2], p3, [1.0]]))
        self.target = np.concatenate([1 + size + have2, 1 + size + shorter, [0]])
        self.fail = np.concatenate([np.zeros(1 + size, np.int64), 1 + pairs % size])
        self.backoff = np.log10(prior / (np.concatenate([[0.0], one, two]) + prior))
        self.word_state = np.where(one > 0, 1 + np.arange(size), 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that words lead to from states, and the log10 probabilities on the way."""
        after, gained = np.empty_like(state), np.zeros(len(state))
        at, now = np.arange(len(state)), state
        while len(at):
            root = now == 0
            out = at[root]
            gained[out] += self.unigrams[word[out]]
            after[out] = self.word_state[word[out]]
            at, now = at[~root], now[~root]
            key = now * self.size + word[at]
            arc = np.searchsorted(self.arcs, key)
            hit = self.arcs[arc] == key
            gained[at[hit]] += self.weight[arc[hit]]
            after[at[hit]] = self.target[arc[hit]]
            at, now = at[~hit], now[~hit]
            gained[at] += self.backoff[now]
            now = self.fail[now]
        return after, gained

    def scores(self, tokens: np.ndarray, first: np.ndarray, last: np.ndarray, lane: int = LANE) -> np.ndarray:
        """One left-to-right traversal of each text, from the token after its start (``first``) to its end (``last``), many texts side by side.

        A long text takes several lanes. All but its first go over the two tokens before them without counting these, which brings the automaton to the same state.
        """
        lanes = -(-(last - first) // lane)
        text = np.repeat(np.arange(len(first)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = first[text] + 1 + nth * lane
        warm = np.where(nth > 0, 2, 0)
        length = np.minimum(last[text] + 1 - begin, lane) + warm
        begin = begin - warm
        order = np.argsort(-length, kind="stable")
        begin, warm, length = begin[order], warm[order], length[order]
        state = np.where(warm == 0, self.word_state[-1], 0)
        total = np.zeros(len(order))
        running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")  # lanes longer than t
        for t, n in enumerate(running.tolist()):
            state[:n], gained = self.step(state[:n], tokens[begin[:n] + t])
            total[:n] += np.where(warm[:n] <= t, gained, 0.0)
        return np.bincount(text[order], weights=total, minlength=len(first))


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, prior: float = PRIOR,
    chunk_tokens: int = CHUNK_TOKENS, range_tokens: int = RANGE_TOKENS, most: int = FAN,
) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the sum of log10 of smoothed unigram shares, ``score`` the model's log10 probability of the text with its end.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (fold(F.col(id_col), folds) == held_fold).alias("held_out"))
    id_type = docs.schema[id_col].dataType.simpleString()
    chunks = encoded_chunks(source, id_type, chunk_tokens)
    learnt = F.size(F.filter("held", lambda held: ~held))
    units, offered, texts = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(learnt), F.lit(0))).first()
    bits = min(64, SPARE_BITS + offered.bit_length())
    rounds, parts = rounds_of(-(-offered // range_tokens) or 1, most)

    answers = counted(sent_grams(chunks, bits, parts), units, bits, parts, parts, rounds)
    answers = materialize(answers.withColumnRenamed("unit", "chunk"), "lm-counts")
    types, tokens = answers.where("n = 1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    types, tokens = types - (texts > 0), tokens - texts  # without the start

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = Chunk(row, bits)
        of: dict[int, list[dict]] = {1: [], 2: [], 3: []}
        for answer in right.to_pylist():
            of[answer["n"]].append(answer)
        for n, answered in of.items():
            order, cuts = chunk.ranges(n, bits, parts)
            for answer in answered:
                span = order[cuts[answer["part"]] : cuts[answer["part"] + 1]]
                chunk.counts[n][span] = _corrected(chunk.counts[n][span], answer)
        unigrams = (chunk.counts[1] + 0.5) / (tokens + 0.5 * (types + 1))
        counted = chunk.tokens != chunk.start
        per_text = lambda values: np.add.reduceat(np.where(counted, values[chunk.tokens], 0), chunk.first)
        score = BackoffAutomaton(chunk, unigrams, prior).scores(chunk.tokens, chunk.first, chunk.last)
        return pa.table({
            "doc_id": left["doc_ids"].combine_chunks().flatten(), "held_out": chunk.held, "n_tokens": chunk.last - chunk.first, "n_known": per_text((chunk.counts[1] > 0).astype(np.int64)),
            "train_tokens": np.full(len(chunk.held), tokens, np.int64), "base_score": per_text(np.log10(unigrams)), "score": score,
        })

    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    own = answers.select("chunk", "n", "part", "changed", "counts")
    return chunks.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, schema)
