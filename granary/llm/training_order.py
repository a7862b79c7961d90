"""Training-order materialisation: token sequences at keyed pseudo-random places in fixed-stride shards.

Texts are encoded and joined, each followed by the end-of-document id, and cut into sequences of ``STRIDE`` ids; only
the last sequence of an input partition is filled up with end ids. With N sequences in all, a keyed Feistel permutation of the
numbers below the next power of four, walked along its cycle until it falls below N, gives each sequence's number its global
slot. Slot s stands in shard s // ``SHARD_SEQUENCES``, at byte (s % ``SHARD_SEQUENCES``) * stride. So each shard is one range of slots. Sequences are
partitioned by ranges of shards, and a task writes its shards one after another. A manifest, written last, holds N, stride, key, id width and
vocabulary: with the folder alone a reader can start at any slot and read on sequentially.

Each text is encoded once. Sequences travel in compressed runs, grouped by shard before they shuffle. No permutation table exists
anywhere; a slot is a few multiplications.

Edge cases: a null or empty text is one end id. An empty table gives no shard. Null ids are kept. Repeated rows are materialised each. Text
that spells the end token is encoded as ordinary text. Ids are as wide as the vocabulary needs; an end id that doesn't fit is an error. Other columns are ignored. A long text is many sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import bpe, corpus_files
from granary.llm.common import materialize, scratch_path, ship_package

#: Ids in a sequence, sequences in a shard (32 MB), and sequences in a compressed run.
STRIDE, SHARD_SEQUENCES, RUN_SEQUENCES = 1024, 1 << 14, 1024
#: Level of the runs' compression: 7 makes them 3 % smaller and takes half as long again.
LEVEL = 5
#: Partitions that shards are written from at most.
PARTITIONS = 10_000
MANIFEST = "manifest.json"
END = 50256
KEY = 0x5EED_2026
ROUNDS = 6
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Permutation:
    """A keyed permutation of the numbers below ``n``."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            self.keys = [self._mix(np.array([key + i], np.uint64) * _M1)[0] for i in range(1, ROUNDS + 1)]

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * _M2
        return x ^ (x >> np.uint64(27))

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        with np.errstate(over="ignore"):
            for key in keys:
                left, right = right, left ^ (self._mix((right ^ key) * _M1) >> np.uint64(16) & mask)
        return right << half | left  # halves swapped, so that the reversed keys undo it

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys)
        while (out := np.flatnonzero(x >= self.n)).size:
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """Slots of sequence numbers."""
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """Sequence numbers of slots."""
        return self._walk(slots, self.keys[::-1])


def encoded_runs(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, stride: int, end: int) -> DataFrame:
    """(part, first, n, used, owners, run): compressed runs of sequences; ``first`` counts within the partition.

    ``used`` is the number of ids in the run's last sequence, ``owners`` the ids of the documents that own the sequences' first tokens.
    """
    id_type = docs.schema[id_col].dataType
    id_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type.simpleString(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = bpe.quick_codec(vocabulary), zstandard.ZstdCompressor(level=LEVEL)
        part, first, room = TaskContext.get().partitionId(), 0, stride * RUN_SEQUENCES
        closing = np.array([end], own.dtype)
        held: list[np.ndarray] = []
        bounds: list[int] = []  # where documents begin among the held ids
        owners: list = []
        size = 0

        def emit(count: int) -> pa.RecordBatch:
            """A run of the first ``count`` held ids."""
            nonlocal held, bounds, owners, size, first
            flat = np.concatenate(held)
            sequences = -(-count // stride)
            filled = np.full(sequences * stride, end, own.dtype)
            filled[:count] = flat[:count]
            at = np.searchsorted(np.array(bounds), np.arange(sequences) * stride, side="right") - 1
            record = [[part], [first], [sequences], [count - (sequences - 1) * stride], [[owners[i] for i in at]], [press.compress(filled.tobytes())]]
            last = int(np.searchsorted(np.array(bounds), count, side="right")) - 1
            held, size, first = [flat[count:]], size - count, first + sequences
            bounds, owners = [max(0, b - count) for b in bounds[last:]], owners[last:]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(record, [pa.int64()] * 4 + [pa.list_(id_arrow), pa.binary()], strict=True)], names)

        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.encode(text.as_py(), specials=False)
                bounds.append(size)
                owners.append(owner)
                held += [ids, closing]
                size += len(ids) + 1
                while size >= room:
                    yield emit(room)
        if size:
            yield emit(size)

    names = ["part", "first", "n", "used", "owners", "run"]
    source = docs.select(F.col(id_col).cast(id_type if id_arrow != pa.string() else "string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = {pa.int64(): "bigint", pa.int32(): "int"}.get(id_arrow, "string")
    return source.mapInArrow(run, f"part bigint, first bigint, n bigint, used bigint, owners array<{kind}>, run binary")


def materialise_order(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", key: int = KEY, stride: int = STRIDE, shard_sequences: int = SHARD_SEQUENCES, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write the shards and the manifest into ``folder``; returns (slot, shard, byte_offset, n_tokens, first_doc_id, ids_crc32) of every sequence."""
    spark = docs.sparkSession
    ship_package(spark)
    path = vocabulary or bpe.default_vocabulary()
    corpus_files.make_folder(folder)
    dtype = bpe.id_type(path)
    if end > np.iinfo(dtype).max:
        raise ValueError(f"the end id {end} doesn't fit the vocabulary's ids")
    runs = materialize(encoded_runs(docs, id_col, text_col, path, stride, end), "order-runs")
    kind = runs.schema["owners"].dataType.elementType.simpleString()
    owner_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    # One row for each input partition: where its sequences begin among all.
    parts = sorted((r["part"], r["n"]) for r in runs.groupBy("part").agg(F.sum("n").alias("n")).collect())
    begins = dict(zip([p for p, _ in parts], np.cumsum([0, *(n for _, n in parts)]).tolist(), strict=False))
    total = sum(n for _, n in parts)
    order = Permutation(total, key)
    start = spark.sparkContext.broadcast(begins)
    moved_schema = pa.schema([("shard", pa.int64()), ("places", pa.list_(pa.int64())), ("used", pa.list_(pa.int64())), ("owners", pa.list_(owner_type)), ("run", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                sequences = np.frombuffer(unpress.decompress(row["run"]), dtype).reshape(row["n"], stride)
                slots = order.slots(np.arange(row["n"]) + start.value[row["part"]] + row["first"])
                used = np.full(row["n"], stride)
                used[-1] = row["used"]
                shard, owners = slots // shard_sequences, np.array(row["owners"], object)
                by = np.argsort(shard, kind="stable")
                for group in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
                    record = {"shard": int(shard[group[0]]), "places": slots[group] % shard_sequences, "used": used[group], "owners": owners[group].tolist(), "run": press.compress(sequences[group].tobytes())}
                    yield pa.RecordBatch.from_pylist([record], moved_schema)

    names = ["slot", "shard", "byte_offset", "n_tokens", "first_doc_id", "ids_crc32"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after another, each in several rows; one is held at a time."""
        unpress, shard, filled, used, owners = zstandard.ZstdDecompressor(), None, None, None, None

        def finished() -> pa.RecordBatch:
            corpus_files.write_file(f"{folder}/{shard_name(shard)}", [filled.data])
            rows = len(filled)
            digests = pa.array([zlib.crc32(row.tobytes()) for row in filled], pa.int64())
            columns = [pa.array(np.arange(rows) + shard * shard_sequences), pa.array([shard] * rows, pa.int64()), pa.array(np.arange(rows) * stride * dtype.itemsize), pa.array(used), pa.array(owners.tolist(), owner_type), digests]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for k in range(batch.num_rows):
                number, places, n, own, run = (batch.column(c)[k].as_py() for c in range(5))
                if number != shard:
                    if shard is not None:
                        yield finished()
                    shard, rows = number, min(shard_sequences, total - number * shard_sequences)
                    filled, used, owners = np.full((rows, stride), end, dtype), np.zeros(rows, np.int64), np.empty(rows, object)
                places = np.array(places)
                filled[places] = np.frombuffer(unpress.decompress(run), dtype).reshape(len(places), stride)
                used[places], owners[places] = n, own
        if shard is not None:
            yield finished()

    dealt = runs.mapInArrow(deal, f"shard bigint, places array<bigint>, used array<bigint>, owners array<{kind}>, run binary")
    shards = -(-total // shard_sequences)
    parts = max(1, min(shards, PARTITIONS))
    ranged = dealt.repartitionById(parts, F.expr(f"cast(shard * {parts} div {max(1, shards)} as int)")).sortWithinPartitions("shard")
    written = ranged.mapInArrow(write, f"slot bigint, shard bigint, byte_offset bigint, n_tokens bigint, first_doc_id {kind}, ids_crc32 bigint")
    index = materialize(written, "order-index")
    facts = {"sequences": total, "stride": stride, "shard_sequences": shard_sequences, "dtype": dtype.str, "key": key, "end": end, "vocabulary": path}
    corpus_files.write_file(f"{folder}/{MANIFEST}", [json.dumps(facts).encode()])
    return index


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_manifest(folder: str) -> dict:
    """What a reader must know: sequences, stride, shard_sequences, dtype, key, end, vocabulary."""
    return json.loads(corpus_files.read_file(f"{folder}/{MANIFEST}"))


def read_sequences(folder: str, slot: int = 0, at_a_time: int = 256) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, in training order; reads forward through the shards."""
    facts = read_manifest(folder)
    dtype, stride, per_shard = np.dtype(facts["dtype"]), facts["stride"], facts["shard_sequences"]
    width = stride * dtype.itemsize
    while slot < facts["sequences"]:
        shard, place = divmod(slot, per_shard)
        count = min(at_a_time, per_shard - place, facts["sequences"] - slot)
        raw = corpus_files.read_range(f"{folder}/{shard_name(shard)}", place * width, count * width)
        yield from np.frombuffer(raw, dtype).reshape(count, stride)
        slot += count


def training_order(docs: DataFrame, **options) -> DataFrame:
    """Materialise ``docs`` in a new folder of the shared folder; returns the index of the sequences."""
    return materialise_order(docs, scratch_path(docs.sparkSession, "training-order"), **options)
