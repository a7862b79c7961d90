"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, here a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most R
bits, then from some segment on the differences summed over the first l segments of the ring stay within
l * R / SEGMENTS, for every l. So candidates share the run of segments whose budget is below one bit (28 of
64 bits, in one of 16 rotations), and must keep each longer chain within its budget before all 64 bits are
compared. Only distinct fingerprints are compared, so copies cost nothing.

No bucket is compared pair by pair. Beyond the run the next chain, 60 of 64 bits, may hold one bit, so each
rotation's chain of 60 bits is indexed once, and looked up by itself and by its neighbours with one zero beyond
the run turned into a one: of two chains a bit apart, one has such a zero. At most 16 fingerprints have one
chain and at most 33 chains meet it, so the work is linear in the fingerprints, however crowded a run is, and
every pair within the radius is met. Runs that one fingerprint alone has are left out first.

Edge cases: a null or empty text, or one of white space, has fingerprint zero, linked like any other; a text
with fewer words than a shingle is one shingle. Rows with repeated ids each get their row; a null id is
never a component's id unless the whole component has none. Empty tables give empty results. Columns other than the id and the
text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import BROADCAST_ROWS, broadcast_small, materialize, packed, ship_package, text_digest, unpacked, with_maybe, without
from granary.llm.components import connected_components

BITS, SEGMENTS, RADIUS = 64, 16, 2
SEED = 42
#: Of near-dedup: rows from which frequent shingles are guessed, frequent shingles at most, tokens by which a node looks for a leader, and
#: members of a block of a shingle's pairs.
SAMPLED, FREQUENT, LED, BLOCK = 4_000, 200_000, 8, 1_000
#: Hashes that are counted at a time, which bounds memory for very long texts.
_BLOCK = 1 << 17


def shingle_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size) + np.arange(len(words))
        starts, ends = (end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]), ">u8")


def fingerprint_of(hashes: np.ndarray) -> bytes:
    """The 64-bit SimHash of shingle hashes, big-endian."""
    ones, raw = np.zeros(BITS, np.int64), hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), _BLOCK):
        ones += np.unpackbits(raw[at : at + _BLOCK], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(raw)).tobytes()


def fingerprint(text: str, shingle: int = 3) -> bytes:
    """The 64-bit SimHash of a text, big-endian."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint): the SimHash as a signed long and as 16 hexadecimal digits."""
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            longs = np.frombuffer(b"".join(raw), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(longs), pa.array([x.hex() for x in raw], pa.string())], ["doc_id", "fp", "fingerprint"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id {id_type}, fp bigint, fingerprint string")


def pigeonring_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b): all pairs of distinct ``fp`` within ``radius`` bits (two at most) of each other, a being the lesser."""
    if radius != 2:
        raise ValueError("the radius is two bits")
    width = BITS // SEGMENTS
    # Per budget, the longest chain that it holds for: run with 0, then chains with 1, 2, ... bits.
    longest = {length * radius // SEGMENTS: length * width for length in range(1, SEGMENTS + 1)}
    run_bits, chain_bits = longest[0], longest[1]
    turned = F.expr(f"shiftleft(fp, i * {width}) | IF(i = 0, 0, shiftrightunsigned(fp, {BITS} - i * {width}))")
    turns = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("i"))
        .select("fp", "i", turned.alias("r"))
        .withColumn("run", F.shiftrightunsigned("r", BITS - run_bits))
    )
    sizes = turns.groupBy("i", "run").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("i", "run")
    shared = materialize(turns.join(sizes, ["i", "run"]), "ring").select("i", "fp", "r", F.shiftrightunsigned("r", BITS - chain_bits).alias("chain"))

    zeros = f"filter(sequence(0, {chain_bits - run_bits - 1}), k -> (chain & shiftleft(1L, k)) = 0)"
    probes = F.expr(f"concat(array(chain), transform({zeros}, k -> chain | shiftleft(1L, k)))")
    asked = shared.select("i", F.col("fp").alias("a"), F.col("r").alias("ra"), F.col("chain").alias("own"), F.explode(probes).alias("chain"))
    index = shared.select("i", F.col("fp").alias("b"), F.col("r").alias("rb"), "chain")
    differ = F.col("ra").bitwiseXOR(F.col("rb"))
    pairs = asked.join(index, ["i", "chain"]).where("own != chain OR a < b")
    for budget, bits in sorted(longest.items()):
        pairs = pairs.where(F.bit_count(F.shiftrightunsigned(differ, BITS - bits)) <= budget)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row for each input row: doc_id, fingerprint, component_id (least id reachable over links)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = materialize(least, "simhash-distinct")
    roots = connected_components(pigeonring_links(least.select("fp")))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reach = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(reach, "root").select(F.col("fp").alias("k"), "component_id")
    return rows.join(found, rows["fp"] == found["k"]).select("doc_id", "fingerprint", "component_id")


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The different shingles of a text as signed longs, ascending; a text without words has one, zero."""
    return np.unique(hashes.astype(np.uint64).view(np.int64)) if len(hashes) else np.zeros(1, np.int64)


def frequent_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of rows have, ascending, and how many do. They set an order only, which any guess serves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(np.concatenate([shingle_set(shingle_hashes(text.as_py(), shingle)) for text in batch.column(0)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    step = max(1, rows.count() // SAMPLED)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("text")
    counted = sample.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 2")
    table = counted.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix_of(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first of a set's shingles, rare ones first: so many that a set as similar as ``similarity`` has one of them among its own first.

    Also how often each of these is in the sample, zero if it isn't known as frequent. The order is the same for all sets.
    """
    keys, counts = frequent
    often = np.zeros(len(own), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        often = np.where(keys[at] == own, counts[at], 0)
    first = np.argsort(often, kind="stable")[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
    return own[first], often[first]


def sketches(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(rid, doc_id, digest, fp, size, rare, last, prefix) of rows (doc_id, text, digest).

    A number for each row, SimHash, number of different shingles, and the shingles by which the complete join meets, the ``rare`` ones first;
    ``last`` is how often the last one is in the sample.
    """
    ship_package(rows.sparkSession)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            prints, sizes, rare, last, prefixes = [], [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), shingle)
                own = shingle_set(hashes)
                first, often = prefix_of(own, frequent.value, similarity)
                prints.append(fingerprint_of(hashes))
                sizes.append(len(own))
                rare.append(int((often == 0).sum()))
                last.append(int(often[-1]))
                prefixes.append(first)
            fp = pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))
            more = [fp, pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), pa.array(last, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            numbers = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0), batch.column(2), *more], ["rid", "doc_id", "digest", "fp", "size", "rare", "last", "prefix"])

    return rows.select("doc_id", "text", "digest").mapInArrow(run, f"rid bigint, doc_id {id_type}, digest binary, fp bigint, size int, rare int, last bigint, prefix array<bigint>")


def shared_tokens(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, size, end, tokens) of nodes (node, size, rare, last, prefix) that share a token of their prefixes with others: these tokens.

    Of two sets that reach the similarity, the smaller has a shared token so early (``lead``) that it has as many left as the two must
    share. Tokens known as frequent are not looked up, so no key is hot. Only two longs travel for a token, as these rows are most of what shuffles.
    """
    key = F.shiftright("token", 16)  # 48 bits: enough to meet by
    lead = F.col("at") < F.col("size") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("size") - 1e-9) + 1
    tokens = nodes.select("node", "size", "rare", F.posexplode("prefix").alias("at", "token"))
    slim = lambda rows: rows.select(key.alias("token"), (F.col("node") * 2 + lead.cast("int")).alias("mark"))
    met = slim(tokens.where("at < rare")).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("members > 1").drop("members")
    marked = met.unionByName(slim(tokens.where("at >= rare"))).select(F.expr("mark div 2").alias("node"), F.struct((F.col("mark") % 2 == 1).alias("lead"), "token").alias("held"))
    held = marked.groupBy("node").agg(F.collect_list("held").alias("tokens"))  # a part of one text's prefix
    facts = nodes.select(F.col("node").alias("k"), "size", F.struct("last", F.element_at("prefix", -1).alias("token")).alias("end"))
    return held.join(facts, F.col("node") == F.col("k")).select("node", "size", "end", "tokens")


def fits(a: str, b: str, similarity: float):
    """Whether two sizes allow the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6


def leader_pairs(held: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each node and, of the leaders of its ``LED`` least tokens, the one that it shares most of them with.

    A token's leader is the node with the largest share of tokens that others have, too: copies have tokens of their own where they
    were edited, and their original has none. So this is linear, and connects most of a group, even where its copies are like the original only.
    """
    support = (F.size("tokens") / F.col("size")).alias("support")
    few = F.slice(F.array_sort("tokens.token"), 1, LED)
    backed = held.select("node", "size", support, F.explode(few).alias("token"))
    rank = F.struct("support", (-F.col("node")).alias("order"), "size")
    leaders = backed.groupBy("token").agg(F.max(rank).alias("leader")).select("token", (-F.col("leader.order")).alias("leader"), F.col("leader.size").alias("leader_size"))
    led = backed.select("token", "node", "size").join(leaders, "token").where(F.col("node") != F.col("leader")).where(fits("size", "leader_size", similarity))
    met = led.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", (-F.col("leader")).alias("order"))).alias("best"))
    return best.select(F.col("node").alias("a"), (-F.col("best.order")).alias("b"))


def remaining_pairs(held: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b, x, y): pairs of nodes under different roots x and y, among them all that reach the similarity.

    A token whose nodes are all under one root is left out before any pair is made; the pairs of the others are made in blocks.
    """
    rooted = held.select("node", "size", "tokens").join(roots.select(F.col("node").alias("k"), "root"), F.col("node") == F.col("k"), "left")
    tokens = rooted.select("node", "size", F.coalesce("root", "node").alias("root"), F.inline("tokens"))
    mixed = tokens.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"), F.count_if("lead").alias("leads"))
    mixed = mixed.where("low < high AND leads > 0").select("token", F.ceil(F.col("members") / BLOCK).alias("across"), F.ceil(F.col("leads") / BLOCK).alias("down"))
    dealt = tokens.join(mixed, "token")
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    named = lambda k, root, size: [F.col("node").alias(k), F.col("root").alias(root), F.col("size").alias(size)]
    one = dealt.where("lead").select("token", number("down").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("across") - 1)).alias("j"), *named("a", "x", "size_a"))
    two = dealt.select("token", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("down") - 1)).alias("i"), number("across").alias("j"), *named("b", "y", "size_b"))
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    met = one.join(two, ["token", "i", "j"]).where("x != y").where(smaller & fits("size_a", "size_b", similarity))
    return met.select("a", "b", "x", "y").distinct()


def hopeful(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that can reach the similarity, with ``n``, the number of tokens that their prefixes share.

    Of the two prefixes one ends first in the common order; beyond its end two sets share no more than what its set has left.
    """
    named = lambda side: [F.col("tokens.token").alias(f"tokens_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "end")]]
    both = pairs.join(held.select(F.col("node").alias("a"), *named("a")), "a").join(held.select(F.col("node").alias("b"), *named("b")), "b")
    counted = both.withColumn("n", F.size(F.array_intersect("tokens_a", "tokens_b")))
    rest = F.ceil(F.lit(similarity) * F.when(F.col("end_a") < F.col("end_b"), F.col("size_a")).otherwise(F.col("size_b")) - 1e-9) - 1
    enough = F.col("n") + rest >= F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-6
    return counted.where(enough & fits("size_a", "size_b", similarity)).select(*pairs.columns, "n")


def alike(source: DataFrame, copies: DataFrame, candidates: DataFrame, shingle: int, similarity: float, repeated: bool) -> DataFrame:
    """The candidates (a, b) whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Texts come from ``source`` (doc_id, text, digest) by the least id of each node's copies; with ``repeated`` several rows may agree in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(shingle_hashes(text.as_py(), shingle)).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    asked = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = materialize(copies.join(asked, "node").select("node", F.col("digest").alias("k"), F.col("least.doc_id").alias("k_id")), "near-asked")
    n = asked.count()
    same = (F.col("digest") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("k_id"))
    if n > BROADCAST_ROWS:
        source = with_maybe(source, F.xxhash64("doc_id", "digest"), asked, F.xxhash64("k_id", "k"), n).where("maybe")
    texts = source.join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, same).select("node", "text")
    sets = texts.mapInArrow(run, "node bigint, shingles array<bigint>")
    sets = materialize(sets.dropDuplicates(["node"]) if repeated else sets, "near-shingles")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return candidates.select("a", "b").join(left, "a").join(right, "b").where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def joined_roots(roots: DataFrame, source: DataFrame, copies: DataFrame, tried: DataFrame, shingle: int, similarity: float, repeated: bool) -> DataFrame:
    """(node, root) after the alike among the pairs (a, b) have joined their roots x and y."""
    more = alike(source, copies, tried, shingle, similarity, repeated).join(tried, ["a", "b"])
    links = more.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return materialize(connected_components(links), "near-roots")


def near_groups(source: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Groups of rows (doc_id, text, digest): (known, copies, roots, repeated).

    ``known`` has a row for each row, ``copies`` one for each different text with its node, ``roots`` (node, root) of the nodes that
    are linked to others, and ``repeated`` tells whether rows agree in id and text.
    """
    known = materialize(sketches(source, shingle, similarity), "near-sketches")
    repeated = bool(known.groupBy("doc_id", "digest").count().where("count > 1").head(1))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    copies = known.groupBy("digest").agg(F.min("rid").alias("node"), F.min(order).alias("least"), F.count(F.lit(1)).alias("rows"))
    copies = materialize(copies, "near-copies")
    several = copies.where("rows > 1").select(F.col("digest").alias("k"))
    tested = with_maybe(known, F.xxhash64("digest"), several, F.xxhash64("k"), several.count()).withColumnRenamed("rid", "node")
    nodes = tested.where("NOT maybe").unionByName(tested.where("maybe").join(copies.select("node"), "node", "left_semi"))
    held = materialize(shared_tokens(nodes, similarity), "near-held")

    # Within two bits: nodes with one fingerprint link to the least of them, and these by the ring. Nodes that share no token can't be alike.
    prints = materialize(nodes.select("node", "fp").join(held.select("node"), "node", "left_semi"), "near-prints")
    points = materialize(prints.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "near-points")
    stars = prints.join(points.where("n > 1"), "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    named = lambda fp, node: points.select(F.col("fp").alias(fp), F.col("first").alias(node))
    ring = pigeonring_links(points.select("fp")).join(named("a", "x"), "a").join(named("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = stars.unionByName(ring).unionByName(leader_pairs(held, similarity)).distinct()
    found = alike(source, copies, materialize(hopeful(pairs, held, similarity), "near-pairs"), shingle, similarity, repeated)
    roots = materialize(connected_components(found), "near-roots")

    # What is still apart: first the best pair of each two roots, then every other pair of roots that are apart even then.
    others = materialize(hopeful(remaining_pairs(held, roots, similarity), held, similarity), "near-remaining")
    if others.head(1):
        tried = others.groupBy("x", "y").agg(F.max(F.struct("n", "a", "b")).alias("best")).select("best.a", "best.b", "x", "y")
        roots = joined_roots(roots, source, copies, materialize(tried, "near-pairs"), shingle, similarity, repeated)
        to = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        again = others.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(to("x"), "x", "left").join(to("y"), "y", "left")
        again = materialize(again.select("a", "b", F.coalesce("x_root", "x").alias("x"), F.coalesce("y_root", "y").alias("y")).where("x != y"), "near-remaining")
        if again.head(1):
            roots = joined_roots(roots, source, copies, again, shingle, similarity, repeated)
    return known, copies, roots, repeated


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but one document of each group of near-duplicates: the one with the least id stays.

    Documents are near-duplicates if their sets of shingles have a Jaccard similarity of at least ``similarity``, and groups are what such
    pairs connect. At that similarity fingerprints may differ in a dozen bits, too many for an index on the fingerprint alone. So links are
    sought in steps, and the shingles themselves (64-bit hashes) decide each time. First come cheap candidates, from the pigeonring (two bits)
    and from the leaders of shared shingles; they connect most groups. Then a join on prefixes of the sets of shingles
    meets every pair that can reach the similarity and that isn't connected yet, so nothing is lost by the size of a group.

    Rows are told apart by id and text, so null and repeated ids don't pull other documents along. Null ids come last in the order; of several
    rows of a group that have its least id, or no id, the one with the least digest stays. Of rows that agree in id and text one stays. A null
    text counts as empty. An empty table gives an empty result; other columns pass, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_digest(F.col(text_col)).alias("digest"))
    known, copies, roots, repeated = near_groups(source, shingle, similarity)
    linked = copies.join(roots.select(F.col("node").alias("k"), "root"), F.col("node") == F.col("k"), "left")
    order = F.struct("least.no_id", "least.doc_id", "digest")
    reach = linked.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("stays")).withColumnRenamed("root", "r")
    settled = linked.where("root IS NOT NULL OR rows > 1").join(reach, F.col("root") == F.col("r"), "left").select(F.col("digest").alias("k"), F.coalesce("stays", order).alias("stays"))
    settled = materialize(settled, "near-settled")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    gone = known.select("doc_id", "digest").join(broadcast_small(settled), F.col("digest") == F.col("k")).where(own != F.col("stays"))
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct(), "near-gone")
    kept = without(packed(docs, id_col, text_col), gone)
    return unpacked(one_of_each(kept, known) if repeated else kept)


def one_of_each(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, digest) with one of those that agree in id and digest; only these shuffle."""
    several = known.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    several = materialize(several, "near-repeated")
    tested = with_maybe(rows, F.xxhash64("doc_id", "digest"), several, F.xxhash64("gone_id", "gone_digest"), several.count())
    return tested.where("NOT maybe").drop("maybe").unionByName(tested.where("maybe").drop("maybe").dropDuplicates(["doc_id", "digest"]))
