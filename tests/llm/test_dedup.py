"""Exact, line and near dedup, and decontamination (3, 5, 2, 9)."""

import random

import pytest
from compare import same_rows
from helpers import ODD, SCHEMA, components, docs_of, line_dedup, near_groups, rows_of, simhash
from pyspark.sql import functions as F

from granary.llm import decontam, exact_dedup
from granary.llm import line_dedup as lines
from granary.llm import simhash as near
from granary.llm.common import marked, with_maybe, without
from granary.llm.components import connected_components
from granary.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    same_rows(queries()[name](spark, sf_dir), duck, oracle_sql()[name])


def test_op3_on_odd_rows(spark):
    texts = [*ODD, "same  text", "same\ttext", "same text", "same text"]
    ids = [*range(len(ODD)), 90, 80, 80, None]
    rows = exact_dedup.exact_dedup(docs_of(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    same = [r for r in rows if r["group_size"] == 4]
    assert {r["keep_id"] for r in same} == {80}
    assert sorted((str(r["doc_id"]), r["kept"]) for r in same) == [("80", False), ("80", True), ("90", False), ("None", False)]
    empty = [r for r in rows if r["doc_id"] in (0, 1)]
    assert [(r["keep_id"], r["kept"]) for r in sorted(empty, key=lambda r: r["doc_id"])] == [(0, True), (0, False)]
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_op3_without_broadcast_gives_the_same(spark, documents):
    columns = ("doc_id", "keep_id", "group_size", "kept")
    assert rows_of(exact_dedup.exact_dedup(documents, broadcast_rows=0), *columns) == rows_of(exact_dedup.exact_dedup(documents), *columns)


def test_op3_filter_misses_no_repeat(spark):
    rows = exact_dedup.fingerprints(docs_of(spark, [str(i % 700) for i in range(1000)]), "doc_id", "text")
    slots = exact_dedup.with_slots(rows, 100)
    hit = {r["block"]: r["hit"] for r in exact_dedup.repeated_blocks(slots).collect()}
    for r in slots.join(rows.groupBy("text_sha256").count().where("count > 1"), "text_sha256").collect():
        assert hit[r["block"]] >> r["slot_a"] & 1
        assert hit[r["block"]] >> r["slot_b"] & 1
    assert exact_dedup.with_slots(rows, 100).where("slot_a = slot_b").count() == 0


def test_op3_sifts_rows_before_they_shuffle(spark):
    rows = exact_dedup.fingerprints(docs_of(spark, [str(i % 2950) for i in range(3000)]), "doc_id", "text")
    slots = exact_dedup.with_slots(rows, 60_000)
    bloom = exact_dedup.repeated_blocks(slots)
    hits = [rows_of(exact_dedup.with_hits(slots, bloom, bound), "doc_id", "hit") for bound in (0, 10**6)]
    assert hits[0] == hits[1] and len(hits[0]) == 3000
    sifted = with_maybe(slots, F.xxhash64("block"), bloom, F.xxhash64("block"), bloom.count()).where("maybe").count()
    assert 100 <= sifted < 700  # the copies, and rows that share a block or a bit with one


def test_op5_equals_the_plain_version(spark, documents, texts):
    found = dict(rows_of(lines.line_dedup(documents), "doc_id", "text"))
    assert found == line_dedup(list(texts.items()))


def test_op5_on_odd_rows(spark):
    shared = "\n".join(f"line {i} of a shared passage" for i in range(12))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*ODD, f"x\n{passage}\ny", f"z\n{passage}\nx", f"head\n{shared}\ntail", f"other\nhead\n{shared}", shared, "\n".join(["same"] * 50)]
    found = dict(rows_of(lines.line_dedup(docs_of(spark, texts)), "doc_id", "text"))
    assert found == line_dedup(list(enumerate(texts)))
    assert any(len(found[k]) < len(texts[k]) for k in (len(ODD) + 3, len(ODD) + 4))
    assert found[len(ODD) + 1] == "z\nx"
    assert lines.line_dedup(docs_of(spark, [])).count() == 0
    nulls = lines.line_dedup(docs_of(spark, [shared, shared, shared], [None, 5, 5])).collect()
    assert sorted((str(r["doc_id"]), r["text"] == shared) for r in nulls) == [("5", True), ("5", True), ("None", False)]


def test_op5_removes_passages_of_few_lines(spark):
    """Passages of over 50 words in one to six lines, between lines of the documents' own: the first stays, no other does; shorter ones stay."""
    rng = random.Random(2)
    texts, passages = [], []
    for n in range(1, 7):
        for size in (51, 60, 90):
            words = [f"p{rng.randrange(10**6)}" for _ in range(size)]
            cuts = sorted(rng.sample(range(1, size), n - 1))
            passages.append("\n".join("  ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, size], strict=True)))
    short = "\n".join(" ".join(f"s{k}x{j}" for j in range(25)) for k in range(2))
    own = lambda: "\n".join(" ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 4)))
    for passage in passages:
        texts += [f"{own()}\n{passage}\n{own()}" for _ in range(3)]
    texts += [f"{own()}\n{short}" for _ in range(2)]
    docs = docs_of(spark, texts)
    found = dict(rows_of(lines.line_dedup(docs), "doc_id", "text"))
    assert found == line_dedup(list(enumerate(texts)))
    for k, passage in enumerate(passages):
        assert [passage in found[i] for i in range(3 * k, 3 * k + 3)] == [True, False, False]
    assert all(found[i] == texts[i] for i in range(len(texts) - 2, len(texts)))


def test_op5_gives_the_same_by_filter(spark, documents, monkeypatch):
    expected = rows_of(lines.line_dedup(documents), "doc_id", "text")
    monkeypatch.setattr(lines, "marked", lambda rows, keys, listed: marked(rows, keys, listed, broadcast_bytes=-1))
    monkeypatch.setattr(lines, "broadcast_small", lambda df: df)
    assert rows_of(lines.line_dedup(documents), "doc_id", "text") == expected


def test_columns_with_working_names_survive(spark):
    names = ["hash", "piece", "gone", "id", "row", "h", "lines", "first", "kept", "text_hash", "gone_id", "key_id", "digest", "maybe", "filter_word", "node", "doc", "fp", "at"]
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "x y z"]).select("*", *[F.lit(7).alias(n) for n in names])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "p q r s t u v")], "item_id long, text string")
    from granary.llm import importance

    for out in (lines.line_dedup(docs), near.near_dedup(docs), decontam.decontaminate(docs, bench), importance.resample(docs, labels)):
        assert out.columns == docs.columns
        assert out.where(" AND ".join(f"`{n}` = 7" for n in names)).count() == out.count() > 0


def test_op2_query_equals_all_pairs(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in queries()["op2_simhash"](spark, sf_dir).collect()}
    prints = {i: simhash(t, 3) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    found = components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r["component_id"] for i, r in rows.items()} == found


def test_op2_on_odd_rows(spark):
    rows = near.simhash_groups(docs_of(spark, [*ODD, "a", "a"], [*range(len(ODD)), None, 4])).collect()
    assert len(rows) == len(ODD) + 2
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {0}
    assert {r["component_id"] for r in rows if r["fingerprint"] == f"{simhash('a', 3):016x}"} == {4}
    assert near.simhash_groups(docs_of(spark, [])).count() == 0
    assert near.near_dedup(docs_of(spark, [])).count() == 0
    assert near.near_dedup(docs_of(spark, ["a", "a"], [3, 3])).count() == 1


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("block", "rows"), [(1000, 100_000), (5, 0)])
def test_near_dedup_finds_what_all_pairs_find(spark, monkeypatch, block, rows):
    """Copies with few and with many edits, groups small and large, and a line that all documents share; with small blocks, without broadcasts."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BROADCAST_ROWS", rows)
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(40)]
    texts = [f"a line that all of the documents share among them {t}" for t in base]
    texts += [edited(rng, base[0], 1) for _ in range(90)] + [edited(rng, t, k) for t in base for k in (1, 2, 3, 6, 12, 40)] + [t.upper() for t in base[:5]] + ODD
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = docs_of(spark, texts, ids)
    kept = {r["doc_id"] for r in near.near_dedup(docs).collect()}
    assert kept == {i for i, least in near_groups(dict(zip(ids, texts, strict=True))).items() if i == least}


@pytest.mark.parametrize("own", [30, 40])
def test_near_dedup_finds_twins_on_a_template(spark, own):
    """Texts are mostly one template and unlike each other, but each has a twin."""
    rng = random.Random(own)
    template = [f"t{i}" for i in range(200 - own)]
    texts = []
    for k in range(150):
        words = [*template, *(f"d{k}x{rng.randrange(10**6)}" for _ in range(own))]
        texts += [" ".join(words), " ".join([*words[:-1], f"twin{k}"])]
    kept = {r["doc_id"] for r in near.near_dedup(docs_of(spark, texts)).collect()}
    assert kept == {i for i, least in near_groups(dict(enumerate(texts))).items() if i == least}
    assert kept == set(range(0, 300, 2))


def test_rows_with_null_and_repeated_ids_are_told_apart(spark):
    """Unlike texts stay whatever their ids are; of equal texts one stays, of equal rows too."""
    texts = ["a b c d e f g", "a b c d e f g", "unlike the others in every word of it", "another one that is like none of them", "leaks p q r s t u v w"]
    bench = spark.createDataFrame([(1, "p q r s t u v w")], "item_id long, text string")
    for ids in ([1, None, None, None, None], [1, 2, 2, 2, 2], [None] * 5, [7] * 5):
        rows = [(r["doc_id"], r["text"]) for r in near.near_dedup(docs_of(spark, texts, ids)).collect()]
        assert sorted(t for _, t in rows) == sorted(texts[1:])
        assert (ids[0], texts[0]) in rows
        rows = [(r["doc_id"], r["text"]) for r in decontam.decontaminate(docs_of(spark, texts, ids), bench).collect()]
        assert sorted(t for _, t in rows) == sorted(texts[:4])
    docs = docs_of(spark, [*texts, *texts, *texts], [3] * 5 + [3] * 5 + [9] * 5)
    assert sorted((r["doc_id"], r["text"]) for r in near.near_dedup(docs).collect()) == sorted((3, t) for t in texts[1:])


def test_without_gives_the_same_by_filter(spark):
    rows = spark.range(3000).select(F.struct(F.col("id").alias("x")).alias("row"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"))
    gone = rows.where("row.x % 7 = 0").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    expected = [x for x in range(3000) if x % 7]
    for bound in (0, 10_000):
        assert sorted(r["row"]["x"] for r in without(rows, gone, broadcast_rows=bound).collect()) == expected
    tested = with_maybe(rows, F.xxhash64("doc_id", "digest"), gone, F.xxhash64("gone_id", "gone_digest"), gone.count())
    assert tested.where("maybe AND row.x % 7 != 0").count() < 0.2 * 3000
    assert without(rows, gone.where("false"), broadcast_rows=-1).count() == 3000


def test_near_dedup_finds_stars_of_copies(spark):
    """Copies that were edited each on its own reach the similarity with the original only."""
    rng = random.Random(11)
    stars = [" ".join(f"w{rng.randrange(9000)}" for _ in range(200)) for _ in range(2)]
    texts = [edited(rng, t, 3) for t, copies in zip(stars, (400, 60), strict=True) for _ in range(copies)] + stars + ODD
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    kept = {r["doc_id"] for r in near.near_dedup(docs_of(spark, texts, ids)).collect()}
    least = near_groups(dict(zip(ids, texts, strict=True)))
    assert kept == {i for i in ids if least[i] == i}
    assert len({least[i] for i in ids[:460]}) == 2


def test_near_dedup_blocks_meet_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    held = [(k, 10, [(True, 5), (False, 100 + k)]) for k in range(20)] + [(50, 40, [(True, 5)]), (60, 10, [(True, 7)]), (61, 10, [(True, 7)])]
    held = spark.createDataFrame(held, "node long, size int, tokens array<struct<lead: boolean, token: long>>")
    roots = spark.createDataFrame([(60, 60), (61, 60)], "node long, root long")
    found = near.remaining_pairs(held, roots, 0.8).collect()
    assert sorted(tuple(sorted((r["a"], r["b"]))) for r in found) == [(a, b) for a in range(20) for b in range(a + 1, 20)]


def signed_longs(prints):
    return sorted(x - (1 << 64) if x >> 63 else x for x in prints)


def bits_apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def test_pigeonring_links_are_all_pairs_within_two_bits(spark):
    """Random fingerprints, edited ones, and 500 that share one run of bits, among which no bucket is small."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(120)]
    prints = set(base)
    for b in base[:40]:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {base[0] ^ 1 << i for i in range(64)}
    run = base[1] >> 36 << 36
    crowd = [run | rng.getrandbits(36) for _ in range(150)]
    prints |= {x ^ 1 << rng.randrange(36) ^ 1 << rng.randrange(36) for x in crowd} | set(crowd) | {crowd[0] ^ i for i in range(200)}
    signed = signed_longs(prints | {0, 1, (1 << 64) - 1, (1 << 63) - 1, 1 << 63})
    links = [(r["a"], r["b"]) for r in near.pigeonring_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert len(links) == len(set(links))
    assert set(links) == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bits_apart(a, b) <= 2}


def test_pigeonring_links_of_one_or_no_fingerprint(spark):
    for prints in ([], [7]):
        assert near.pigeonring_links(spark.createDataFrame([(x,) for x in prints], "fp long")).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_leaks(docs, items, similarity=0.8, shingle=5, radius=64):
    """Every window of an item's length, with all shingles weighted by all documents."""
    import math
    from collections import Counter

    import xxhash

    def simhash_of(bag, weight):
        ones, total = [0.0] * 64, sum(weight(s) * c for s, c in bag.items())
        for s, c in bag.items():
            h = xxhash.xxh64_intdigest(s, 42)
            for bit in range(64):
                ones[bit] += weight(s) * c * (h >> bit & 1)
        return sum(1 << bit for bit in range(64) if 2 * ones[bit] > total)

    split = {i: decontam.words_of(t) for i, t in docs}
    shingles = lambda w, n: Counter(b" ".join(w[k : k + n]) for k in range(len(w) - n + 1))
    everywhere = {n: {i: shingles(d, n) for i, d in split.items()} for n in {min(shingle, len(decontam.words_of(t))) for _, t in items} if n}
    out = set()
    for item, text in items:
        w = decontam.words_of(text)
        if not w:
            continue
        n = min(shingle, len(w))
        own = shingles(w, n)
        df = Counter(s for bag in everywhere[n].values() for s in own if s in bag)
        weight = lambda s, df=df: round(math.log1p(len(docs) / df[s]) * (1 << 20)) / (1 << 20) if df.get(s) else 1.0
        for i, d in split.items():
            if not own.keys() & everywhere[n][i].keys():
                continue
            for start in range(max(1, len(d) - len(w) + 1)):
                bag = shingles(d[start : start + len(w)], n)
                both = sum(weight(s) * min(c, bag[s]) for s, c in own.items())
                either = sum(weight(s) * max(own[s], bag[s]) for s in own.keys() | bag.keys())
                if both / either >= similarity and (radius == 64 or (simhash_of(own, weight) ^ simhash_of(bag, weight)).bit_count() <= radius):
                    out.add((i, item))
                    break
    return out


def test_op9_query_equals_all_windows(spark, sf_dir, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = set(rows_of(queries()["op9_decontamination"](spark, sf_dir), "doc_id", "item_id"))
    assert found == plain_leaks(list(texts.items()), items)
    assert found


def test_op9_meets_windows_at_every_offset(spark):
    """Swapped halves, moved sentences and random edits: all windows within the radius that are similar enough, and nearly all that are."""
    rng = random.Random(5)
    items = [(k, " ".join(f"i{k}w{rng.randrange(400)}" for _ in range(n))) for k, n in enumerate((100, 60, 60, 40, 25))]
    texts = []
    for _ in range(60):
        item = rng.choice(items)[1].split()
        kind = rng.randrange(4)
        if kind == 0:
            cut = rng.randrange(1, len(item))
            item = item[cut:] + item[:cut]
        elif kind == 1:
            a, b = sorted(rng.sample(range(len(item)), 2))
            item = item[:a] + item[b:] + item[a:b]
        elif kind == 2:
            item = edited(rng, " ".join(item), rng.randrange(1, 4)).split()
        own = [f"o{rng.randrange(300)}" for _ in range(rng.randrange(60))]
        texts.append(" ".join([*own[:20], *item, *own[20:]]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(spark, texts), bench).collect()}
    alike = plain_leaks(list(enumerate(texts)), items)
    assert found == plain_leaks(list(enumerate(texts)), items, radius=decontam.RADIUS)
    assert found <= alike
    assert len(found) >= 0.95 * len(alike) > 20


def test_op9_index_prunes_and_meets_all_within_the_radius():
    rng = random.Random(3)
    index = decontam.ItemIndex([(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(2000)])
    index.weigh({})
    import numpy as np

    assert sum(len(index.near(np.uint64(rng.getrandbits(64)))) for _ in range(40)) < 0.05 * 2000 * 40
    for _ in range(40):
        item = rng.randrange(2000)
        value = int(index.prints[item])
        for bit in rng.sample(range(64), decontam.RADIUS):
            value ^= 1 << bit
        assert item in index.candidates(30, np.uint64(value))


def test_op9_on_odd_rows_and_edits(spark):
    item = " ".join(f"w{i}" for i in range(40))
    changed = item.replace("w20", "other")
    texts = [*ODD, f"before {item} after", item.upper().replace(" ", "! "), f"{changed} and more", "w1 w2 w3 w4 w5 w6 alone", f"{item} {item}"]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "w1 w2"), (5, item)], "item_id long, text string")
    docs = docs_of(spark, texts)
    n = len(ODD)
    for block in (20_000, 1):
        found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, item_block=block).collect()}
        assert {(n + k, i) for k in (0, 1, 4) for i in (1, 5)} <= found
        assert not {d for d, _ in found} & set(range(n))
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench.where("item_id = 1")).collect()}
    assert {n, n + 1, n + 4} & kept == set()
    assert n + 3 in kept
    assert decontam.leaks(docs_of(spark, []), bench).count() == 0
    assert decontam.leaks(docs, bench.where("false")).count() == 0
    assert SCHEMA.names == decontam.decontaminate(docs, bench).columns
