"""Encoding, token files and training order (4, 1, 7)."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import ODD, docs_of, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import bpe, token_scan, training_order
from granary.llm.queries import queries

END = 50256


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab '\n\t<|endoftext|>sré²½  ", max_size=60))
def test_ids_and_texts_equal_the_library(library, codec, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == ids
    assert bpe.quick_codec(bpe.default_vocabulary()).encode(text).tolist() == ids
    assert codec.decode(np.array(ids, codec.dtype)) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_the_library(library, codec):
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(END + 1) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, codec.dtype)) == library.decode(ids, skip_special_tokens=False)


def test_long_words_are_linear(codec, library):
    word = "aeinrst" * 20_000
    assert codec.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


def test_op4_on_odd_rows(spark, library):
    found = bpe.encode_documents(docs_of(spark, [*ODD, "a", "a"], [*range(len(ODD)), None, None]), with_ids=True).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        if r["doc_id"] is not None:
            text = ODD[r["doc_id"]] or ""
            ids = library.encode(text, add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert np.frombuffer(r["token_ids"], "<u2").tolist() == ids
    assert bpe.encode_documents(docs_of(spark, [])).count() == 0


def test_op4_query(spark, sf_dir, texts, library):
    found = {r["doc_id"]: r for r in queries()["op4_bpe_codec"](spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (found[i]["n_tokens"], found[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_op1_query(spark, sf_dir, texts, library):
    found = dict(rows_of(queries()["op1_token_counts"](spark, sf_dir), "doc_id", "n_tokens"))
    assert found == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}


def test_op1_on_odd_rows(spark, codec):
    found = rows_of(token_scan.token_counts(docs_of(spark, ODD)), "doc_id", "n_tokens")
    assert found == sorted(((i, len(codec.encode(t or "", specials=False))) for i, t in enumerate(ODD)), key=repr)
    assert token_scan.token_counts(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("block_tokens", [1, 3, 8, 100])
def test_documents_are_stitched_across_blocks(spark, tmp_path, block_tokens):
    rng, expected = random.Random(block_tokens), {}
    for k in range(6):
        ids = [[], [5] * 20, [END] * 7, [5] * 8 + [END], *[[rng.choice([1, 2, END]) for _ in range(40)] for _ in range(2)]][k]
        (tmp_path / f"t{k}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        counts, run = [], 0
        for i in ids:
            counts, run = (counts + [run], 0) if i == END else (counts, run + 1)
        expected |= {(k, o): n for o, n in enumerate(counts + [run] * (run > 0))}
    found = token_scan.scan_token_files(spark, f"file://{tmp_path}", block_tokens=block_tokens).collect()
    assert {(int(r["file"][-5]), r["ordinal"]): r["n_tokens"] for r in found} == expected


def test_half_a_token_is_refused(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        token_scan.scan_token_files(spark, f"file://{tmp_path}")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65536, 70001])
def test_the_permutation_is_one(n):
    order = training_order.Permutation(n)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.numbers(slots) == np.arange(n)).all()
    if n > 100:
        assert (slots != training_order.Permutation(n, key=7).slots(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.2


def test_op7_round_trip_and_resume(spark, documents, texts, tmp_path, codec):
    folder = f"file://{tmp_path}/order"
    index = training_order.materialise_order(documents.repartition(3), folder, stride=128, shard_sequences=500).orderBy("slot").collect()
    total = len(index)
    assert [r["slot"] for r in index] == list(range(total))
    read = list(training_order.read_sequences(folder))
    assert [zlib.crc32(s.tobytes()) for s in read] == [r["ids_crc32"] for r in index]
    later = list(training_order.read_sequences(folder, 777))
    assert all((a == b).all() for a, b in zip(later, read[777:], strict=True))
    back = np.argsort(training_order.Permutation(total).numbers(np.arange(total)))
    flat = np.concatenate([read[i][: index[i]["n_tokens"]] for i in back])
    ends = np.flatnonzero(flat == END)
    found = sorted(flat[a:b].tobytes() for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True))
    assert found == sorted(codec.encode(t or "", specials=False).tobytes() for t in texts.values())


def test_op7_query(spark, sf_dir, texts, codec):
    rows = queries()["op7_training_order"](spark, sf_dir).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(r["n_tokens"] for r in rows) == sum(len(codec.encode(t or "", specials=False)) + 1 for t in texts.values())


def test_op7_on_odd_rows(spark, tmp_path):
    rows = training_order.materialise_order(docs_of(spark, [*ODD, "a"], [*range(len(ODD)), None]), f"file://{tmp_path}/a", stride=16, shard_sequences=100).collect()
    assert len({r["slot"] for r in rows}) == len(rows) > 100
    assert training_order.materialise_order(docs_of(spark, []), f"file://{tmp_path}/b").count() == 0


def test_op7_index_tells_whose_tokens_each_sequence_begins_with(spark, tmp_path):
    """first_doc_id and n_tokens against sequences cut one after another, in the places that the permutation gives; the manifest tells the rest."""
    texts = [None, "", "short", "word " * 300, *(f"text {k} " * (k % 40) for k in range(80))]
    folder = f"file://{tmp_path}/order"
    rows = training_order.materialise_order(docs_of(spark, texts).coalesce(1), folder, stride=16, shard_sequences=20).collect()
    own = bpe.quick_codec(bpe.default_vocabulary())
    flat, owner = [], []
    for k, text in enumerate(texts):
        ids = [*own.encode(text or "", specials=False).tolist(), training_order.END]
        flat += ids
        owner += [k] * len(ids)
    n = -(-len(flat) // 16)
    slots = training_order.Permutation(n).slots(np.arange(n)).tolist()
    assert {(r["slot"], r["first_doc_id"], r["n_tokens"]) for r in rows} == {(slots[k], owner[16 * k], len(flat[16 * k : 16 * k + 16])) for k in range(n)}
    assert all((r["shard"], r["byte_offset"]) == (r["slot"] // 20, r["slot"] % 20 * 32) for r in rows)
    facts = training_order.read_manifest(folder)
    assert (facts["sequences"], facts["stride"], facts["dtype"]) == (n, 16, "<u2")
    assert [x.tolist()[: r["n_tokens"]] for x, r in zip(training_order.read_sequences(folder), sorted(rows, key=lambda r: r["slot"]), strict=True)] == [
        flat[16 * k : 16 * k + 16] for k in training_order.Permutation(n).numbers(np.arange(n)).tolist()
    ]
    with pytest.raises(ValueError):
        training_order.materialise_order(docs_of(spark, ["a"]), f"file://{tmp_path}/c", end=70_000)


def test_words_are_asked_for_once_and_kept_when_the_older_half_goes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 8)
    own = bpe.BytePairCodec(bpe.default_vocabulary())
    text = " ".join(f"word{i % 7} naïve{i % 3}" for i in range(50))
    assert own.encode(text).tolist() == [i for w in own._words(text) for i in own.encode_word(w)]
    asked = []
    known = bpe.Remembered(lambda w: (asked.append(w), known.setdefault(w, b"x"))[1])
    assert b"".join(map(known.__getitem__, ["a", "b", "a", "b", "a"])) == b"xxxxx"
    assert asked == ["a", "b"]
