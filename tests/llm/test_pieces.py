"""SentencePiece encoding and decoding (11) against the library."""

import hashlib
import random

import numpy as np
import pytest
from helpers import ODD, docs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import pieces
from granary.llm.queries import queries


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(pieces.default_model())


def ids_of(library, text):
    return library.encode(text or "", add_bos=True, add_eos=True)


def digests(library, text):
    ids = ids_of(library, text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("ab the,.\n\t▁<s>é½😀  ", max_size=60))
def test_ids_and_texts_equal_the_library(library, codec, text):
    ids = ids_of(library, text)
    assert codec.encode(text).tolist() == ids
    assert codec.decode(np.array(ids)) == library.decode(ids)


def test_runs_of_pieces_and_spaces_equal_the_library(library, codec):
    rng, known = random.Random(2), sorted(codec._ids)
    for k in range(4000):
        text = "".join(rng.choice(known) for _ in range(rng.randrange(1, 6))) if k % 2 else " " * rng.randrange(40) + rng.choice(known) + " " * rng.randrange(50)
        assert codec.encode(text).tolist() == ids_of(library, text)


def test_any_ids_decode_as_the_library(library, codec):
    rng = random.Random(1)
    for _ in range(2000):
        ids = [rng.randrange(300 if rng.random() < 0.6 else 32000) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_the_table_holds_the_last_token_of_each_prefix(library, codec):
    word = "▁uncharacteristically"
    last = codec.last_tokens(word)
    for n in range(2, len(word) + 1):
        assert last[n] == library.encode(word[1:n])[-1]


def test_long_words_are_linear(library, codec):
    word = "aeinrst" * 20_000
    assert codec.encode(word).tolist() == ids_of(library, word)


def test_words_join_to_the_text(codec):
    for text in [t or "" for t in ODD] + ["▁▁(ab, c.com\n▁\n12a▁x...😀y\x1f"]:
        assert "".join(codec._words(text)) == text


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as format_of

    spec = format_of.ModelProto()
    with open(pieces.default_model(), "rb") as file:
        spec.ParseFromString(file.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "a.model").write_bytes(spec.SerializeToString())
    spec.normalizer_spec.remove_extra_whitespaces = False
    spec.trainer_spec.model_type = 1
    (tmp_path / "b.model").write_bytes(spec.SerializeToString())
    for name in ("a", "b"):
        with pytest.raises(ValueError):
            pieces.PieceCodec(str(tmp_path / f"{name}.model"))


def test_op11_on_odd_rows(spark, library):
    rows = docs_of(spark, [*ODD, "a", "a"], [*range(len(ODD)), None, None])
    clash = rows.selectExpr("*", "text AS id", "text AS n_tokens", "1 AS token_ids", "2 AS ids_sha256")
    found = pieces.encode_documents(clash, with_ids=True).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        text = "a" if r["doc_id"] is None else ODD[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(library, text)
        assert np.frombuffer(r["token_ids"], "<u2").tolist() == ids_of(library, text)
    assert pieces.encode_documents(docs_of(spark, [])).count() == 0


def test_op11_query(spark, sf_dir, texts, library):
    found = {r["doc_id"]: r for r in queries()["op11_piece_codec"](spark, sf_dir).collect()}
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in found.items()} == {i: digests(library, t) for i, t in texts.items()}
