"""Further columns of the input change nothing, whatever they are called."""

import hashlib

import numpy as np
import pytest
from helpers import docs_of, rows_of
from pyspark.sql import functions as F

from granary.llm import bpe, decontam, exact_dedup, langid, lm_score, simhash, token_scan, training_order
from granary.llm.queries import queries

NAMES = [
    "hash", "id", "row", "h", "key", "first", "kept", "digest", "keep_id", "group_size", "text_sha256", "node", "doc", "fp", "at", "bit", "n", "n_tokens", "ids_sha256", "held_out",
    "score", "lang_pred", "slot", "shard", "file", "block", "ordinal", "place", "lot", "l", "item", "item_id", "fingerprint", "component_id", "chosen", "token_ids", "maybe", "word", "count",
]
TEXTS = ["the cat sat on the mat today", "the cat sat on the mat today", "der hund lief durch den wald", None, "", "a b c d e f g h i j k l", "one two three four five six seven eight"]


@pytest.mark.parametrize(
    "op",
    [token_scan.token_counts, simhash.simhash_groups, exact_dedup.exact_dedup, bpe.encode_documents, training_order.training_order, lm_score.score_documents, langid.identify, "leaks"],
    ids=["op1", "op2", "op3", "op4", "op7", "op8", "op10", "op9"],
)
def test_columns_with_working_names_change_nothing(spark, op):
    docs = docs_of(spark, TEXTS, lang=["en", "en", "de", "en", None, "en", "en"])
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    if op == "leaks":
        op = lambda df: decontam.leaks(df, bench)
    plain = op(docs)
    clashing = op(docs.select("*", *[F.lit("7").alias(n) for n in NAMES]))
    assert clashing.columns == plain.columns
    shown = [c for c in plain.columns if c not in ("file", "path")]
    assert rows_of(clashing, *shown) == rows_of(plain, *shown)


def test_op4_decoded_texts_over_the_table(spark, sf_dir, texts):
    found = {r["doc_id"]: r["decoded_sha256"] for r in queries()["op4_bpe_codec"](spark, sf_dir).collect()}
    assert found == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}


def test_the_pipeline_runs_as_a_whole(spark, sf_dir, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    codec = bpe.codec(bpe.default_vocabulary())
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert 0 < len(rows) < len(texts)
    assert {r["doc_id"] for r in rows} <= set(texts)
    for r in rows:
        text = codec.decode(np.frombuffer(r["token_ids"], codec.dtype))
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split("\n")) - {""} <= set((texts[r["doc_id"]] or "").split("\n"))  # lines only ever go
