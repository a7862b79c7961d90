"""Quality selection, language-model scoring and language identification (6, 8, 10), and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, docs_of, line_dedup, near_groups, words
from pyspark.sql import functions as F

from granary.llm import decontam, importance, langid, lm_score
from granary.llm.queries import queries

LABELS = "doc_id long, quality int, toxic int"


def test_op6_weights_equal_the_plain_ratio(spark, sf_dir, documents, texts):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r["doc_id"]: r for r in queries()["op6_importance_resampling"](spark, sf_dir).collect()}
    hashed = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(importance.SEED)), F.lit(2)).alias("h")).collect()}
    known = {r["doc_id"]: r for r in labels.collect()}
    good = {i for i, r in known.items() if r["quality"] == 1 and not r["toxic"] and hashed[i] == 0}
    found = {i: importance.features(t or "") for i, t in texts.items()}
    raw = sum(np.bincount(f, minlength=importance.BUCKETS) for f in found.values())
    target = sum(np.bincount(found[i], minlength=importance.BUCKETS) for i in good)
    smooth = lambda c: (c + 0.01 * c.mean()) / (c + 0.01 * c.mean()).sum()
    ratio = np.log(smooth(target) / smooth(raw))
    mean = {i: ratio[f].sum() / (len(f) + importance.PRIOR) for i, f in found.items()}
    unseen = [i for i in known if hashed[i] == 1 and not known[i]["toxic"]]
    cut = importance.best_cut(np.array([mean[i] for i in unseen]), np.array([known[i]["quality"] == 1 for i in unseen]))
    for i, f in found.items():
        assert rows[i]["log_weight"] == pytest.approx((mean[i] - cut) * (len(f) + importance.PRIOR), abs=1e-6)

    split = {i: set(re.sub(rb"[!-/:-@\[-`{-~]", b" ", (t or "").lower().encode()).split()) for i, t in texts.items()}
    toxic = [i for i, r in known.items() if r["toxic"] and hashed[i] == 0]
    having, everywhere = (Counter(w for i in ids for w in split[i]) for ids in (toxic, texts))
    worst = {w: math.log((n / len(toxic) + 0.005) / (everywhere[w] / len(texts) + 0.005)) for w, n in having.items() if n >= max(3, 0.02 * len(toxic))}
    for i, w in split.items():
        assert rows[i]["toxicity"] == pytest.approx(sum(sorted((worst[x] for x in w if worst.get(x, 0) > 0), reverse=True)[:2]))

    drawn = {i: r["gumbel_key"] for i, r in rows.items() if r["gumbel_key"] is not None}
    k = sum(rows[i]["log_weight"] >= 0 for i in drawn)
    assert {i for i, r in rows.items() if r["selected"]} == {i for i, key in drawn.items() if key >= sorted(drawn.values(), reverse=True)[k - 1]}


def test_op6_keeps_good_and_rejects_bad_and_toxic(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries()["op6_importance_resampling"](spark, sf_dir).join(labels, "doc_id").collect()
    chosen = lambda quality, toxic: np.mean([r["selected"] for r in rows if (r["quality"], r["toxic"]) == (quality, toxic)])
    assert chosen(1, 0) > 0.98
    assert chosen(0, 0) < 0.1
    assert chosen(1, 1) < 0.5  # few toxic labels to learn from at this size; the README has the figures of a larger one


def test_op6_rejects_toxic_words_in_good_texts(spark):
    """Toxic words in texts that are good by all others, short and very long ones; without them, nothing is lost."""
    rng = np.random.default_rng(3)
    clean = [" ".join(f"w{x}" for x in rng.zipf(1.5, 60 if k % 9 else 5000)) for k in range(400)]
    insults = ["vile", "rotten", "filthy", "lout"]
    texts = [t + f" You {insults[k % 4]}, {insults[(k + 1) % 4]}!" if k % 5 == 0 else t for k, t in enumerate(clean)]
    texts += [" ".join(f"#{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(60)]
    labels = spark.createDataFrame([(k, int(k < 400), int(k < 400 and k % 5 == 0)) for k in [*range(300), *range(400, 460)]], LABELS)
    rows = {r["doc_id"]: r["selected"] for r in importance.importance(docs_of(spark, texts), labels).collect()}
    assert not any(rows[k] for k in range(0, 400, 5))
    assert all(rows[k] for k in range(400) if k % 5)


def test_op6_draws_in_proportion_to_the_weights(spark):
    """Over many seeds the first draw falls on each document as often as its weight says, and inclusion grows with the weight."""
    weights = np.log([1.0, 2.0, 4.0, 8.0, 16.0])
    rows = spark.createDataFrame([(k, float(w)) for k, w in enumerate(weights)], "doc_id long, w double")
    seeds = spark.range(4000).select(F.col("id").alias("seed"))
    keyed = rows.join(F.broadcast(seeds)).select("doc_id", "seed", importance.gumbel_key(F.col("w"), F.xxhash64("doc_id", "seed"), 1.0).alias("key"))
    top = keyed.groupBy("seed").agg(F.max_by("doc_id", "key").alias("first")).groupBy("first").count().collect()
    share = {r["first"]: r["count"] / 4000 for r in top}
    for k, w in enumerate(np.exp(weights)):
        assert share[k] == pytest.approx(w / 31, abs=0.025)


@pytest.mark.parametrize("k", [0, 1, 37, 10**6])
def test_op6_draws_as_many_as_asked(spark, sf_dir, documents, k):
    """A number of documents far from the cut: the largest keys of those that aren't toxic, with ties at the last place."""
    rows = importance.importance(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), k=k).collect()
    keys = sorted((r["gumbel_key"] for r in rows if r["gumbel_key"] is not None), reverse=True)
    last = keys[min(k, len(keys)) - 1] if k else math.inf
    assert all(r["selected"] == (r["gumbel_key"] is not None and r["gumbel_key"] >= last) for r in rows)
    assert min(k, len(keys)) <= sum(r["selected"] for r in rows) < max(1, k + 20)


def test_op6_on_odd_rows(spark):
    docs = docs_of(spark, [*ODD, "a", "a"], [*range(len(ODD)), None, 4])
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 0, None), (6, None, 1), (None, 1, 0), (99, 1, 1)], LABELS)
    assert importance.importance(docs, labels).count() == len(ODD) + 2
    assert importance.resample(docs, labels.where("false")).count() == len(ODD) + 2
    assert importance.resample(docs_of(spark, []), labels).count() == 0


def test_best_cut():
    assert importance.best_cut(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True])) == 1.5
    assert importance.best_cut(np.array([1.0]), np.array([True])) == 0.0
    assert importance.best_cut(np.array([]), np.array([], bool)) == 0.0


@pytest.mark.parametrize("chunk, part, most", [(lm_score.CHUNK_TOKENS, lm_score.RANGE_TOKENS, lm_score.FAN), (900, 5_000, lm_score.FAN), (900, 5_000, 3)])
def test_op8_equals_the_plain_model(spark, documents, texts, chunk, part, most):
    """Also with many chunks and ranges, counted in one round or in several."""
    rows = {r["doc_id"]: r for r in lm_score.score_documents(documents, chunk_tokens=chunk, range_tokens=part, most=most).collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    count, pairs, triples = Counter(), Counter(), Counter()
    for i in train:
        s = ["start", *words(texts[i]), "end"]
        count.update(s)
        pairs.update(zip(s, s[1:], strict=False))
        triples.update(zip(s, s[1:], s[2:], strict=False))
    tokens = sum(count.values()) - count["start"]
    types = len(count) - 1
    base = lambda w: (count[w] + 0.5) / (tokens + 0.5 * (types + 1))

    def p(history, w):
        if not history:
            return base(w)
        shorter, k = p(history[1:], w), lm_score.PRIOR
        if len(history) == 2:
            return (triples[(*history, w)] + k * shorter) / (pairs[history] + k)
        return (pairs[(*history, w)] + k * shorter) / (count[history[0]] + k)

    for i, text in texts.items():
        s, r = ["start", *words(text), "end"], rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (i not in train, len(s) - 1, tokens)
        assert r["n_known"] == sum(count[w] > 0 for w in s[1:])
        assert r["base_score"] == pytest.approx(sum(math.log10(base(w)) for w in s[1:]))
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(s[max(0, k - 2) : k]), s[k])) for k in range(1, len(s))))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    seen = {w for w in count if w != "start"}
    for history in [(), ("start",), *[g[:1] for g in list(pairs)[1:4]], *[g[:2] for g in list(triples)[:4]]]:
        assert sum(p(history, w) for w in seen) + p(history, "never seen") == pytest.approx(1)


def test_op8_rounds():
    for parts in (1, 2, 7, 8, 9, 64, 65, 1000):
        rounds, fan = lm_score.rounds_of(parts, 8)
        assert fan <= 8 and fan**rounds >= parts and (rounds == 1 or 8 ** (rounds - 1) < parts)


def test_op8_rows_sent_do_not_grow_with_the_square(spark, monkeypatch):
    """Each round sends some ``fan`` rows of each n for a chunk. Sent straight to as many ranges as there are chunks, they would be three for each pair of both."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(3000, 300).astype(str)) for _ in range(120)]
    write, pool = lm_score.materialize, lm_score.pooled
    for n in (60, 120):
        seen = {}
        monkeypatch.setattr(lm_score, "materialize", lambda df, name, seen=seen: seen.setdefault(name, write(df, name)))
        monkeypatch.setattr(lm_score, "pooled", lambda *args, seen=seen: seen.setdefault("pooled", pool(*args)))
        docs = docs_of(spark, texts[:n]).repartition(n, "doc_id")  # a chunk for each partition that isn't empty
        assert lm_score.score_documents(docs, range_tokens=301, most=16).count() == n
        chunks, sent = seen["lm-chunks"].count(), [seen[name].count() for name in ("lm-sent", "pooled", "lm-counts")]
        fan = lm_score.rounds_of(n, 16)[1]
        teams = -(-chunks // fan)
        assert chunks > n / 2
        assert sent[0] == sent[2] <= 3 * fan * chunks
        assert sent[1] <= 3 * fan * fan * teams
        assert sum(sent[:2]) < 3 * n * chunks


def test_op8_lanes_and_blocks_change_nothing(monkeypatch):
    """Texts cut into lanes, and bytes hashed in blocks, give what whole ones give."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefg"), n)) for n in (0, 1, 2, 3, 7, 40, 41, 400)]
    data = "\n".join([*texts, "\t a\x0bb\x0c\r c  \u00e9\u2003x ", "x" * 300, " "]).encode()
    hashes, firsts = lm_score.word_hashes(data)
    split = data.split()
    assert len(hashes) == len(split) and len(set(hashes.tolist())) == len(set(split)) == len(set(zip(hashes.tolist(), split, strict=True)))
    assert [data[f : f + len(w)] for f, w in zip(firsts.tolist(), split, strict=True)] == split
    monkeypatch.setattr(lm_score, "BLOCK", 16)
    again = lm_score.word_hashes(data)
    assert np.array_equal(hashes, again[0]) and np.array_equal(firsts, again[1])

    found = [lm_score.word_hashes(t.encode())[0] for t in texts]
    own, place = np.unique(np.concatenate(found), return_inverse=True)
    row = {"hashes": own.tobytes(), "words": lm_score.pack(place), "lengths": [len(f) for f in found], "held": [i % 2 == 1 for i in range(len(texts))]}
    chunk = lm_score.Chunk(row, 64)
    automaton = lm_score.BackoffAutomaton(chunk, (chunk.counts[1] + 0.5) / 1000)
    whole = automaton.scores(chunk.tokens, chunk.first, chunk.last)
    for lane in (2, 3, 7, 40):
        assert automaton.scores(chunk.tokens, chunk.first, chunk.last, lane) == pytest.approx(whole)


def test_op8_packs_what_it_unpacks():
    for values in ([], [0], [0, 0], [1, 255, 256], [2**64 - 1, 0]):
        assert lm_score.unpack(lm_score.pack(np.array(values, np.uint64)), len(values)).tolist() == values


def test_op8_on_odd_rows(spark):
    rows = lm_score.score_documents(docs_of(spark, [*ODD, "b b", "b b"], [*range(len(ODD)), None, None])).collect()
    assert len(rows) == len(ODD) + 2
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 and r["n_tokens"] >= 1 for r in rows)
    assert lm_score.score_documents(docs_of(spark, [])).count() == 0
    untrained = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert [r["score"] for r in lm_score.score_documents(docs_of(spark, ["a b"], [untrained])).collect()] == [0.0]


def test_op10_query_is_right_on_held_out_documents(spark, sf_dir, documents):
    rows = queries()["op10_language_id"](spark, sf_dir).join(documents, "doc_id").collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_op10_equals_plain_votes(spark, documents, texts):
    """Each document's votes counted one by one, with the machines fitted on the same sample."""
    held = langid.fold(F.col("doc_id"), 4) == 2
    sample = langid.training_sample(documents.select("doc_id", "text", "lang", held.alias("held_out")), langid.PER_LANGUAGE).collect()
    x, langs = np.array([np.frombuffer(r["x"], np.float32) for r in sample]), np.array([r["lang"] for r in sample], object)
    order = sorted(range(len(langs)), key=lambda i: (langs[i], x[i].tobytes()))
    model = langid.LanguageModel(x[order], langs[order])

    def votes(machines, v):
        won, sums = Counter(), Counter()
        for (a, b), w, bias in zip(machines.pairs, machines.weights, machines.bias, strict=True):
            margin = float(v @ w + bias)
            won[a if margin >= 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
        return min(range(len(machines.classes)), key=lambda c: (-won[c], -sums[c], machines.classes[c]))

    for r in langid.identify(documents).collect():
        v = langid.vector(texts[r["doc_id"]] or "")
        machines = model.within[votes(model.families, v)]
        assert r["lang_pred"] == machines.classes[votes(machines, v)]


def test_op10_learns_rare_languages_and_repeated_ids(spark):
    texts = ["the cat and the dog"] * 700 + ["der hund und die katze"] * 3
    docs = docs_of(spark, texts, [*range(700), 3, 3, 3], lang=["en"] * 700 + ["de"] * 3)
    learnt = langid.training_sample(docs.select("doc_id", "text", "lang", F.lit(False).alias("held_out")), 20).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in learnt} == {"en": 20, "de": 1}


def test_op10_repeated_ids_take_no_places(spark):
    """One id 600 times, once with one text and once with many, beside 700 other documents."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    others = [f"the cat {name(i)} and the dog" for i in range(700)]
    for repeated in (["one text of a hot id"] * 600, [f"text {name(i)} of a hot id" for i in range(600)]):
        docs = docs_of(spark, others + repeated, [*range(700), *[5000] * 600], lang=["en"] * 1300)
        sample = langid.training_sample(docs.select("doc_id", "text", "lang", F.lit(False).alias("held_out")), 400)
        assert sample.count() == 400
        if len(set(repeated)) == 1:
            assert sample.distinct().count() == 400


def test_op10_on_odd_rows(spark, documents):
    some = documents.limit(120).collect()
    texts, ids, lang = [r["text"] for r in some], [r["doc_id"] for r in some], [r["lang"] for r in some]
    odd = [None, "", "123 !!", "ß", "日本", *ODD]
    docs = docs_of(spark, [*texts, *odd, *odd], [*ids, *[None] * len(odd), *[10_000] * len(odd)], [*lang, *[None] * (2 * len(odd))])
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r["lang_pred"] for r in rows}
    assert "und" in by
    assert by - {"und"} <= set(lang)
    assert sum(r["lang_pred"] == "und" for r in rows) == 2 * sum(not t or not any(c.isalpha() for c in t) for t in odd)
    assert {r["lang_pred"] for r in langid.identify(docs_of(spark, ["a", None], lang=[None, "en"])).collect()} == {"und"}
    assert langid.identify(docs_of(spark, [])).count() == 0
    one = langid.identify(docs_of(spark, ["hello there"] * 9, lang=["en"] * 9)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}


def test_pipeline_stages_equal_plain_versions(spark, sf_dir, documents, texts):
    import corpus_pipeline
    from granary.llm.common import materialize

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]
    docs, now = documents, dict(texts)
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        if name == "bpe":
            assert {r["doc_id"] for r in out.collect()} == set(now)
            break
        assert out.schema == docs.schema
        found = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            chosen = {r["doc_id"] for r in importance.importance(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("selected").collect()}
            expected = {i: t for i, t in now.items() if i in chosen}
        elif name == "line_dedup":
            expected = line_dedup(list(now.items()))
        elif name == "simhash_near_dedup":
            least = near_groups(now)
            expected = {i: t for i, t in now.items() if least[i] == i}
        else:
            leaked = {r["doc_id"] for r in decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert leaked
            expected = {i: t for i, t in now.items() if i not in leaked}
        assert found == expected, name
        docs, now = out, found


def test_pipeline_on_odd_rows(spark, sf_dir):
    import corpus_pipeline

    for docs in (docs_of(spark, [*ODD, "a", "a"], [*range(len(ODD)), None, 4], lang=[None] * (len(ODD) + 2)), docs_of(spark, [])):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf_dir)
            if name != "bpe":
                assert out.columns == docs.columns
        out.collect()
