"""Language identification in two steps: the language family first, then the language within it.

Both steps use one-versus-one linear support vector machines (squared hinge loss) over hashed byte trigrams of the lower-cased
text with everything but letters taken as a space. A text is a point on the unit sphere: the square roots of its
trigrams' shares. Between families there is a machine for each pair of families; within a family one for each pair
of its languages. Each machine votes; ties go to the larger sum of margins, then to the name.

The machines are fitted on a bounded sample, ``PER_LANGUAGE`` training documents of each language at most, chosen by a hash
of their ids and texts; every document is predicted.

Edge cases: a null text and a text without a letter are ``und`` with score 0, as is everything if no training document
has a language. With one language in training, all other texts get it, with score 1. A language that is in no
known family is a family of its own. Null ids count as the empty text for the fold and are not learnt from; repeated rows each get
their row. Learning takes each different (id, text, language) once: copies of a row weigh no more than one, and leave the others' places alone; rows that share
an id but not a text count as different documents. Other columns are ignored. Long texts are read in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import broadcast_small, fold, materialize, ship_package, text_digest

#: Families of languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
}
PER_LANGUAGE = 400
#: Documents that are ranked for each one that is learnt from. A language with fewer ids than that is ranked whole.
SPARE = 3
BUCKETS = 1 << 12
#: Strength of the L2 penalty on a machine's weights, and gradient steps.
PENALTY, STEPS = 1e-3, 150
_SLICE = 1 << 20
_TABLE = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_has_letter = regex.compile(r"\p{L}").search


def vector(text: str) -> np.ndarray:
    """Square roots of the shares of the text's hashed trigrams."""
    counts = np.zeros(BUCKETS)
    for at in range(0, len(text), _SLICE):
        raw = b" ".join([b"", *text[at : at + _SLICE].lower().encode().translate(_TABLE).split(), b""])
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1))


def fit_machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps; y is 1 or -1."""
    used = np.flatnonzero(x.any(axis=0))  # a trigram that no text has gets no weight
    x = np.hstack([x[:, used], np.ones((len(x), 1))]).astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)  # both sides count alike
    y = y.astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1.0 / (2 * 2.0 + PENALTY))  # rows have norm sqrt(2), the shares sum to one
    for step in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (PENALTY * ahead - 2 * ((share * y * slack) @ x))
        ahead = (new + np.float32(step / (step + 3)) * (new - w)).astype(np.float32)
        w = new
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-1]
    return weights, float(w[-1])


class Machines:
    """One-versus-one machines among some classes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        fitted = []
        for a, b in self.pairs:
            own = (labels == self.classes[a]) | (labels == self.classes[b])
            fitted.append(fit_machine(x[own], np.where(labels[own] == self.classes[a], 1.0, -1.0)))
        self.weights = np.array([w for w, _ in fitted]).reshape(len(fitted), x.shape[1])
        self.bias = np.array([b for _, b in fitted])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, confidence between 0 and 1) of each row."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights.T + self.bias
        votes, sums = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (a, b) in enumerate(self.pairs):
            first = margin[:, k] >= 0
            votes[:, a] += first
            votes[:, b] += ~first
            sums[:, a] += margin[:, k]
            sums[:, b] -= margin[:, k]
        best = np.array([np.lexsort((np.arange(n)[::-1], s, v))[-1] for v, s in zip(votes, sums, strict=True)])
        mean = sums[np.arange(len(x)), best] / (n - 1)
        return best, 1 / (1 + np.exp(-3 * mean))


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: np.ndarray, families: dict[str, list[str]] = FAMILIES):
        family_of = {lang: family for family, members in families.items() for lang in members}
        own = np.array([family_of.get(lang, f"other: {lang}") for lang in langs.tolist()])
        self.families = Machines(x, own)
        self.within = [Machines(x[own == f], langs[own == f]) for f in self.families.classes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.families.predict(x)
        names, score = [""] * len(x), np.zeros(len(x))
        for f, machines in enumerate(self.within):
            at = np.flatnonzero(family == f)
            if len(at):
                lang, within = machines.predict(x[at])
                score[at] = sure[at] * within
                for i, k in zip(at.tolist(), lang.tolist(), strict=True):
                    names[i] = machines.classes[k]
        return names, score


def training_sample(source: DataFrame, per_language: int) -> DataFrame:
    """(lang, x): the hashed trigrams of at most ``per_language`` training documents of each language.

    Rows are made distinct by id and text first. Only the documents whose hash is low enough to be among them, some ``SPARE`` times as many, are ranked, so no
    language gathers in one task.
    """
    learnt = source.where("NOT held_out AND lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").withColumn("digest", text_digest("text"))
    narrow = learnt.select("doc_id", "lang", "digest").withColumn("h", F.xxhash64("doc_id", "digest"))
    ids = materialize(narrow.groupBy("lang").agg(F.approx_count_distinct("h").alias("ids")), "langid-languages").withColumnRenamed("lang", "l")
    lot = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    likely = narrow.withColumn("lot", lot).join(broadcast_small(ids), F.col("lang") == F.col("l")).where(F.col("lot") * F.col("ids") <= SPARE * per_language)
    different = likely.select("doc_id", "lang", "digest", "lot").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("lot", "doc_id", "digest"))
    chosen = different.withColumn("place", place).where(F.col("place") <= per_language)
    chosen = chosen.select(F.col("doc_id").alias("chosen"), F.col("lang").alias("chosen_lang"), F.col("digest").alias("chosen_digest"))
    chosen = F.broadcast(materialize(chosen, "langid-sample"))  # ``per_language`` rows for each language at most
    same = (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("chosen_lang")) & (F.col("digest") == F.col("chosen_digest"))
    rows = learnt.join(chosen, same).groupBy("doc_id", "lang", "digest").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(text.as_py()).astype(np.float32).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    return rows.where(F.col("text").rlike(r"\p{L}")).select("lang", "text").mapInArrow(run, "lang string, x binary")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    ship_package(spark)
    held = fold(F.col(id_col), folds) == held_fold
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    sample = training_sample(source, per_language).toArrow()
    x = np.array([np.frombuffer(v.as_py(), np.float32) for v in sample.column("x")]).reshape(sample.num_rows, BUCKETS)
    langs = np.array(sample.column("lang").to_pylist(), object)
    order = sorted(range(len(langs)), key=lambda i: (langs[i], x[i].tobytes()))  # the fit must not depend on tasks' order
    model = spark.sparkContext.broadcast(LanguageModel(x[order], langs[order]) if len(langs) else None)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for first in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(first, 512).to_pylist()
                at = [i for i, text in enumerate(texts) if text and _has_letter(text)]
                if at and model.value is not None:
                    found, score = model.value.predict(np.array([vector(texts[i]) for i in at]))
                    for i, name, s in zip(at, found, score.tolist(), strict=True):
                        names[first + i], scores[first + i] = name, s
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return source.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
