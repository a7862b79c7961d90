"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, decontam, exact_dedup, hard_negatives, importance, langid, line_dedup, lm_score, pieces, simhash, token_scan, training_order, whitening
from granary.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_removed, n_chars and text_sha256 of what is left of each text."""
    cleaned = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"), removed_col="lines_removed")
    text = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "lines_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("digest")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(documents(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are ids divisible by 100; ids divisible by 7 have the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(embeddings(spark, sf_dir).withColumn("label", moved), F.col("id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), l AS (
  SELECT rid, doc_id, pos, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL)
), r AS (
  SELECT *, ((coalesce(lag(h) OVER w, 0) % 2147483647) * 31 + h) % 2147483647 AS roll, sum(words) OVER w AS upto FROM l WINDOW w AS (PARTITION BY rid ORDER BY pos)
), b AS (
  SELECT *, roll < coalesce(lag(roll) OVER w, 2147483647) AND roll < coalesce(lead(roll) OVER w, -1) AS cut FROM r WINDOW w AS (PARTITION BY rid ORDER BY pos)
), n AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no FROM b
), c AS (
  SELECT rid, doc_id, min(pos) AS spot, count(*) AS lines, string_agg(line, chr(10) ORDER BY pos) AS piece FROM n GROUP BY rid, doc_id, chunk_no HAVING count(*) > 1
), e AS (
  SELECT x.rid, x.doc_id, x.pos AS spot, min(y.pos) AS stop FROM r x JOIN r y ON x.rid = y.rid AND y.pos BETWEEN x.pos AND x.pos + 63 AND y.upto - x.upto + x.words > 50 GROUP BY x.rid, x.doc_id, x.pos
), s AS (
  SELECT e.rid, e.doc_id, e.spot, e.stop - e.spot + 1 AS lines, string_agg(l.line, chr(10) ORDER BY l.pos) AS piece FROM e JOIN l ON l.rid = e.rid AND l.pos BETWEEN e.spot AND e.stop GROUP BY e.rid, e.doc_id, e.spot, e.stop
), f AS (
  SELECT *, first_value(rid) OVER w AS first_rid, first_value(spot + lines) OVER w AS first_end FROM (SELECT * FROM c UNION SELECT * FROM s) WINDOW w AS (PARTITION BY piece ORDER BY doc_id, rid, spot, lines)
), g AS (
  SELECT DISTINCT l.rid, l.pos FROM f JOIN l ON l.rid = f.rid AND l.pos BETWEEN f.spot AND f.spot + f.lines - 1 WHERE f.first_rid <> f.rid OR f.first_end <= f.spot
), t AS (
  SELECT l.rid, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.rid IS NULL), '') AS text, count(g.rid) AS lines_removed FROM l LEFT JOIN g ON l.rid = g.rid AND l.pos = g.pos GROUP BY l.rid
)
SELECT d.doc_id, coalesce(t.lines_removed, 0)::BIGINT AS lines_removed, length(coalesce(t.text, '')) AS n_chars, sha256(coalesce(t.text, '')) AS text_sha256
FROM d LEFT JOIN t USING (rid)
"""


OP12_SQL = """
WITH q AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(c AS DOUBLE)) for c in embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM q a JOIN q b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a, anchor_id, b AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_simhash": op2_simhash,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_bpe_codec": op4_bpe_codec,
        "op5_line_dedup": op5_line_dedup,
        "op6_importance_resampling": op6_importance_resampling,
        "op7_training_order": op7_training_order,
        "op8_lm_score": op8_lm_score,
        "op9_decontamination": op9_decontamination,
        "op10_language_id": op10_language_id,
        "op11_piece_codec": op11_piece_codec,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op12_hard_negatives": OP12_SQL}
