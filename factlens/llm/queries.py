"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .components import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(*first, "quality")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    return linededup.report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    from . import decontam

    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    return urls.judge(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: op2: identifiers are not repeated in the driver's table, so the only error is a missing result.
_OP2 = """
WITH RECURSIVE u AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
l(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.conv_id = u.conv_id AND v.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, l.level + 1 FROM l JOIN u ON u.conv_id = l.conv_id AND u.turn = l.turn + 2)
SELECT u.conv_id, u.turn, 'call-' || u.conv_id || '-' || u.turn AS id, l.level, a.turn AS result_turn,
  CASE WHEN a.turn IS NULL THEN 'no result' ELSE '' END AS errors, a.turn IS NOT NULL AS valid,
  '{"arguments":{' || CASE WHEN u.turn >= 2 THEN '"after":"call-' || u.conv_id || '-' || (u.turn - 2) || '",' ELSE '' END || '"prompt":' || CAST(to_json(u.text) AS VARCHAR)
  || ',"turn":' || u.turn || '},"id":"call-' || u.conv_id || '-' || u.turn || '","name":"reply","result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS json
FROM u JOIN l USING (conv_id, turn) LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1"""

_OP10 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, k.y FROM r JOIN k ON r.other = k.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2"""

SQL: dict[str, str] = {"op2_chat_format": _OP2, "op10_ngram_jaccard": _OP10}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
