"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, bpe, chat, quality, simhash, substring, tokenbin, toxicity, urlfilter
from .common import table

#: Name of the vocabulary file of the queries; ``public_tokenizers`` knows its place.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text. Null is as empty: no tokens, digests of nothing. A row for each row, repeats and null ids included; empty tables give none."""
    return bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), emit=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


TOXIC_FROM = 0.3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learnt from those of ``docs`` whose label is not held out."""
    return toxicity.train(toxicity.training_rows(docs, labels, fold(F.col("doc_id")) != 2))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text; learnt from labels that are not held out. Null and empty texts score as the intercept, null ids are not held out. Without labels of both kinds all scores are one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))).alias("held_out"), "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op3_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the ids of every text into rows, each with its segments. Null and empty texts add their end id alone; repeated rows are packed each; an empty table gives no rows."""
    return tokenbin.pack_token_rows(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and read it back. Null texts and roles are empty; equal turns go by role, then text; orders of roles that are not valid are formatted and flagged."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    return chat.read_back(chat.format_chats(rows.unionByName(spark.sql(own))))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take repeated 50-word windows out of every text. A null text has no words; a row with a null id loses nothing and takes nothing; rows that repeat an id are judged against smaller ids."""
    done = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url, by rules first. A null url or one without :// has an empty host and path, and the verdict of the model; the longest rule wins; repeated rows are judged each."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES, urlfilter.train(spark)).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every text into few sequences. Null and empty texts are one piece, the end id; rows that repeat an id are packed each; an empty table gives no pieces."""
    return bestfit.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every text by its lines. Null and empty texts have no words and fail; repeated rows are judged each; an empty table gives no rows."""
    judged = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of the query vectors. Null, zero and not finite vectors take no part; of rows that share an id the nearest counts; ties go to the smaller id; fewer candidates give fewer rows."""
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all texts. Null and empty texts have fingerprint zero, linked like any other; rows that repeat an id each have a row; an empty table gives none."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe_roundtrip, op2_toxicity, op3_token_rows, op4_chat_format, op5_substring_dedup, op6_url_filter, op7_best_fit, op8_quality_rules, op9_nearest, op10_simhash)
}

_CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<|role|>", "<|text|>", "<|end|>")
_ESCAPES = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in _CONTROLS)

ORACLE: dict[str, str] = {
    "op8_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT rid, i, array_to_string(list_slice(words, i, i + 4), ' ') AS content
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, content) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY rid),
lines AS (SELECT rid, line, length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) AS chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, length(line) - length(replace(line, '!', '')) AS shouts,
    length(line) - length(regexp_replace(line, '[|»›•]', '', 'g')) AS bars, regexp_matches(lower(line), 'PHRASES') AS phrase
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dup,
    coalesce(sum(chars) FILTER ((symbols >= 3 AND symbols > n * 0.3::DOUBLE) OR (bars >= 3 AND n <= bars * 3) OR (shouts >= 3 AND shouts > n * 0.5::DOUBLE) OR (phrase AND n <= 20)), 0) AS lost
  FROM lines WHERE n > 0 GROUP BY rid
),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN judged USING (rid) LEFT JOIN covered c USING (rid)
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= word_chars * 0.3::DOUBLE) AS kept FROM f""".replace(
        "PHRASES", "|".join(quality.PHRASES)
    ),
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY content) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS at FROM repeats),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM w)
SELECT w.doc_id, any_value(len(w.words))::BIGINT AS n_words, count(g.at)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.at) FILTER (g.at IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN each e ON e.doc_id = w.doc_id LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at = e.at
GROUP BY w.doc_id""",
    "op4_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), t AS (
  SELECT *, row_number() OVER w AS rn, lag(role, 1, '') OVER w AS before, lead(role) OVER w AS after,
    length(text) + (length(text) - length(replace(text, '␛', ''))) + {_ESCAPES} AS escaped
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 18 ELSE 23 + length(role) END)::BIGINT AS formatted_chars,
  bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM t GROUP BY conv_id""",
}

__all__ = ["ORACLE", "QUERIES", "vocabulary_path"]
