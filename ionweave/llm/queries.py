"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import table


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers as files

    return {"json": files.path("byte_bpe_50k.json"), "ranks": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.token_counts import byte_bpe_vocabulary, token_counts

    return token_counts(table(spark, sf_dir, "documents"), byte_bpe_vocabulary(tokenizer_files()["ranks"]))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.best_fit_packing import layout, packed_sequences

    files = tokenizer_files()
    return layout(packed_sequences(table(spark, sf_dir, "documents"), files["json"], files["ranks"], files["pattern"])[0])


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """Each turn replies to the one before it; equal turn numbers are ordered by role and text."""
    from pyspark.sql import Window

    control = "</s>[INST] ok [/INST]"
    added = conversations.sparkSession.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(added)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select(F.col("conv_id").alias("tree_id"), place.alias("node_id"), (place - 1).alias("parent_id"), "role", "text")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.chat_formatting import chat_formatting, read_back

    return read_back(chat_formatting(conversation_rows(table(spark, sf_dir, "conversations")))).withColumnRenamed("tree_id", "conv_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.source_mixing import mix_counts, taken

    mixed = mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", taken(F.col("copies"), F.col("size")).alias("taken"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.line_frequency import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_quality_classifier,
        op2_token_counts,
        op3_best_fit_packing,
        op4_lm_scoring,
        op5_exact_dedup,
        op6_chat_formatting,
        op7_source_mixing,
        op8_quality_rules,
        op9_ngram_jaccard_join,
        op10_warc,
        pipeline,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": EXACT_DEDUP_SQL, "op6_chat_formatting": CHAT_SQL, "op8_quality_rules": QUALITY_RULES_SQL, "op9_ngram_jaccard_join": JACCARD_SQL, "op10_warc": WARC_SQL}


EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), s AS (
  SELECT doc_id, length(raw) AS size, sha256(norm) AS text_sha256, norm FROM t
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM s
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|unk>|pad>|INST\]|/INST\])', '\1\\\2\3', 'g') AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

QUALITY_RULES_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
windows AS (SELECT id, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS n FROM windows),
covered AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM again WHERE n > 1) GROUP BY id),
lines AS (SELECT id, source, text, unnest(string_split(text, chr(10))) AS line FROM w),
full_lines AS (SELECT id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  regexp_replace(translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY id),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM t GROUP BY source),
common AS (SELECT l.source, l.norm FROM full_lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.norm, h.n HAVING count(DISTINCT l.text) > 20 AND count(DISTINCT l.text) > h.n * 0.01),
lost AS (SELECT l.id, sum(l.n) AS n FROM full_lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY l.id),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_line_words
  FROM w LEFT JOIN dup USING (id) LEFT JOIN covered USING (id) LEFT JOIN lost USING (id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_line_words > 0 AND n_words - n_line_words < 0.3 * n_words) AS kept FROM f
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x, min(y) AS least FROM r GROUP BY x),
c AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT w.doc_id, least(w.doc_id, coalesce(k.least, w.doc_id)) AS class_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, CAST(coalesce(n.n, 0) AS INTEGER) AS n_shingles
FROM w LEFT JOIN k ON k.x = w.doc_id LEFT JOIN c ON c.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p),
g AS (SELECT *, list_transform(range(8), lambda j: CAST('0x' || substr(h, 1 + 5 * CAST(j AS INTEGER), 5) AS BIGINT)) AS v FROM d),
b AS (SELECT *, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((x >> k) & 31 AS INTEGER), 1)), '')), '') AS payload_digest FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
