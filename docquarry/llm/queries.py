"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import ann, chat, licenses, ngram_join, packing, quality, secrets_scan, sp_bpe, token_counts, token_files
from docquarry.llm.common import read_table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join("'" + w + "'" for w in sorted({v for w in quality.STOP_WORDS for v in (w, w.capitalize())}))

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
        len(list_intersect(list_distinct(ws), [{_STOP}])) AS stop_kinds,
        len(regexp_extract_all(t, '\p{{Lu}}')) AS upper, len(regexp_extract_all(t, '\p{{Lu}}|\p{{Ll}}')) AS letters
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15 AND n_symbols / greatest(n_words, 1) <= 0.1
  AND stop_kinds >= 2 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND upper / greatest(letters, 1) <= 0.5 AS kept
FROM b
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets_scan.train(secrets_scan.labelled_samples(spark))
    return secrets_scan.report(read_table(spark, sf_dir, "documents"), model)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    planted = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat.digests(chat.format_windows(turns))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.report(read_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY sh) END AS class_id FROM s),
e AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS m FROM n UNION SELECT u.b, c.m FROM c JOIN u ON u.a = c.doc_id),
m AS (SELECT doc_id, min(m) AS component_id FROM c GROUP BY 1),
d AS (SELECT a AS doc_id, count(*) AS others FROM u GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, CAST(coalesce(d.others, 0) AS BIGINT) AS n_similar, m.component_id, n.class_id
FROM n JOIN m ON m.doc_id = n.doc_id LEFT JOIN d ON d.doc_id = n.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_nearest": op2_nearest,
        "op3_quality": op3_quality,
        "op4_token_counts": op4_token_counts,
        "op5_licenses": op5_licenses,
        "op6_secrets": op6_secrets,
        "op7_chat": op7_chat,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_token_files": op9_token_files,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op3_quality": OP3_SQL}
