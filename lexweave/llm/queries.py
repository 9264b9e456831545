"""The registered queries of the training-data operators and, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bradley_terry, chat, decontaminate, html_extract, license_scan, pii, sentencepiece_codec, simhash, suffix_dedup
from . import quality_rules as quality
from .common import table


def model_path() -> str:
    """The public model that the codec's query reads; a parameter everywhere else."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def _op1_sql() -> str:
    stop = sorted({f for w in quality.STOP_WORDS for f in (w, w.capitalize())})
    listed = ", ".join(f"'{w}'" for w in stop)
    bounds = []
    for r in quality.RULES:
        bounds += [f"coalesce({r.metric} >= {r.least}, true)"] if r.least is not None else []
        bounds += [f"coalesce({r.metric} <= {r.most}, true)"] if r.most is not None else []
    word, verdict = r"[^\x20\x09-\x0D]+", " AND ".join(bounds)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[{quality.SYMBOLS}]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(ls) AS n_lines, len(list_filter(ws, lambda x: x IN ({listed}))) AS n_stop,
        len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_shout
        FROM w LEFT JOIN cov USING (rid)),
ratio AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio,
        n_stop / nullif(n_words, 0) AS stop_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
        n_shout / nullif(n_words, 0) AS shout_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {verdict} AS kept FROM ratio"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(table(spark, sf_dir, "conversations"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), check_digits=True)


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bradley_terry.score(docs, bradley_terry.learn(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS g
       FROM (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g
       FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
hit AS (SELECT DISTINCT rid, i, size, item_id FROM dw JOIN bw USING (size, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), model_path())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules,
            op2_suffix_dedup,
            op3_chat_formatting,
            op4_pii,
            op5_bradley_terry,
            op6_decontamination,
            op7_sentencepiece,
            op8_license_scan,
            op9_html_extraction,
            op10_simhash,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op6_decontamination": _OP6_SQL}
