"""The queries opN_<name> and pipeline, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, exact_dedup, licenses, mixing, ngram_join, sharding, substring_dedup, toxicity, url_filter
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(url_filter.rule_labels(pages).where("NOT held_out")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), short_lines=True)


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_toxicity, op3_mixing, op4_url_filter, op5_license_scan, op6_decontamination, op7_sharding, op8_ngram_join, op9_exact_dedup, op10_substring_dedup)}


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Added characters of an escaped text: one for each backslash and for each control string.
_ESCAPED = " + ".join(["length({0})"] + [f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ["\\", *chat.CONTROL]])
_MARKS = len(chat.OPEN + chat.CLOSE + chat.END)


def _shingles(table: str, key: str, pattern: str, k: int) -> str:
    """CTE bodies: words of each row, and its distinct shingles (a row of fewer words is one)."""
    return f"""{table}_w AS (SELECT {key} AS id, regexp_extract_all({ASCII_LOWER}, '{pattern}') AS w FROM {table}),
{table}_s AS (SELECT DISTINCT id, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM {table}_w WHERE len(w) > 0)),
{table}_n AS (SELECT id, count(*) AS n FROM {table}_s GROUP BY id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum({_MARKS} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, false AS rewrites_history FROM c""",
        "op6_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM b) ON len(w) >= k)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, n_shared, n_shared / n AS containment FROM m JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n""",
        "op8_ngram_join": f"""
WITH RECURSIVE {_shingles("documents", "doc_id", "[^\\x20\\x09-\\x0D]+", 3)},
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM documents_s a JOIN documents_s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN documents_n p ON p.id = x JOIN documents_n q ON q.id = y WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, y FROM reach JOIN link ON x = other)
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN documents_n USING (id) GROUP BY id""",
        "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({ASCII_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    }
