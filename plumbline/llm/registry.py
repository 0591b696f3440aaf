"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, warc
from plumbline.llm.bpe import digests, encode
from plumbline.llm.common import LOWER, UPPER, table
from plumbline.llm.exact_dedup import digest, exact_dedup
from plumbline.llm.language import held_out, identify, learn_from
from plumbline.llm.line_dedup import line_matches
from plumbline.llm.mixing import mix
from plumbline.llm.near_dedup import near_classes
from plumbline.llm.pii import find_pii
from plumbline.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup(docs.withColumn("text_sha256", digest(F.col("text"))))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL["op1_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op4_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    # A row for each document again, in two steps, so that no long array is made.
    each = mixed.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 4096))))
    each = each.withColumn("nth", F.explode(F.sequence(F.col("step") * 4096 + 1, F.least("rows", F.col("step") * 4096 + 4096))))
    copies = F.col("base") + (F.col("nth") <= F.col("ups")).cast("int")
    return each.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn_from(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_trees(chat.from_turns(rows)))


ORACLE_SQL["op2_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    [role, text] AS parts FROM c
), e AS (
  SELECT *, list_sum(list_transform(parts, lambda p: length(replace(replace(p, '\', '\\'), '</turn>', '<\/turn>'))
    + coalesce(list_sum(list_transform(regexp_extract_all(p, '###+'), lambda x: length(x) - 2)), 0)))
    + length(role) - length(replace(role, ':', '')) AS chars FROM o
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || ': ' || '</turn>' || chr(10)) + chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.build(table(spark, sf_dir, "pages"))
    return made.select(
        F.col("source_id").cast("long").alias("page_id"), "kind", "record_id", "refers_to", "concurrent_to", "target_uri",
        "block_digest", "source_digest", "content_length", F.sha2(F.encode("record", "UTF-8"), 256).alias("record_sha256"),
    )


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_matches(table(spark, sf_dir, "documents")).drop("lh")
