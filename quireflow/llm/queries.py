"""The queries of this subpackage: thin digests of its operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.bin_packing import packed_documents
from quireflow.llm.bpe_codec import bpe_round_trip
from quireflow.llm.code_search import sign_codes, top_k
from quireflow.llm.line_dedup import line_dedup
from quireflow.llm.lm_scoring import lm_scores
from quireflow.llm.pii_surrogates import pseudonymize
from quireflow.llm.quality_rules import verdicts
from quireflow.llm.simhash_dedup import simhash_groups
from quireflow.llm.substring_dedup import substring_dedup
from quireflow.llm.token_counts import token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: A real run passes a secret of its own.
DEMO_KEY = "not a secret: results of this query are published"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), modulus=7, held_out=2)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(documents(spark, sf_dir), DEMO_KEY).select("doc_id", "n_entities", "text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), WORD_BPE, capacity=4096, end_id=1)


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir), shingle=3, bits=2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir)).drop("t").withColumnRenamed("k", "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(documents(spark, sf_dir), min_sites=10)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 20."""
    codes = sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(codes, codes.where("id % 20 = 0"), k=10)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), BYTE_BPE, limit=512)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), BYTE_BPE)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), size=50)


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_code_search": op7_code_search,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE: dict[str, str] = {
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), trimmed AS (
  SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM lines
), common AS (
  SELECT x, min(doc_id) AS owner FROM trimmed WHERE x <> '' GROUP BY x HAVING count(DISTINCT site) >= 10
)
SELECT doc_id, count(*) FILTER (x <> '') AS n_lines, count(*) FILTER (doc_id > owner) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR doc_id <= owner), '')) AS kept_sha256
FROM trimmed LEFT JOIN common USING (x) GROUP BY doc_id
""",
    "op7_code_search": """
WITH codes AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS c FROM embeddings
), ranked AS (
  SELECT q.vec_id AS query_id, x.vec_id AS neighbor_id, hamming(q.c, x.c) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.c, x.c), x.vec_id) AS rank
  FROM codes q JOIN codes x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
""",
}
