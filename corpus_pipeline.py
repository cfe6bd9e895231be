"""The corpus pipeline: quality rules, line dedup, near-dedup by verified similarity, PII surrogates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of ``docs``, with n_chars following the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.bin_packing import packed_documents
from quireflow.llm.line_dedup import line_dedup
from quireflow.llm.pii_surrogates import pseudonymize
from quireflow.llm.quality_rules import quality_filter
from quireflow.llm.similar_sets import similar_groups
from quireflow.llm.store import written

#: A real run passes a secret of its own.
DEMO_KEY = "not a secret: results of this pipeline are published"


def _same_columns(docs: DataFrame, changed: DataFrame) -> DataFrame:
    return changed.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go; so do null and empty texts. Repeated rows are treated alike."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on ten sites or more go from all documents but the one with the smallest id; a null id keeps none. Null texts stay null."""
    return _same_columns(docs, line_dedup(docs, min_sites=10))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    A link is a similarity of 0.8 or more between the sets of five-word shingles, verified on
    the whole sets; groups are connected by links. A null text counts as empty. Rows with a null
    id stay. Of rows with one id, those in other groups are judged on their own; of equal
    rows one stays; of different texts under the smallest id the one with the smallest hash.
    """
    groups = similar_groups(docs, shingle=5, num=4, den=5)
    first = groups.where("k is not null").groupBy("root").agg(F.min(F.struct("k", "t")).alias("m")).select(F.col("m.k").alias("__k"), F.col("m.t").alias("__t"))
    own = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = own.join(first, (F.col("doc_id") == F.col("__k")) & (F.col("__h") == F.col("__t")), "left_semi").dropDuplicates(["doc_id", "__h"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates, the same one for equal values in all rows. Null texts and ids stay."""
    return _same_columns(docs, pseudonymize(docs, DEMO_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens. A null text is empty: a piece of its end alone; repeated rows are each packed."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("pii_surrogates", private_data), ("best_fit_packing", packing)]

#: Sketches, fingerprints, keyed surrogates and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
