"""Four stages from raw documents to packed training sequences.

Each stage takes all that its predecessor kept, reread from Parquet: quality rules reject documents,
near-duplicates leave one document of each group, repeated passages are cut out of the texts, and
what is left is packed. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from driftline.llm import minhash, packing, quality, suffix
from driftline.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts have no words and are rejected."""
    judged = quality.assess(docs, keep=docs.columns)
    # The carried columns come last; the first ones are the operator's own.
    names = [f"_{i}" for i in range(len(judged.columns))]
    own = len(names) - len(docs.columns)
    kept = names[judged.columns.index("kept")]
    return judged.toDF(*names).where(F.col(kept)).select(*names[own:]).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id, or any if none has one.

    Rows are linked by their texts alone, under a key of their own: rows that repeat a doc_id stay if
    their texts are not linked, and copies without a doc_id go like others.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = suffix.written(docs.select(row, F.monotonically_increasing_id().alias("key")), "near-keyed")
    linked = minhash.link(keyed, "key", "row.text").select(F.col("doc_id").alias("key"), "component_id")
    first = keyed.select("key", "row.doc_id").join(linked, "key").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key")
    )
    kept = keyed.join(first.select("key"), "key", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: Fifty words of running text have more bytes than this, but for one passage in a hundred.
PASSAGE = 240


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of ``PASSAGE`` bytes that occur elsewhere.

    Null and short texts stay as they are; rows that repeat a longer text are emptied. ``n_chars``,
    if there is one, is counted anew.
    """
    cut = suffix.without_repeats(docs, PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else cut


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, in sequences that keep the mixture of sources.

    A null or empty text is packed as its end token; each row is a document, whatever it repeats.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: SQL has no tokenizer; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
