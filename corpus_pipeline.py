"""A training corpus from ``documents``: quality filter, near-duplicate removal, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Missing optional columns, further columns, nulls, repeated rows and empty
tables are handled as the operators' docstrings say: a null or empty text is judged by the classifier like any
other, is never a near copy, stays null and packs to its end token.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.llm.common import anti_join, free_names, materialize, semi_join, table
from vesselwatch.llm.minhash import near_duplicates
from vesselwatch.llm.packing import pack_documents
from vesselwatch.llm.pii import pseudonymise
from vesselwatch.llm.quality import THRESHOLD, score_quality, train
from vesselwatch.session import shared_dir

#: Demonstration key; a deployment passes its own secret.
PII_KEY = "demonstration-key"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text is scored as the empty one; repeated rows are judged alike; without labels all stay.
    """
    (score,) = free_names(docs, "score")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net, score_col=score).where(F.col(score) >= THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id.

    Rows with a null id or without words stay. Where ids are repeated each row is a document of its own: of those with
    the smallest id the one with the smallest text stays, of equal rows one.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        groups = near_duplicates(docs, width=5, percent=80)
        return anti_join(docs, materialize(groups.where("not kept").select("doc_id"), "copies"), "doc_id")
    row, component, best = free_names(docs, "row", "component", "best")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered.where("doc_id is not null"), id_col=row, width=5, percent=80).where("n_shingles > 0").select(row, F.col("component_id").alias(component))
    groups = materialize(groups.join(numbered.select(row, "doc_id", F.sha2("text", 256).alias("digest")), row), "groups")
    first = groups.groupBy(component).agg(F.min(F.struct("doc_id", "digest", row)).alias(best))
    others = groups.join(first, component).where(F.col(row) != F.col(best)[row]).select(row)
    return anti_join(numbered, materialize(others, "copies"), row).select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars follows the new text where there is one; a null text stays null."""
    out = pseudonymise(docs, PII_KEY, count_col=None)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null or empty text is its end token; null and repeated ids are documents of their own."""
    import public_tokenizers

    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: The classifier and the packer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/llm-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
