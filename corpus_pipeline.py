"""A corpus pipeline of the operators in ``campaignlens.llm``: quality, near duplicates, contamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and read again for the next one. All but the
last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.llm.bpe import encode_decode
from campaignlens.llm.common import materialize, table
from campaignlens.llm.decontam import find_contamination
from campaignlens.llm.minhash import near_duplicates
from campaignlens.llm.quality import crc_of, score_quality, train_quality
from campaignlens.llm.secrets import redact_spans, scan_secrets

#: Training the quality model and folding of samples have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of 0.3 or more; the model is trained on this stage's documents and the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(crc_of(F.col("doc_id"), 5) != 0)
    return score_quality(docs, train_quality(docs, labels), out="__score").where("__score >= 0.3").select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id: five-word shingles, similarity 0.8 or more. Documents without an id stay."""
    groups = near_duplicates(docs)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0 OR 20 * n_hit < n_words").select(docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    clean = scan_secrets(docs, out="__spans").withColumn("text", redact_spans("text", "__spans"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    import public_tokenizers

    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
