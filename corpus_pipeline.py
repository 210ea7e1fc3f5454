"""From raw documents to packed training sequences: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents (doc_id, text, lang, source, n_chars); the last returns a row per piece of a document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.llm import line_dedup, mixing, packing, quality_rules, shared, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the rules reject go."""
    return quality_rules.kept_rows(docs, public_tokenizers.path(quality_rules.MODEL))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated lines go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    out = out if n_chars is None else out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, n_chars).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group stays."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as the mix takes it, in training order."""
    return mixing.training_order(mixing.mix(docs, docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of documents with their sequence and place in it."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY), packing.END_ID)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_dups), ("mixing", mixture), ("packing", sequences)]

#: Tokenisers and fingerprints have no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written to the shared folder and read again.

    What a stage writes for itself goes when its rows are written, and these when the next stage's are: of a run only its result is left."""
    docs, folder, before = shared.documents(spark, sf_dir), shared.shared_dir(spark), None
    for name, stage in STAGES:
        with shared.run_folder(spark):
            docs = shared.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"), folder)
        if before:
            shared.remove(spark, before)
        before = f"{folder}/{name.replace(' ', '-')}"
    return docs
