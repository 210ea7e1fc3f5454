"""Incremental index: new files of documents are added to an index of postings, and standing questions are asked of it.

    python -m jobs.index_documents --input DIR --output DIR --checkpoint DIR [--config FILE]

Reads a growing folder of Parquet files (doc_id, text) as a stream that ends when nothing new is left; its checkpoint
remembers the files taken. Each micro-batch is a batch of the index (OUTPUT/index, partitioned by batch and bucket of
the term): a batch that broke off is written again under its number. Then the questions of the configuration are
asked of the whole index, whose statistics are those of all batches, and OUTPUT/answers (partitioned by question) is
replaced. A run without new files leaves the index and the answers as they are.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import log, read_config, settings, show_log
from seekwell.operators import postings
from seekwell.sources.cuts import run_folder

CONFIG = "index_documents.json"


def take_new(spark: SparkSession, config: dict, source: str, output: str, checkpoint: str) -> dict[str, int]:
    """Adds what is new at ``source`` to the index; returns the sums of this run."""
    total = {"batches": 0, "n_docs": 0, "total_dl": 0}

    def add(batch: DataFrame, number: int) -> None:
        with run_folder(spark):
            sums = postings.add(batch, f"{output}/index", number, "doc_id", "text", config["buckets"])
        log.info("index_documents batch %s: %s", number, sums)
        total["batches"] += 1
        for name, n in sums.items():
            total[name] += n

    schema = spark.read.parquet(source).select("doc_id", "text").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return total


def answers(spark: SparkSession, config: dict, output: str) -> DataFrame:
    """(question, nth, doc_id, score): the best documents of each question."""
    found = []
    for name, question in sorted(config["questions"].items()):
        got = postings.search(spark, f"{output}/index", question, config["documents_per_question"], config["buckets"])
        log.info("index_documents question %s: %s ranges hold a term of it, %s scored", name, got.ranges, got.scored)
        found.append(got.best.select(F.lit(name).alias("question"), F.col("id").alias("doc_id"), F.round("lex", 6).alias("score")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.select("question", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "doc_id")).alias("nth"), "doc_id", "score")


def run(spark: SparkSession, config: dict, source: str, output: str, checkpoint: str) -> DataFrame:
    """The whole job; returns all output as it stands: part ``index``, a row (doc_id, term, tf) for each term of a document, and part
    ``answers``, a row (question, nth, doc_id, score) for each answer; what a part doesn't have is empty or 0."""
    took = take_new(spark, config, source, output, checkpoint)
    log.info("index_documents read %s documents of new files at %s in %s batches", took["n_docs"], source, took["batches"])
    if took["batches"] and config["questions"]:
        with run_folder(spark), settings(spark, spark__sql__sources__partitionOverwriteMode="static"):
            answers(spark, config, output).write.mode("overwrite").partitionBy("question").parquet(f"{output}/answers")
        log.info("index_documents wrote answers to %s/answers", output)
    blank, none = F.lit(""), F.lit(0)
    index = postings.frequencies(spark, f"{output}/index", "doc_id").select(F.lit("index").alias("part"), blank.alias("question"), none.alias("nth"), "doc_id", F.lit(0.0).alias("score"), "term", "tf")
    if not config["questions"]:
        return index
    stored = spark.read.schema("nth int, doc_id long, score double, question string").parquet(f"{output}/answers")
    return index.unionByName(stored.select(F.lit("answers").alias("part"), "question", "nth", "doc_id", "score", blank.alias("term"), none.cast("long").alias("tf")))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.index_documents", description=__doc__.split("\n")[0])
    parser.add_argument("--input", required=True, help="folder (or pattern) of Parquet files")
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--config", help=f"JSON file; {CONFIG} beside the job by default")
    args = parser.parse_args(argv)
    show_log()
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    try:
        run(spark, read_config(args.config, CONFIG), args.input, args.output, args.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
