"""Evidence report: for each question of the configuration the best documents of a corpus with verbatim excerpts.

    python -m jobs.evidence_report --input DIR --output DIR [--config FILE]

Reads DIR/documents.parquet (doc_id, text), ranks all documents for all questions in one pass over their texts, and
cuts windows of lines around the words that a question asks for. Writes Parquet partitioned by question: nth, doc_id,
score, start_line, end_line, source (the lines), cut (whether the excerpt was too long). The report replaces what is
at the output, so a run over the same input gives the same rows, and one that follows a broken run mends it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import log, read_config, settings, show_log
from seekwell.functions.text import inflections, line_count, query_terms, terms
from seekwell.operators import ranges
from seekwell.operators.bm25 import bm25_many
from seekwell.sources.cuts import cut, run_folder

CONFIG = "evidence_report.json"


def best_documents(docs: DataFrame, questions: dict[str, str], least: float, k: int) -> DataFrame:
    """(question, doc_id, score, nth): the ``k`` best of each question, ties by id."""
    scored = bm25_many(docs, questions, "doc_id").where(F.col("lex") >= least).select("question", "doc_id", F.round("lex", 6).alias("score"))
    nth = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k)


def hit_lines(found: DataFrame, questions: dict[str, str]) -> DataFrame:
    """(path, line): lines of found documents (path, question, text) that hold an inflection of a word of their question."""
    lines = found.select("path", "question", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    held = F.lit(False)
    for name, q in sorted(questions.items()):
        words = sorted({w for t in query_terms(q) for w in inflections(t)})
        held = F.when(F.col("question") == name, F.arrays_overlap("words", F.array(*map(F.lit, words)))).otherwise(held)
    return lines.withColumn("words", terms(F.col("line_text"))).where(held).select("path", (F.col("at") + 1).alias("line"))


def run(spark: SparkSession, config: dict, source: str, output: str) -> DataFrame:
    """The whole job; returns the report as read back from ``output``."""
    with run_folder(spark):  # the report is written when its cuts go
        return report(spark, config, source, output)


def report(spark: SparkSession, config: dict, source: str, output: str) -> DataFrame:
    questions = config["questions"]
    read = Observation("evidence_report_read")
    docs = spark.read.parquet(f"{source.rstrip('/')}/documents.parquet").select("doc_id", "text")
    watched = docs.observe(read, F.count("*").alias("documents"), F.count("text").alias("texts"))
    best = best_documents(watched, questions, config["least_score"], config["documents_per_question"])
    # At most documents_per_question rows for each question: small enough to send to the scan that fetches their texts.
    # They're written once, since lines, windows and excerpts would each scan the whole corpus for them again.
    found = cut(docs.join(F.broadcast(best), "doc_id").select(F.concat_ws("/", "question", F.col("doc_id").cast("string")).alias("path"), "question", "nth", "doc_id", "score", "text"))
    lines = hit_lines(found, questions)
    windows = ranges.expand(lines.select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line")), found.select("path", line_count(F.col("text")).alias("n_lines")))
    excerpts = ranges.excerpts(windows, found.select("path", F.col("text").alias("source")), most=config["excerpt_bytes"])
    rows = found.drop("text").join(excerpts, "path").select("question", "nth", "doc_id", "score", "start_line", "end_line", "source", "cut")
    written = Observation("evidence_report_written")
    out = rows.observe(written, F.count("*").alias("excerpts"), F.sum(F.octet_length("source")).alias("bytes")).repartition("question").sortWithinPartitions("question", "nth", "start_line")
    with settings(spark, spark__sql__sources__partitionOverwriteMode="static"):
        out.write.mode("overwrite").partitionBy("question").parquet(output)
    log.info("evidence_report read %s from %s", read.get, source)
    log.info("evidence_report wrote %s to %s", written.get, output)
    return spark.read.schema(rows.select("nth", "doc_id", "score", "start_line", "end_line", "source", "cut", "question").schema).parquet(output)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.evidence_report", description=__doc__.split("\n")[0])
    parser.add_argument("--input", required=True, help="folder that holds documents.parquet")
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", help=f"JSON file; {CONFIG} beside the job by default")
    args = parser.parse_args(argv)
    show_log()
    spark = SparkSession.builder.appName("evidence_report").getOrCreate()
    try:
        run(spark, read_config(args.config, CONFIG), args.input, args.output)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
