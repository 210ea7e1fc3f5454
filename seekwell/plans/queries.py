
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import evidence_report, index_documents
from jobs.common import read_config

from ..functions import paths, text
from ..operators import bm25 as lexical
from ..operators import describe, graph, judge, postings, ranges, ranking
from ..operators.units import text_chunks as chunk_texts
from ..sources.cuts import shared_folder, spread
from ..sources.reader import snapshot_status
from . import paths_of_documents
from .render import json_files

QUERY = "How are theReadings heated onder tionShed?"
HIT = "heat"
#: Phrases that a scan of all texts takes at once.
PHRASES = 10_000
NOW = "2024-02-05 00:00:00"
#: Tables whose rows are worth a core each, with their keys: small files of them are dealt out before the text functions run.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found, TEXTS[name]) if name in TEXTS else found


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "source", paths_of_documents.derived_path(F.col("doc_id"), F.col("source")).alias("path"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "turn", "text")


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T3, A3."""
    return lexical.term_frequencies(_docs(spark, sf_dir), "doc_id")


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5."""
    return lexical.corpus_stats(_docs(spark, sf_dir), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


def _lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf_dir), QUERY, "doc_id")


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6-T8."""
    return _lex(spark, sf_dir).select("doc_id", F.round("lex", 6).alias("lex"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 40."""
    best = ranking.top(_lex(spark, sf_dir).select("doc_id", F.round("lex", 6).alias("score")), "doc_id")
    return best.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk out of an index of postings, which is built in the shared folder first."""
    path = f"{shared_folder(spark)}/postings/{uuid.uuid4().hex}"
    postings.add(_docs(spark, sf_dir), path, 0, "doc_id")
    best = postings.search(spark, path, QUERY).best.select(F.col("id").alias("doc_id"), F.round("lex", 6).alias("score"))
    return best.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def job1_evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over the whole table, run twice into one new folder."""
    output, config = f"{shared_folder(spark)}/jobs/{uuid.uuid4().hex}", read_config(None, evidence_report.CONFIG)
    for _ in range(2):
        report = evidence_report.run(spark, config, sf_dir, output)
    return report


def job2_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index job over the whole table, run twice with one new folder and checkpoint: the second run finds nothing new. (A stream
    takes a folder or a pattern; the table may be a file.)"""
    folder, config = f"{shared_folder(spark)}/jobs/{uuid.uuid4().hex}", read_config(None, index_documents.CONFIG)
    for _ in range(2):
        output = index_documents.run(spark, config, f"{sf_dir}/documents.parque[t]", f"{folder}/output", f"{folder}/checkpoint")
    return output


def bm25_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(table(spark, sf_dir, "pages"), QUERY, "page_id", "html").select("page_id", F.round("lex", 6).alias("lex"))


def bm25_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(_turns(spark, sf_dir), QUERY, "turn_id").select("turn_id", F.round("lex", 6).alias("lex"))


def bm25_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best turns of each conversation."""
    scores = lexical.bm25(_turns(spark, sf_dir), QUERY, "turn_id", "text", "conv_id").withColumn("lex", F.round("lex", 6)).withColumn("unit_idx", F.col("turn_id"))
    return ranking.top_units(scores, "conv_id", 3).select("conv_id", "turn_id", "lex")


def lexical_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F9."""
    return lexical.before_judge(_lex(spark, sf_dir)).select("doc_id", F.round("lex", 6).alias("lex"), (F.col("lex") >= lexical.MIN_LEXICAL).alias("passes"))


def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F4."""
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", paths.allowed(p).alias("default_policy"), paths.allowed(p, hidden=True).alias("with_hidden"), paths.allowed(p, True, True, False).alias("with_dependencies"), paths.allowed(p, True, True, True).alias("with_all"))


def language_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    return _paths(spark, sf_dir).select("path", paths.language(F.col("path")).alias("language"))


#: FIXTURES.md A4: paths of tests, and of no tests.
TEST_PATHS = ("a/tests/x.rs", "a/testFixtures/x.java", "web/__tests__/a.ts", "a/FooTest.java", "a/FooTests.kt", "a/FooIT.java", "pkg/test_x.py", "pkg/x_test.go", "web/x.test.ts", "web/x.spec.tsx")
OTHER_PATHS = ("src/test_utils.rs", "src/latest.rs", "web/protractor.ts", "pkg/contest.py", "src/TestUtils.kt")


def test_path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    more = spark.createDataFrame([(p,) for p in (*TEST_PATHS, *OTHER_PATHS)], "path string")
    return _paths(spark, sf_dir).select("path").union(more).select("path", paths.is_test_path(F.col("path")).alias("is_test"))


def describe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P5, P9."""
    docs = _docs(spark, sf_dir).withColumn("path", paths_of_documents.derived_path(F.col("doc_id"), F.col("source")))
    none = F.array().cast("array<string>")
    return docs.select("path", describe.description(F.col("path"), F.col("text"), none, none).alias("description"))


def clamp_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, P10."""
    clamped = text.clamp_bytes(text.one_line(F.col("text")), 100)
    return _docs(spark, sf_dir).select("doc_id", clamped.alias("clamped"), F.octet_length(clamped).alias("n_bytes"))


def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17, A8."""
    return _paths(spark, sf_dir).select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct()


def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of texts with how many documents hold them."""
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


#: Bytes (hex) that the sniffer must tell apart: NUL, ESC, tab, DEL, form feed, invalid UTF-8, a control byte after the searched ones.
SNIFF_ROWS = {-1: "6100", -2: "611b", -3: "6109", -4: "617f", -5: "610c", -6: "61ff"}


def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, S7."""
    literal = spark.createDataFrame(list(SNIFF_ROWS.items()), "doc_id long, hex string").select("doc_id", F.unhex("hex").alias("content"))
    rows = _docs(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content")).union(literal)
    return rows.select("doc_id", snapshot_status(F.col("content")).alias("s")).select("doc_id", "s.status", "s.reason")


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document n imports the path of document n div 2, its extension unknown."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", paths_of_documents.derived_path(F.col("doc_id"), F.col("source")).alias("path"))
    half = docs.select(F.col("doc_id").alias("half_id"), paths_of_documents.derived_path(F.col("doc_id"), F.col("source"), False).alias("spec"))
    asked = docs.withColumn("half_id", F.floor(F.col("doc_id") / 2)).join(half, "half_id")
    candidates = F.transform(F.array(*map(F.lit, paths_of_documents.EXTENSIONS)), lambda e: F.concat(F.col("spec"), F.lit("."), e))
    return graph.resolve(asked.select("path", candidates.alias("candidates")), docs)


def propagate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn imports the next of its conversation."""
    turns = _turns(spark, sf_dir)
    scores = lexical.bm25(turns, QUERY, "turn_id").select(F.col("turn_id").alias("path"), "lex")
    edges = turns.select(F.col("turn_id").alias("importer"), (F.col("turn_id") + 1).alias("importee"))
    return graph.propagate(scores, edges).select(F.col("path").alias("turn_id"), F.round("lex", 6).alias("lex"))


def blend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is judged, by the share of two marks in its text."""
    marks = (F.contains("text", F.lit("heat")).cast("int") + F.contains("text", F.lit("tion")).cast("int")) / 2
    judged = _docs(spark, sf_dir).select("doc_id", marks.alias("sem"))
    best = ranking.top(ranking.blend(_lex(spark, sf_dir).join(judged, "doc_id")).withColumn("score", F.round("score", 6)), "doc_id")
    return best.select("doc_id", "score", ranking.is_strong(F.col("score")).alias("strong"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("nth"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U13."""
    return chunk_texts(_docs(spark, sf_dir), "doc_id", "text")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("source"))


def _hits(files: DataFrame) -> DataFrame:
    return describe.numbered_lines(files).where(F.contains(F.lower("text"), F.lit(HIT))).select("path", F.col("line"))


def _windows(files: DataFrame) -> DataFrame:
    hits = _hits(files).select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    n_lines = files.select("path", text.line_count(F.col("source")).alias("n_lines"))
    return ranges.expand(hits, n_lines)


def line_hits_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5, R6."""
    return _windows(_files(spark, sf_dir)).select(F.col("path").alias("doc_id"), "start_line", "end_line")


def excerpt_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7, P13, with a small cap so that it cuts."""
    files = _files(spark, sf_dir)
    return ranges.excerpts(_windows(files), files, most=1500).select(F.col("path").alias("doc_id"), "start_line", "end_line", F.sha2("source", 256).alias("source_hash"), "cut")


def unit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in groups of at most two and 380 bytes; a turn's name is its whole text."""
    units = _turns(spark, sf_dir).select(F.col("conv_id").alias("path"), F.col("turn").cast("int").alias("unit_idx"), F.col("text").alias("name"))
    return ranking.pack_units(units).select(F.col("path").alias("conv_id"), F.col("unit_idx").alias("turn"), "group_idx")


def lead_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lead for each event type and day of a user."""
    leads = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), F.dayofmonth("ts").alias("start_line"), F.dayofmonth("ts").alias("end_line"), F.col("value").alias("score"))
    return ranking.distinct_leads(leads).select(F.col("path").alias("user_id"), "name", "start_line", F.round("score", 6).alias("score"))


def phrase_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain the first 40 characters of a benchmark item.

    The longest word inside the phrase (neither its first nor its last, which may be parts of words) is the key of a hash join with
    the documents' distinct words, without their texts; only the pairs that meet are looked at with ``contains``. Phrases with no
    such word (one or two words, text without spaces) are a query set that a scan of all texts takes in blocks of PHRASES."""
    inner = F.filter(F.split(F.substring("phrase", F.lit(1), F.lit(40)), " "), lambda w: F.length(w) > 0)
    middle = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    longest = F.aggregate(middle, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 40).alias("phrase")).withColumn("word", longest)
    docs = _docs(spark, sf_dir)
    keyed = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    met = keyed.join(items.where("word <> ''"), "word").select("doc_id", "item_id", "phrase").distinct()
    by_word = docs.select("doc_id", "text").join(met, "doc_id").where(F.contains("text", "phrase")).select("doc_id", "item_id")
    bare = items.where("word = ''").select("item_id", "phrase")
    blocks = -(-bare.count() // PHRASES)
    found = by_word
    for k in range(blocks):  # some PHRASES phrases of 40 characters at most each
        block = bare.where(F.pmod(F.xxhash64("item_id", "phrase"), F.lit(blocks)) == k)
        found = found.union(docs.join(F.broadcast(block), F.contains("text", "phrase")).select("doc_id", "item_id"))
    return found.distinct()


def range_join_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit lines in overlapping units of ten lines, one begun at every fifth."""
    files = _files(spark, sf_dir)
    n_lines = text.line_count(F.col("source"))
    starts = files.select("path", F.explode(F.sequence(F.lit(0), F.floor((n_lines - 1) / 5).cast("int"))).alias("unit_idx"))
    units = starts.select("path", "unit_idx", F.concat(F.lit("u"), F.col("unit_idx").cast("string")).alias("name"), (F.col("unit_idx") * 5 + 1).alias("start_line"), (F.col("unit_idx") * 5 + 10).alias("end_line"))
    return ranges.innermost(_hits(files), units).select(F.col("path").alias("doc_id"), "line", "unit")


def role_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, A13."""
    answer = lambda k: (F.col("doc_id") * (2 * k + 3) % 101) / 100
    roles = ranking.role_labels({r: answer(k) for k, r in enumerate(ranking.ROLES)})
    return _docs(spark, sf_dir).select("doc_id", F.array_join(roles, ",").alias("roles"))


def budget_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 40 documents' texts against a budget of 20,000 bytes."""
    best = bm25_topk(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", F.octet_length("text").alias("bytes")), "doc_id")
    return ranking.byte_budget(best, 20_000).select("doc_id", "nth", F.col("bytes").cast("long").alias("bytes"), "kept")


def _event_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("user_id", F.lit(":"), "event_type")
    return table(spark, sf_dir, "events").select(key.alias("key"), F.lit(judge.SCHEMA).alias("schema"), F.col("ts").alias("created_at"), F.create_map(F.lit("q"), "value").alias("answers"), F.octet_length("props").cast("long").alias("bytes"), "event_id")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key asked against entries younger than seven days."""
    cache = _event_cache(spark, sf_dir)
    live = judge.live(cache, F.lit(NOW).cast("timestamp")).groupBy("key").agg(F.max_by("answers", F.struct("created_at", "event_id")).alias("answers"))
    asked = cache.select("key").distinct()
    return asked.join(live, "key", "left").select("key", F.col("answers").isNotNull().alias("hit"), F.round(F.col("answers")["q"], 6).alias("answer"))


def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries within half of all bytes."""
    cache = _event_cache(spark, sf_dir).withColumn("key", F.col("event_id").cast("string"))
    half = cache.agg(F.floor(F.sum("bytes") / 2).alias("b")).first()["b"] or 0
    return judge.trim(cache, half).select("event_id")


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return ranking.issue_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a run; errors are issues, refunds interrupts."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(F.col("value") < 1, 1).otherwise(0)).alias("issues"), F.max(F.col("value") > 400).alias("stopped"))
    return e.select("user_id", ranking.status(F.col("issues"), F.coalesce("stopped", F.lit(False))).alias("status"))


def grouped_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10 over the 40 best."""
    best = bm25_topk(spark, sf_dir).drop("nth").join(_paths(spark, sf_dir), "doc_id")
    return ranking.presentation_order(best).select("path", "score", "is_test", "nth")


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, P14, P16."""
    best = bm25_topk(spark, sf_dir).drop("nth").join(_paths(spark, sf_dir), "doc_id").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    excerpt = F.struct(F.lit(1).alias("start_line"), text.line_count(F.col("text")).alias("end_line"), F.col("text").alias("source"))
    lead = "array<struct<name:string,start_line:int,end_line:int,score:double>>"
    call = "array<struct<caller:string,name:string,start_line:int,end_line:int>>"
    rows = best.select("path", "score", F.array().cast("array<string>").alias("roles"), F.lit(None).cast("int").alias("priority"), F.array().cast(lead).alias("leads"), F.array().cast(call).alias("call_leads"), F.array(excerpt).alias("excerpts"), F.lit(False).alias("source_omitted"))
    return json_files(rows).select("path", "json")


def quote_and_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, P15, P18 over whole texts."""
    return _docs(spark, sf_dir).select("doc_id", text.quote(F.col("text")).alias("quoted"), text.shell_arg(F.col("text")).alias("arg"), text.fence(F.col("text")).alias("fence"))


def contained_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of five lines, one begun at every line, that lie wholly in a window around hits."""
    files = _files(spark, sf_dir)
    starts = files.select("path", F.explode(F.sequence(F.lit(1), text.line_count(F.col("source")))).alias("start_line"))
    return ranges.contained(starts.withColumn("end_line", F.col("start_line") + 4), _windows(files)).select(F.col("path").alias("doc_id"), "start_line")


def _called_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a word before a space is a call."""
    return _files(spark, sf_dir).withColumn("source", F.translate("source", " ", "("))


def _line_units(files: DataFrame, n: int) -> DataFrame:
    """Of each line a unit that is named by its first word and ends n lines further down."""
    lines = files.select("path", text.line_count(F.col("source")).alias("n_lines"), F.posexplode(F.split("source", "\n")).alias("at", "text")).withColumn("line", F.col("at") + 1)
    return lines.select("path", F.col("line").alias("unit_idx"), F.regexp_extract("text", r"^([^(]+)", 1).alias("name"), F.col("line").alias("start_line"), F.least(F.col("line") + n, "n_lines").cast("int").alias("end_line"))


def calls_by_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's first word is a definition: lines of a document that call one of its definitions."""
    files = _called_files(spark, sf_dir)
    return describe.calls(_line_units(files, 0), describe.numbered_lines(files)).select(F.col("path").alias("doc_id"), "d_idx", "called", "line")


def unit_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of units of three lines, one begun at each line, with what they call."""
    files = _called_files(spark, sf_dir)
    return describe.unit_descriptions(_line_units(files, 2), files).select(F.col("path").alias("doc_id"), F.col("unit_idx").alias("line"), "description")


def call_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in windows around hits; every document is a Python file."""
    files = _called_files(spark, sf_dir).withColumn("path", F.concat(F.col("path").cast("string"), F.lit(".py")))
    found = describe.call_leads(_line_units(files, 2), files, _windows(files))
    return found.select(F.regexp_extract("path", "^[0-9]+", 0).cast("long").alias("doc_id"), "caller", "name", F.col("start_line").alias("line"))


def answer_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an event's value, a 500th of it, answers a question; every third event is asked another one besides."""
    asked = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("q"), F.lit("other"))).otherwise(F.array(F.lit("q")))
    return table(spark, sf_dir, "events").select("event_id", judge.valid(F.create_map(F.lit("q"), F.col("value") / 500), asked).alias("valid"))


def _importing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines, quoted in turn or not, are imported."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("import "), x)).otherwise(F.concat(F.lit('import "'), F.substring_index(x, " ", 2), F.lit('"'))))
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", paths_of_documents.derived_path(F.col("doc_id"), F.col("source")).alias("path"), F.array_join(line, "\n").alias("source"))


def import_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    return _importing_files(spark, sf_dir).select("doc_id", F.posexplode(graph.import_specifiers(F.col("path"), F.col("source"))).alias("nth", "spec"))


def specifier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of a document's first line mean to importers of every language."""
    docs = _docs(spark, sf_dir).select("doc_id", paths_of_documents.derived_path(F.col("doc_id"), F.col("source")).alias("path"), F.explode(F.split(F.substring_index("text", "\n", 1), " ")).alias("spec"))
    return docs.distinct().select("doc_id", "spec", F.array_join(graph.candidates(F.col("path"), F.col("spec")), " ").alias("candidates"))


def commented_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around hits, widened by the comments (here lines with tion) that touch them or are parted from them by blank lines."""
    files = _files(spark, sf_dir)
    lines = describe.numbered_lines(files)
    some = lambda which: lines.where(which).select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    n_lines = files.select("path", text.line_count(F.col("source")).alias("n_lines"))
    wide = ranges.expand(some(F.contains(F.lower("text"), F.lit(HIT))), n_lines, some(F.contains("text", F.lit("tion"))), some(F.trim("text") == ""))
    return wide.select(F.col("path").alias("doc_id"), "start_line", "end_line")


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each document's request."""
    question = F.struct(F.lit("relevant").alias("qid"), F.lit(judge.file_question(QUERY)).alias("instructions"))
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("state"), F.array(question).alias("questions"))
    return rows.select("doc_id", judge.cache_key(judge.TermJudge.name).alias("key"))


def weak_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two named units of a conversation, whose turns are units; every fourth is plain source, every fourth a context."""
    kind = F.col("turn") % 4
    name = F.when(kind == 0, F.lit("source")).when(kind == 1, F.concat("conv_id", F.lit(".context"))).otherwise(F.concat(F.lit("u"), "turn"))
    units = _turns(spark, sf_dir).select(F.col("conv_id").alias("path"), F.col("turn").alias("unit_idx"), name.alias("name"), F.col("turn").alias("start_line"), F.col("turn").alias("end_line"))
    return ranking.weak_leads(units, k=2).select(F.col("path").alias("conv_id"), "name", F.col("start_line").alias("turn"), "score")


def nested_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's leads (lead_dedup) in their order."""
    leads = lead_dedup(spark, sf_dir).select(F.col("user_id").alias("path"), "name", "start_line", F.col("start_line").alias("end_line"), "score")
    shown = F.transform("leads", lambda x: F.concat(x["name"], F.lit("@"), x["start_line"].cast("string")))
    return ranking.nested_leads(leads).select(F.col("path").alias("user_id"), F.array_join(shown, " ").alias("leads"))


def state_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, P16."""
    return _docs(spark, sf_dir).select("doc_id", text.state_header(F.lit(f"\n{QUERY}\nnow "), F.col("text")).alias("state"), text.round4(F.col("n_chars") / 7).alias("seventh"))


NAMES = (
    tokenize_terms, bm25_stats, bm25_scores, bm25_topk, bm25_pages, bm25_turns, bm25_partitioned, lexical_prefilter, policy_filter, language_of_path, test_path_classify,
    describe_documents, clamp_bytes, path_ancestors, content_hash_dups, binary_sniff, import_edges, propagate_scores, blend_topk, text_chunks, line_hits_merge, excerpt_cap,
    unit_pack, lead_dedup, phrase_contains_join, range_join_innermost, role_labels, budget_fold, cache_lookup, cache_evict, issue_counts, run_status, grouped_order, json_report,
    quote_and_shell, contained_units, commented_windows, cache_keys, weak_leads, nested_leads, state_headers,
    bm25_indexed, calls_by_endings, unit_calls, call_leads, answer_validity, import_specifiers, specifier_candidates, job1_evidence_report, job2_index_documents,
)
QUERIES = {f.__name__: f for f in NAMES}
