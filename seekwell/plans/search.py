"""One question over one corpus: the whole plan from files to evidence.

The stages are DataFrames; Python runs in the reader, the parsers and the judge alone. Lineage is
cut after each of them, so plans stay small; after the top 40 all that follows is bounded by the caps.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..functions.text import clamp_bytes, state_header
from ..operators import describe, graph, ranges, ranking
from ..operators.bm25 import before_judge, bm25
from ..operators.judge import MAX_REQUESTS, AnswerCache, Judge, Stop, TermJudge, evaluate, file_question, role_questions
from ..operators.contents import Store, inspect_once
from ..operators.units import comments, units
from ..schemas import CALL_LEAD, EXCERPT, LEAD
from ..sources.cuts import cut
from ..sources.reader import listing, snapshots
from ..sources.walk import Policy

#: Bytes of a description in role questions.
ROLE_BYTES = 320


@dataclass
class Options:
    policy: Policy = field(default_factory=Policy)
    cache_path: str | None = None
    #: Where what the parsers find is kept over runs.
    contents_path: str | None = None
    judge: Judge = field(default_factory=TermJudge)
    debug: bool = False
    #: Tasks that judge at once; None leaves it to Spark.
    workers: int | None = None
    #: Ends the judging when called; the result then holds what was judged, with status interrupted.
    stop: Stop | None = None


@dataclass
class Result:
    """files is a table of EVIDENCE (at most 40 rows); the rest is small run data."""

    root: str
    query: str
    status: str
    files: DataFrame
    instruction_files: list[str]
    pytest_files: list[str]
    issues: dict[str, int]
    counts: dict[str, int]
    warnings: dict[str, int] = field(default_factory=dict)
    provider_failure: str | None = None
    lookup_incomplete: bool = False


def _questions(pairs: dict[str, str]):
    return F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(t).alias("instructions")) for q, t in sorted(pairs.items())])


def descriptions(files: DataFrame, found: DataFrame) -> DataFrame:
    """P5: (path, description) of (path, source) with its inspected units."""
    names = units(found).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_idx", "name"))), lambda x: x["name"]).alias("names"))
    empty = F.array().cast("array<string>")
    rows = files.join(names, "path", "left").withColumn("names", F.coalesce("names", empty))
    return rows.select("path", describe.description(F.col("path"), F.col("source"), F.col("names"), graph.import_specifiers(F.col("path"), F.col("source"))).alias("description"))


def search_files(spark: SparkSession, files: DataFrame, query: str, options: Options | None = None, root: str = ".", issues: dict[str, int] | None = None, look: Callable[[list[str]], tuple[list[str], bool]] | None = None) -> Result:
    """The plan over (path, source). look: of some paths (a few for each of at most 40 files) those that are files, and whether any couldn't be
    looked at; by default the table's own paths count."""
    options, issues = options or Options(), dict(issues or {})
    cache = AnswerCache(spark, options.cache_path) if options.cache_path else None
    counts = {"requests": 0, "cache_hits": 0, "inspected_files": 0}
    failures: list[str] = []

    def judged(requests: DataFrame) -> DataFrame:
        answers, n = evaluate(requests, options.judge, cache, limit=max(0, MAX_REQUESTS - counts["requests"]), workers=options.workers, stop=options.stop)
        counts["requests"] += n["requests"]
        counts["cache_hits"] += n["cache_hits"]
        if n["refused"]:
            issues["interrupted"] = issues.get("interrupted", 0) + 1
        if n["invalid"] > n["refused"]:
            issues["provider"] = issues.get("provider", 0) + n["invalid"] - n["refused"]
            failures.append(n["failure"] or "invalid answers")
        return answers

    def stage(name: str) -> None:
        """What the cluster's job list shows."""
        spark.sparkContext.setJobDescription(f"search: {name}")

    stage("read and parse")
    files = cut(files.select("path", "source"))
    counts["inspected_files"] = files.count()
    findings, once = inspect_once(files, Store(spark, options.contents_path) if options.contents_path else None)
    counts |= {"contents": once["contents"], "parsed": once["parsed"]}
    found = cut(findings)
    all_units, all_comments = units(found), comments(found)
    stage("describe and rank")
    described = cut(descriptions(files, found))
    lexical = cut(bm25(described, query, "path", "description"))

    stage("judge files")
    ask = F.struct(F.lit("relevant").alias("qid"), F.lit(file_question(query)).alias("instructions"))
    requests = before_judge(lexical).join(described, "path").select(F.col("path").alias("req_id"), state_header(F.lit(query), F.col("description")).alias("state"), F.array(ask).alias("questions"))
    sem = judged(requests).select(F.col("req_id").alias("path"), F.col("answers")["relevant"].alias("sem"))

    spread = graph.propagate(lexical, cut(graph.import_edges(files)))
    blended = cut(ranking.blend(spread.join(sem, "path", "left")))
    for r in ranking.overflow(blended).collect():
        issues[r["kind"]] = r["n"]
    chosen = cut(ranking.top(blended))
    strong, weak = chosen.where(ranking.is_strong(F.col("score"))), chosen.where(~ranking.is_strong(F.col("score")))

    stage("select units")
    # Units of the strong candidates: ranked inside their file, packed in pairs, judged.
    of_strong = cut(all_units.join(strong.select("path"), "path", "left_semi"))
    unit_text = cut(describe.unit_descriptions(of_strong, files.join(strong.select("path"), "path", "left_semi")))
    ranked = bm25(unit_text, query, "unit_idx", "description", "path")
    asked = cut(ranking.top_units(of_strong.join(ranked, ["path", "unit_idx"])))
    groups = ranking.pack_units(asked).join(unit_text, ["path", "unit_idx"]).join(asked.select("path", "unit_idx", "name"), ["path", "unit_idx"])
    question = F.struct(F.concat(F.lit("u"), F.col("unit_idx").cast("string")).alias("qid"), F.concat(F.lit("Is "), F.col("name"), F.lit(f" needed to answer: {' '.join(query.split())}")).alias("instructions"))
    per_group = groups.groupBy("path", "group_idx").agg(F.array_sort(F.collect_list(F.struct("unit_idx", "description", question.alias("q")))).alias("us"))
    requests = per_group.select(
        F.concat("path", F.lit("\n"), F.col("group_idx").cast("string")).alias("req_id"),
        state_header(F.lit(query), F.concat(F.lit("File: "), "path", F.lit("\n"), F.array_join(F.transform("us", lambda u: u["description"]), "\n"))).alias("state"),
        F.transform("us", lambda u: u["q"]).alias("questions"),
    )
    answers = judged(requests).select(F.substring_index("req_id", "\n", 1).alias("path"), F.explode("answers").alias("qid", "p"))
    scored = cut(of_strong.join(answers.select("path", F.expr("int(substring(qid, 2))").alias("unit_idx"), "p"), ["path", "unit_idx"]))

    picked = scored.where(F.col("p") > ranking.SELECT_ABOVE)
    lines = describe.numbered_lines(files.join(picked.select("path"), "path", "left_semi"))
    blank = lines.where(F.trim("text") == "").select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    n_lines = lines.groupBy("path").agg(F.max("line").alias("n_lines"))
    wide = ranges.expand(ranges.merge(picked), n_lines, all_comments.join(picked.select("path").distinct(), "path", "left_semi"), blank)
    texts = cut(ranges.excerpts(wide, files))
    excerpts = texts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "source"))).alias("excerpts"), F.max("cut").alias("was_cut"))

    leads = scored.where(F.col("p") > ranking.LEAD_ABOVE).select("path", "name", "start_line", "end_line", F.col("p").alias("score"))
    leads = ranking.distinct_leads(leads).unionByName(ranking.weak_leads(all_units.join(weak.select("path"), "path", "left_semi")))
    call = describe.call_leads(of_strong, files.join(strong.select("path"), "path", "left_semi"), picked)
    calls = call.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("caller", "name", "start_line", "end_line"))).alias("call_leads"))

    stage("assess roles")
    roles_for = chosen.join(excerpts.select("path"), "path", "left_semi").orderBy(F.desc("score"), "path").limit(ranking.MAX_ROLE_FILES)
    requests = roles_for.join(described, "path").select(F.col("path").alias("req_id"), state_header(F.lit(query), clamp_bytes(F.col("description"), ROLE_BYTES)).alias("state"), _questions(role_questions(query)).alias("questions"))
    roles = judged(requests).select(F.col("req_id").alias("path"), ranking.role_labels({r: F.col("answers")[r] for r in ranking.ROLES}).alias("roles"))

    none = lambda kind: F.array().cast(f"array<{kind}>")
    evidence = (
        chosen.select("path", "score").join(roles, "path", "left").join(ranking.nested_leads(leads), "path", "left").join(calls, "path", "left").join(excerpts, "path", "left")
        .select(
            "path", "score", F.coalesce("roles", none("string")).alias("roles"), F.lit(None).cast("int").alias("priority"), F.coalesce("leads", none(LEAD)).alias("leads"),
            F.coalesce("call_leads", none(CALL_LEAD)).alias("call_leads"), F.coalesce("excerpts", none(EXCERPT)).alias("excerpts"), F.coalesce("was_cut", F.lit(False)).alias("source_omitted"),
        )
        .orderBy(F.desc("score"), "path")
    )
    evidence = cut(evidence)

    stage("context")
    above = evidence.select(F.explode(ancestors(F.col("path"))).alias("dir")).union(spark.createDataFrame([("",)], "dir string")).distinct()
    wanted = above.select(F.when(F.col("dir") == "", "AGENTS.md").otherwise(F.concat("dir", F.lit("/AGENTS.md"))).alias("path"))
    incomplete = False
    if look:
        instructions, incomplete = look(sorted(r["path"] for r in wanted.collect()))
    else:
        instructions = sorted(r["path"] for r in wanted.join(files, "path", "left_semi").collect())
    pytest_files = sorted(r["path"] for r in pytest_paths(evidence, all_units, files).collect())
    spark.sparkContext.setJobDescription(None)
    status = "interrupted" if "interrupted" in issues else "incomplete" if issues else "complete"
    return Result(root, query, status, evidence, instructions, pytest_files, issues, counts, dict(cache.warnings) if cache else {}, next(iter(failures), None), incomplete)


def pytest_paths(evidence: DataFrame, all_units: DataFrame, files: DataFrame) -> DataFrame:
    """Python files with excerpts that import pytest and of which a test_ unit lies wholly inside an excerpt."""
    shown = evidence.where(F.col("path").endswith(".py")).select("path", F.explode("excerpts").alias("e")).select("path", "e.*")
    imports = files.where(F.col("source").rlike(r"(?m)^(import pytest|from pytest )")).select("path")
    tests = all_units.where(F.regexp_extract("name", r"([^.]+)$", 1).startswith("test_"))
    return ranges.contained(tests, shown).select("path").distinct().join(imports, "path", "left_semi")


def search(spark: SparkSession, root: str, query: str, options: Options | None = None) -> Result:
    """The plan over a directory that all executors see."""
    options = options or Options()
    files, walk_issues, found = listing(spark, root, options.policy)
    read = cut(snapshots(files, root))
    counted: dict[str, int] = {}
    for r in ranking.issue_counts(walk_issues.unionByName(read.where("status = 'issue'").select(F.col("reason").alias("kind"), "path"))).collect():
        counted[r["kind"]] = r["n"]

    def look(paths: list[str]) -> tuple[list[str], bool]:
        """On the disk itself, so that ignored and hidden files count too."""
        there, incomplete = [], False
        for p in paths:
            try:
                if stat.S_ISREG(os.lstat(f"{root}/{p}").st_mode):
                    there.append(p)
            except FileNotFoundError:
                pass
            except OSError:
                incomplete = True
        return there, incomplete

    return search_files(spark, read.where("status = 'ok'"), query, options, root, counted, look)
