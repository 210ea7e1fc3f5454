"""Python -m seekwell search QUERY [ROOT] | doctor | cache-clear. Exit codes: 0 complete, 1 failed, 2 incomplete, 130 interrupted."""

from __future__ import annotations

import argparse
import importlib
import shlex
import signal
import sys
import threading
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.judge import AnswerCache, Judge, Stop, TermJudge, judge_bool
from .operators.resident import CommandJudge, choose
from .plans.render import render_json, render_text
from .plans.search import Options, search
from .sources.cuts import remove, run_folder
from .sources.walk import Policy

CACHE, CONTENTS = (str(Path.home() / ".cache/seekwell" / name) for name in ("answers", "contents"))


def judge_named(name: str) -> Judge:
    """M5: the default judge; the program of command:LINE (of auto:LINE if it's there, else the default); or what MODULE:NAME makes."""
    if name == "terms":
        return TermJudge()
    if name.startswith("command:"):
        return CommandJudge(tuple(shlex.split(name.removeprefix("command:"))))
    if name.startswith("auto:"):
        return choose(name.removeprefix("auto:"))
    module, _, made = name.partition(":")
    return getattr(importlib.import_module(module), made)()


def doctor(judge: Judge | None = None) -> bool:
    """The judge says yes to a question whose answer is in the state."""
    return judge_bool(judge or TermJudge(), "File: auth.py\nDeclarations: check_password", "check password") > 0.5


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seekwell")
    commands = parser.add_subparsers(dest="command", required=True)
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("root", nargs="?", default=".")
    for flag in ("hidden", "no-ignore", "include-dependencies", "include-sensitive", "no-cache", "json", "debug-scores"):
        find.add_argument(f"--{flag}", action="store_true")
    find.add_argument("--max-source-bytes", type=int, default=0)
    find.add_argument("--judge", default="terms", help="terms; command:LINE or auto:LINE, a program that answers JSON lines; or MODULE:NAME of something that makes a judge")
    find.add_argument("--workers", type=int, help="tasks that judge at once")
    commands.add_parser("doctor")
    commands.add_parser("cache-clear")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        good = doctor()
        print("judge: ok" if good else "judge: failed")
        return int(not good)
    spark = SparkSession.builder.appName("seekwell").getOrCreate()
    try:
        if args.command == "cache-clear":
            AnswerCache(spark, CACHE).clear()
            remove(spark, CONTENTS)
            return 0
        if not Path(args.root).is_dir():
            print(f"not a directory: {args.root}", file=sys.stderr)
            return 1
        stop = Stop(spark)
        stop_at_interrupt(stop)
        with run_folder(spark):  # what is printed needs no cut any more
            return find_and_print(spark, args, stop)
    except KeyboardInterrupt:
        return 130


def stop_at_interrupt(stop: Stop) -> None:
    """The first interrupt ends the judging, so that what's found is still printed; a second one ends the program."""

    def handle(number: int, frame: object) -> None:
        signal.signal(signal.SIGINT, signal.default_int_handler)
        threading.Thread(target=stop, daemon=True).start()  # the main thread may be in a call to the JVM

    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGINT, handle)


def find_and_print(spark: SparkSession, args: argparse.Namespace, stop: Stop) -> int:
    policy = Policy(args.hidden, args.no_ignore, args.include_dependencies, args.include_sensitive)
    result = search(spark, args.root, args.query, Options(policy, None if args.no_cache else CACHE, None if args.no_cache else CONTENTS, judge_named(args.judge), workers=args.workers, stop=stop))
    if args.debug_scores:
        result.files.select("path", "score").show(40, truncate=False)
    print(render_json(result) if args.json else render_text(result, args.max_source_bytes))
    return {"complete": 0, "incomplete": 2}.get(result.status, 130)


if __name__ == "__main__":
    sys.exit(main())
