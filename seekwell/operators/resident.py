"""A judge that is a program of its own, kept running beside each of Spark's Python workers.

The program reads requests and writes answers, a JSON object a line: first {"ready": true}; then for each {"id", "state", "questions"} an
{"id", "ok": true, "answers": {question: number}} or {"id", "ok": false, "error"}. It's started when a worker's first request comes, so a run
whose answers are all cached starts none, and it stays for the tasks that follow in that worker. One that dies is started
again for the request at hand, once; one that doesn't answer in time is ended, and started again for the next request.
"""

from __future__ import annotations

import atexit
import json
import queue
import shlex
import shutil
import subprocess
import threading
import time
from dataclasses import dataclass

from .judge import Judge, TermJudge

#: Seconds until the program must be ready, and until it must have answered; the kind of a yes-or-no question.
READY_SECONDS, ANSWER_SECONDS = 600.0, 120.0
QUESTION_TYPE = "noul"


class Gone(OSError):
    """The program has ended."""


class Child:
    """One running program. A thread of its own reads its lines, so that waiting for one can end in time."""

    def __init__(self, command: tuple[str, ...], ready_seconds: float) -> None:
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.lines: queue.Queue[bytes | None] = queue.Queue()
        self.last = 0
        threading.Thread(target=self._read, daemon=True).start()
        try:
            if self._line(time.monotonic() + ready_seconds).get("ready") is not True:
                raise OSError("the judge's first line doesn't say that it's ready")
        except Exception:
            self.end()
            raise

    def _read(self) -> None:
        for line in self.process.stdout:
            self.lines.put(line)
        self.lines.put(None)

    def _line(self, until: float) -> dict:
        """The next line that is a JSON object; others are passed over."""
        while True:
            try:
                line = self.lines.get(timeout=max(0.0, until - time.monotonic()))
            except queue.Empty:
                raise TimeoutError("the judge didn't answer in time") from None
            if line is None:
                raise Gone("the judge has ended")
            try:
                found = json.loads(line)
            except ValueError:
                continue
            if isinstance(found, dict):
                return found

    def ask(self, state: str, questions: dict[str, str], seconds: float) -> dict[str, float]:
        self.last += 1
        until = time.monotonic() + seconds
        request = {"id": self.last, "state": state, "questions": {q: {"type": QUESTION_TYPE, "instructions": text} for q, text in questions.items()}}
        try:
            self.process.stdin.write(json.dumps(request).encode() + b"\n")
            self.process.stdin.flush()
        except OSError:
            raise Gone("the judge has ended") from None
        while (answer := self._line(until)).get("id") != self.last:
            pass  # a late answer to a request that was given up, or no answer at all
        if answer.get("ok") is not True:
            raise RuntimeError(str(answer.get("error", "unknown error")))
        return {q: float(x) for q, x in (answer.get("answers") or {}).items() if isinstance(x, (int, float)) and not isinstance(x, bool)}

    def end(self) -> None:
        self.process.kill()
        self.process.wait()


_CHILDREN: dict[tuple[str, ...], Child] = {}  # of this Python worker


def _end_all() -> None:
    for child in _CHILDREN.values():
        child.end()


atexit.register(_end_all)


@dataclass
class CommandJudge:
    """The judge that ``command`` (a program and its arguments) starts. ``name`` belongs to the keys of its cached answers: give another with another model."""

    command: tuple[str, ...]
    name: str = ""
    ready_seconds: float = READY_SECONDS
    answer_seconds: float = ANSWER_SECONDS

    def __post_init__(self) -> None:
        self.command = tuple(self.command)
        self.name = self.name or f"command:{shlex.join(self.command)}"

    def available(self) -> bool:
        """Whether the program can be found here; it isn't started."""
        return bool(self.command) and shutil.which(self.command[0]) is not None

    def predict(self, state: str, questions: dict[str, str]) -> dict[str, float]:
        for again in (True, False):
            child = _CHILDREN.get(self.command)
            if child is None:
                child = _CHILDREN[self.command] = Child(self.command, self.ready_seconds)
            try:
                return child.ask(state, questions, self.answer_seconds)
            except OSError as e:  # ended, or too late: it isn't asked again
                _CHILDREN.pop(self.command).end()
                if not (again and isinstance(e, Gone)):
                    raise
        raise AssertionError


def choose(command: str, name: str = "") -> Judge:
    """M5: the judge of a command line if its program is there, else the default one."""
    judge = CommandJudge(tuple(shlex.split(command)), name)
    return judge if judge.available() else TermJudge()
