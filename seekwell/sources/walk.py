"""The walk of a directory tree under a policy.

Listing is the driver's work: ignore rules depend on order and on the directories above, and Spark's own file
sources hide names that begin with a dot or an underscore. Only metadata is touched; reading is distributed.
"""

from __future__ import annotations

import os
import re
import stat
from collections import deque
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.paths import DEPENDENCY_DIRS, SENSITIVE_NAMES, SENSITIVE_SUFFIXES

#: Entries seen at most, bytes of a rule file.
MAX_ENTRIES, RULE_BYTES = 100_000, 1 << 20


@dataclass(frozen=True)
class Policy:
    hidden: bool = False
    no_ignore: bool = False
    include_dependencies: bool = False
    include_sensitive: bool = False


def rule_regex(pattern: str) -> str:
    """A gitignore glob as a regular expression over a path relative to the rule file."""
    out, i, n = "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == n:
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
            while i < n and pattern[i] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < n:
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Rules:
    """One rule file: the last rule that matches decides."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[bool, bool, re.Pattern[str]]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:]
            only_dir = line.endswith("/")
            line = line.rstrip("/") if only_dir else line
            anchored = "/" in line
            body = rule_regex(line.lstrip("/"))
            try:
                self.rules.append((keep, only_dir, re.compile(body if anchored else f"(?:.*/)?{body}")))
            except re.error:
                continue  # a rule that is no pattern matches nothing

    def decide(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept by a negated rule; None: no rule speaks."""
        for keep, only_dir, pattern in reversed(self.rules):
            if (is_dir or not only_dir) and pattern.fullmatch(path):
                return not keep
        return None


@dataclass
class Scope:
    """The rule files of one directory."""

    prefix: str
    git: Rules | None
    search: Rules | None

    def decide(self, path: str, is_dir: bool) -> bool | None:
        inside = path[len(self.prefix) + 1 :] if self.prefix else path
        for rules in (self.search, self.git):  # .ignore comes before .gitignore
            if rules and (found := rules.decide(inside, is_dir)) is not None:
                return found
        return None


@dataclass
class Walk:
    files: list[tuple[str, str, str, int, int]] = field(default_factory=list)
    issues: list[tuple[str, str]] = field(default_factory=list)
    truncated: bool = False


def load_rules(path: Path) -> Rules | None:
    """A regular file of at most 1 MiB; else as if it weren't there."""
    try:
        info = path.lstat()
        if not stat.S_ISREG(info.st_mode) or info.st_size > RULE_BYTES:
            return None
        return Rules(path.read_text(errors="replace"))
    except OSError:
        return None


def global_rules() -> Rules | None:
    """The user's global exclude file, as git would find it by default."""
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    named = None
    for config in (Path.home() / ".gitconfig", home / "git/config"):
        try:
            if m := re.search(r"(?im)^\s*excludesfile\s*=\s*(.+?)\s*$", config.read_text(errors="replace")):
                named = Path(os.path.expanduser(m[1].strip('"')))
        except OSError:
            continue
    return load_rules(named or home / "git/ignore")


def is_sensitive_name(name: str) -> bool:
    low = name.lower()
    return low in SENSITIVE_NAMES or low.startswith(".env.") or low.endswith(SENSITIVE_SUFFIXES)


def walk(root: str | Path, policy: Policy = Policy(), excludes: Rules | None = None, max_entries: int = MAX_ENTRIES) -> Walk:  # noqa: B008
    """Breadth first from ``root``, names sorted in each directory. files: (path, name, dir, size, ord).

    ``excludes`` are the global rules (D8: they hold under no_ignore too)."""
    root, out = Path(root), Walk()
    queue: deque[tuple[str, list[Scope]]] = deque([("", [])])
    seen = 0
    while queue:
        where, scopes = queue.popleft()
        try:
            entries = sorted(os.scandir(root / where if where else root), key=lambda e: e.name)
        except OSError:
            if where:
                out.issues.append(("unreadable", where))
            continue
        here = root / where if where else root
        if where and any(e.name == ".git" for e in entries):  # another repository
            scopes = [s for s in scopes if not s.git]
        if not policy.no_ignore:
            scope = Scope(where, load_rules(here / ".gitignore"), load_rules(here / ".ignore"))
            if scope.git or scope.search:
                scopes = [*scopes, scope]
        for e in entries:
            seen += 1
            if seen > max_entries:
                if not out.truncated:
                    out.issues.append(("resource_limit", where))
                out.truncated = True
                return out
            name, path = e.name, f"{where}/{e.name}" if where else e.name
            if name == ".git" or (name.startswith(".") and not policy.hidden):
                continue
            try:
                info = e.stat(follow_symlinks=False)
            except OSError:
                out.issues.append(("changed", path))
                continue
            is_dir = stat.S_ISDIR(info.st_mode)
            if not is_dir and not stat.S_ISREG(info.st_mode):
                continue  # S4
            if is_dir and not policy.include_dependencies and name in DEPENDENCY_DIRS:
                continue
            if not policy.include_sensitive and is_sensitive_name(name):
                continue
            decision = excludes.decide(path, is_dir) if excludes else None
            for s in scopes:
                if (found := s.decide(path, is_dir)) is not None:
                    decision = found
            if decision:
                continue
            if is_dir:
                queue.append((path, scopes))
            else:
                out.files.append((path, name, where, info.st_size, len(out.files)))
    return out
