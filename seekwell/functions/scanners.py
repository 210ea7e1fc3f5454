"""Named units and comment ranges of source files.

Python goes through ast and tokenize. The brace languages share one scanner: comments and strings are blanked out
(same length, so offsets hold), the text is cut into statements at brackets' depth 0, and a statement's head is
read by the language's patterns (of its first 4,000 characters). This is no full parser: text that doesn't balance is chunked like
any other text.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Bytes parsed at most, bytes of a text chunk.
PARSE_BYTES, CHUNK_BYTES = 1_000_000, 2500


@dataclass
class Unit:
    name: str
    start_line: int
    end_line: int
    byte_start: int
    byte_end: int
    owner_headers: list[tuple[int, int]] = field(default_factory=list)
    partial: bool = False


@dataclass
class Inspection:
    units: list[Unit]
    comments: list[tuple[int, int]]
    mode: str


class Lines:
    """Line numbers (from 1) and byte offsets of character offsets."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        #: Bytes before each character; none for ASCII, where they are its place.
        self.bytes = None
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            self.bytes = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF))))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        return at if self.bytes is None else int(self.bytes[at])

    def place(self, line: int, column: int) -> int:
        """The character at byte ``column`` of a line."""
        start = self.starts[line - 1]
        return start + column if self.bytes is None else int(np.searchsorted(self.bytes, self.bytes[start] + column))

    def unit(self, name: str, a: int, b: int, owners: list[tuple[int, int]] | None = None) -> Unit:
        """A unit over the characters a..b; its end is its last occupied character."""
        while b > a and self.text[b - 1].isspace():
            b -= 1
        return Unit(name, self.line(a), self.line(max(a, b - 1)), self.byte(a), self.byte(b), list(owners or []))


def text_units(text: str, most: int = CHUNK_BYTES) -> list[Unit]:
    """Chunks of at most ``most`` bytes, extended to a character's end, cut back to the last line end where there is one; true line numbers."""
    data, out, at, line = text.encode(), [], 0, 1
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end < len(data) and (cut := data.rfind(b"\n", at, end)) > at:
            end = cut + 1
        ends = data.count(b"\n", at, end)
        last = line + ends - (data[end - 1 : end] == b"\n")
        out.append(Unit("source", line, max(line, last), at, end, [], True))
        at, line = end, line + ends
    return out


def _header(name: str, lines: Lines, start: int, first_member: int | None) -> Unit | None:
    """The lines of a class down to its first member; none if that stands on the class's own line or is missing."""
    if first_member is None or lines.line(first_member) <= lines.line(start):
        return None
    end = lines.starts[lines.line(first_member) - 1]
    return lines.unit(f"{name}.context", start, end)


# ---- Python

_SPACE = re.compile(r"\s*")


def python_units(text: str) -> tuple[list[Unit], list[tuple[int, int]]]:
    """U1. Raises SyntaxError where the text isn't Python."""
    tree, lines, units = ast.parse(text), Lines(text), []

    def span(node: ast.stmt) -> tuple[int, int]:
        first = min([node, *getattr(node, "decorator_list", [])], key=lambda n: n.lineno)
        begin = lines.place(node.lineno, node.col_offset) if first is node else _SPACE.match(text, lines.starts[first.lineno - 1]).end()
        return begin, lines.place(node.end_lineno, node.end_col_offset)

    def visit(body: list[ast.stmt], prefix: str, owners: list[tuple[int, int]], top: bool) -> None:
        for node in body:
            a, b = span(node)
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                units.append(lines.unit(prefix + node.name, a, b, owners))
            elif isinstance(node, ast.ClassDef):
                name = prefix + node.name
                if node.decorator_list:
                    units.append(lines.unit(name, a, b, owners))
                    continue
                if node.body[0].lineno == node.lineno:
                    continue  # all on one line
                members = [n for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
                if not members:
                    units.append(lines.unit(name, a, b, owners))
                    continue
                head = _header(name, lines, a, span(node.body[0])[0])
                own = [*owners]
                if head:
                    units.append(head)
                    own.append((head.start_line, head.end_line))
                visit(node.body, f"{name}.", own, False)
            elif top and isinstance(node, ast.Assign | ast.AnnAssign):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                if names := [n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)]:
                    units.append(lines.unit(names[0], a, b, owners))

    visit(tree.body, "", [], True)
    comments = sorted({(t.start[0], t.end[0]) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT})
    return units, comments


# ---- brace languages

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_BRACKET = re.compile(r"[()\[\]{}]")


def blanked(text: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and the insides of strings as spaces, and the comments as (first, last) lines."""
    quotes = {"rust": r'"(?:\\.|[^"\\])*"', "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'', "swift": r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"', "kotlin": r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\''}
    usual = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    script = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
    strings = quotes.get(lang, script if lang in ("typescript", "tsx", "javascript") else usual)
    if lang == "rust":
        strings = r'r(#*)"[\s\S]*?(?:"\1|\Z)|' + strings + r"|'(?:\\.[^']*|[^'\\\n])'"
    pattern = re.compile(rf"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>{strings})")  # what isn't closed goes to the end, or each opening would be searched for its end
    lines, comments, out, at = Lines(text), [], [], 0
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        keep = m["comment"] is None
        blank = re.sub(r"[^\n]", " ", m[0])
        out.append(m[0][0] + blank[1:-1] + m[0][-1] if keep and len(m[0]) > 1 else blank)
        if not keep:
            comments.append((lines.line(m.start()), lines.line(m.end() - 1)))
        at = m.end()
    return "".join(out) + text[at:], sorted(set(comments))


class Brackets:
    """The place of the bracket that closes each one, found when first asked and kept with all inside."""

    def __init__(self, text: str) -> None:
        self.text, self.ends = text, {}

    def closing(self, at: int, end: int) -> int:
        """The closing bracket before ``end`` of the one at ``at``; ValueError without one."""
        if at not in self.ends:
            stack: list[tuple[int, str]] = []
            for m in _BRACKET.finditer(self.text, at, end):
                c = m[0]
                if c in _OPEN:
                    stack.append((m.start(), _OPEN[c]))
                else:
                    opened, wanted = stack.pop()
                    if wanted != c:
                        raise ValueError("brackets don't match")
                    self.ends[opened] = m.start()
                    if not stack:
                        break
            else:
                raise ValueError("a bracket isn't closed")
        if self.ends[at] >= end:
            raise ValueError("a bracket isn't closed")
        return self.ends[at]


@dataclass
class Statement:
    start: int
    head: str
    body: tuple[int, int] | None
    end: int


_GOES_ON = re.compile(r"[.?:=&|+*/%<>,{)\]-]|where\b|throws\b|extends\b|implements\b|else\b|catch\b|finally\b|in\b")
_BINDS = re.compile(r"(?:export\s+)?(?:import|const|let|var)\b")
_BARE_EXPORT = re.compile(r"export\s*$")
_ACCESS = re.compile(r"(?:public|private|protected)\s*:(?!:)")
_UNFINISHED = re.compile(r"(?:[=,(\[&|+*/%<.:?-]|\b(?:extends|implements|where|return|func|fun|const|let|var|val|export|default|async|static|public|private|open|override|final))$")
_AFTER_BODY = {True: re.compile(r"\s*(?:;|=|(?:else|catch|finally|while)\b)"), False: re.compile(r"[ \t]*(?:;|=|[\w*&]+[^;{}()]*;)")}
#: Characters of the longest word that leaves a statement unfinished, and the one before it.
_WORD_CHARS = 12
#: Characters of a statement's head that are looked at for its name.
_HEAD_CHARS = 4000


def statements(text: str, a: int, b: int, by_line: bool, brackets: Brackets) -> Iterator[Statement]:
    """The statements of text[a:b]. They end at a semicolon, after a body in braces, or (``by_line``) at a line's end that nothing carries on.
    Each character is looked at a bounded number of times."""
    i, equals = a, a - 1
    while i < b:
        while i < b and (text[i].isspace() or text[i] in ";,"):
            i += 1
        if i >= b:
            return
        if not by_line and (m := _ACCESS.match(text, i)):  # C++ labels
            i = m.end()
            continue
        if text[i] == "#" and not by_line and text[i : i + 2] != "#[":  # a preprocessor line
            while i < b and (text[i] != "\n" or text[i - 1] == "\\"):
                i += 1
            continue
        start, body, head_end = i, None, None
        binds = by_line and _BINDS.match(text, start, b) is not None
        solid = start  # the end of what isn't white space, so far
        while i < b:
            c = text[i]
            if c == "{":
                close = brackets.closing(i, b)
                if binds and equals < start:
                    equals = text.find("=", start, b) % (b + 1)  # the first one, or b
                value = (solid > start and text[solid - 1] in "=(,") or text[max(start, solid - 2) : solid] == "=>" or (binds and equals >= i) or (by_line and _BARE_EXPORT.match(text, start, i) is not None)
                if body is None and not value:
                    body, head_end = (i + 1, close), i
                i = solid = close + 1
                if not value and not _AFTER_BODY[by_line].match(text, i, b):
                    break
                continue
            if c in "([":
                i = solid = brackets.closing(i, b) + 1
                continue
            if c in _CLOSE:
                raise ValueError("brackets don't match")
            if c == ";":
                i += 1
                break
            if c == "\n" and by_line:
                after = _SPACE.match(text, i, b).end()
                if not _UNFINISHED.search(text, max(start, solid - _WORD_CHARS), solid) and not _GOES_ON.match(text, after, b):
                    break
                i = after
                continue
            i += 1
            if not c.isspace():
                solid = i
        end = i
        yield Statement(start, text[start : min(head_end if head_end is not None else end, start + _HEAD_CHARS)], body, end)
        i = max(i, start + 1)


_NAME = re.compile(r"[\w$]*")


class Scanner:
    """Units of one file of a brace language."""

    def __init__(self, text: str, masked: str, lang: str) -> None:
        self.text, self.masked, self.lang, self.lines, self.units, self.brackets = text, masked, lang, Lines(text), [], Brackets(masked)
        self.by_line = lang in ("go", "swift", "kotlin", "typescript", "tsx", "javascript")

    def add(self, name: str, s: Statement, owners: list[tuple[int, int]]) -> None:
        self.units.append(self.lines.unit(name, s.start, s.end, owners))

    def members(self, name: str, s: Statement, owners: list[tuple[int, int]], member: Callable[[Statement], list[str]], whole: bool = True) -> None:
        """A class: its header, then its members as ``name.member``; the whole class where it has none."""
        found = [(m, names) for m in statements(self.masked, *s.body, self.by_line, self.brackets) if (names := member(m))] if s.body else []
        if not found:
            if whole:
                self.add(name, s, owners)
            return
        if head := _header(name, self.lines, s.start, found[0][0].start):
            head.owner_headers = list(owners)
            self.units.append(head)
            owners = [*owners, (head.start_line, head.end_line)]
        for m, names in found:
            self.add(f"{name}.{', '.join(names)}", m, owners)

    def scan(self) -> list[Unit]:
        self.block(0, len(self.masked), "", [])
        return self.units

    def block(self, a: int, b: int, prefix: str, owners: list[tuple[int, int]]) -> None:
        visit = getattr(self, {"typescript": "script", "tsx": "script", "javascript": "script"}.get(self.lang, self.lang))
        for s in statements(self.masked, a, b, self.by_line, self.brackets):
            visit(s, prefix, owners)

    # U5
    def rust(self, s: Statement, prefix: str, owners: list[tuple[int, int]]) -> None:
        head = re.sub(r"^(?:#!?\[[^\]]*\]\s*)+", "", s.head).strip()
        if m := re.match(r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|unsafe\s+)*impl\b\s*(?:<[^{]*?>\s*)?(?:.*?\bfor\s+)?[&\s]*(?:mut\s+|dyn\s+)?(?:[\w]+::)*(\w+)", head, re.S):
            self.members(prefix + m[1], s, owners, lambda x: [f[1]] if (f := re.search(r"\bfn\s+(\w+)", x.head)) else [f[1]] if (f := re.match(r"(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:const|type)\s+(\w+)", x.head)) else [], whole=False)
        elif m := re.match(r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", head):
            if s.body:
                self.block(*s.body, f"{prefix}{m[1]}::", owners)
        elif m := re.match(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern(?:\s*\"[^\"]*\")?)\s+)*(?:fn|struct|enum|union|trait|type|static(?:\s+mut)?|const)\s+(\w+)", head):
            self.add(prefix + m[1], s, owners)

    # U6
    def go(self, s: Statement, prefix: str, owners: list[tuple[int, int]]) -> None:
        if m := re.match(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*(\w+)", s.head):
            self.add(f"{m[1]}.{m[2]}", s, owners)
        elif (m := re.match(r"func\s+(\w+)", s.head)) or (m := re.match(r"type\s+(\w+)", s.head)):
            self.add(m[1], s, owners)
        elif m := re.match(r"(type|const|var)\s*\(", s.head):
            a = s.start + m.end()
            for x in statements(self.masked, a, self.brackets.closing(a - 1, len(self.masked)), True, self.brackets):
                if n := re.match(r"\w+(?:\s*,\s*\w+)*" if m[1] != "type" else r"\w+", x.head):
                    self.add(", ".join(re.findall(r"\w+", n[0])), x, owners)
        elif m := re.match(r"(?:const|var)\s+(\w+(?:\s*,\s*\w+)*)", s.head):
            self.add(", ".join(re.findall(r"\w+", m[1])), s, owners)

    # U7
    def java(self, s: Statement, prefix: str, owners: list[tuple[int, int]]) -> None:
        if m := re.search(r"(?<!\.)\b(?:class|@?interface|enum|record)\s+(\w+)", s.head):
            self.members(prefix + m[1], s, owners, self.java_member)

    def java_member(self, s: Statement) -> list[str]:
        head = re.sub(r"@\w+(?:\.\w+)*(?:\([^)]*\))?", " ", s.head).strip()
        if m := re.search(r"\b(?:class|@?interface|enum|record)\s+(\w+)", head):
            return [m[1]]
        head = head.split("=")[0]
        if m := re.search(r"(\w+)\s*\(", head):
            return [m[1]] if s.body or head.rstrip().endswith(";") or re.search(r"\)\s*(?:throws [\w., ]+)?;?\s*$", head) else []
        m = re.match(r"(?:[\w<>\[\],.?&]+\s+)+(\w+)(?:\s*\[\])*\s*;?$", " ".join(head.split()))
        return [m[1]] if m and not s.head.startswith(("import", "package")) else []

    # U8
    def swift(self, s: Statement, prefix: str, owners: list[tuple[int, int]]) -> None:
        if (m := re.search(r"\b(?:class|protocol|enum|struct|actor|extension)\s+([\w.]+)", s.head)) and s.body and not re.match(r"(?:\w+\s+)*(?:func|var|let)\b", s.head):
            self.members(prefix + m[1], s, owners, self.swift_member)
        elif names := self.swift_member(s):
            self.add(prefix + names[0], s, owners)

    def swift_member(self, s: Statement) -> list[str]:
        if m := re.search(r"\b(?:func|var|let|typealias|class|struct|enum|protocol|actor|associatedtype)\s+(\w+|[^\s\w(]+)", s.head):
            return [m[1]]
        return [m[0].strip("?!( ")] if (m := re.search(r"\b(?:init[?!]?\s*[<(]|deinit\b|subscript\b)", s.head)) else []

    # U9
    def kotlin(self, s: Statement, prefix: str, owners: list[tuple[int, int]]) -> None:
        if m := re.match(r"(?:@\w+(?:\([^)]*\))?\s+|\w+\s+)*?(?:class|interface|object)\s+(\w+)", s.head):
            self.members(prefix + m[1], s, owners, self.kotlin_member)
        elif names := self.kotlin_member(s):
            self.add(prefix + names[0], s, owners)

    def kotlin_member(self, s: Statement) -> list[str]:
        if m := re.search(r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?(\w+)\s*\(", s.head):
            return [m[1]]
        if m := re.match(r"(?:@\w+(?:\([^)]*\))?\s+|\w+\s+)*?(?:val|var)\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(\w+)", s.head):
            return [m[1]]
        m = re.match(r"(?:\w+\s+)*?(?:class|interface|object|typealias)\s+(\w+)", s.head)
        return [m[1]] if m else []

    # U10
    def cpp(self, s: Statement, prefix: str, owners: list[tuple[int, int]]) -> None:
        head = s.head.strip()
        while m := re.match(r"template\s*<", head):
            depth, i = 0, m.end() - 1
            while i < len(head):
                depth += (head[i] == "<") - (head[i] == ">")
                i += 1
                if not depth:
                    break
            head = head[i:].strip()
        if m := re.match(r"(?:inline\s+)?namespace\s*([\w:]*)", head):
            if s.body:
                self.block(*s.body, f"{prefix}{m[1]}::" if m[1] else prefix, owners)
        elif re.match(r"extern\s*\"", head) and s.body:
            self.block(*s.body, prefix, owners)
        elif s.body and (m := re.match(r"(?:typedef\s+)?(?:class|struct|union|enum(?:\s+class|\s+struct)?)\s+(?:\[\[[^\]]*\]\]\s*)?(?:[A-Z_]+\s+)?(\w+)\b(?!\s*\()", head)) and "(" not in head:
            self.members(prefix + m[1], s, owners, self.cpp_member)
        elif s.body and (m := re.search(r"((?:[\w~]+(?:<[^<>]*>)?::)*(?:operator\s*[^\s(]+|~?\w+))\s*\(", head)):
            self.add(prefix + re.sub(r"<[^<>]*>", "", m[1]).replace("::", "."), s, owners)

    def cpp_member(self, s: Statement) -> list[str]:
        head = re.sub(r"^\s*(?:(?:public|private|protected)\s*:\s*)+", "", s.head)
        if m := re.match(r"\s*(?:class|struct|enum(?:\s+class)?)\s+(\w+)", head):
            return [m[1]] if s.body else []
        if m := re.search(r"(operator\s*[^\s(]+|~?\w+)\s*\(", head):
            return [m[1]]
        m = re.match(r"(?:[\w:<>,*&\s]+[\s*&])(\w+)\s*(?:\[[^\]]*\])*\s*(?:=.*|\{.*)?;?\s*$", head, re.S)
        return [m[1]] if m and not re.match(r"\s*(?:using|friend|typedef)\b", head) else []

    # U2-U4
    def script(self, s: Statement, prefix: str, owners: list[tuple[int, int]]) -> None:
        head = re.sub(r"^(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:export\s+)?(?:default\s+)?(?:declare\s+)?", "", s.head.strip())
        if m := re.match(r"(?:abstract\s+)?class\b\s*(\w*)", head):
            self.members(prefix + (m[1] or "default"), s, owners, self.script_member)
        elif m := re.match(r"(?:async\s+)?function\b\s*\*?\s*(\w*)", head):
            self.add(prefix + (m[1] or "default"), s, owners)
        elif m := re.match(r"(?:const\s+)?(?:interface|enum|type|namespace|module)\s+([\w.]+)", head):
            self.add(prefix + m[1], s, owners)
        elif m := re.match(r"(?:const|let|var)\s+", head):
            self.add(prefix + ", ".join(self.bindings(s.start + s.head.index(head[: m.end()]) + m.end())), s, owners)
        elif s.head.strip():
            self.add("source", s, owners)

    def bindings(self, at: int) -> list[str]:
        """U4: the names that the first declarator binds."""
        text = self.masked
        if text[at : at + 1] not in ("{", "["):
            return _NAME.match(text, at)[0].split() or ["source"]
        inside = text[at : self.brackets.closing(at, len(text)) + 1]
        return [m[1] for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*(?=[,}\]=]|$)", re.sub(r"=[^,}\]]*", "", inside))] or ["source"]

    def script_member(self, s: Statement) -> list[str]:
        head = re.sub(r"@[\w.]+(?:\([^)]*\))?", " ", s.head).strip()
        m = re.match(r"(?:(?:public|private|protected|static|readonly|abstract|override|declare|async|get|set|accessor)\s+)*\*?\s*([#\w$]+)\s*(?:[?!]?\s*[(<:=;]|$|[?!])", head)
        return [m[1]] if m else []


def inspect(lang: str, text: str) -> Inspection:
    """The units and comments of one file; text chunks where the language is unknown or the text doesn't parse."""
    if len(text.encode()) <= PARSE_BYTES:
        try:
            if lang == "python":
                units, comments = python_units(text)
            elif lang != "text":
                masked, comments = blanked(text, lang)
                units = Scanner(text, masked, lang).scan()
            else:
                units, comments = [], []
            if units:
                return Inspection(units, comments, "Python" if lang == "python" else "TypeScript")
        except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError, tokenize.TokenError):  # MemoryError: nested too deeply for the parser
            pass
    return Inspection(text_units(text) if text.strip() else [], [], "Text")
