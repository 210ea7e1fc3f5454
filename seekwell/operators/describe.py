"""Descriptions of files and units, and local calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp_bytes, docstring_line, header_text, line_count, signature_line

#: Bytes of a description, its names, imports and characters of content; calls of a unit's description.
DESCRIPTION_BYTES, NAMES, IMPORTS, CONTENT_CHARS, CALLS = 600, 12, 6, 200, 4
#: Words of 64 bits that tell, of each length, which hashes the names of a file have.
WORDS = 4


def description(path: Column, source: Column, names: Column, imports: Column) -> Column:
    """P5: path and lines, then header, declarations (F15) and imports as far as there are any; else the beginning of the content."""
    header = header_text(source)
    named = F.slice(F.filter(names, lambda n: ~n.endswith(".context") & (n != "source")), 1, NAMES)
    brought = F.slice(imports, 1, IMPORTS)
    body = F.array(
        F.when(F.coalesce(header, F.lit("")) != "", F.concat(F.lit("Header: "), header)),
        F.when(F.size(named) > 0, F.concat(F.lit("Declarations: "), F.array_join(named, ", "))),
        F.when(F.size(brought) > 0, F.concat(F.lit("Imports: "), F.array_join(brought, ", "))),
    )
    kept = F.array_compact(body)
    content = F.concat(F.lit("Content: "), F.translate(F.substring(source, 1, CONTENT_CHARS), "\n", " "))
    first = F.concat(F.lit("File: "), path, F.lit(" ("), line_count(source).cast("string"), F.lit(" lines)"))
    return clamp_bytes(F.concat_ws("\n", first, F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(content)), DESCRIPTION_BYTES)


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return files.select("path", F.posexplode(F.split("source", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def _definitions(units: DataFrame) -> DataFrame:
    """(path, d_idx, called, d_start, d_end) of the units that can be called."""
    defs = units.where(~F.col("name").endswith(".context") & (F.col("name") != "source")).select("path", F.col("unit_idx").alias("d_idx"), F.regexp_extract("name", r"([^.:]+)$", 1).alias("called"), F.col("start_line").alias("d_start"), F.col("end_line").alias("d_end"))
    return defs.where((F.length("called") > 0) & ~F.contains("called", F.lit("(")))


def _endings(defs: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, line, called): of what stands before a line's parentheses the distinct endings that may be names of its file: as long as one, and
    with a hash that one of that length has. Lines are dealt by file before they're cut; of their endings, many times their size, few others
    than names move on."""
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(64 * WORDS)).cast("int")
    word = lambda name: F.floor(place(name) / 64).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place("called") % 64)
    masks = [F.bit_or(F.when(word("called") == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(WORDS)]
    by_size = defs.groupBy("path", F.length("called").alias("n")).agg(*masks)
    sizes = by_size.groupBy("path").agg(F.collect_list(F.struct("n", F.array(*(f"m{i}" for i in range(WORDS))).alias("m"))).alias("sizes"))  # a few numbers for each length
    may_be = lambda s, e: F.getbit(F.get(s["m"], word(e)), place(e) % 64) == 1
    pieces = F.split("text", "\\(")
    before = F.array_distinct(F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    ends = F.flatten(F.transform(before, lambda p: F.transform(F.filter("sizes", lambda s: (s["n"] <= F.length(p)) & may_be(s, F.right(p, s["n"]))), lambda s: F.right(p, s["n"]))))
    some = lines.where(F.instr("text", "(") > 0).select("path", "line", "text")
    return some.join(sizes, "path").select("path", "line", F.explode(F.array_distinct(ends)).alias("called"))


def calls(units: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, d_idx, called, d_start, d_end, line): lines (distinct by path and line) of a file that hold ``name(`` of one of its units;
    names as they're called, the part after the last dot or ::. A name holds no parenthesis.

    What stands before an opening parenthesis ends in a called name, so a line is cut at its parentheses, and of each piece the endings that
    may be names of its file are the keys of an equi-join: no line meets a definition that it doesn't name."""
    defs = _definitions(units)
    return _endings(defs, lines).join(defs, ["path", "called"]).select("path", "d_idx", "called", "d_start", "d_end", "line")


def _calls_of_units(units: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, unit_idx, calls): the first CALLS definitions, in their order, that a unit's lines call and that don't lie in the unit. Names
    are met, line by line, before their definitions are, so a name that many units bear costs its list once for each unit that calls it."""
    defs = _definitions(units)
    named = defs.groupBy("path", "called").agg(F.array_sort(F.collect_list(F.struct("d_idx", "d_start", "d_end"))).alias("defs"))
    met = _endings(defs, lines).join(named.select("path", "called"), ["path", "called"], "left_semi")
    held = units.where("start_line <= end_line").select("path", "unit_idx", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    asked = met.join(held, ["path", "line"]).select("path", "unit_idx", "start_line", "end_line", "called").distinct()
    other = F.filter("defs", lambda d: ~((d["d_start"] >= F.col("start_line")) & (d["d_end"] <= F.col("end_line"))))
    first = F.transform(F.slice(other, 1, CALLS), lambda d: F.struct(d["d_idx"].alias("d_idx"), F.col("called").alias("called")))
    found = asked.join(named, ["path", "called"]).select("path", "unit_idx", first.alias("first")).where(F.size("first") > 0)
    in_order = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("first")))), 1, CALLS)
    return found.groupBy("path", "unit_idx").agg(F.transform(in_order, lambda x: x["called"]).alias("calls"))


def unit_descriptions(units: DataFrame, files: DataFrame) -> DataFrame:
    """(path, unit_idx, description): name, lines, signature, a docstring if the signature is short, and up to four
    definitions of the file, in their order, that its lines call and that don't lie in the unit itself. A source meets all its units at
    once and is split into lines once; no unit carries more than its signature and docstring on."""
    called = _calls_of_units(units, numbered_lines(files.join(units.select("path").distinct(), "path", "left_semi")))
    every = units.groupBy("path").agg(F.collect_list(F.struct("unit_idx", "name", "start_line", "end_line")).alias("units")).join(files.select("path", "source"), "path")
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  # evaluates value once

    def shown(u: Column, body: Column) -> Column:
        head = F.concat(u["name"], F.lit(" (lines "), u["start_line"].cast("string"), F.lit("-"), u["end_line"].cast("string"), F.lit("): "), signature_line(body))
        return F.struct(u["unit_idx"].alias("unit_idx"), head.alias("head"), docstring_line(body).alias("doc"))

    body = lambda u, lines: F.slice(lines, u["start_line"], F.least(u["end_line"] - u["start_line"] + 1, F.lit(6)))
    texts = let(F.split("source", "\n"), lambda lines: F.transform("units", lambda u: let(body(u, lines), lambda some: shown(u, some))))
    rows = every.select("path", F.explode(texts).alias("u")).select("path", "u.*").join(called, ["path", "unit_idx"], "left")
    parts = F.array_compact(F.array(F.col("head"), F.when(F.octet_length("head") < 60, F.col("doc")), F.when(F.size("calls") > 0, F.concat(F.lit("calls "), F.array_join("calls", ", ")))))
    return rows.select("path", "unit_idx", F.array_join(parts, " | ").alias("description"))


def call_leads(units: DataFrame, files: DataFrame, selected: DataFrame) -> DataFrame:
    """(path, caller, name, start_line, end_line) in Python files: selected lines outside the callee's own range that hold
    ``name(``; the caller is the innermost unit, a class's context too, or module. selected (path, start_line, end_line)."""
    from .ranges import innermost

    python = files.where(F.col("path").rlike(r"\.pyi?$"))
    found = calls(units, numbered_lines(python)).where(~F.col("line").between(F.col("d_start"), F.col("d_end")))
    chosen = selected.select("path", F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    met = found.join(chosen, "path").where(F.col("line").between(F.col("s_start"), F.col("s_end"))).select("path", "called", "line").distinct()
    held = innermost(met, units)
    return held.select("path", F.coalesce("unit", F.lit("module")).alias("caller"), F.col("called").alias("name"), F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line")).distinct()
