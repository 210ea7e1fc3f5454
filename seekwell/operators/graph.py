"""Import specifiers, their resolution, and propagation along the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language

#: Lines searched for imports, specifiers kept; factor, rounds and least gain of propagation.
IMPORT_LINES, MAX_IMPORTS = 400, 24
FACTOR, ROUNDS, GAIN = 0.75, 2, 1e-9

_JS = r"""^\s*(?:import|export)\b[^'"]*?\bfrom\s*['"]([^'"]+)['"]|^\s*import\s*['"]([^'"]+)['"]|\b(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)"""
#: Language -> patterns; a line's specifier is the first group that matches.
PATTERNS = {
    "python": (r"^\s*from\s+([.\w]+)\s+import\b", r"^\s*import\s+([.\w]+)"),
    "typescript": (_JS,), "tsx": (_JS,), "javascript": (_JS,),
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"),
    "java": (r"^\s*import\s+(?:static\s+)?([\w.]+)",), "kotlin": (r"^\s*import\s+([\w.]+)",), "swift": (r"^\s*(?:@\w+\s+)*import\s+(?:\w+\s+)?([\w.]+)",),
    "cpp": (r'^\s*#\s*include\s*"([^"]+)"',),
}


def _first_group(line: Column, pattern: str) -> Column:
    n = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")
    groups = [F.regexp_extract(line, pattern, i) for i in range(1, n + 1)]
    return reduce(lambda a, b: F.when(a != "", a).otherwise(b), groups)


def _line_specifiers(lines: Column, patterns: tuple[str, ...]) -> Column:
    per_line = F.flatten(F.transform(lines, lambda x: F.array(*[_first_group(x, p) for p in patterns])))
    return F.filter(per_line, lambda s: s != "")


def import_specifiers(path: Column, source: Column) -> Column:
    """The specifiers of a file's first 400 lines in order, distinct, at most 24; grouped Go imports are read line by line."""
    lines = F.slice(F.split(source, "\n"), 1, IMPORT_LINES)
    lang = language(path)
    go_text = F.array_join(lines, "\n")
    single = F.regexp_extract_all(go_text, F.lit(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), 1)
    blocks = F.regexp_extract_all(go_text, F.lit(r"(?ms)^import\s*\((.*?)^\s*\)"), 1)
    grouped = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), 1)))
    found = F.when(lang == "go", F.concat(single, grouped))
    for name, patterns in PATTERNS.items():
        found = found.when(lang == name, _line_specifiers(lines, patterns))
    return F.slice(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))), 1, MAX_IMPORTS)


def _up(directory: Column, levels: Column) -> Column:
    """A directory so many levels up; the root is the empty string."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0))), "/")


def _in(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def normalized(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda a, x: F.when((x == ".") | (x == ""), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def candidates(path: Column, spec: Column) -> Column:
    """The paths that a specifier may mean, likeliest first, by the importer's language."""
    lang = language(path)
    here = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    each = lambda base, *suffixes: [F.concat(base, F.lit(s)) for s in suffixes]
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    base = _up(here, dots - 1)
    relative = F.when(rest == "", base).otherwise(_in(base, rest))
    py_rel = F.array(*each(relative, ".py", ".pyi", "/__init__.py"))
    py_abs = F.array(*[x for b in (rest, F.concat(F.lit("src/"), rest), _in(here, rest)) for x in each(b, ".py", ".pyi", "/__init__.py")])
    js = normalized(_in(here, spec))
    no_ext = F.regexp_replace(js, r"\.[mc]?jsx?$", "")
    js_all = F.array(js, *each(js, ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"), *each(no_ext, ".ts", ".tsx"))
    # Rust: crate::a::Item names src/a.rs or src/a/mod.rs; ever shorter prefixes are tried.
    parts = F.filter(F.split(F.regexp_replace(spec, "^(crate|self|super)::", ""), "::"), lambda x: x != "")
    root = F.when(spec.startswith("crate::"), F.when(F.instr(path, "src/") > 0, F.regexp_extract(path, "^(.*?src)/", 1)).otherwise(F.lit("src"))).when(spec.startswith("super::"), _up(here, F.lit(1))).otherwise(here)
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rust = F.when(F.size(parts) > 0, F.flatten(F.transform(prefixes, lambda p: F.array(F.concat(_in(root, p), F.lit(".rs")), F.concat(_in(root, p), F.lit("/mod.rs")))))).otherwise(F.array().cast("array<string>"))
    dotted = F.replace(spec, F.lit("."), F.lit("/"))
    java = F.array(*[F.concat(F.lit(r), dotted, F.lit(".java")) for r in ("src/main/java/", "src/test/java/", "src/", "")])
    kotlin = F.array(*[F.concat(F.lit(r), dotted, F.lit(e)) for r in ("src/main/kotlin/", "src/main/java/", "src/test/kotlin/", "src/", "") for e in (".kt", ".java")])
    cpp = F.array(normalized(_in(here, spec)), normalized(spec), normalized(F.concat(F.lit("include/"), spec)), normalized(F.concat(F.lit("src/"), spec)))
    return (
        F.when((lang == "python") & (dots > 0), py_rel).when(lang == "python", py_abs)
        .when(lang.isin("typescript", "tsx", "javascript") & spec.startswith("."), js_all)
        .when(lang == "rust", rust).when(lang == "java", java).when(lang == "kotlin", kotlin).when(lang == "cpp", cpp)
        .otherwise(F.array().cast("array<string>"))
    )


def resolve(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (importer, importee) from (path, candidates: ordered paths per specifier): the first candidate that is a
    file, never the importer itself. files (path). Distinct."""
    asked = specifiers.select("path", F.xxhash64("candidates").alias("spec_idx"), F.posexplode("candidates").alias("rank", "candidate"))
    met = asked.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").where("candidate <> path")
    return met.groupBy("path", "spec_idx").agg(F.min_by("candidate", "rank").alias("importee")).select(F.col("path").alias("importer"), "importee").distinct()


def import_edges(files: DataFrame) -> DataFrame:
    """The import graph of (path, source)."""
    specs = files.select("path", F.explode(import_specifiers(F.col("path"), F.col("source"))).alias("spec"))
    return resolve(specs.select("path", candidates(F.col("path"), F.col("spec")).alias("candidates")), files)


def propagate(scores: DataFrame, edges: DataFrame, factor: float = FACTOR, rounds: int = ROUNDS) -> DataFrame:
    """(path, lex) after ``rounds`` times new = max(own, factor * max over importees) where that gains more than
    1e-9; all reads of a round come before its writes. Importees without a score are ignored."""
    for _ in range(rounds):
        best = edges.join(scores.select(F.col("path").alias("importee"), "lex"), "importee").groupBy("importer").agg((F.max("lex") * factor).alias("pulled"))
        joined = scores.join(best.withColumnRenamed("importer", "path"), "path", "left")
        scores = joined.withColumn("lex", F.when(F.col("pulled") > F.col("lex") + GAIN, F.col("pulled")).otherwise(F.col("lex"))).drop("pulled")
    return scores
