"""Paths for tables that have none: a fixed function of doc_id and source, in both dialects, that meets every branch of the path operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRS = ("src", "tests", "node_modules", ".config", "build", "lib/core", "__tests__", "docs")
STEMS = (("mod_", ""), ("test_", ""), ("", "_test"), ("Foo", "Test"), (".env.", ""), ("", ".spec"), ("latest", ""))
EXTENSIONS = ("py", "rs", "ts", "java", "go", "kt", "cpp", "md", "pem")


def derived_path(doc_id: Column, source: Column, extension: bool = True) -> Column:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (doc_id % len(values) + 1).cast("int"))
    parts = [pick(DIRS), F.lit("/"), source, F.lit("/"), pick([a for a, _ in STEMS]), doc_id.cast("string"), pick([b for _, b in STEMS])]
    return F.concat(*parts, *([F.lit("."), pick(EXTENSIONS)] if extension else []))


def derived_path_sql(doc_id: str = "doc_id", source: str = "source", extension: bool = True) -> str:
    pick = lambda values: f"([{', '.join(repr(v) for v in values)}])[({doc_id} % {len(values)} + 1)::INT]"
    base = f"{pick(DIRS)} || '/' || {source} || '/' || {pick([a for a, _ in STEMS])} || {doc_id}::VARCHAR || {pick([b for _, b in STEMS])}"
    return f"({base} || '.' || {pick(EXTENSIONS)})" if extension else f"({base})"
