"""Path expressions: walk policy, languages, test files, ancestors."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: F3, fixed values: directories of dependencies and build products.
DEPENDENCY_DIRS = ("node_modules", "vendor", "venv", ".venv", ".tox", "__pycache__", "dist", "build", "coverage", "target", ".next", ".nuxt", ".turbo")
#: F4, fixed values: names that may hold secrets, and such suffixes.
SENSITIVE_NAMES = (".env", "credentials", "credentials.json", "secrets.json", "secrets.yaml", "secrets.yml", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".netrc", ".npmrc", ".pypirc")
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx")
#: P1, fixed values: language by extension.
LANGUAGES = {
    "python": ("py", "pyi"), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx", "jsx"), "javascript": ("js", "mjs", "cjs"), "rust": ("rs",), "go": ("go",),
    "java": ("java",), "swift": ("swift",), "kotlin": ("kt", "kts"), "cpp": ("cpp", "cc", "cxx", "c", "h", "hpp", "hh", "hxx", "ipp"),
}
#: F16, fixed values: directory names of tests.
TEST_DIRS = ("test", "tests", "androidtest", "testfixtures", "__tests__")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without one."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def language(path: Column) -> Column:
    """P1; text for all other files."""
    table = F.create_map(*chain.from_iterable((F.lit(e), F.lit(lang)) for lang, exts in LANGUAGES.items() for e in exts))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("text"))


def is_sensitive(name: Column) -> Column:
    """F4 for one name."""
    low = F.lower(name)
    found = low.isin(*SENSITIVE_NAMES) | low.startswith(".env.")
    for s in SENSITIVE_SUFFIXES:
        found = found | low.endswith(s)
    return found


def allowed(path: Column, hidden: bool = False, dependencies: bool = False, sensitive: bool = False) -> Column:
    """F1-F4 for a file's path, on every segment; dependency names count for directories only."""
    parts = F.split(path, "/")
    keep = ~F.array_contains(parts, ".git")
    if not hidden:
        keep = keep & ~F.exists(parts, lambda x: x.startswith("."))
    if not dependencies:
        keep = keep & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, DEPENDENCY_DIRS)))
    if not sensitive:
        keep = keep & ~F.exists(parts, is_sensitive)
    return keep


def is_test_path(path: Column) -> Column:
    """F16: by a segment's name, else by what the language's test files are called."""
    name, ext = file_name(path), F.lower(extension(path))
    stem = F.when(F.instr(name, ".") > 0, F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1)).otherwise(name)
    low = F.lower(stem)
    by_name = (
        F.when(ext == "py", low.startswith("test_") | low.endswith("_test"))
        .when(ext == "go", low.endswith("_test"))
        .when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "mts"), low.endswith(".test") | low.endswith(".spec") | low.endswith("_test"))
        .otherwise(stem.endswith("Test") | stem.endswith("Tests") | stem.endswith("IT") | low.endswith("_test"))
    )
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, TEST_DIRS))) | by_name


def ancestors(path: Column) -> Column:
    """The directories above a file, the root ("") first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
