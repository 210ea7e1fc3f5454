"""Text expressions: identifier-aware terms, inflection variants, byte limits, cleaning. Columns only, no Python per row.

"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cuts between terms; everything outside A-Z, a-z, 0-9 separates.
CHUNKS = "[A-Za-z0-9]+"  # matching chunks is some eight times faster in Java than splitting at the negated class
CASE_CUTS = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z]{2})(?=[A-Z](?![A-Z]))"
TERM_CUTS = f"[^A-Za-z0-9]+|{CASE_CUTS}"
#: Words that the case cuts may cut; others are spared the slow look-around.
CASED = "[a-z0-9][A-Z]|[A-Z]{3}"
#: T3, fixed values: endings that inflection adds; a stem keeps at least three characters.
ENDINGS = ("ing", "ies", "ed", "es", "er", "s", "d")
STEM = 3


def terms(text: Column) -> Column:
    """The lower-case terms of a text, of two characters at least, with repeats."""
    pieces = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CHUNKS), 0), lambda c: F.split(c, CASE_CUTS)))
    return F.transform(F.filter(pieces, lambda t: F.length(t) >= 2), lambda t: F.lower(t))


#: T3 in SQL. All variants of a word are prefixes of it, each of another length, so the rules come down to four
#: conditions on its end: what one, two, three and four characters less may be.
_SHORTER = (
    "length({w}) >= 4 AND right({w}, 1) IN ('s', 'd', 'e')",
    "length({w}) >= 5 AND right({w}, 2) IN ('es', 'ed', 'er')",
    "length({w}) >= 6 AND (right({w}, 3) IN ('ing', 'ies') OR (right({w}, 2) IN ('es', 'ed', 'er') AND substring({w}, -3, 1) = 'e'))",
    "length({w}) >= 7 AND right({w}, 3) IN ('ing', 'ies') AND substring({w}, -4, 1) = 'e'",
)


def variants_sql(word: str) -> str:
    """T3 of a lower-case word, a column or a lambda's variable, in SQL: the word, its stems, and each of these less a final e; distinct."""
    less = [f"IF({c.format(w=word)}, left({word}, length({word}) - {k}), '')" for k, c in enumerate(_SHORTER, 1)]
    return f"array_remove(array({word}, {', '.join(less)}), '')"


def variants(word: str) -> Column:
    """T3 of the lower-case words in a column."""
    return F.expr(variants_sql(word))


def variant_count(word: str) -> Column:
    """The number of variants of the lower-case words in a column."""
    return F.expr(f"1 + {' + '.join(f'IF({c.format(w=word)}, 1, 0)' for c in _SHORTER)}")


def variants_of(word: str) -> set[str]:
    """T3 for one word of a query, on the driver."""
    base = {word} | {word[: -len(e)] for e in ENDINGS if word.endswith(e) and len(word) >= STEM + len(e)}
    return base | {b[:-1] for b in base if b.endswith("e") and len(b) > STEM}


def query_terms(query: str) -> Counter:
    """T1 and T3 of a query: term -> how often it occurs among the variants of the query's words."""
    found = (t.lower() for t in re.split(TERM_CUTS, query) if len(t) >= 2)
    return Counter(v for t in found for v in variants_of(t))


def inflections(term: str) -> list[str]:
    """All words of which ``term`` is a variant."""
    stems = [term, term + "e"] if len(term) >= STEM else [term]
    more = [s + e for s in stems for e in ENDINGS if len(s) >= STEM]
    return sorted({term, *(stems[1:]), *more})


def clamp_bytes(text: Column, n: int) -> Column:
    """At most ``n`` bytes of UTF-8, cut between characters."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(min(4, n + 1))]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*cuts))


def one_line(text: Column) -> Column:
    """P10: line ends become spaces; ends are trimmed."""
    return F.trim(F.translate(text, "\r\n", "  "))


def state_header(query: Column, rest: Column) -> Column:
    """The query goes first, so a byte limit never removes it."""
    return F.concat(F.lit("Query: "), one_line(query), F.lit("\n"), rest)


def quote(text: Column) -> Column:
    """A JSON string without C1, bidirectional and separator controls."""
    inner = F.to_json(F.struct(F.regexp_replace(text, "[\u007f-\u009f\u2028-\u202e\u2066-\u2069]", "").alias("s")))
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def shell_arg(text: Column) -> Column:
    """Single-quoted for a POSIX shell."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def round4(x: Column) -> Column:
    """P16."""
    return F.round(x, 4)


def lines_text(source: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (from 1) of a source."""
    return F.array_join(F.slice(F.split(source, "\n"), first, last - first + 1), "\n")


def line_count(source: Column) -> Column:
    return F.length(source) - F.length(F.replace(source, F.lit("\n"))) + 1


def fence(source: Column) -> Column:
    """A run of backticks longer than any in the source, three at least."""
    runs = F.transform(F.regexp_extract_all(source, F.lit("(`+)"), 1), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(F.array_max(runs), F.lit(0)) + 1, F.lit(3)))


def header_text(source: Column) -> Column:
    """The first telling line among the first 40 that aren't blank: comment marks off, no licence talk, a letter, at most 120 characters."""
    some = F.slice(F.filter(F.split(source, "\n"), lambda x: F.trim(x) != ""), 1, 40)
    long = F.filter(some, lambda x: F.octet_length(F.trim(x)) > 6)
    bare = F.transform(long, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^/*\**#*!*", "")))
    telling = F.filter(bare, lambda x: ~F.lower(x).rlike("licen[sc]e|copyright") & x.rlike(r"\p{L}"))
    return F.substring(F.get(telling, F.lit(0)), 1, 120)


def signature_line(lines: Column) -> Column:
    """The first line of a unit's lines, or the second if that is blank; trimmed, 70 characters."""
    first, second = F.trim(F.get(lines, F.lit(0))), F.trim(F.get(lines, F.lit(1)))
    return F.substring(F.when(first != "", first).otherwise(F.coalesce(second, F.lit(""))), 1, 70)


def docstring_line(lines: Column) -> Column:
    """The first of six lines that opens a documentation comment, its marks off; needs a letter; 90 characters."""
    opened = F.filter(F.slice(lines, 1, 6), lambda x: F.trim(x).rlike('^(///|/\\*\\*|#|""")'))
    bare = F.transform(opened, lambda x: F.trim(F.regexp_replace(F.trim(x), '^[/*"#\\s]+|[/*"#\\s]+$', "")))
    return F.substring(F.get(F.filter(bare, lambda x: x.rlike(r"\p{L}")), F.lit(0)), 1, 90)
