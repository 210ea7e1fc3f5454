"""The lexical filter over a stream of new documents: stateless, so it needs no watermark.

BM25's statistics belong to a whole corpus; a stream has none yet, so documents are passed on by the share of the
query's words (in any inflection) that they hold.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TERM_CUTS, inflections, terms, variants_of


def matching(docs: DataFrame, query: str, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs``, a stream or a table, with share: that of the query's distinct words found in the text; only rows of at least ``least``."""
    asked = sorted({t.lower() for t in re.split(TERM_CUTS, query) if len(t) >= 2})
    if not asked:
        return docs.withColumn("share", F.lit(0.0)).where(F.lit(least <= 0))
    held = terms(F.coalesce(F.col(text_col), F.lit("")))
    forms = [sorted({w for v in variants_of(t) for w in inflections(v)}) for t in asked]
    found = [F.arrays_overlap(held, F.array(*map(F.lit, f))).cast("int") for f in forms]
    total = found[0]
    for x in found[1:]:
        total = total + x
    return docs.withColumn("share", total / len(asked)).where(F.col("share") >= least)


def follow(stream: DataFrame, query: str, name: str, least: float = 0.5, text_col: str = "text"):
    """Starts a query that keeps what matches under ``name`` in memory; for other sinks, write ``matching`` yourself."""
    return matching(stream, query, least, text_col).writeStream.format("memory").queryName(name).outputMode("append").start()
