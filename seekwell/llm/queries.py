"""The registered queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that defines it
MODULES = {
    "op1_token_counts": "token_counts",
    "op2_quality_classifier": "quality_classifier",
    "op3_token_files": "token_files",
    "op4_packing": "packing",
    "op5_secrets": "secrets",
    "op6_quality_rules": "quality_rules",
    "op7_simhash": "simhash",
    "op8_media": "media",
    "op9_mixing": "mixing",
    "op10_line_dedup": "line_dedup",
    "op11_fill_in_middle": "fill_in_middle",
    "op12_jaccard_join": "jaccard_join",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
