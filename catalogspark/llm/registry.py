"""The opN_<name> queries of this subpackage and their DuckDB twins, found in the modules listed here."""

import importlib
from collections.abc import Callable

MODULES = ("token_counts", "quality_classifier", "media_columns", "context_tree", "suffix_dedup", "packing", "ngram_join", "quality_rules", "url_filters", "mixing", "filter_audit", "two_tier_bpe", "vector_codes")


def _modules():
    return [importlib.import_module(f"catalogspark.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "ORACLE_SQL", {}).items()}
