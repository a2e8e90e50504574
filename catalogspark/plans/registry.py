"""Registered queries of the catalogue engine and their DuckDB twins."""

from collections.abc import Callable

from catalogspark.plans import assessments, catalogue, contents, copies, decisions, derived, editing, exports, files, intake, merging, metatexts, normal, origins, records, streams

MODULES = (catalogue, records, editing, decisions, derived, files, intake, normal, metatexts, contents, exports, origins, merging, copies, assessments, streams)


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
