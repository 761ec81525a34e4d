"""Audit queries by section of the operator inventory; each module registers a DataFrame form and DuckDB SQL."""

from tracewright.audits import extraction, graphs, metrics, predicates, relations, reports, scheduling, slices, stores
from tracewright.audits import composites  # isort: skip  it builds on the queries of the others
from tracewright.audits.registry import COVERS, QUERIES, SQL

__all__ = ["COVERS", "QUERIES", "SQL", "composites", "extraction", "graphs", "metrics", "predicates", "relations", "reports", "scheduling", "slices", "stores"]
