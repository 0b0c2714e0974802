"""The library's queries over the driver's tables and their SQL twins.

Domain tables are mapped onto the driver's: documents are evidence, embeddings its hashes and vectors, events both the
append-only results and the audit log, orders and customers the cases and their owners, conversations the lineages,
labels the measured signals and pages the occurrences on the web.
"""

from __future__ import annotations

from evidara.plans import cases, derived, endpoints, graphs, measures, reads, reports, retrieval, signals

_MODULES = (retrieval, cases, signals, derived, graphs, measures, reads, reports, endpoints)


def queries():
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
