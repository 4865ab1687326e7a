"""The query catalogue: every query with its SQL statement where SQL can say it."""

from loomtrace.plans import acceptance, graph, ingest, more, problems, text, units

_MODULES = [problems, graph, units, text, acceptance, more, ingest]


def all_queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def all_oracle() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
