"""All queries of the core library by name, and their SQL counterparts."""

from __future__ import annotations

from auditloom.plans import archive, detection, documents, engine, records, validation

MODULES = (archive, detection, documents, engine, records, validation)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}
