"""All registered queries of the record-linkage library, by operator id."""

from __future__ import annotations

from tessera.plans import decisions, extra, linkage, relational

_MODULES = (relational, decisions, linkage, extra)

flagship = decisions.flagship


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.oracles().items()}
