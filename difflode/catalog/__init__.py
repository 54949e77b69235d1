"""Further queries by subject, each module with its SQL."""

from __future__ import annotations

from types import ModuleType


def parts() -> list[ModuleType]:
    """The modules of the catalog; each has ``queries`` and ``oracle_sql``."""
    from difflode.catalog import pairs, records, scoring, text, workflow

    return [scoring, text, records, pairs, workflow]
