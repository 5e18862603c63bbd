"""All queries of the timeline engine with their SQL."""

from __future__ import annotations

from timeweave.plans import ingest, spectra, timelines, transcripts
from timeweave.plans.timelines import condensed  # noqa: F401 - the flagship query

MODULES = (ingest, timelines, transcripts, spectra)


def queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
