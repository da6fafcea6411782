"""The registered queries and their DuckDB SQL, and the domain pipelines."""

from __future__ import annotations

from . import cleaning, linking, patterns, upkeep

QUERIES = {**cleaning.QUERIES, **upkeep.QUERIES, **linking.QUERIES, **patterns.QUERIES}
ORACLES = {**cleaning.ORACLES, **upkeep.ORACLES, **linking.ORACLES, **patterns.ORACLES}
