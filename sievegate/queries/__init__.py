"""Every query of the engine itself with its DuckDB oracle, by name."""

from sievegate.queries import files, governance, issues, metering, profile, records, scoring, similarity, synthetic  # noqa: F401
from sievegate.queries.registry import ORACLE, QUERIES  # noqa: F401
