"""Every operator run over the star-schema tables, with the SQL that must give the same rows."""

from binwright.workload import (  # noqa: F401
    aggregates,
    extracts,
    filters,
    ingests,
    joins,
    quality,
    ranks,
    scalars,
    tables,
)
from binwright.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
