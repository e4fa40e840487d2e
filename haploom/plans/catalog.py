"""All registered queries of the engine and their DuckDB SQL."""

from haploom.plans import file_queries, haplotype_queries  # noqa: F401  (they register their queries)
from haploom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
