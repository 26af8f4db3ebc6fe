"""Independent SQL for every registered query, run by DuckDB on the raw tables."""

from martlens_oracle.catalog import oracle_queries

__all__ = ["oracle_queries"]
