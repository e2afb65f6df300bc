"""Independent DuckDB oracle for every registered query.

The SQL follows the *reference job's* shape rather than the Spark plans:
separate filtered aggregates merged with full outer joins, group totals
merged back onto rows, one filtered copy per campaign.  So the oracle checks
the rewrites the Spark plans make (one-pass conditional aggregation,
factored weighted averages, grouping sets, explode instead of merges), not
just the same SQL run twice.  Only the driver's base tables are visible, so
the input stand-ins of ``FIXTURES.md`` are inlined as CTEs.
"""

from oracle.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
