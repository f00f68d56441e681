"""The registered queries of the library and their DuckDB counterparts."""

from kinlight.plans import function_queries, relational_queries, vector_queries, workflow_queries  # noqa: F401
from kinlight.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
