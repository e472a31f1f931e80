"""All queries and their SQL."""

from . import import_queries, queries, report_queries  # noqa: F401

QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.ORACLE_SQL)
