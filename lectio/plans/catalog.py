"""Registry of the driver queries and their DuckDB equivalents."""

from . import q_corpus, q_fixtures

QUERIES = q_corpus.QUERIES | q_fixtures.QUERIES
ORACLE_SQL = q_corpus.ORACLE_SQL | q_fixtures.ORACLE_SQL
