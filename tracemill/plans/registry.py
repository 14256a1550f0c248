"""All queries outside the llm subpackage, and their SQL."""

from tracemill.plans import audit_queries, extension_queries, hook_queries, load_queries, load_sql, more_queries, queries, rule_queries, view_queries

QUERIES = queries.QUERIES | more_queries.QUERIES | load_queries.QUERIES | hook_queries.QUERIES | audit_queries.QUERIES | view_queries.QUERIES | rule_queries.QUERIES | extension_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | more_queries.ORACLE_SQL | load_sql.ORACLE_SQL | hook_queries.ORACLE_SQL | audit_queries.ORACLE_SQL | view_queries.ORACLE_SQL | rule_queries.ORACLE_SQL | extension_queries.ORACLE_SQL
