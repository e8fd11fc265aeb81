"""All queries of the ledger, by name, and their SQL."""

from docledger.plans import function_queries, ledger_queries, more_queries, rule_queries

MODULES = (rule_queries, ledger_queries, function_queries, more_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
