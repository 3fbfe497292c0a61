"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from . import adapter_queries, case_queries, graph_queries, io_queries, ranking_queries, retrieval_queries, text_queries, unit_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (retrieval_queries, ranking_queries, text_queries, graph_queries, unit_queries, case_queries, io_queries, adapter_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
