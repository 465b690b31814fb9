"""The registered queries of the evaluation operators, and the SQL that checks them."""

from . import judge_queries, retrieval_queries, run_queries, saved_queries, text_queries

MODULES = (text_queries, retrieval_queries, judge_queries, run_queries, saved_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
