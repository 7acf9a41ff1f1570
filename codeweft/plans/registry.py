"""All queries of the core, with the SQL they are checked against."""

from codeweft.plans import core_queries, extract_queries, hierarchy_queries, pattern_queries

MODULES = [hierarchy_queries, core_queries, pattern_queries, extract_queries]


def core_queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def core_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}
