"""All registered queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.plans import align_queries, combine_queries, encode_queries, eval_queries, extra_queries, factor_queries, index_queries, misc_queries, search_queries, system_queries, table_queries

_MODULES = (factor_queries, align_queries, eval_queries, combine_queries, misc_queries, system_queries, extra_queries, index_queries, encode_queries, table_queries, search_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "ic_series"
