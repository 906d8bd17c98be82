"""Every operator as a named query over the given tables, with the same question in SQL."""

from . import exact_queries, history_queries, ledger_queries, model_queries

QUERIES = {**ledger_queries.QUERIES, **model_queries.QUERIES, **exact_queries.QUERIES, **history_queries.QUERIES}
ORACLES = {**ledger_queries.ORACLES, **model_queries.ORACLES, **exact_queries.ORACLES, **history_queries.ORACLES}
