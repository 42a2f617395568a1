"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import q_backtest, q_data, q_features, q_market, q_model, q_models, q_more, q_streams, recursive_sql, walk_sql

MODULES = [q_features, q_market, q_model, q_data, q_backtest, q_more, q_models, q_streams]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in [*MODULES, recursive_sql, walk_sql] for k, s in m.ORACLES.items()}
