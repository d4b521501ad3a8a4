"""Every query of the engine itself, with its SQL twin where SQL can express it."""

from __future__ import annotations

from phenogrid.plans import q_clean, q_eval, q_models, q_scale, q_summaries, q_time

QUERIES: dict = {}
SQL: dict = {}
for _part in (q_models, q_clean, q_scale, q_eval, q_time, q_summaries):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
