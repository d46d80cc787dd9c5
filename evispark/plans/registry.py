"""All queries of the library by name, and the SQL that checks them."""

from . import analytic, clocks, curation, evaluation, queues, relational, texts

_PLANS = (analytic, curation, relational, clocks, evaluation, queues, texts)
QUERIES: dict = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}

#: Sums of integers, which the checking engine widens to 128 bits.
_SUMS = {
    "sessions": ["session"], "ir_metrics": ["hits"], "conditional_sums": ["purchases", "large"], "budget_reservation": ["used"], "usage_by_cycle": ["chars", "asked", "answered"],
    "usage_by_role": ["chars"], "usage_totals": ["turns", "longest"], "audit_bad_rate": ["bad"], "label_metrics": ["kept"], "storage_stats": ["chars"],
}


def _narrow(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _SUMS.get(name, []))
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) t" if casts else sql


ORACLES: dict = {name: _narrow(name, sql) for plan in _PLANS for name, sql in plan.ORACLES.items()}
