"""Policy rules as data: predicates compile to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def compile_predicate(rule: dict) -> Column:
    """`all` / `any` of rules, or {field, op, value} with op eq, in, lt, lte, gt, gte, exists. Empty is true; a null or a value
    that is no number compares as false."""
    if not rule:
        return F.lit(True)
    if "all" in rule:
        return reduce(lambda a, b: a & b, map(compile_predicate, rule["all"]), F.lit(True))
    if "any" in rule:
        return reduce(lambda a, b: a | b, map(compile_predicate, rule["any"]), F.lit(False))
    c, op, value = F.col(rule["field"]), rule["op"], rule.get("value")
    if op == "exists":
        return c.isNotNull() == F.lit(bool(value if value is not None else True))
    if op == "eq":
        return F.coalesce(c == F.lit(value), F.lit(False))
    if op == "in":
        return F.coalesce(c.isin(*value), F.lit(False))
    try:
        number = float(value)
    except (TypeError, ValueError):
        return F.lit(False)
    return F.coalesce(_NUMERIC[op](c.cast("string").try_cast("double"), F.lit(number)), F.lit(False))


def first_match(rules: list[tuple[str, dict]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, rule in rules:
        out = F.when(compile_predicate(rule), name) if out is None else out.when(compile_predicate(rule), name)
    return F.lit(default) if out is None else out.otherwise(default)
