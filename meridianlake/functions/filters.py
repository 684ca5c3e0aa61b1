"""Predicates over JSON metadata: a conjunction of scalar, list or {operator: value} conditions by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "nin")


class UnknownOperator(ValueError):
    pass


def _kind(value) -> str:
    return {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(value)]


def _same(actual: Column, typed: Column, value) -> Column:
    """Strict equality: type and value agree; None stands for a missing or null key."""
    if value is None:
        return typed.isNull() | (typed == "VOID")
    names = {"boolean": ["BOOLEAN"], "bigint": ["BIGINT", "INT", "SMALLINT", "TINYINT"], "double": ["DOUBLE", "FLOAT"], "string": ["STRING"]}[_kind(value)]
    of_type = typed.isin(names) | (typed.startswith("DECIMAL") if _kind(value) == "double" else F.lit(False))
    return F.coalesce(of_type & (F.try_variant_get(actual, "$", _kind(value)) == F.lit(value)), F.lit(False))


def _any(actual: Column, typed: Column, values) -> Column:
    return reduce(lambda a, b: a | b, (_same(actual, typed, v) for v in values), F.lit(False))


def _order(actual: Column, typed: Column, op: str, value) -> Column:
    """A missing key counts as equal to 0, false and the empty text, and as less than any other value."""
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    got = F.try_variant_get(actual, "$", "double" if numeric else "string")
    want = F.lit(float(value)) if numeric else F.lit(value)
    compared = {"gt": got > want, "gte": got >= want, "lt": got < want, "lte": got <= want}[op]
    missing = op in ("lte", "gte") if value in (0, "", False) else op in ("lt", "lte")
    return F.when(typed.isNull() | (typed == "VOID"), F.lit(missing)).otherwise(F.coalesce(compared, F.lit(False)))


def condition(metadata: Column, key: str, expected) -> Column:
    """Condition on one key of a VARIANT object."""
    actual = F.try_variant_get(metadata, f'$["{key}"]', "variant")
    typed = F.upper(F.schema_of_variant(actual))
    if isinstance(expected, dict):
        parts = []
        for op, value in expected.items():
            if op not in OPERATORS:
                raise UnknownOperator(f"unknown filter operator {op!r}")
            if op == "eq":
                parts.append(_same(actual, typed, value))
            elif op == "neq":
                parts.append(~_same(actual, typed, value))
            elif op in ("in", "nin"):
                listed = isinstance(value, (list, tuple))
                parts.append(F.lit(False) if not listed else _any(actual, typed, value) if op == "in" else ~_any(actual, typed, value))
            else:
                parts.append(_order(actual, typed, op, value))
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if isinstance(expected, (list, tuple)):
        return _any(actual, typed, expected)
    return _same(actual, typed, expected)


def matches(metadata: Column, filters: dict) -> Column:
    """Conjunction of all conditions; metadata is JSON text, unreadable text has no keys."""
    variant = F.try_parse_json(metadata)
    return reduce(lambda a, b: a & b, (condition(variant, k, v) for k, v in filters.items()), F.lit(True))


def scoped(filters: dict | None, tenant: str) -> dict:
    """Filters within a tenant: the tenant replaces any that the caller gave."""
    return {**(filters or {}), "tenant_id": tenant}


def valid_namespace(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-]{1,64}$")


def remote_filter(filters: dict) -> dict:
    """The filters in the form that remote vector services take: a list of conditions that must all hold.

    Only equality, lists and ranges can be told to such a service; other operators are refused.
    """
    must = []
    for key, expected in filters.items():
        if isinstance(expected, dict):
            if other := set(expected) - {"gt", "gte", "lt", "lte"}:
                raise UnknownOperator(f"operators {sorted(other)} can't be sent to a remote service")
            must.append({"key": key, "range": dict(expected)})
        elif isinstance(expected, (list, tuple)):
            must.append({"key": key, "match": {"any": list(expected)}})
        else:
            must.append({"key": key, "match": {"value": expected}})
    return {"must": must} if must else {}
