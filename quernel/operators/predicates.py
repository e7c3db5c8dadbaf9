"""Predicates of a SELECT as columns, with literals coerced to the column's kind once, in the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions import semistructured as semi
from ..functions import text
from ..sql import ast
from ..types import Typed, coerce, literal


def between(column: Column, low: Column, high: Column) -> Column:
    """Inclusive; reversed bounds are swapped."""
    return (column >= F.least(low, high)) & (column <= F.greatest(low, high))


class Binder:
    """Predicates over columns of known kinds: {lower-case name: (name, kind, Spark type)}."""

    def __init__(self, columns: dict[str, tuple[str, str, str]], semi_join=None):
        self.columns, self.semi_join = columns, semi_join

    def column(self, name: str) -> tuple[Column, str, str]:
        try:
            real, kind, spark_type = self.columns[name.lower()]
        except KeyError:
            raise SchemaError(f"unknown column {name}") from None
        return F.col(f"`{real}`"), kind, spark_type

    def equal(self, name: str, value) -> Column:
        c, kind, spark_type = self.column(name)
        if value is None:
            return F.lit(None).cast("boolean")  # unknown, whatever stands around it
        if kind in ("JSON", "JSONB"):
            return semi.canonical_json(c) == F.lit(semi.canonical_json_literal(coerce(value, "JSON")))
        if kind == "GEOMETRY":
            g = literal(value, kind)
            return semi.overlaps(c, g) & (c == g)
        return c == literal(value, kind, spark_type)

    def bind(self, p: ast.Predicate) -> Column:
        if isinstance(p, ast.Logic):
            parts = [self.bind(x) for x in p.parts]
            return ~parts[0] if p.op == "not" else reduce((lambda a, b: a & b) if p.op == "and" else (lambda a, b: a | b), parts)
        if isinstance(p, ast.Compare):
            if p.op in ("=", "<>"):
                hit = self.equal(p.column, p.value)
                return hit if p.op == "=" else ~hit
            c, kind, spark_type = self.column(p.column)
            v = literal(p.value, kind, spark_type)
            return {">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v}[p.op]
        if isinstance(p, ast.Between):
            c, kind, spark_type = self.column(p.column)
            low, high = coerce(p.low, kind), coerce(p.high, kind)
            if low is None or high is None:
                return F.lit(None).cast("boolean")
            low, high = (low, high) if low <= high else (high, low)
            return (c >= literal(low, kind, spark_type)) & (c <= literal(high, kind, spark_type))
        if isinstance(p, ast.IsNull):
            c, _, _ = self.column(p.column)
            return c.isNotNull() if p.negated else c.isNull()
        if isinstance(p, ast.InList):
            return reduce(lambda a, b: a | b, [self.equal(p.column, v) for v in p.values])
        if isinstance(p, ast.Like):
            return self.column(p.column)[0].like(p.pattern)
        if isinstance(p, ast.FullText):
            c, kind, _ = self.column(p.column)
            return text.matches(c, p.query, p.language) if kind == "TEXT" else F.lit(False)
        raise SchemaError(f"{type(p).__name__} stands alone in WHERE")


def constants(p: ast.Predicate | None):
    """Literals of a predicate, for a plan's key."""
    if p is None:
        return ()
    if isinstance(p, ast.Logic):
        return tuple(v for x in p.parts for v in constants(x))
    return tuple(repr(v) if isinstance(v, Typed) else v for v in (getattr(p, "value", None), getattr(p, "low", None), getattr(p, "high", None), getattr(p, "values", None)) if v is not None)
