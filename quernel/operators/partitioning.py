"""Range, hash and list partitioning: the label of a row, and the labels that a predicate can touch."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError, SchemaError
from ..sql import ast
from ..types import coerce, literal

LABEL = "__part"


@dataclass(frozen=True)
class Scheme:
    """parts: range (label, bound or None), ascending, None last; list (label, values or None), None last; hash (label,)."""

    kind: str
    column: str
    column_kind: str
    parts: tuple

    @staticmethod
    def of(p: ast.Partitioning, kind: str) -> Scheme:
        if p.kind == "hash":
            return Scheme("hash", p.column, kind, tuple((f"p{i}",) for i in range(p.count)))
        if len({label for label, _ in p.parts}) < len(p.parts):
            raise SchemaError("two partitions have one name")
        if p.kind == "range":
            parts = [(label, None if bound is None else coerce(bound[0], kind)) for label, bound in p.parts]
            bounds = [b for _, b in parts if b is not None]
            if len(set(bounds)) < len(bounds) or len(parts) - len(bounds) > 1:
                raise SchemaError("two partitions have one bound")
            return Scheme("range", p.column, kind, tuple(sorted(parts, key=lambda x: (x[1] is None, x[1] if x[1] is not None else 0))))
        parts = [(label, None if values is None else tuple(coerce(v, kind) for v in values)) for label, values in p.parts]
        every = [v for _, values in parts if values for v in values]
        if len(set(every)) < len(every):
            raise SchemaError("two partitions list one value")
        return Scheme("list", p.column, kind, tuple(sorted(parts, key=lambda x: x[1] is None)))

    def label(self) -> Column:
        """A row's partition; null where no partition takes it."""
        c = F.col(f"`{self.column}`")
        if self.kind == "hash":
            return F.when(c.isNotNull(), F.concat(F.lit("p"), F.pmod(F.xxhash64(c), F.lit(len(self.parts))).cast("string")))
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for label, rule in self.parts:
            if self.kind == "range":
                out = out.otherwise(F.lit(label)) if rule is None else out.when(c < literal(rule, self.column_kind), F.lit(label))
            else:
                out = out.otherwise(F.lit(label)) if rule is None else out.when(c.isin(*[literal(v, self.column_kind) for v in rule if v is not None]) | (c.isNull() if None in rule else F.lit(False)), F.lit(label))
        return out

    def touched(self, p: ast.Predicate | None) -> list[str] | None:
        """Labels of partitions that may hold rows of the predicate; None: all. Never drops one that does."""
        if p is None or getattr(p, "column", "").lower() != self.column.lower():
            return None
        if isinstance(p, ast.Compare) and p.op == "=" and p.value is not None:
            v = coerce(p.value, self.column_kind)
            if self.kind == "hash":
                return None  # Spark's own hash is not known to the driver; the filter itself prunes
            if self.kind == "list":
                return [label for label, values in self.parts if values is not None and v in values] or [label for label, values in self.parts if values is None]
            return self._range(v, v)
        if self.kind == "range" and isinstance(p, ast.Compare) and p.op in (">=", ">"):
            return self._range(coerce(p.value, self.column_kind), None)
        if self.kind == "range" and isinstance(p, ast.Compare) and p.op in ("<=", "<"):
            return self._range(None, coerce(p.value, self.column_kind))
        if self.kind == "range" and isinstance(p, ast.Between):
            low, high = sorted((coerce(p.low, self.column_kind), coerce(p.high, self.column_kind)))
            return self._range(low, high)
        return None

    def _range(self, low, high) -> list[str]:
        out, previous = [], None
        for label, bound in self.parts:
            if (low is None or bound is None or low < bound) and (high is None or previous is None or high >= previous):
                out.append(label)
            previous = bound
        return out

    def add(self, label: str, rule=None) -> Scheme:
        if any(x[0] == label for x in self.parts):
            raise EngineError(f"partition {label} exists")
        if self.kind == "hash":
            raise EngineError("a hash partitioning has a fixed number of partitions")
        return Scheme.of(ast.Partitioning(self.kind, self.column, tuple((n, None if r is None else r if self.kind == "list" else (r,)) for n, r in (*self.parts, (label, rule)))), self.column_kind)

    def drop(self, label: str) -> Scheme:
        if self.kind == "hash":
            raise EngineError("a hash partition can't be dropped")
        if len(self.parts) == 1:
            raise EngineError("the last partition can't be dropped")
        rest = tuple(x for x in self.parts if x[0] != label)
        if len(rest) == len(self.parts):
            raise EngineError(f"no partition {label}")
        return replace(self, parts=rest)
