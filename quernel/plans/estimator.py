"""Cardinality and cost estimates from collected statistics, for explaining and for choosing what to compute; Catalyst plans execution."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..sql import ast
from ..types import coerce

#: Defaults where statistics are missing, and unit costs.
ANY, EQUAL, IN_COLUMN, FULL_TEXT = 0.25, 0.1, 0.15, 0.05
CPU_ROW, PAGE, IO_INDEX, CPU_INDEX, PROJECT_ROW, JOIN_IO = 1.0, 8192, 3.0, 0.5, 0.05, 0.5


@dataclass
class ColumnStats:
    kind: str
    nulls: int
    distinct: int
    low: float | None = None
    high: float | None = None
    buckets: list[tuple[float, float, int]] = field(default_factory=list)


@dataclass
class TableStats:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)
    analyzed: bool = True
    row_width: float = 100.0

    def column(self, name: str) -> ColumnStats | None:
        return next((s for c, s in self.columns.items() if c.lower() == name.lower()), None)


@dataclass(frozen=True)
class Estimate:
    rows: float
    confidence: float


def _number(kind: str, value) -> float | None:
    v = coerce(value, kind)
    if v is None or kind not in ("INTEGER", "FLOAT", "TIMESTAMP"):
        return None
    return v.timestamp() * 1000 if kind == "TIMESTAMP" else float(v)


def _between(s: ColumnStats, rows: int, low: float, high: float, sure: float) -> tuple[float, float]:
    some = max(1, rows - s.nulls)
    low, high = min(low, high), max(low, high)
    if s.buckets:
        share = 0.0
        for a, b, n in s.buckets:
            if high < a or low > b:
                continue
            span = max(b - a, 1.0 if s.kind != "FLOAT" else 1e-12)
            share += n / some * min(1.0, max(0.0, min(high, b) - max(low, a)) / span if b > a else 1.0)
        return min(1.0, share), min(0.9, sure + 0.3)
    if s.low is not None and s.high is not None:
        if s.high - s.low <= 0:
            return float(low <= s.low <= high), min(0.8, sure + 0.2)
        return min(1.0, max(0.0, min(high, s.high) - max(low, s.low)) / (s.high - s.low)), min(0.8, sure + 0.2)
    return ANY, sure


def selectivity(p: ast.Predicate | None, stats: TableStats) -> tuple[float, float]:
    """(share of rows, confidence)."""
    if p is None:
        return 1.0, 0.7 if stats.analyzed else 0.3
    if isinstance(p, ast.Logic):
        parts = [selectivity(x, stats) for x in p.parts]
        sure = min(c for _, c in parts)
        if p.op == "and":
            return math.prod(s for s, _ in parts), sure
        return (1 - parts[0][0], sure) if p.op == "not" else (1 - math.prod(1 - s for s, _ in parts), sure)
    if isinstance(p, ast.InColumn):
        return IN_COLUMN, 0.1
    if isinstance(p, ast.FullText):
        return FULL_TEXT, 0.05
    s = stats.column(p.column)
    if isinstance(p, ast.IsNull):
        share = s.nulls / max(1, stats.rows) if s else 0.0
        return (1 - share if p.negated else share), 0.5 if s else 0.05
    if isinstance(p, ast.InList):
        return min(1.0, len(p.values) * selectivity(ast.Compare(p.column, "=", p.values[0]), stats)[0]), 0.3
    if isinstance(p, ast.Compare) and p.op == "=":
        if s is None:
            return EQUAL, 0.1
        some = max(1, stats.rows - s.nulls)
        sure, share, v = 0.6 if stats.analyzed else 0.3, max(1 / max(1, s.distinct), 1 / some), _number(s.kind, p.value)
        for a, b, n in s.buckets:
            if v is not None and a <= v <= b:
                return min(1.0, max(share, n / some / max(b - a, 1.0), 1 / some)), min(0.9, sure + 0.25)
        return min(1.0, share), sure
    if isinstance(p, ast.Compare | ast.Between) and s is not None and (isinstance(p, ast.Between) or p.op in (">=", ">", "<=", "<")):
        sure = 0.5 if stats.analyzed else 0.2
        if isinstance(p, ast.Between):
            low, high = _number(s.kind, p.low), _number(s.kind, p.high)
        else:
            v = _number(s.kind, p.value)
            low, high = (v, s.high) if p.op in (">=", ">") else (s.low, v)
        if low is not None and high is not None:
            return _between(s, stats.rows, low, high, sure)
    return ANY, 0.1


def estimate_scan(p: ast.Predicate | None, stats: TableStats) -> Estimate:
    share, sure = selectivity(p, stats)
    return Estimate(stats.rows * share, sure)


def estimate_join(left: TableStats, left_column: str, right: TableStats, right_column: str) -> Estimate:
    """Rows over the larger number of distinct keys, for the part of both ranges that overlaps."""
    if not left.rows or not right.rows:
        return Estimate(0.0, 0.9)
    a, b = left.column(left_column), right.column(right_column)
    rows = (left.rows - (a.nulls if a else 0)) * (right.rows - (b.nulls if b else 0))
    out = rows / max(a.distinct if a else left.rows, b.distinct if b else right.rows, 1)
    if a and b and None not in (a.low, a.high, b.low, b.high) and a.high > a.low:
        meet = max(0.0, min(a.high, b.high) - max(a.low, b.low))
        if meet <= 0 and not (a.low <= b.low <= a.high):
            return Estimate(0.0, 0.75)
        return Estimate(out, 0.75)
    return Estimate(out, 0.4)


def scan_cost(stats: TableStats, p: ast.Predicate | None = None, columns: int | None = None, by_index: bool = False) -> float:
    """Unit costs of reading: rows and pages, or an index probe; and of the columns that are kept."""
    rows = stats.rows
    width = stats.row_width * (columns / max(1, len(stats.columns)) if columns and stats.columns else 1.0)
    if by_index:
        rows = estimate_scan(p, stats).rows
        return IO_INDEX + CPU_INDEX * rows
    return CPU_ROW * rows + math.ceil(rows * width / PAGE) + (PROJECT_ROW * rows if columns else 0.0)


def join_cost(left: TableStats, right: TableStats, out: Estimate) -> float:
    return CPU_ROW * (left.rows + right.rows + out.rows) + JOIN_IO * min(left.rows, right.rows)


@dataclass(frozen=True)
class Workload:
    rows: int
    dimension: int
    queries_per_second: float = 0.0
    p95_ms: float = 0.0
    updates_per_second: float = 0.0
    memory_pressure: float = 0.0


def recommend_index(w: Workload) -> str:
    if w.rows < 10_000:
        return "brute_force"
    if w.memory_pressure > 0.8 and w.rows > 100_000:
        return "quantized_cells"
    if w.queries_per_second > 1000 and w.p95_ms > 10:
        return "cells"
    return "hybrid" if w.updates_per_second > 100 else "cells"


def predict_latency_ms(index: str, rows: int, dimension: int, ef: int = 50, pq_m: int = 8) -> float:
    if index == "brute_force":
        return rows * dimension * 1e-6
    if index == "cells":
        return math.log2(rows) * ef * dimension * 2e-6
    if index == "quantized_cells":
        return math.log2(rows) * ef * pq_m * 1.5e-6
    return (predict_latency_ms("cells", rows, dimension, 32) + predict_latency_ms("brute_force", rows, dimension)) / 2


def predict_memory(index: str, rows: int, dimension: int, m: int = 16, pq_m: int = 8) -> int:
    base = rows * dimension * 4
    if index == "brute_force":
        return base
    if index == "quantized_cells":
        return rows * pq_m + rows * m * 4 + pq_m * 256 * (dimension // pq_m) * 4
    return base + rows * (8 if index == "hybrid" else m) * 4


def storage_mode(rows: int, row_width: float, cardinalities: list[int], least_rows: int = 10_000, least_width: int = 256, low: float = 0.1) -> str:
    if rows < least_rows or row_width <= least_width or not cardinalities:
        return "row"
    return "columnar" if sum(cardinalities) / len(cardinalities) / max(rows, 1) <= low else "row"
