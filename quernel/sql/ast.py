"""Statements as values: equal statements are equal, which cache and view rewrite rely on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Predicate:
    pass


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    op: str  # = >= and, as extensions, > < <= <>
    value: object


@dataclass(frozen=True)
class Between(Predicate):
    column: str
    low: object
    high: object


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str
    negated: bool = False


@dataclass(frozen=True)
class InColumn(Predicate):
    column: str
    table: str
    other: str


@dataclass(frozen=True)
class InList(Predicate):  # extension
    column: str
    values: tuple


@dataclass(frozen=True)
class Like(Predicate):  # extension
    column: str
    pattern: str


@dataclass(frozen=True)
class FullText(Predicate):
    column: str
    query: str
    language: str | None = None


@dataclass(frozen=True)
class Logic(Predicate):  # extension
    op: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class ColumnItem:
    name: str


@dataclass(frozen=True)
class RowNumber:
    partition: str | None
    order: str
    alias: str = "row_number"


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple | None  # None: *
    predicate: Predicate | None = None
    order: tuple = ()  # extension: (column, descending)
    limit: int | None = None  # extension
    offset: int = 0  # extension


@dataclass(frozen=True)
class Cte:
    name: str
    query: Select
    step: Select | None = None


@dataclass(frozen=True)
class Query:
    select: Select
    ctes: tuple = ()
    recursive: bool = False


@dataclass(frozen=True)
class Partitioning:
    kind: str  # range, hash, list
    column: str
    parts: tuple = ()  # range: (name, bound or None for MAXVALUE); list: (name, values or None for DEFAULT)
    count: int = 0


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple  # (name, type name)
    partitioning: Partitioning | None = None


@dataclass(frozen=True)
class CreateView:
    name: str
    query: Select
    synchronous: bool = True


@dataclass(frozen=True)
class RefreshView:
    name: str
    synchronous: bool | None = None


@dataclass(frozen=True)
class CreateGraph:
    name: str


@dataclass(frozen=True)
class CreateNode:
    graph: str
    id: str
    properties: tuple = ()


@dataclass(frozen=True)
class CreateEdge:
    graph: str
    source: str
    target: str
    label: str | None = None
    properties: tuple = ()


@dataclass(frozen=True)
class MatchGraph:
    graph: str
    source: str | None = None
    target: str | None = None
    label: str | None = None
    properties: tuple = ()


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple | None
    rows: tuple


@dataclass(frozen=True)
class Source:
    """A value of MERGE: a column of the source or the target, or a literal."""

    side: str  # source, target, literal
    value: object


@dataclass(frozen=True)
class Merge:
    target: str
    source: str
    target_key: str
    source_key: str
    sets: tuple | None = None  # (column, Source)
    insert_columns: tuple | None = None
    insert_values: tuple | None = None
    ctes: tuple = ()
    recursive: bool = False


@dataclass(frozen=True)
class Analyze:
    table: str | None = None


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class CreateCollection:
    name: str
    options: tuple


@dataclass(frozen=True)
class InsertPoint:
    collection: str
    options: tuple


@dataclass(frozen=True)
class Search:
    collection: str
    options: tuple = field(default=())
