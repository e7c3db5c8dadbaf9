"""Recursive descent from tokens to statements. Keywords are case-insensitive and whole words."""

from __future__ import annotations

import json

from ..errors import ParseError
from ..types import Typed
from . import ast
from .lexer import Token, tokenize


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.i = sql, tokenize(sql), 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, wanted: str):
        raise ParseError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return t.kind == "word" and t.text.upper() in words

    def take(self, *words: str) -> bool:
        """Takes all of the words if they come next."""
        if all(self.is_word(w, ahead=k) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(" ".join(words))

    def symbol(self, s: str) -> bool:
        if self.now.kind == "symbol" and self.now.text == s:
            self.i += 1
            return True
        return False

    def need_symbol(self, s: str) -> None:
        if not self.symbol(s):
            self.fail(repr(s))

    def name(self) -> str:
        if self.now.kind not in ("word", "quoted"):
            self.fail("a name")
        self.i += 1
        return self.tokens[self.i - 1].text

    def string(self) -> str:
        if self.now.kind != "string":
            self.fail("a string")
        self.i += 1
        return self.tokens[self.i - 1].text

    def integer(self) -> int:
        t = self.now
        if t.kind != "number" or not t.text.isdigit():
            self.fail("a whole number")
        self.i += 1
        return int(t.text)

    def listed(self, one) -> tuple:
        out = [one()]
        while self.symbol(","):
            out.append(one())
        return tuple(out)

    def in_brackets(self, one) -> tuple:
        self.need_symbol("(")
        out = self.listed(one)
        self.need_symbol(")")
        return out

    def number(self) -> float | int:
        sign = -1 if self.symbol("-") else 1
        self.symbol("+")
        t = self.now
        if t.kind != "number":
            self.fail("a number")
        self.i += 1
        return sign * (int(t.text) if t.text.isdigit() else float(t.text))

    def literal(self):
        t = self.now
        if t.kind == "string":
            return self.string()
        if t.kind == "json":
            self.i += 1
            return Typed("JSON", t.text)
        if t.kind == "number" or (t.kind == "symbol" and t.text in "+-"):
            return self.number()
        if self.symbol("["):
            values = self.listed(self.number)
            self.need_symbol("]")
            return Typed("GEOMETRY" if len(values) == 4 else "JSON", json.dumps(list(values)))
        if self.take("TRUE"):
            return True
        if self.take("FALSE"):
            return False
        if self.take("NULL"):
            return None
        if self.is_word("POINT"):
            self.i += 1
            self.need_symbol("(")
            x = self.number()
            self.symbol(",")
            y = self.number()
            self.need_symbol(")")
            return Typed("GEOMETRY", f"POINT({x} {y})")
        for kind in ("JSON", "JSONB", "XML", "GEOMETRY"):
            if self.is_word(kind):
                self.i += 1
                value = self.literal()
                return Typed(kind, value.text if isinstance(value, Typed) else str(value))
        return self.fail("a literal")

    # -- statements

    def statement(self):
        out = self._statement()
        self.symbol(";")
        if self.now.kind != "end":
            self.fail("the end of the statement")
        return out

    def _statement(self):
        if self.is_word("WITH"):
            self.i += 1
            recursive = self.take("RECURSIVE")
            ctes = self.listed(lambda: self.cte(recursive))
            if len({c.name.lower() for c in ctes}) < len(ctes):
                raise ParseError("two common table expressions have one name")
            if self.is_word("MERGE"):
                return self.merge(ctes, recursive)
            return ast.Query(self.select(), ctes, recursive)
        if self.is_word("SELECT"):
            return ast.Query(self.select())
        if self.is_word("MERGE"):
            return self.merge((), False)
        if self.take("INSERT", "INTO"):
            return self.insert()
        if self.take("ANALYZE"):
            return ast.Analyze(self.name() if self.now.kind in ("word", "quoted") else None)
        if self.take("REFRESH", "MATERIALIZED", "VIEW"):
            return ast.RefreshView(self.name(), self.mode(None))
        if self.take("SHOW", "TABLES"):
            return ast.ShowTables()
        if self.take("MATCH", "GRAPH"):
            return self.match()
        if self.take("SEARCH"):
            return ast.Search(self.name(), self.options())
        if self.take("CREATE"):
            return self.create()
        return self.fail("a statement")

    def mode(self, default: bool | None) -> bool | None:
        if self.take("SYNCHRONOUS"):
            return True
        return False if self.take("ASYNCHRONOUS") else default

    def cte(self, recursive: bool) -> ast.Cte:
        name = self.name()
        self.need("AS")
        self.need_symbol("(")
        first, step = self.select(), None
        if self.take("UNION", "ALL"):
            if not recursive:
                raise ParseError("UNION ALL stands only in WITH RECURSIVE")
            step = self.select()
        self.need_symbol(")")
        return ast.Cte(name, first, step)

    def select(self) -> ast.Select:
        self.need("SELECT")
        items = None if self.symbol("*") else self.listed(self.item)
        self.need("FROM")
        table = self.name()
        predicate = self.disjunction() if self.take("WHERE") else None
        order = self.listed(self.order_item) if self.take("ORDER", "BY") else ()
        limit = self.integer() if self.take("LIMIT") else None
        offset = self.integer() if self.take("OFFSET") else 0
        return ast.Select(table, items, predicate, order, limit, offset)

    def order_item(self) -> tuple[str, bool]:
        column = self.name()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return column, down

    def item(self):
        if self.is_word("ROW_NUMBER") and self.tokens[self.i + 1].text == "(":
            self.i += 1
            self.need_symbol("(")
            self.need_symbol(")")
            self.need("OVER")
            self.need_symbol("(")
            partition = self.name() if self.take("PARTITION", "BY") else None
            self.need("ORDER", "BY")
            order = self.name()
            self.need_symbol(")")
            return ast.RowNumber(partition, order, self.name() if self.take("AS") else "row_number")
        return ast.ColumnItem(self.name())

    def disjunction(self) -> ast.Predicate:
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else ast.Logic("or", tuple(parts))

    def conjunction(self) -> ast.Predicate:
        parts = [self.negation()]
        while self.take("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else ast.Logic("and", tuple(parts))

    def negation(self) -> ast.Predicate:
        if self.take("NOT"):
            return ast.Logic("not", (self.negation(),))
        if self.symbol("("):
            inner = self.disjunction()
            self.need_symbol(")")
            return inner
        return self.comparison()

    def comparison(self) -> ast.Predicate:
        column = self.name()
        for op, plain in ((">=", ">="), ("<=", "<="), ("<>", "<>"), ("!=", "<>"), ("=", "="), (">", ">"), ("<", "<")):
            if self.symbol(op):
                return ast.Compare(column, plain, self.literal())
        if self.symbol("@@"):
            query = self.string()
            return ast.FullText(column, query, self.string() if self.take("LANGUAGE") else None)
        if self.take("BETWEEN"):
            low = self.literal()
            self.need("AND")
            return ast.Between(column, low, self.literal())
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return ast.IsNull(column, negated)
        if self.take("LIKE"):
            return ast.Like(column, self.string())
        if self.take("IN"):
            if self.now.text == "(":
                return ast.InList(column, self.in_brackets(self.literal))
            table = self.name()
            self.need_symbol(".")
            return ast.InColumn(column, table, self.name())
        return self.fail("a comparison")

    def insert(self):
        table = self.name()
        if self.is_word("VALUES") and self.tokens[self.i + 1].text == "(" and self.tokens[self.i + 3].text == "=":
            self.i += 1
            return ast.InsertPoint(table, self.options())
        columns = self.in_brackets(self.name) if self.now.text == "(" else None
        self.need("VALUES")
        return ast.Insert(table, columns, self.listed(lambda: self.in_brackets(self.literal)))

    def options(self) -> tuple:
        """(KEY = value, ...)"""

        def one():
            key = self.name().upper()
            self.need_symbol("=")
            if self.symbol("["):
                values = self.listed(self.number)
                self.need_symbol("]")
                return key, values
            if self.now.kind == "word" and not self.is_word("TRUE", "FALSE", "NULL"):
                return key, self.name()
            value = self.literal()
            return key, value.text if isinstance(value, Typed) else value

        return self.in_brackets(one)

    def create(self):
        if self.take("TABLE"):
            name = self.name()
            columns = self.in_brackets(lambda: (self.name(), self.name()))
            return ast.CreateTable(name, columns, self.partitioning() if self.take("PARTITION", "BY") else None)
        if self.take("MATERIALIZED", "VIEW"):
            name = self.name()
            synchronous = self.mode(None) if self.take("REFRESH") else True
            if synchronous is None:
                self.fail("SYNCHRONOUS or ASYNCHRONOUS")
            self.need("AS")
            return ast.CreateView(name, self.select(), synchronous)
        if self.take("GRAPH"):
            return ast.CreateGraph(self.name())
        if self.take("NODE"):
            graph = self.name()
            self.need("ID")
            return ast.CreateNode(graph, str(self.literal()), self.properties())
        if self.take("EDGE"):
            graph = self.name()
            self.need("FROM")
            source = str(self.literal())
            self.need("TO")
            target = str(self.literal())
            label = str(self.literal()) if self.take("LABEL") else None
            return ast.CreateEdge(graph, source, target, label, self.properties())
        if self.take("COLLECTION"):
            return ast.CreateCollection(self.name(), self.options())
        return self.fail("TABLE, MATERIALIZED VIEW, GRAPH, NODE, EDGE or COLLECTION")

    def properties(self) -> tuple:
        if not self.take("WITH", "PROPERTIES"):
            return ()

        def one():
            key = self.name()
            self.need_symbol("=")
            value = self.literal()
            return key, value.text if isinstance(value, Typed) else "true" if value is True else "false" if value is False else str(value)

        return self.in_brackets(one)

    def match(self) -> ast.MatchGraph:
        graph, found = self.name(), {}
        while True:
            for word, key in (("FROM", "source"), ("TO", "target"), ("LABEL", "label")):
                if self.take(word):
                    found[key] = str(self.literal())
                    break
            else:
                if not self.is_word("WITH"):
                    return ast.MatchGraph(graph, **found)
                found["properties"] = self.properties()

    def partitioning(self) -> ast.Partitioning:
        kind = self.name().lower()
        if kind not in ("range", "hash", "list"):
            raise ParseError(f"unknown partitioning {kind}")
        self.need_symbol("(")
        column = self.name()
        self.need_symbol(")")
        if kind == "hash":
            self.need("PARTITIONS")
            n = self.integer()
            if n < 1:
                raise ParseError("a table has at least one partition")
            return ast.Partitioning(kind, column, count=n)
        count = iter(range(1 << 30))

        def part():
            given = self.name() if self.take("PARTITION") else None
            label = given or f"p{next(count)}"
            if kind == "range":
                self.need("VALUES", "LESS", "THAN")
                if self.take("MAXVALUE"):
                    return label, None
                self.need_symbol("(")
                bound = None if self.take("MAXVALUE") else (self.literal(),)
                self.need_symbol(")")
                return label, bound
            if self.take("DEFAULT"):
                return label, None
            self.need("VALUES")
            if self.take("DEFAULT"):
                return label, None
            self.need("IN")
            return label, self.in_brackets(self.literal)

        return ast.Partitioning(kind, column, self.in_brackets(part))

    def merge(self, ctes: tuple, recursive: bool) -> ast.Merge:
        self.need("MERGE", "INTO")

        def reference() -> tuple[str, str]:
            name = self.name()
            explicit = self.take("AS")
            alias = self.name() if explicit or not self.is_word("USING", "ON") else name
            return name, alias

        target, a = reference()
        self.need("USING")
        source, b = reference()
        self.need("ON")

        def qualified() -> tuple[str | None, str]:
            first = self.name()
            return (first, self.name()) if self.symbol(".") else (None, first)

        def side(q: str | None) -> str:
            if q is None or q.lower() in (b.lower(), source.lower()):
                return "source"
            if q.lower() in (a.lower(), target.lower()):
                return "target"
            raise ParseError(f"unknown table {q} in MERGE")

        left = qualified()
        self.need_symbol("=")
        right = qualified()
        sides = {("target" if left[0] is None else side(left[0])): left[1]}
        sides[side(right[0])] = right[1]
        if len(sides) < 2:
            raise ParseError("ON compares a column of the target with one of the source")

        def value() -> ast.Source:
            if self.now.kind in ("word", "quoted") and not self.is_word("TRUE", "FALSE", "NULL", "JSON", "JSONB", "XML", "GEOMETRY", "POINT"):
                q, column = qualified()
                return ast.Source(side(q), column)
            return ast.Source("literal", self.literal())

        sets = insert_columns = insert_values = None
        while self.take("WHEN"):
            if self.take("MATCHED", "THEN", "UPDATE", "SET"):
                if sets is not None:
                    raise ParseError("WHEN MATCHED stands once at most")

                def assignment():
                    q, column = qualified()
                    if q is not None and side(q) != "target":
                        raise ParseError("SET names a column of the target")
                    self.need_symbol("=")
                    return column, value()

                sets = self.listed(assignment)
            elif self.take("NOT", "MATCHED", "THEN", "INSERT"):
                if insert_columns is not None:
                    raise ParseError("WHEN NOT MATCHED stands once at most")
                insert_columns = self.in_brackets(self.name)
                self.need("VALUES")
                insert_values = self.in_brackets(value)
                if len(insert_columns) != len(insert_values):
                    raise ParseError("INSERT has as many values as columns")
                if any(v.side == "target" for v in insert_values):
                    raise ParseError("INSERT of MERGE can't read the target")
            else:
                self.fail("MATCHED or NOT MATCHED")
        if sets is None and insert_columns is None:
            raise ParseError("MERGE needs a WHEN clause")
        return ast.Merge(target, source, sides["target"], sides["source"], sets, insert_columns, insert_values, ctes, recursive)


def parse(sql: str):
    return Parser(sql).statement()
