"""The rule language of row filters, compiled to Spark columns.

Rules follow ``or < and < not`` with parentheses; a clause is ``NAME OP [VALUE]``. Nulls are unknown (three-valued logic), a NaN
is a value for which every comparison but ``/=`` is false. Rules are checked against a schema before any data are read.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_RULE, MAX_DEPTH, MAX_TERMS, MAX_SETS = 8192, 32, 1024, 64
#: Members up to which a set is a literal list that scans can push down.
INLINE = 1000

_COMPARE = {">", ">=", "<", "<=", "==", "/="}
_MATCH = {"starts_with", "ends_with", "contains"}
_CLASS = {"is_nan", "is_not_nan", "is_finite", "is_not_finite"}
_NULL = {"is_null", "is_not_null"}
_SET = {"in", "not_in"}
_TOKEN = re.compile(r'\s*("[^"]*"|[(),]|[^\s(),"]+)')


class RuleError(ValueError):
    """A rule that can't be parsed, or doesn't fit the schema."""


def tokens(rule: str) -> list[str]:
    if len(rule) > MAX_RULE:
        raise RuleError(f"a rule has at most {MAX_RULE} characters")
    out, at, text = [], 0, rule.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"can't read the rule at {text[at : at + 20]!r}")
        out.append(m[1])
        at = m.end()
    return out


@dataclass
class Clause:
    name: str
    op: str
    value: str | None = None
    items: list[str] | None = None


@dataclass
class Parser:
    """Recursive descent over the tokens of one rule; nodes are clauses or tuples of an operator and nodes."""

    words: list[str]
    at: int = 0
    terms: int = 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def is_word(self, word: str) -> bool:
        return (self.peek() or "").lower() == word

    def take(self, what: str) -> str:
        if self.at >= len(self.words):
            raise RuleError(f"the rule ends where {what} is due")
        self.at += 1
        return self.words[self.at - 1]

    def whole(self):
        node = self.either(0)
        if self.peek() is not None:
            raise RuleError(f"unexpected {self.peek()!r}")
        return node

    def either(self, depth: int):
        return self.chain("or", lambda: self.chain("and", lambda: self.negated(depth)))

    def chain(self, word: str, part):
        nodes = [part()]
        while self.is_word(word):
            self.at += 1
            nodes.append(part())
        return nodes[0] if len(nodes) == 1 else (word, *nodes)

    def negated(self, depth: int):
        if depth > MAX_DEPTH:
            raise RuleError(f"rules nest at most {MAX_DEPTH} deep")
        if self.is_word("not"):
            self.at += 1
            return ("not", self.negated(depth + 1))
        if self.peek() == "(":
            self.at += 1
            node = self.either(depth + 1)
            if self.take("')'") != ")":
                raise RuleError("a parenthesis is not closed")
            return node
        return self.clause()

    def clause(self) -> Clause:
        self.terms += 1
        if self.terms > MAX_TERMS:
            raise RuleError(f"a filter has at most {MAX_TERMS} terms")
        name, op = self.take("a column"), self.take("an operator").lower()
        if name in ("(", ")", ",") or name.startswith('"') or name.lower() in ("and", "or", "not"):
            raise RuleError(f"a column name is due, not {name!r}")
        if op in _NULL | _CLASS:
            return Clause(name, op)
        if op in _SET:
            if self.peek() == "(":
                self.at += 1
                items = [self.take("a set's member")]
                while self.peek() == ",":
                    self.at += 1
                    items.append(self.take("a set's member"))
                if items[0] in (")", ",") or self.take("')'") != ")":
                    raise RuleError("a set is a list in parentheses with at least one member")
                return Clause(name, op, items=items)
            word = self.take("a set")
            if not word.startswith("@"):
                raise RuleError("a set is a list in parentheses or @NAME")
            return Clause(name, op, value=word)
        if op in _COMPARE | _MATCH:
            return Clause(name, op, value=self.take("a value"))
        raise RuleError(f"unknown operator {op!r}")


def column_type(schema: T.StructType, name: str) -> T.DataType:
    """The type of a column or of a dotted leaf of structs."""
    kind: T.DataType = schema
    for part in [name] if name in schema.names else name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise RuleError(f"no column {name!r}")
        kind = kind[part].dataType
    return kind


def _column(schema: T.StructType, name: str) -> Column:
    return F.col(f"`{name}`") if name in schema.names else F.col(".".join(f"`{p}`" for p in name.split(".")))


_FLOATS = (T.FloatType, T.DoubleType)
_WHOLES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_STAMP = re.compile(r"(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?)?")


def literal(text: str, kind: T.DataType):
    """The Python value that a rule's literal stands for in a column of the type."""
    quoted = text.startswith('"')
    bare = text[1:-1].rstrip(" ") if quoted else text
    if isinstance(kind, T.StringType):
        if not quoted:
            raise RuleError(f"a string is written in double quotes: {text}")
        return bare
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        m = quoted and _STAMP.fullmatch(bare)
        if not m:
            raise RuleError(f"a date or time is an ISO-8601 literal in double quotes: {text}")
        if isinstance(kind, T.DateType):
            if m[2]:
                raise RuleError(f"{text} is finer than a date")
            return dt.date.fromisoformat(bare)
        if len(m[3] or "") > 6 and m[3][6:].strip("0"):
            raise RuleError(f"{text} is finer than a microsecond")
        return dt.datetime.fromisoformat(m[1] + "T" + (m[2] or "00:00:00") + (f".{m[3][:6]:0<6}" if m[3] else ""))
    if quoted:
        raise RuleError(f"{text} is no number or boolean")
    if isinstance(kind, T.BooleanType):
        if bare.lower() not in ("true", "false"):
            raise RuleError(f"{text} is neither true nor false")
        return bare.lower() == "true"
    try:
        value = float(bare)
        if math.isnan(value):
            raise RuleError("no value compares with nan; use is_nan or is_not_nan")
        if isinstance(kind, _WHOLES) and re.fullmatch(r"[+-]?\d+", bare):
            return int(bare)
        return value
    except ValueError as e:
        raise e if isinstance(e, RuleError) else RuleError(f"{text} is no number") from None


def compare(c: Column, op: str, value, kind: T.DataType) -> Column:
    """IEEE comparison: Spark ranks NaN above all values, so > and >= are guarded; the guard keeps null unknown and can still be pushed down."""
    if op == "/=":
        return c != F.lit(value)
    if op == "==":
        return c == F.lit(value)
    out = {">": c > F.lit(value), ">=": c >= F.lit(value), "<": c < F.lit(value), "<=": c <= F.lit(value)}[op]
    return out & ~F.isnan(c) if isinstance(kind, _FLOATS) and op in (">", ">=") else out


@dataclass
class Filter:
    """Rules that are AND-ed, with the sets bound to names in them."""

    rules: list[str] = field(default_factory=list)
    sets: dict[str, list] = field(default_factory=dict)

    def add(self, rule: str) -> Filter:
        Parser(tokens(rule)).whole()
        self.rules.append(rule)
        return self

    def bind(self, name: str, values: Iterable) -> Filter:
        """Values for ``@name``; null members are left out, a NaN is refused."""
        members = [v for v in values if v is not None]
        if any(isinstance(v, float) and math.isnan(v) for v in members):
            raise RuleError("a set can't hold a NaN")
        if name not in self.sets and len(self.sets) >= MAX_SETS:
            raise RuleError(f"a filter has at most {MAX_SETS} sets")
        self.sets[name] = members
        return self

    def add_in(self, column: str, values: Iterable, negate: bool = False) -> Filter:
        name = f"set{len(self.sets)}"
        self.bind(name, values)
        return self.add(f"{column} {'not_in' if negate else 'in'} @{name}")

    def clear(self) -> Filter:
        self.rules.clear()
        self.sets.clear()
        return self

    def column(self, schema: T.StructType) -> Column:
        """The condition; unknown is null, which a filter drops."""
        total, nodes = 0, []
        for rule in self.rules:
            parser = Parser(tokens(rule))
            nodes.append(parser.whole())
            total += parser.terms
        if total > MAX_TERMS:
            raise RuleError(f"a filter has at most {MAX_TERMS} terms")
        return reduce(Column.__and__, [self._compile(n, schema) for n in nodes], F.lit(True))

    def _compile(self, node, schema: T.StructType) -> Column:
        if isinstance(node, Clause):
            return self._clause(node, schema)
        parts = [self._compile(n, schema) for n in node[1:]]
        return ~parts[0] if node[0] == "not" else reduce(Column.__and__ if node[0] == "and" else Column.__or__, parts)

    def _clause(self, clause: Clause, schema: T.StructType) -> Column:
        kind, c, op = column_type(schema, clause.name), _column(schema, clause.name), clause.op
        if op in _NULL:
            return c.isNull() if op == "is_null" else c.isNotNull()
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise RuleError(f"{clause.name} holds no single value")
        if op in _CLASS:
            if not isinstance(kind, _FLOATS):
                raise RuleError(f"{op} needs a floating-point column, {clause.name} is {kind.simpleString()}")
            finite = ~F.isnan(c) & (c > F.lit(-math.inf)) & (c < F.lit(math.inf))
            test = {"is_nan": F.isnan(c), "is_not_nan": ~F.isnan(c), "is_finite": finite, "is_not_finite": ~finite}[op]
            return F.when(c.isNotNull(), test)
        if op in _MATCH:
            if not isinstance(kind, T.StringType) or not clause.value.startswith('"'):
                raise RuleError(f"{op} needs a string column and a quoted pattern")
            return {"starts_with": c.startswith, "ends_with": c.endswith, "contains": c.contains}[op](literal(clause.value, kind))
        if op in _COMPARE:
            value = literal(clause.value, kind)
            if isinstance(kind, T.BooleanType) and op not in ("==", "/="):
                raise RuleError(f"{op} does not order booleans")
            return compare(c, op, value, kind)
        if clause.items is not None:
            members = [literal(x, kind) for x in clause.items]
        elif clause.value[1:] in self.sets:
            members = self.sets[clause.value[1:]]
        else:
            raise RuleError(f"no set is bound to {clause.value}")
        if not members:
            return F.when(c.isNotNull(), F.lit(op == "not_in"))
        inside = c.isin(*members)
        return inside if op == "in" else ~inside


def filter_rows(df: DataFrame, rule: str | Filter) -> DataFrame:
    """The rows for which the rule is true. Large sets become a semi or anti join where the whole rule is that one clause."""
    f = rule if isinstance(rule, Filter) else Filter().add(rule)
    big = {n for n, s in f.sets.items() if len(s) > INLINE}
    rest = Filter([], dict(f.sets))
    for r in f.rules:
        node = Parser(tokens(r)).whole()
        if isinstance(node, Clause) and node.op in _SET and (node.value or "")[1:] in big:
            kind, c = column_type(df.schema, node.name), _column(df.schema, node.name)
            members = df.sparkSession.createDataFrame([(v,) for v in f.sets[node.value[1:]]], T.StructType([T.StructField("__member", kind)])).distinct()
            df = df.where(c.isNotNull()).join(members, c == F.col("__member"), "left_semi" if node.op == "in" else "left_anti")
        else:
            rest.rules.append(r)
    return df.where(rest.column(df.schema)) if rest.rules else df


def row_mask(df: DataFrame, rule: str | Filter, name: str = "mask") -> DataFrame:
    """The rows with a boolean column that is true where the rule is; unknown counts as false."""
    f = rule if isinstance(rule, Filter) else Filter().add(rule)
    return df.withColumn(name, F.coalesce(f.column(df.schema), F.lit(False)))
