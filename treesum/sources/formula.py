"""Formulas: 'y ~ a + log(b) + a:g - c', to a response, terms and an offset.

Terms are sets of factors, joined by `:`. `a * b` is a + b + a:b, `a / b` is a + a:b, `(a + b)^2` has all products of up to two,
`.` stands for all columns that the response does not use, `-` takes terms away, `1` and `0` (an intercept, which trees have no
use for) say nothing. A factor is a column (`quoted`, where its name is not plain), factor(column), or arithmetic inside I(...)
or a function. Terms come in order of the number of their factors, as they were first named. Whatever else is written is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain


class DesignError(ValueError):
    pass


#: Functions of formulas and their names in Spark's SQL.
FUNCTIONS = {"log": "ln", "log2": "log2", "log10": "log10", "log1p": "log1p", "exp": "exp", "expm1": "expm1", "sqrt": "sqrt", "abs": "abs", "sin": "sin", "cos": "cos", "tan": "tan", "floor": "floor", "ceiling": "ceil", "round": "round", "sign": "sign", "pmin": "least", "pmax": "greatest"}

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][\w.]*|\.[A-Za-z_][\w.]*)|`([^`]+)`|(\*\*|[-+*/:^(),.~]))")


@dataclass(frozen=True)
class Atom:
    """A factor of a term: its text in one form, the columns it uses, and SQL for a number (None: a column as it is)."""

    text: str
    columns: tuple
    sql: str | None = None
    levels: bool = False


@dataclass(frozen=True)
class Formula:
    response: Atom
    terms: tuple[tuple[Atom, ...], ...]
    offset: tuple[Atom, ...] = field(default=())


def term_name(term: tuple[Atom, ...]) -> str:
    return ":".join(a.text for a in term)


def _plain(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_.][\w.]*", name) else f"`{name}`"


class _Reader:
    def __init__(self, text: str, columns: list[str]):
        self.text, self.columns, self.at, self.tokens = text, columns, 0, []
        i = 0
        while i < len(text.rstrip()):
            m = _TOKEN.match(text, i)
            if not m:
                raise DesignError(f"cannot read {text[i:]!r} in {text!r}")
            kind = next(k for k in range(1, 5) if m[k] is not None)
            self.tokens.append((("number", "name", "quoted", "mark")[kind - 1], "^" if m[kind] == "**" else m[kind]))
            i = m.end()
        self.response_columns: tuple = ()
        self.offset: list[Atom] = []

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" else None

    def take(self, mark: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise DesignError(f"{self.text!r} ends too early")
        t = self.tokens[self.at]
        if mark is not None and t != ("mark", mark):
            raise DesignError(f"{mark!r} expected at {t[1]!r} in {self.text!r}")
        self.at += 1
        return t

    # numbers, inside of I() and functions

    def number(self) -> Atom:
        return self._left(self._product, "+-")

    def _product(self) -> Atom:
        return self._left(self._signed, "*/")

    def _left(self, part, marks: str) -> Atom:
        a = part()
        while (m := self.peek()) is not None and m in marks:
            self.take()
            b = part()
            # text without blanks, SQL with its own brackets
            a = Atom(f"{a.text} {m} {b.text}", a.columns + b.columns, f"({a.sql} {m} {b.sql})")
        return a

    def _signed(self) -> Atom:
        if self.peek() in ("-", "+"):
            m = self.take()[1]
            a = self._signed()
            return Atom(f"{m}{a.text}", a.columns, f"({m}{a.sql})")
        a = self._value()
        if self.peek() == "^":
            self.take()
            b = self._signed()
            return Atom(f"{a.text}^{b.text}", a.columns + b.columns, f"power({a.sql}, {b.sql})")
        return a

    def _value(self) -> Atom:
        kind, t = self.take()
        if kind == "number":
            return Atom(t, (), f"CAST({t} AS DOUBLE)")
        if (kind, t) == ("mark", "("):
            a = self.number()
            self.take(")")
            return Atom(f"({a.text})", a.columns, a.sql)
        if kind == "mark":
            raise DesignError(f"{t!r} is no number in {self.text!r}")
        if kind == "name" and self.peek() == "(":
            return self.call(t)
        return self.column(t)

    def call(self, name: str) -> Atom:
        if name != "I" and name not in FUNCTIONS:
            raise DesignError(f"no function {name!r}")
        self.take("(")
        given = [self.number()]
        while self.peek() == ",":
            self.take()
            given.append(self.number())
        self.take(")")
        if name == "I" and len(given) > 1 or name not in ("pmin", "pmax", "round") and len(given) > 1:
            raise DesignError(f"{name} takes one number")
        columns = tuple(dict.fromkeys(c for a in given for c in a.columns))
        text = f"{name}({', '.join(a.text for a in given)})"
        if name == "I":
            return Atom(text, columns, given[0].sql)
        if name == "round" and len(given) == 2:
            return Atom(text, columns, f"round({given[0].sql}, CAST({given[1].sql} AS INT))")
        return Atom(text, columns, f"{FUNCTIONS[name]}({', '.join(a.sql for a in given)})")

    def column(self, name: str) -> Atom:
        if name not in self.columns:
            raise DesignError(f"no column {name!r}")
        quoted = name.replace("`", "``")
        return Atom(_plain(name), (name,), f"CAST(`{quoted}` AS DOUBLE)")

    # terms

    def terms(self) -> list[tuple[Atom, ...]]:
        out: list[tuple[Atom, ...]] = []
        sign = "+"
        if self.peek() in ("+", "-"):
            sign = self.take()[1]
        while True:
            got = self._crossed()
            out = _union(out, got) if sign == "+" else [t for t in out if _set(t) not in map(_set, got)]
            if self.peek() not in ("+", "-"):
                return out
            sign = self.take()[1]

    def _crossed(self) -> list[tuple[Atom, ...]]:
        a = self._joined()
        while (m := self.peek()) in ("*", "/"):
            self.take()
            b = self._joined()
            if m == "*":
                a = _union(_union(a, b), _products(a, b))
            else:
                every = tuple(dict.fromkeys(chain.from_iterable(a)))
                a = _union(a, _products([every], b))
        return a

    def _joined(self) -> list[tuple[Atom, ...]]:
        a = self._power()
        while self.peek() == ":":
            self.take()
            a = _products(a, self._power())
        return a

    def _power(self) -> list[tuple[Atom, ...]]:
        a = self._factor()
        while self.peek() == "^":
            self.take()
            kind, n = self.take()
            if kind != "number" or not n.isdigit() or int(n) < 1:
                raise DesignError(f"{n!r} is no power of terms")
            first = a
            for _ in range(int(n) - 1):
                a = _union(a, _products(a, first))
        return a

    def _factor(self) -> list[tuple[Atom, ...]]:
        kind, t = self.take()
        if kind == "number":
            if t not in ("0", "1"):
                raise DesignError(f"{t!r} is no term")
            return []
        if (kind, t) == ("mark", "("):
            a = self.terms()
            self.take(")")
            return a
        if (kind, t) == ("mark", "."):
            return [(self._as_is(c),) for c in self.columns if c not in self.response_columns]
        if kind == "mark":
            raise DesignError(f"{t!r} is no term in {self.text!r}")
        if kind == "name" and self.peek() == "(":
            if t in ("factor", "as.factor"):
                self.take("(")
                name = self.take()[1]
                self.take(")")
                return [(Atom(f"factor({_plain(name)})", self.column(name).columns, None, True),)]
            if t == "offset":
                self.take("(")
                self.offset.append(self.number())
                self.take(")")
                return []
            return [(self.call(t),)]
        return [(self._as_is(t),)]

    def _as_is(self, name: str) -> Atom:
        a = self.column(name)
        return Atom(a.text, a.columns)


def _set(term: tuple[Atom, ...]) -> frozenset:
    return frozenset(term)


def _union(a: list, b: list) -> list:
    return [*a, *(t for i, t in enumerate(b) if _set(t) not in map(_set, [*a, *b[:i]]))]


def _products(a: list, b: list) -> list:
    return _union([], [tuple(dict.fromkeys((*s, *t))) for s in a for t in b])


def parse(formula: str, columns: list[str]) -> Formula:
    if formula.count("~") != 1:
        raise DesignError(f"not a formula: {formula!r}")
    left, right = formula.split("~")
    r = _Reader(left, columns)
    response = r.number()
    if r.at < len(r.tokens):
        raise DesignError(f"cannot read the response in {formula!r}")
    t = _Reader(right, columns)
    t.response_columns = response.columns
    terms = t.terms()
    if t.at < len(t.tokens):
        raise DesignError(f"cannot read {t.tokens[t.at][1]!r} in {formula!r}")
    if not terms:
        raise DesignError("no predictors")
    return Formula(response, tuple(sorted(terms, key=len)), tuple(t.offset))


def parse_term(text: str, columns: list[str]) -> tuple[Atom, ...]:
    """A term by its text."""
    if text in columns:
        return (Atom(_plain(text), (text,)),)
    r = _Reader(text, columns)
    found = r.terms()
    if r.at < len(r.tokens) or len(found) != 1:
        raise DesignError(f"not one term: {text!r}")
    return found[0]
