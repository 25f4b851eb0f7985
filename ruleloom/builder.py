"""Rules built in Python instead of text.

``P.Grandparent(x, z) << (P.Parent(x, y), P.Parent(y, z))`` inside
``with rules() as r:`` adds a rule to ``r``; ``r.program(spark, tables)`` is
the program, ``r.text`` its source.
"""

from __future__ import annotations

import contextlib
import json

_open: list[Rules] = []


def _text(value) -> str:
    if isinstance(value, Term):
        return value.text
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False) if '"' not in value and "\\" not in value else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_text, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {_text(v)}" for k, v in value.items()) + "}"
    return repr(value)


class Term:
    """An expression or proposition by its source text."""

    def __init__(self, text: str):
        self.text = text

    def _with(self, op: str, other, swapped: bool = False) -> Term:
        a, b = _text(self), _text(other)
        return Term(f"({b} {op} {a})" if swapped else f"({a} {op} {b})")

    def __add__(self, other):
        return self._with("+", other)

    def __radd__(self, other):
        return self._with("+", other, True)

    def __sub__(self, other):
        return self._with("-", other)

    def __mul__(self, other):
        return self._with("*", other)

    def __rmul__(self, other):
        return self._with("*", other, True)

    def __truediv__(self, other):
        return self._with("/", other)

    def __lt__(self, other):
        return self._with("<", other)

    def __le__(self, other):
        return self._with("<=", other)

    def __gt__(self, other):
        return self._with(">", other)

    def __ge__(self, other):
        return self._with(">=", other)

    def __eq__(self, other):
        return Term(f"{_text(self)} == {_text(other)}")

    def __ne__(self, other):
        return self._with("!=", other)

    __hash__ = None

    def __invert__(self):
        return Term(f"~({self.text})")

    def __or__(self, other):
        return Term(f"({self.text} | {_text(other)})")

    def isin(self, items) -> Term:
        return Term(f"{self.text} in {_text(items)}")

    def __getattr__(self, name: str) -> Term:
        if name.startswith("_"):
            raise AttributeError(name)
        return Term(f"{self.text}.{name}")


class Head(Term):
    def __init__(self, text: str, distinct: bool = False):
        super().__init__(text)
        self.distinct = distinct

    def __lshift__(self, body) -> None:
        parts = body if isinstance(body, tuple) else (body,)
        _open[-1].add(f"{self.text}{' distinct' if self.distinct else ''} :- {', '.join(map(_text, parts))}")

    def fact(self) -> None:
        _open[-1].add(self.text)


class Aggregated:
    def __init__(self, op: str, value):
        self.op, self.value = op, value


def agg(op: str, value) -> Aggregated:
    """An aggregated field: ``P.Total(k=k, n=agg("Sum", v))``."""
    return Aggregated(op, value)


class _Predicates:
    def __getattr__(self, name: str):
        def call(*args, **fields) -> Head:
            parts = [_text(a) for a in args]
            distinct = False
            for k, v in fields.items():
                if isinstance(v, Aggregated):
                    distinct = True
                    parts.append(f"{k}? {v.op}= {_text(v.value)}")
                else:
                    parts.append(f"{k}: {_text(v)}")
            return Head(f"{name}({', '.join(parts)})", distinct)

        return call


P = _Predicates()


def variables(names: str) -> tuple[Term, ...]:
    return tuple(Term(n) for n in names.split())


class Rules:
    def __init__(self):
        self.lines: list[str] = []

    def add(self, line: str) -> None:
        self.lines.append(line)

    @property
    def text(self) -> str:
        return ";\n".join(self.lines) + ";"

    def program(self, spark, tables: dict | None = None, **more):
        from ruleloom import Program

        return Program(self.text, spark, tables, **more)


@contextlib.contextmanager
def rules():
    r = Rules()
    _open.append(r)
    try:
        yield r
    finally:
        _open.pop()
