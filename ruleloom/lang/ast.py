"""Tree of a rule program."""

from __future__ import annotations

from dataclasses import dataclass, field


class ProgramError(Exception):
    """A program that cannot be read or planned."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class ListE:
    items: tuple


@dataclass(frozen=True)
class RecordE:
    """Fields are (name, expression); rest is a variable or None."""

    fields: tuple
    rest: object = None


@dataclass(frozen=True)
class Call:
    """A predicate or function; args are (name or position, expression)."""

    name: str
    args: tuple = ()
    rest: str | None = None


@dataclass(frozen=True)
class If:
    branches: tuple
    other: object


@dataclass(frozen=True)
class Combine:
    op: str
    value: object
    body: object = None


@dataclass(frozen=True)
class PredLit:
    name: str


@dataclass(frozen=True)
class Get:
    value: object
    name: str


@dataclass(frozen=True)
class Exists:
    """Truth of a proposition, as a value."""

    body: object


# propositions


@dataclass(frozen=True)
class Atom:
    call: Call


@dataclass(frozen=True)
class Unify:
    left: object
    right: object


@dataclass(frozen=True)
class In:
    item: object
    items: object


@dataclass(frozen=True)
class Cond:
    value: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Neg:
    body: object


@dataclass
class HeadField:
    name: str | int
    value: object
    op: str | None = None


@dataclass
class Rule:
    name: str
    fields: list[HeadField]
    body: object = None
    distinct: bool = False
    rest: str | None = None
    order_by: list | None = None
    limit: int | None = None
    inline: bool = False
    #: assignment of the head: (None, e) for ``= e``, (op, e) for ``op= e``
    value: HeadField | None = None


@dataclass
class Functor:
    name: str
    source: str
    args: dict = field(default_factory=dict)


@dataclass
class Import:
    path: str
    name: str
    alias: str
