"""XPath syntax trees: immutable, compared by value."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: str


@dataclass(frozen=True)
class Number(Expr):
    value: float


@dataclass(frozen=True)
class Call(Expr):
    """A function. ``text`` and ``node`` without arguments are the forms that stand alone in a predicate."""

    name: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Negate(Expr):
    operand: Expr


@dataclass(frozen=True)
class Union(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Filter(Expr):
    """A parenthesised expression with predicates that count over the whole document."""

    operand: Expr
    predicates: tuple[Expr, ...]


@dataclass(frozen=True)
class Step(Expr):
    axis: str
    test: str
    predicates: tuple[Expr, ...] = ()
    #: A descendant step whose first predicate counts among the children of one parent: ``a//x[n]``.
    by_parent: bool = False


@dataclass(frozen=True)
class Path(Expr):
    """``start`` is "root", "here" (all nodes at the top, the candidate in a predicate) or an expression."""

    start: str | Expr
    steps: tuple[Step, ...]


ANYWHERE = Step("descendant-or-self", "node()")


def walk(expr: Expr, into_predicates: bool = True):
    """All sub-expressions; without ``into_predicates`` those that share the expression's own context."""
    yield expr
    children: tuple = ()
    if isinstance(expr, Call):
        children = expr.args
    elif isinstance(expr, Binary):
        children = (expr.left, expr.right)
    elif isinstance(expr, Negate):
        children = (expr.operand,)
    elif isinstance(expr, Union):
        children = expr.parts
    elif isinstance(expr, Filter):
        children = (expr.operand, *(expr.predicates if into_predicates else ()))
    elif isinstance(expr, Path):
        children = (*((expr.start,) if isinstance(expr.start, Expr) else ()), *expr.steps)
    elif isinstance(expr, Step):
        children = expr.predicates if into_predicates else ()
    for child in children:
        yield from walk(child, into_predicates)
