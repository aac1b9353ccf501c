"""Formulas over named metrics, compiled to Columns or to SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(formula: str, known: Iterable[str]) -> list[tuple[str, str]]:
    """("name" | "number" | "sign", text) in order. Names may hold signs, so the longest known name wins."""
    ordered = sorted(known, key=len, reverse=True)
    out, at = [], 0
    while at < len(formula):
        if formula[at].isspace():
            at += 1
            continue
        name = next((n for n in ordered if formula.startswith(n, at)), None)
        number = re.compile(r"[\d.]+").match(formula, at)
        if name:
            out.append(("name", name))
            at += len(name)
        elif number:
            out.append(("number", number[0]))
            at = number.end()
        elif formula[at] in "+-*/()":
            out.append(("sign", formula[at]))
            at += 1
        else:
            raise ValueError(f"{formula!r}: nothing known at {at}")
    return out


def names(formula: str, known: Iterable[str]) -> list[str]:
    """Known names in a formula, each once, in order."""
    return list(dict.fromkeys(t for kind, t in tokens(formula, known) if kind == "name"))


def parse(formula: str, known: Iterable[str]):
    """A tree of ("name", n), ("number", x), ("-", a) and (sign, a, b); products bind closer, equal signs from the left."""
    rest = tokens(formula, known)

    def take() -> tuple[str, str]:
        if not rest:
            raise ValueError(f"{formula!r} ends too early")
        return rest.pop(0)

    def chain(signs: str, below: Callable):
        left = below()
        while rest and rest[0][0] == "sign" and rest[0][1] in signs:
            sign = take()[1]
            left = (sign, left, below())
        return left

    def atom():
        kind, text = take()
        if kind == "name":
            return ("name", text)
        if kind == "number":
            return ("number", float(text))
        if text == "(":
            inner = chain("+-", product)
            if take() != ("sign", ")"):
                raise ValueError(f"{formula!r}: bracket not closed")
            return inner
        if text in "+-":
            value = atom()
            return ("-", value) if text == "-" else value
        raise ValueError(f"{formula!r}: {text!r} in a wrong place")

    def product():
        return chain("*/", atom)

    tree = chain("+-", product)
    if rest:
        raise ValueError(f"{formula!r}: {rest[0][1]!r} left over")
    return tree


def to_column(tree, value_of: Callable[[str], Column]) -> Column:
    """The tree as a Column; null poisons, and dividing by zero gives null."""
    kind, *parts = tree
    if kind == "name":
        return value_of(parts[0])
    if kind == "number":
        return F.lit(parts[0])
    args = [to_column(p, value_of) for p in parts]
    if len(args) == 1:
        return -args[0]
    a, b = args
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else F.try_divide(a, b)


def to_sql(tree, value_of: Callable[[str], str]) -> str:
    """The tree as SQL text with the same rules."""
    kind, *parts = tree
    if kind == "name":
        return value_of(parts[0])
    if kind == "number":
        return f"cast({parts[0]} as double)"
    args = [to_sql(p, value_of) for p in parts]
    if len(args) == 1:
        return f"(-{args[0]})"
    return f"({args[0]} / nullif({args[1]}, 0))" if kind == "/" else f"({args[0]} {kind} {args[1]})"
