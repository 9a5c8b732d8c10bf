"""User-written formulas and cuts: checked against the table's columns and a fixed set of functions before Spark sees them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions a formula may call, and what they are called in SQL.
FUNCTIONS = {
    "abs": "abs", "sqrt": "sqrt", "log": "ln", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "atan2": "atan2",
    "arctan2": "atan2", "min": "least", "minimum": "least", "max": "greatest", "maximum": "greatest", "pow": "pow",
}


class FormulaError(AnalysisException, ValueError):
    """A text that is no formula over the columns at hand."""


WORDS = frozenset(("AND", "OR", "NOT"))
TOKEN = re.compile(
    r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![A-Za-z_])|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<>|<=|>=|&+|\|+|[-+*/%(),<>=!]))"
)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, token) pairs of a formula; anything else than numbers, names and operators is an error."""
    out, at, text = [], 0, text.strip()
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise FormulaError(f"not part of a formula: {text[at:at + 20]!r}")
        out.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    return out


def checked(text: str, columns: Iterable[str]) -> list[tuple[str, str]]:
    """The formula's tokens, if every name is a column or a known function that is called."""
    found, columns = tokens(text), set(columns)
    for i, (kind, token) in enumerate(found):
        if kind != "name" or token.upper() in WORDS:
            continue
        called = i + 1 < len(found) and found[i + 1][1] == "("
        if called and token not in FUNCTIONS:
            raise FormulaError(f"unknown function {token!r} in {text!r}")
        if not called and token not in columns:
            raise FormulaError(f"unknown column {token!r} in {text!r}")
    return found


def formula(text: str, columns: Iterable[str]) -> Column:
    """A formula as a column; numbers are doubles, ``&`` and ``|`` the logical operators, ``==`` equality."""
    marks = {"==": "=", "!=": "<>", "!": " NOT "}
    found, out = checked(text, columns), []
    for i, (kind, token) in enumerate(found):
        if kind == "number":
            out.append(f"{token}D")
        elif kind == "mark":
            out.append(" AND " if token[0] == "&" else " OR " if token[0] == "|" else marks.get(token, token))
        elif token.upper() in WORDS:
            out.append(f" {token} ")
        elif i + 1 < len(found) and found[i + 1][1] == "(":
            out.append(FUNCTIONS[token])
        else:
            out.append(f"`{token}`")
    return F.expr("".join(out))


def derive(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """Add a column per named formula over the columns of ``df``; formulas do not see each other."""
    return df.withColumns({name: formula(text, df.columns) for name, text in formulas.items()})
