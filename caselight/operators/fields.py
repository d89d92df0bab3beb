"""Typed fields of raw rows: dates in several notations, truth values, rich text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLASHED, _DASHED_NAME, _NAME_FIRST = r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^[A-Za-z]+ \d{1,2}, \d{4}$"
# The notations of dates in the order in which they are tried: shape, pattern, and the same pattern in percent notation. Of an ambiguous one month comes first.
TICKET_DATES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d", "%Y-%m-%d"),
    (_SLASHED, "M/d/y", "%m/%d/%Y"),
    (_SLASHED, "d/M/y", "%d/%m/%Y"),
    (_DASHED_NAME, "d-MMM-y", "%d-%b-%Y"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d", "%Y/%m/%d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y", "%d-%m-%Y"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, y", "%b %d, %Y"),
    (_NAME_FIRST, "MMMM d, y", "%B %d, %Y"),
)
COMMITMENT_DATES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d", "%Y-%m-%d"),
    (_SLASHED, "M/d/y", "%m/%d/%Y"),
    (_SLASHED, "d/M/y", "%d/%m/%Y"),
    (_DASHED_NAME, "d-MMM-y", "%d-%b-%Y"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d", "%Y/%m/%d"),
    (_NAME_FIRST, "MMMM d, y", "%B %d, %Y"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM y", "%d %B %Y"),
)


def normal_date(c: Column, formats: tuple) -> Column:
    """``YYYY-MM-DD`` by the first notation that fits the whole value, else by its first ten characters; null for anything else."""
    v = F.trim(c)
    iso = F.substring(v, 1, 10)
    tries = [F.when(v.rlike(shape), F.try_to_date(v, pattern)) for shape, pattern, _ in formats]
    return F.date_format(F.coalesce(*tries, F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd"))), "yyyy-MM-dd")


def parsed_bool(c: Column, sheet: bool = False) -> Column:
    """Whether a value says yes; in a sheet a cross does, and ``y`` doesn't. Null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "yes", "1", "x" if sheet else "y"), F.lit(False))


# Nodes of a rich-text tree that end a line.
ENDS_LINE = frozenset("paragraph heading listItem bulletList orderedList rule".split())


def adf_text(tree: Any) -> str:
    """The text of a rich-text tree in document order; without recursion, so of any depth. What is no object is its own text."""
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, tree)]
    while todo:
        literal, node = todo.pop()
        if literal or not isinstance(node, dict):
            out.append(str(node))
            continue
        out.append(str(node.get("text") or ""))
        if node.get("type") in ENDS_LINE:
            todo.append((True, "\n"))
        todo.extend((False, child) for child in reversed(node.get("content") or []))
    return "".join(out)
