"""Unranked predicates as boolean columns; a missing value satisfies none of them, ``notEquals`` included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.request import Options
from ..plans.schema import Index


def ordered(c: Column, o: Options, case_sensitive: bool = True) -> Column:
    """Comparisons of integers, floats and strings (by their UTF-8 bytes).

    Without case sensitivity column and value are lowered, but the end of a range is taken as it is.
    """
    value = o.value
    if isinstance(value, str) and not case_sensitive:
        c, value = F.lower(c), value.lower()
    op = o.operator
    if op == "equals":
        return c == F.lit(value)
    if op == "notEquals":
        return c != F.lit(value)
    if op == "startsWith":
        return c.startswith(value)
    if op == "greaterThan":
        return c > F.lit(value)
    if op == "greaterThanOrEquals":
        return c >= F.lit(value)
    if op == "lessThan":
        return c < F.lit(value)
    if op == "lessThanOrEquals":
        return c <= F.lit(value)
    return (c >= F.lit(value)) & (c <= F.lit(o.end))


def string_array(c: Column, o: Options, case_sensitive: bool = True) -> Column:
    """All or any of the values are in the array."""
    values = list(dict.fromkeys(o.value if case_sensitive else (v.lower() for v in o.value)))
    if not case_sensitive:
        c = F.transform(c, F.lower)
    wanted = F.array(*(F.lit(v) for v in values))
    if o.operator == "containsAny":
        return F.arrays_overlap(c, wanted)
    return F.size(F.array_except(wanted, c)) == 0


def predicate(c: Column, index: Index, o: Options) -> Column:
    """The boolean column of a leaf on a property."""
    if index.kind == "stringArray":
        return c.isNotNull() & string_array(c, o, index.case_sensitive)
    if index.kind == "integer":
        return ordered(c.cast("long"), o)
    return ordered(c, o, index.case_sensitive)
