"""Ordered severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions.text import ColumnLike, col, words_array


def ordinal(severity: ColumnLike) -> Column:
    """passed 0 < minor 1 < major 2 < critical 3; compare these to order severities."""
    return F.array_position(words_array(lex.SEVERITIES), col(severity)).cast("int") - 1


def from_ordinal(value: ColumnLike) -> Column:
    # a chain, since element_at drops the null of a null index when the array has no nulls
    name = F.lit(None).cast("string")
    for number, severity in enumerate(lex.SEVERITIES):
        name = F.when(col(value) == number, severity).otherwise(name)
    return name


def worst(severity: ColumnLike) -> Column:
    """Aggregate: the worst severity of a group, ``passed`` when there is none."""
    return F.coalesce(from_ordinal(F.max(ordinal(severity))), F.lit("passed"))


def worst_of(severities: ColumnLike) -> Column:
    """The worst of an array, ``passed`` when it is empty."""
    top = F.array_max(F.transform(col(severities), ordinal))
    return F.coalesce(from_ordinal(top), F.lit("passed"))


def priority(severity: ColumnLike) -> Column:
    expr = F.lit(0)
    for name, value in lex.SEVERITY_PRIORITY.items():
        expr = F.when(col(severity) == name, value).otherwise(expr)
    return expr
