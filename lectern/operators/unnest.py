"""Arrays into rows without evaluating the array more than once.

A plain ``explode`` makes Catalyst infer a ``size(array) > 0`` filter and push it down with a
copy of the whole array expression. The outer form has no such filter; the empty row it adds
is dropped on the generated position, which cannot be pushed below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, keep: Sequence[Column | str], value: str = "_v", pos: str = "_p") -> DataFrame:
    """One row per entry with its 0-based position."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def unnest_structs(df: DataFrame, array: Column | str, keep: Sequence[Column | str], pos: str | None = None) -> DataFrame:
    """One row per struct of the array, its fields as columns."""
    rows = unnest(df, array, keep, "_v", pos or "_p")
    return rows.select(*[c for c in rows.columns if c not in ("_v", "_p")], "_v.*")
