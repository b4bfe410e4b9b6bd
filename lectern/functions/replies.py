"""Model replies as text: fence stripping and tolerant JSON reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import ColumnLike, col, strip, words_array

# the opening fence line, the body, and a last line that is a closing fence
FENCED = r"(?s)\A```[^\n]*\n?(.*?)(?:(?:(?<=\n)|\n)[^\S\n]*```)?\z"


def strip_fences(text: ColumnLike) -> Column:
    """Drop the opening fence line and a closing fence line; other text is only trimmed."""
    text = col(text)
    bare = text.startswith("{") & text.endswith("}")  # nothing to drop, as most replies
    return F.when(bare, text).otherwise(F.regexp_replace(strip(text), FENCED, "$1"))


def parsed(text: ColumnLike) -> Column:
    """The reply as a variant; null when it is not JSON."""
    return F.try_parse_json(strip_fences(text))


def is_object(text: ColumnLike) -> Column:
    body = strip_fences(text)
    return F.coalesce(F.try_parse_json(body).isNotNull() & body.startswith("{"), F.lit(False))


def read_as(text: ColumnLike, schema: str) -> Column:
    """Reply text read with a DDL schema; absent and mistyped fields become null."""
    return F.from_json(strip_fences(text), schema, {"mode": "PERMISSIVE"})


def has_key(text: ColumnLike, path: str) -> Column:
    """True when the key is present, even with a JSON null; ``path`` as in ``$.a.b``."""
    return F.try_variant_get(parsed(text), path, "variant").isNotNull()


def default_text(value: ColumnLike, default: str = "") -> Column:
    return F.coalesce(col(value), F.lit(default))


def empty_texts(value: ColumnLike) -> Column:
    return F.coalesce(col(value), words_array([]))


def one_of(value: ColumnLike, allowed: tuple[str, ...], default: str) -> Column:
    """The value if it is in the list, else the default (also for null)."""
    value = col(value)
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(default))
