"""Names, keys and small scalar clean-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import ColumnLike, col


def collection_name(name: ColumnLike) -> Column:
    """A valid collection name: ``[A-Za-z0-9_-]``, alphanumeric ends, 3 to 63 characters."""
    clean = F.btrim(F.regexp_replace(col(name), "[^a-zA-Z0-9_-]", "_"), F.lit("_-"))
    filled = F.rpad(F.when(clean == "", "a").otherwise(clean), 3, "a")
    short = F.when(F.length(clean) < 3, filled).otherwise(clean)
    cut = F.rtrim(F.substring(short, 1, 63), F.lit("_-"))
    return F.when(F.length(short) > 63, cut).otherwise(short)


def file_name(name: ColumnLike, longest: int = 100) -> Column:
    clean = F.btrim(F.regexp_replace(col(name), r'[<>:"/\\|?*]', "_"), F.lit(". "))
    return F.when(
        F.length(clean) > longest, F.btrim(F.substring(clean, 1, longest), F.lit(". "))
    ).otherwise(clean)


def snapshot_name(name: ColumnLike) -> Column:
    """Certification name as used in snapshot and queue paths."""
    return F.regexp_replace(F.translate(col(name), " /", "__"), r"[()]", "")


def type_name(name: ColumnLike) -> Column:
    """Lower case, every run of other characters one underscore, no underscore at the ends."""
    return F.btrim(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "_"), F.lit("_"))


slug = type_name


def entity_key(name: ColumnLike) -> Column:
    """Key of a module, topic or subtopic inside an entity path."""
    return F.lower(F.translate(col(name), " ", "_"))


def as_text(value: ColumnLike) -> Column:
    return col(value).cast("string")


def content_hash(direct_link: ColumnLike, mirror_links: ColumnLike) -> Column:
    """Content hash named by the first link that carries one."""
    links = F.concat(
        F.array(F.coalesce(col(direct_link), F.lit(""))),
        F.coalesce(col(mirror_links), F.array().cast("array<string>")),
    )

    def part(text: Column, mark: str, n: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(n))

    def hash_of(url: Column) -> Column:
        main_tail = part(url, "/main/", -1)
        return (
            F.when(url.contains("md5="), part(part(url, "md5=", 2), "&", 1))
            .when(url.contains("/md5/"), part(part(url, "/md5/", -1), "/", 1))
            .when(url.contains("/main/") & main_tail.contains("/"), part(main_tail, "/", 1))
        )

    return F.get(F.filter(F.transform(links, hash_of), lambda h: h.isNotNull()), F.lit(0))
