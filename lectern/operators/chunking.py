"""Books into heading chunks with pages, and their places in a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.durable import numbered
from lectern.operators.unnest import unnest, unnest_structs


def heading_sections(markdown: ColumnLike) -> Column:
    """``array<struct<section_pos, section_heading, text>>`` split at lines starting ``# ``.

    Text before the first heading has a null heading; empty bodies are dropped. In place.
    """
    parts = F.split(F.concat(F.lit("\n"), col(markdown)), "\n# ")

    def section(part: Column, pos: Column) -> Column:
        first = F.split_part(part, F.lit("\n"), F.lit(1))
        body = F.substring(part, F.length(first) + 2, F.length(part))
        return F.struct(
            pos.alias("section_pos"),
            F.when(pos > 0, T.strip(first)).alias("section_heading"),
            T.strip(F.when(pos > 0, body).otherwise(part)).alias("text"),
        )

    return F.filter(F.transform(parts, section), lambda s: s["text"] != "")


def image_paths(text: ColumnLike) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"!\[.*?\]\((.+?)\)"), F.lit(1))


def headings(markdown: ColumnLike) -> Column:
    """Distinct heading texts of the whole book."""
    lines = F.filter(F.split(col(markdown), "\n"), lambda x: x.startswith("# ") & (F.length(x) > 2))
    return F.array_distinct(F.transform(lines, lambda x: T.strip(F.substring(x, 3, F.length(x)))))


def block_sections(books: DataFrame, key: str = "book_id") -> DataFrame:
    """Pages per section of the page blocks: ``(book, section_no, section_heading, pages)``.

    A block whose text equals a heading opens a section; pages are sorted and distinct; a
    leading section without heading is kept only if it has pages.
    """
    blocks = unnest(books, "blocks", [key, headings("markdown").alias("_headings")], "b", "block_pos").filter(F.col("b").isNotNull()).select(
        key, "block_pos", F.col("b.page_idx").alias("page_idx"),
        F.when(F.array_contains("_headings", T.strip(F.coalesce("b.text", F.lit("")))), T.strip("b.text")).alias("opens"),
    )
    running = Window.partitionBy(key).orderBy("block_pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered_blocks = blocks.withColumn("section_no", F.count("opens").over(running))
    sections = numbered_blocks.groupBy(key, "section_no").agg(
        F.max("opens").alias("section_heading"),
        F.array_sort(F.collect_set("page_idx")).alias("page_numbers"),
    )
    return sections.filter(F.col("section_heading").isNotNull() | (F.size("page_numbers") > 0))


def chunk_books(books: DataFrame, key: str = "book_id", meta: Sequence[str] = ("book_title", "book_author", "source_file")) -> DataFrame:
    """Heading chunks of ``books(key, markdown, blocks, meta)`` with images and pages.

    The n-th chunk under a heading takes the pages of the n-th section with that heading. Only
    chunks that are emitted count on the text side; all sections count on the block side. A
    book arrives as one row, so its windows are bounded by that row.
    """
    chunks = unnest_structs(books, heading_sections("markdown"), [key, *meta])
    by_heading = Window.partitionBy(key, "section_heading")
    chunks = chunks.withColumn("_nth", F.row_number().over(by_heading.orderBy("section_pos")))
    sections = block_sections(books, key).withColumn(
        "_nth", F.row_number().over(by_heading.orderBy("section_no"))
    )
    # all null-heading chunks (there is one) use the first null section
    pages = sections.select(key, F.coalesce("section_heading", F.lit("")).alias("_h"), F.col("section_heading").isNull().alias("_n"), "_nth", "page_numbers")
    joined = chunks.withColumn("_h", F.coalesce("section_heading", F.lit(""))).withColumn(
        "_n", F.col("section_heading").isNull()
    ).join(pages, [key, "_h", "_n", "_nth"], "left")
    return joined.select(
        key, F.col("section_pos").alias("chunk_pos"), "text", "section_heading",
        image_paths("text").alias("image_paths"),
        F.coalesce("page_numbers", F.array().cast("array<int>")).alias("page_numbers"), *meta,
    )


def assign_chunk_ids(chunks: DataFrame, order: Sequence[str] = ("book_id", "chunk_pos")) -> DataFrame:
    """``chunk_<n>`` by position inside the collection."""
    return numbered(chunks, ["collection"], list(order), "position").withColumn(
        "chunk_id", F.concat(F.lit("chunk_"), F.col("position").cast("string"))
    )


def stable_chunk_ids(chunks: DataFrame, parts: Sequence[str] = ("source_file", "chunk_pos")) -> DataFrame:
    """Ids from the chunk's origin: a second batch never overwrites the first."""
    key = F.md5(F.concat_ws("\x1f", *[F.col(p).cast("string") for p in parts]))
    return chunks.withColumn("chunk_id", F.concat(F.lit("chunk_"), key))


def hashed_vectors(chunks: DataFrame, size: int = 256, text: str = "text") -> DataFrame:
    """Unit-length hashed term counts, for when no embedding model has filled ``vector``."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    terms = chunks.withColumn("_terms", T.key_terms(text))
    counted = HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=size).transform(terms)
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return unit.withColumn("vector", vector_to_array("_unit", "float32")).drop("_terms", "_counts", "_unit")


def decode_metadata(rows: DataFrame) -> DataFrame:
    """Flat store metadata back to arrays; missing books are Unknown, sections empty."""
    pages = F.filter(F.split(F.coalesce("page_numbers", F.lit("")), ","), lambda p: p != "")
    images = F.transform(F.split(F.coalesce("image_paths", F.lit("")), r"\|\|\|"), T.strip)
    unknown = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    changed = ("page_numbers", "image_paths", "book_title", "book_author", "section_heading")
    return rows.select(
        *[c for c in rows.columns if c not in changed],
        F.transform(pages, lambda p: p.cast("int")).alias("page_numbers"),
        F.filter(images, lambda p: p != "").alias("image_paths"),
        unknown("book_title"), unknown("book_author"),
        F.coalesce("section_heading", F.lit("")).alias("section_heading"),
    )


def encode_metadata(chunks: DataFrame) -> DataFrame:
    """Array columns to the flat form an outside store takes."""
    return (
        chunks.withColumn("page_numbers", F.array_join(F.col("page_numbers").cast("array<string>"), ","))
        .withColumn("image_paths", F.array_join("image_paths", "|||"))
        .withColumn("section_heading", F.coalesce("section_heading", F.lit("")))
    )
