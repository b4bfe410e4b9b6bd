"""Scans of files the pipeline starts from."""

from __future__ import annotations

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lectern.functions.text import ColumnLike, col
from lectern.sources import schemas as S

LEAST_PDF_BYTES = 10_000


def _stem(path: ColumnLike) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def _folder(path: ColumnLike) -> Column:
    return F.regexp_replace(col(path), r"/[^/]*$", "")


def _whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
        .select(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("path"), F.col("value"))
    )


def book_files(spark: SparkSession, root: str) -> DataFrame:
    """Book Markdown with its block list: ``path, title, markdown, blocks_path, blocks``.

    The block list with the book's own stem wins, else the first in the folder, else none.
    """
    books = _whole_files(spark, root, "*.md").select("path", _folder("path").alias("folder"), _stem("path").alias("title"), F.col("value").alias("markdown"))
    lists = _whole_files(spark, root, "*_content_list.json").select(F.col("path").alias("blocks_path"), _folder("path").alias("folder"), "value")
    own = F.col("blocks_path").endswith(F.concat(F.lit("/"), F.col("title"), F.lit("_content_list.json")))
    # paths only are compared; contents are joined afterwards
    chosen = (
        books.select("path", "folder", "title").join(lists.select("folder", "blocks_path"), "folder")
        .groupBy("path").agg(F.min_by("blocks_path", F.struct((~own).cast("int"), F.col("blocks_path"))).alias("blocks_path"))
    )
    return (
        books.join(chosen, "path", "left").join(lists.select("blocks_path", "value"), "blocks_path", "left")
        .withColumn("blocks", page_blocks("value")).drop("value", "folder")
    )


def page_blocks(value: ColumnLike) -> Column:
    """JSON block list -> ``array<struct<text, page_idx>>``; entries that are no objects are
    skipped, a missing list is empty."""
    entries = F.from_json(col(value), "array<variant>")
    objects = F.filter(entries, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    block = lambda v: F.struct(
        F.try_variant_get(v, "$.text", "string").alias("text"), F.try_variant_get(v, "$.page_idx", "int").alias("page_idx")
    )
    return F.coalesce(F.transform(objects, block), F.expr(f"cast(array() as {S.BLOCKS})"))


@F.pandas_udf(BinaryType())
def _first_bytes(paths: pd.Series) -> pd.Series:
    """The first five bytes of each named file; null where no file is named."""
    stores: dict = {}

    def start(path: str | None) -> bytes | None:
        if path is None:
            return None
        scheme, rest = path.split(":", 1)
        host, inner = ("", rest) if not rest.startswith("//") else rest[2:].partition("/")[::2]
        if (scheme, host) not in stores:
            stores[scheme, host] = (fs.LocalFileSystem(), "") if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{host}/")
        store, root = stores[scheme, host]
        with store.open_input_file(f"{root.rstrip('/')}/{inner.lstrip('/')}") as f:
            return f.read(5)

    return paths.map(start, na_action="ignore").astype(object)


def pdf_files(spark: SparkSession, root: str, through_spark: bool = False) -> DataFrame:
    """Inventory of PDFs with their validity.

    Spark lists the files and reads none; tasks then read five bytes of each that is large enough. With
    ``through_spark`` its reader reads them whole, for stores that :mod:`pyarrow.fs` does not reach (and for files
    of up to 2 GB). Empty files are not listed.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    )
    start = F.col("content") if through_spark else _first_bytes(F.when(F.col("length") > LEAST_PDF_BYTES, F.col("path")))
    return files.select(
        "path", _stem("path").alias("title"), F.lit("Unknown").alias("author"), "length", "modificationTime",
        F.coalesce(is_valid_pdf("length", start), F.lit(False)).alias("is_valid"),
    )


def is_valid_pdf(length: ColumnLike, content: ColumnLike) -> Column:
    return (col(length) > LEAST_PDF_BYTES) & (F.hex(F.substring(col(content), 1, 5)) == "255044462D")


def courses(spark: SparkSession, path: str) -> DataFrame:
    """Course documents, one per file; ``course_id`` is the file's stem."""
    return spark.read.schema(S.COURSE).json(path, multiLine=True).withColumn(
        "course_id", _stem(F.col("_metadata.file_path"))
    ).withColumn("modified_at", F.col("_metadata.file_modification_time"))


def queue(spark: SparkSession, path: str) -> DataFrame:
    """Correction queue lines: every action with its queue's header columns.

    A header holds for its own file, or for its folder where that was written by ``write_queue``
    (``certification=...``, many part files); actions without any header are an error.
    """
    file = F.col("_metadata.file_path")
    queue_of = F.when(_folder(file).rlike("/certification=[^/]*$"), _folder(file)).otherwise(file)
    lines = spark.read.text(path).select(queue_of.alias("queue"), F.trim("value").alias("line")).filter("line <> ''")
    kind = F.get_json_object("line", "$._type")
    headers = lines.filter(kind == "queue_header").select("queue", F.from_json("line", S.QUEUE_HEADER).alias("h"))
    headers = headers.groupBy("queue").agg(F.max("h").alias("h"))
    actions = lines.filter(F.coalesce(kind, F.lit("")) != "queue_header").select("queue", F.from_json("line", S.ACTION).alias("a"))
    joined = actions.join(headers, "queue", "left")
    checked = F.when(F.col("h").isNull(), F.raise_error(F.concat(F.lit("no queue header in "), F.col("queue")))).otherwise(F.col("h"))
    return joined.select(checked.alias("h"), "a").select("h.certification_name", "h.source_version", "h.target_version", "a.*")


def question_types(spark: SparkSession, path: str) -> DataFrame:
    """Type registry ``(question_type, definition)``."""
    doc = spark.read.schema(f"schemas map<string,{S.QUESTION_TYPE}>").json(path, multiLine=True)
    return doc.select(F.explode("schemas").alias("question_type", "definition"))


def image_annotations(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(S.ANNOTATIONS).json(path, multiLine=True)
    rows = doc.select(F.posexplode("annotations").alias("annotation_pos", "a")).select("annotation_pos", "a.path", "a.description")
    return rows.filter(F.coalesce("description", F.lit("")) != "")


def attempts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(S.ATTEMPT).json(path)
