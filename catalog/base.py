"""Input tables and derived rows shared by the registered queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lectern.functions import text as T


#: Of a table's files: texts unfold to many times their size, and what a task sorts of that is to fit its memory.
BYTES_OF_TASK = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A given table. One that arrives in fewer splits than there are cores (a single small file)
    is spread first; a table of many splits is left alone. With ``by`` its rows are dealt by that
    column instead, to tasks of about ``BYTES_OF_TASK``: what is made of them afterwards lies with its row, so joins
    and sums by it move nothing."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if by:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_OF_TASK)), by)
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages", "conversations", "embeddings") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def plain(df: DataFrame) -> DataFrame:
    """Flat result columns: long integers, doubles rounded to 6, arrays of text joined by |."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (Ty.IntegerType, Ty.ShortType, Ty.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (Ty.DoubleType, Ty.FloatType, Ty.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, Ty.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, Ty.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|", "")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- SQL building blocks --------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_sentences(x: str, enders: str = ".!?") -> str:
    cut = f"string_split(regexp_replace({x}, '([{enders}])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda z: {sql_strip('z')}), lambda z: z <> '')"


def sql_words(x: str) -> str:
    """Split at white space, no empty parts."""
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda z: z <> '')"


def sql_long_words(x: str, least: int = 4) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{W}{{{least},}}'))"


def sql_terms(x: str, stop) -> str:
    stop = [s for s in stop if len(s) > 3]
    return (
        f"list_filter(regexp_extract_all(lower({x}), '{W}{{4,}}'),"
        f" lambda z: NOT list_contains({sql_list(stop)}, z))"
    )


def sql_has(x: str, words: str) -> str:
    """A whole word of the alternation stands in the (lower-case) text."""
    return f"regexp_matches({x}, '(^|[^\\p{{L}}\\p{{N}}_])(?:{words})($|[^\\p{{L}}\\p{{N}}_])')"


def sql_jaccard(a: str, b: str) -> str:
    """Of lists without repeats."""
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE"
        f" ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"
    )


def sql_joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


# --- items derived from documents: one question per text ---------------------------------

ALLOWED_TAGS = ["tag_0", "tag_1", "tag_2"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a question: its sentences are stem, answer and distractors, the whole text
    is the explanation, the last sentence the learning target; empty text where a sentence is missing."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    rows = table(spark, sf_dir, "documents").withColumn("text", empty(F.col("text"))).withColumn("s", T.sentences("text"))
    return rows.select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").alias("pos"), "source", "lang",
        empty(F.get("s", F.lit(0))).alias("stem"), empty(F.get("s", F.lit(1))).alias("correct_answer"),
        F.slice("s", 3, 3).alias("distractors"), F.col("text").alias("explanation"),
        F.array(F.concat(F.lit("tag_"), (F.col("doc_id") % 4).cast("string"))).alias("scope_tags"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("doc_id") % 3 + 1).cast("int")).alias("difficulty"),
        empty(F.get("s", F.size("s") - 1)).alias("learning_target"),
    )


SQL_ITEMS = f"""
split AS (SELECT * REPLACE (coalesce(text, '') AS text), {sql_sentences("coalesce(text, '')")} AS s FROM documents),
items AS (
  SELECT doc_id AS item_id, doc_id AS pos, source, lang, coalesce(s[1], '') AS stem, coalesce(s[2], '') AS correct_answer, s[3:5] AS distractors,
         text AS explanation, ['tag_' || (doc_id % 4)::VARCHAR] AS scope_tags,
         ['easy', 'medium', 'hard'][(doc_id % 3 + 1)::INT] AS difficulty, coalesce(s[len(s)], '') AS learning_target
  FROM split)
"""


# --- items derived from benchmark, with documents as their source chunks ------------------


def source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as an item: the text explains, its first sentence is the target, its second answers."""
    rows = table(spark, sf_dir, "benchmark").withColumn("s", T.sentences("text"))
    return rows.select(
        "item_id", F.col("text").alias("explanation"),
        F.coalesce(F.get("s", F.lit(1)), F.get("s", F.lit(0))).alias("correct_answer"),
        F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("learning_target"),
        F.element_at(F.array(F.lit("beginner"), F.lit("intermediate"), F.lit("advanced")), (F.col("item_id") % 3 + 1).cast("int")).alias("difficulty"),
    )


SQL_SOURCE_ITEMS = f"""
source_items AS (
  SELECT item_id, text AS explanation, coalesce(s[2], s[1]) AS correct_answer,
         coalesce(s[1], '') AS learning_target,
         ['beginner', 'intermediate', 'advanced'][(item_id % 3 + 1)::INT] AS difficulty
  FROM (SELECT *, {sql_sentences('text')} AS s FROM benchmark))
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source chunks per item: every document belongs to one item, by its number."""
    n = table(spark, sf_dir, "benchmark").count()
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        (F.col("doc_id") % n).alias("item_id"), F.col("doc_id").alias("chunk_id"),
        F.floor(F.col("doc_id") / n).alias("chunk_pos"), "text", "source", "lang",
    )


SQL_LINKS = """
links AS (
  SELECT doc_id % (SELECT count(*) FROM benchmark) AS item_id, doc_id AS chunk_id,
         doc_id // (SELECT count(*) FROM benchmark) AS chunk_pos, text, source, lang
  FROM documents)
"""

Query = tuple  # (callable, SQL or None)


def as_json_reply(*fields: Column) -> Column:
    """A reply text around the given fields, as a model would send it."""
    return F.concat(F.lit("```json\n"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("\n```"))
