"""Quotes: two-round extraction, offsets, and checking that texts really use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.fuzzy import fuzzy_reach, fuzzy_reach_all, fuzzy_similarity, may_reach
from lectern.functions.text import ColumnLike, col
from lectern.operators.durable import first_by
from lectern.operators.retrieval import vector_topk
from lectern.operators.unnest import unnest

PER_CHUNK = 3


def chunk_quotes(
    chunks: DataFrame, target: ColumnLike | None = None, keep: int = PER_CHUNK, **lexicon
) -> DataFrame:
    """Best quotable sentences per chunk; row-wise, so no shuffle."""
    found = T.quotable_sentences("text", target, **lexicon)
    ranked = chunks.withColumn("_found", F.slice(found, 1, keep))
    rest = [c for c in chunks.columns if c != "text"]
    out = unnest(ranked, "_found", rest, "_q", "quote_rank")
    return out.select(*rest, (F.col("quote_rank") + 1).alias("quote_rank"), "_q.*")


def dedup_quotes(quotes: DataFrame, order: list[str], key: str = "item_id") -> DataFrame:
    """One quote per item and lower-case trimmed text, the first in ``order``."""
    marked = quotes.withColumn("_text", T.strip(F.lower("sentence")))
    return first_by([key, "_text"], F.struct(*order), marked).drop("_text")


def verify_offsets(
    quote: ColumnLike, start: ColumnLike, end: ColumnLike, text: ColumnLike
) -> Column:
    """The slice at the offsets equals the quote; without offsets, the quote is contained."""
    quote, start, end, text = col(quote), col(start), col(end), col(text)
    piece = F.substring(text, start + 1, end - start)
    return F.when((start >= 0) & (end > start), piece == quote).otherwise(text.contains(quote))


def _round(
    items: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    lexicon: dict,
) -> DataFrame:
    """One retrieval round: each hit chunk once per item, with its quotes and keywords."""
    hits = vector_topk(
        queries.select("query_id", "collection", "vector"),
        chunks.select("chunk_id", "collection", "vector"),
        k,
    )
    # a chunk keeps its best distance and the place where it was first seen
    merged = (
        hits.join(queries.select("query_id", "query_pos", "item_id"), "query_id")
        .groupBy("item_id", "chunk_id")
        .agg(
            F.min("distance").alias("distance"),
            F.min(F.struct("query_pos", "rank")).alias("_seen"),
        )
        .select("item_id", "chunk_id", "distance", "_seen.*")
    )
    order = Window.partitionBy("item_id").orderBy("distance", "query_pos", "rank")
    merged = merged.withColumn("chunk_index", F.row_number().over(order) - 1)
    read = (
        merged.join(chunks.select("chunk_id", "text"), "chunk_id")
        .join(items.select("item_id", "learning_target", "must_include"), "item_id")
        .select(
            "item_id", "chunk_id", "chunk_index", "query_pos", "rank", "distance",
            F.filter("must_include", lambda w: F.lower("text").contains(w)).alias("keywords"),
            F.slice(
                T.quotable_sentences("text", F.col("learning_target"), **lexicon), 1, PER_CHUNK
            ).alias("found"),
        )
    )
    return read


def _summary(read: DataFrame) -> DataFrame:
    """Per item: chunks read, keywords seen. Keywords per item are few (a fixed list)."""
    keywords = read.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("chunks_searched"),
        F.array_sort(F.flatten(F.collect_set("keywords"))).alias("_found"),
    )
    return keywords.withColumn("keywords_found", F.array_distinct("_found")).drop("_found")


def _quotes(read: DataFrame, round_no: int) -> DataFrame:
    keep = ["item_id", "chunk_id", "chunk_index", "query_pos", "rank", F.lit(round_no).alias("round")]
    return unnest(read, "found", keep, "_q", "quote_pos").select("*", "_q.sentence", "_q.score", "_q.start_char", "_q.end_char").drop("_q")


def two_round_quotes(
    items: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    min_quotes: int = 2,
    max_rounds: int = 2,
    k_round1: int = 10,
    k_round2: int = 25,
    persist: Callable[[DataFrame], DataFrame] = lambda df: df,
    **lexicon,
) -> tuple[DataFrame, DataFrame]:
    """Quotes per item by precise queries first, broader ones only where those fall short.

    ``items(item_id, learning_target, must_include)``,
    ``queries(query_id, query_pos, item_id, intent, collection, vector)``,
    ``chunks(chunk_id, collection, vector, text)`` -> quotes and one status row per item.
    ``persist`` may cut the plan between rounds (a checkpoint on a cluster).
    """
    items = items.withColumn("must_include", F.array_distinct(F.transform("must_include", F.lower)))
    precise = queries.filter(F.col("intent").isin("high_precision", "quote_hunt"))
    read1 = _round(items, precise, chunks, k_round1, lexicon)
    read1 = persist(read1)
    order = ["round", "query_pos", "rank", "chunk_id", "quote_pos"]
    quotes1 = dedup_quotes(_quotes(read1, 1), order)

    def state(read: DataFrame, quotes: DataFrame) -> DataFrame:
        counts = quotes.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        return (
            items.select("item_id", "must_include")
            .join(_summary(read), "item_id", "left")
            .join(counts, "item_id", "left")
            .fillna(0, ["n", "chunks_searched"])
            .withColumn("keywords_found", F.coalesce("keywords_found", T.words_array([])))
            .withColumn("keywords_missing", F.array_except("must_include", "keywords_found"))
            .drop("must_include")
        )

    state1 = persist(state(read1, quotes1))
    done = (F.col("n") >= min_quotes) & (F.size("keywords_missing") == 0)
    any_status = F.when(F.col("n") > 0, "marginal").otherwise("insufficient")
    if max_rounds < 2:
        status = state1.withColumn("status", F.when(done, "sufficient").otherwise(any_status))
        status = status.withColumn("retrieval_rounds", F.lit(1))
        final = quotes1
    else:
        open_items = state1.filter(~done).select("item_id")
        again = items.join(open_items, "item_id", "left_semi")
        read2 = _round(
            again, queries.join(open_items, "item_id", "left_semi"), chunks, k_round2, lexicon
        )
        read2 = persist(read2)
        open_quotes1 = quotes1.join(open_items, "item_id", "left_semi")
        quotes2 = dedup_quotes(open_quotes1.unionByName(_quotes(read2, 2)), order)
        # round 2 repeats the precise queries with a larger k, so it sees round 1's chunks too
        state2 = state(read2, quotes2).join(open_items, "item_id", "left_semi")
        enough = F.when(F.col("n") >= min_quotes, "sufficient").otherwise(any_status)
        status = (
            state1.filter(done)
            .withColumn("status", F.lit("sufficient"))
            .withColumn("retrieval_rounds", F.lit(1))
            .unionByName(
                state2.withColumn("status", enough).withColumn("retrieval_rounds", F.lit(2))
            )
        )
        final = quotes1.join(open_items, "item_id", "left_anti").unionByName(quotes2)
    kept = keep_best(final, order, min_quotes * 2, status)
    return kept, status.withColumnRenamed("n", "quotes_found")


def keep_best(quotes: DataFrame, order: list[str], top: int, status: DataFrame) -> DataFrame:
    """Number quotes Q1.. in discovery order; keep the best ``top`` of satisfied items."""
    seen = Window.partitionBy("item_id").orderBy(*order)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "discovered")
    return (
        quotes.withColumn("discovered", F.row_number().over(seen))
        .withColumn("quote_id", F.concat(F.lit("Q"), F.col("discovered")))
        .withColumn("place", F.row_number().over(best))
        .join(status.select("item_id", "status"), "item_id")
        .filter((F.col("status") != "sufficient") | (F.col("place") <= top))
        .drop("status")
    )


def chunks_of_quotes(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct chunks holding an item's quotes, in the order of their first quote."""
    first = quotes.groupBy("item_id", "chunk_id").agg(F.min("place").alias("first_place"))
    return first.join(chunks, "chunk_id")


# --- checking generated text --------------------------------------------------------


def check_quote(
    text: ColumnLike, quote: ColumnLike, threshold: float = 0.85, score_missing: bool = True, plain_text: ColumnLike | None = None,
) -> Column:
    """``struct<found, exact_match, match_text, similarity>`` for one quote in one text.

    Exact, then white space and punctuation aside (0.95), then fuzzy. The costly fuzzy search
    sees nulls for rows the cheap tests have settled. Without ``score_missing`` a quote that is not
    found has similarity 0, and rows without any seed of the quote are settled as well.
    ``plain_text``: the text as :func:`T.normalize_for_matching` gives it, where that is known already.
    """
    text, quote = col(text), T.strip(quote)
    exact = text.contains(quote)
    normal = T.normalize_for_matching(text) if plain_text is None else col(plain_text)
    plain = normal.contains(T.normalize_for_matching(quote))
    open_row = ~exact & ~plain
    low_quote, low_text = F.lower(quote), F.lower(text)
    if score_missing:
        fuzzy = fuzzy_similarity(F.when(open_row, low_quote), F.when(open_row, low_text))
    else:
        open_row = open_row & may_reach(low_quote, low_text, threshold)
        fuzzy = fuzzy_reach(F.when(open_row, low_quote), F.when(open_row, low_text), F.lit(float(threshold)))
    similarity = F.when(exact, 1.0).when(plain, 0.95).otherwise(fuzzy)
    found = exact | plain | (fuzzy >= threshold)
    return F.struct(
        F.coalesce(found, F.lit(False)).alias("found"),
        F.coalesce(exact, F.lit(False)).alias("exact_match"),
        F.when(exact | plain, quote).alias("match_text"),
        F.coalesce(similarity, F.lit(0.0)).alias("similarity"),
    )


def check_quote_no_fuzzy(text: ColumnLike, quote: ColumnLike, plain_text: ColumnLike | None = None) -> Column:
    """The exact and normalised steps of :func:`check_quote` only, all inside the JVM."""
    text, quote = col(text), T.strip(quote)
    exact = text.contains(quote)
    normal = T.normalize_for_matching(text) if plain_text is None else col(plain_text)
    plain = normal.contains(T.normalize_for_matching(quote))
    return F.struct(
        (exact | plain).alias("found"),
        exact.alias("exact_match"),
        F.when(exact | plain, quote).alias("match_text"),
        F.when(exact, 1.0).when(plain, 0.95).otherwise(0.0).alias("similarity"),
    )


def verify_quotes(
    texts: DataFrame, quotes: DataFrame, threshold: float = 0.85, fuzzy: bool = True
) -> DataFrame:
    """Required quotes in generated texts, one row per text.

    ``texts(item_id, generated_text, required_quote_ids)`` with a null list meaning all of the
    item's quotes; ``quotes(item_id, quote_id, text)``. Unknown ids count as missing.

    The quotes of an item travel as one array (a short list written by a plan), so a text is moved once,
    normalised once and meets all of them on its own row. Only lists of quotes that may be near go to Python.
    """
    given = quotes.groupBy("item_id").agg(F.collect_list(F.struct("quote_id", T.strip("text").alias("text"))).alias("_given"))
    rows = texts.select("item_id", "generated_text", "required_quote_ids").join(given, "item_id", "left")
    text, required = F.col("generated_text"), F.col("required_quote_ids")
    once = F.struct(  # worked out once for all quotes
        text.alias("text"), T.normalize_for_matching(text).alias("plain"), F.lower(text).alias("low"), required.alias("required"),
        (required.isNull() | (F.size(F.array_distinct(required)) == F.size(required))).alias("single"),
        F.filter("_given", lambda q: required.isNull() | F.array_contains(required, q["quote_id"])).alias("met"),
    )
    rows = rows.select("item_id", F.explode(F.array(once)).alias("_t")).select("item_id", "_t.*")

    def checked(q: Column) -> Column:
        """1 for exact, 2 for equal but for white space and punctuation, else 0."""
        times = F.when(F.col("single"), 1).otherwise(F.size(F.filter("required", lambda r: r == q["quote_id"])))
        plain = F.col("plain").contains(T.normalize_for_matching(q["text"]))
        step = F.when(F.col("text").contains(q["text"]), 1).when(plain, 2).otherwise(0)
        return F.struct(q["quote_id"].alias("quote_id"), times.alias("times"), step.alias("step"), q["text"].alias("text"))

    rows = rows.withColumn("met", F.explode(F.array(F.transform(F.coalesce("met", F.array_repeat(F.get("met", F.lit(0)), 0)), checked))))
    if fuzzy:
        needle = lambda q: F.when((q["step"] == 0) & may_reach(F.lower(q["text"]), "low", threshold), F.lower(q["text"]))
        rows = rows.withColumn("needles", F.explode(F.array(F.transform("met", needle))))
        some = F.exists("needles", lambda n: n.isNotNull())
        reach = fuzzy_reach_all(F.when(some, F.col("needles")), F.when(some, F.col("low")), F.lit(float(threshold)))
        rows = rows.select("item_id", "required", "met", reach.alias("reach"))
        near = lambda q, i: (q["step"] == 2) | F.coalesce(F.get("reach", i) >= threshold, F.lit(False))
    else:
        near = lambda q, i: q["step"] == 2
    told = F.transform("met", lambda q, i: F.struct(q["quote_id"], q["times"], F.when(near(q, i) & (q["step"] != 1), 2).otherwise(q["step"]).alias("step")))
    known = F.array_compact(F.transform("met", lambda q: q["quote_id"]))
    rows = rows.select("item_id", "required", F.explode(F.array(F.struct(told.alias("met"), known.alias("known")))).alias("_t")).select("item_id", "required", "_t.*")
    total = lambda test: F.aggregate(F.filter("met", test), F.lit(0).cast("long"), lambda s, q: s + q["times"])
    lost = F.flatten(F.transform(F.filter("met", lambda q: q["step"] == 0), lambda q: F.array_repeat(q["quote_id"], q["times"])))
    rows = rows.select(
        "item_id", total(lambda q: F.lit(True)).alias("asked"), total(lambda q: q["step"] == 1).alias("exact_match_count"),
        total(lambda q: q["step"] == 2).alias("fuzzy_match_count"), lost.alias("lost"),
        F.explode(F.array(F.filter(F.coalesce("required", T.words_array([])), lambda r: ~F.array_contains("known", r)))).alias("unknown"),
    )
    return rows.select(
        "item_id", (F.col("asked") + F.size("unknown")).alias("required_count"), "exact_match_count", "fuzzy_match_count",
        F.array_sort(F.concat("lost", "unknown")).alias("missing_quote_ids"),
    ).withColumn("all_required_found", F.size("missing_quote_ids") == 0)
