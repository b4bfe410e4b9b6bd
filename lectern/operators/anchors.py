"""Anchor quotes: choosing them, and checking that a question uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.durable import first_by


def select_anchors(
    items: DataFrame, links: DataFrame, max_anchors: int = 2, **lexicon
) -> DataFrame:
    """At most ``max_anchors`` sentences per item that cover its target terms.

    ``items(item_id, learning_target, difficulty)``,
    ``links(item_id, chunk_id, chunk_pos, text)`` -> one row per anchor.

    Chunks are taken by relevance; each gives the sentence with most terms still uncovered.
    Rather than walking an item's chunks in one group, every round finds for all items at once
    the next chunk that adds a term: a mergeable minimum per item, ``max_anchors`` times.
    """
    wanted = F.array_distinct(T.key_terms("learning_target"))
    ranked = (
        links.join(items, "item_id")
        .withColumn("score", T.relevance("text", "learning_target", "difficulty"))
        .withColumn("target_terms", wanted)
        .select(
            "item_id", "chunk_id", "chunk_pos", "score", "target_terms",
            F.transform(
                T.anchor_sentences("text", **lexicon),
                lambda s: F.struct(
                    s.alias("sentence"),
                    F.array_intersect(T.key_terms(s), wanted).alias("terms"),
                ),
            ).alias("candidates"),
        )
        .withColumn("candidates", F.filter("candidates", lambda c: F.size(c["terms"]) > 0))
        .filter(F.size("candidates") > 0)
        .withColumn("order", F.struct((-F.col("score")).alias("s"), F.col("chunk_pos").alias("p")))
        .withColumn("covered", T.words_array([]))
    )
    anchors = None
    for number in range(1, max_anchors + 1):
        gain = lambda c: F.size(F.array_except(c["terms"], F.col("covered")))
        best = F.array_max(F.transform("candidates", gain))
        pick = F.get(F.filter("candidates", lambda c: gain(c) == F.col("gain")), F.lit(0))
        chosen = first_by(
            ["item_id"], "order",
            ranked.withColumn("gain", best).filter(F.col("gain") > 0)
            .withColumn("pick", pick)
            .select("item_id", "order", "chunk_id", "chunk_pos", "score", "target_terms",
                    "pick.sentence", "pick.terms", "covered"),
        ).withColumn("anchor_no", F.lit(number))
        chosen = chosen.withColumn("now_covered", F.array_union("covered", "terms"))
        out = chosen.select(
            "item_id", "anchor_no", F.col("sentence").alias("anchor_text"), "chunk_id",
            F.col("chunk_pos").alias("chunk_index"), F.col("score").alias("relevance_score"),
            (F.size("now_covered") / F.greatest(F.size("target_terms"), F.lit(1))).alias("coverage"),
        )
        anchors = out if anchors is None else anchors.unionByName(out)
        if number < max_anchors:
            # later chunks only: everything before the chosen one added nothing
            ranked = (
                ranked.drop("covered")
                .join(
                    chosen.select(
                        "item_id", F.col("order").alias("_used"), F.col("now_covered").alias("covered"),
                        F.col("chunk_id").alias("_chunk"),
                    ),
                    "item_id",
                )
                .filter((F.col("order") > F.col("_used")) & (F.col("chunk_id") != F.col("_chunk")))
                .drop("_used", "_chunk")
            )
    return anchors


def anchor_summary(items: DataFrame, anchors: DataFrame, min_anchors: int = 1) -> DataFrame:
    """Anchor count and final coverage per item, also for items without anchors."""
    per_item = anchors.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("anchors"), F.max("coverage").alias("coverage_score")
    )
    return (
        items.select("item_id")
        .join(per_item, "item_id", "left")
        .fillna(0, ["anchors"]).fillna(0.0, ["coverage_score"])
        .withColumn("enough", F.col("anchors") >= min_anchors)
    )


def reused_phrase(anchor: ColumnLike, text: ColumnLike, least_chars: int = 15) -> Column:
    """Shortest word run (three words or more) of the anchor that stands in the text, or null.

    Any run of n + 1 words begins with a run of n, so only places where the shorter run stands are tried
    again, and longer runs only matter while those found are under ``least_chars``.
    """
    given = F.struct(T.split_words(F.lower(col(anchor))).alias("words"), F.lower(col(text)).alias("low"))
    return F.get(F.transform(F.array(given), lambda p: _phrase(p["words"], p["low"], least_chars)), F.lit(0))


def _phrase(words: Column, low: Column, least_chars: int) -> Column:
    count = F.size(words)
    run = lambda i, n: F.array_join(F.slice(words, i, n), " ")

    def longer(state: Column, n: Column) -> Column:
        starts = F.filter(state["starts"], lambda i: (i + n - 1 <= count) & low.contains(run(i, n)))
        tried = F.transform(F.array(starts), lambda s: F.struct(  # the places are worked out once
            s.alias("starts"), F.get(F.filter(F.transform(s, lambda i: run(i, n)), lambda r: F.length(r) >= least_chars), F.lit(0)).alias("phrase"),
        ))
        return F.when(state["phrase"].isNotNull() | (F.size(state["starts"]) == 0), state).otherwise(F.get(tried, F.lit(0)))

    start = F.struct(F.sequence(F.lit(1), F.greatest(count - 2, F.lit(1))).alias("starts"), F.lit(None).cast("string").alias("phrase"))
    return F.when(count >= 3, F.aggregate(F.sequence(F.lit(3), F.greatest(count, F.lit(3))), start, longer)["phrase"])


def anchor_usage(questions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Do the answer and explanation reuse anchor wording? One row per question with anchors.

    ``questions(item_id, correct_answer, explanation)``, ``anchors(item_id, anchor_text)``;
    an item has few anchors: they travel as one array, so its text is moved and lower-cased once.
    """
    few = anchors.groupBy("item_id").agg(F.collect_list("anchor_text").alias("_given"), F.count_if(F.col("anchor_text").isNull()).alias("_nulls"))
    text = F.lower(F.concat_ws(" ", "correct_answer", "explanation"))
    rows = questions.join(few, "item_id").select("item_id", "_given", "_nulls", F.explode(F.array(text)).alias("_low"))
    words = lambda a: F.struct(T.split_words(F.lower(a)).alias("words"))
    found = F.transform(F.transform("_given", words), lambda p: _phrase(p["words"], F.col("_low"), 15))
    rows = rows.select("item_id", F.explode(F.array(F.struct(F.array_compact(found).alias("p"), (F.size("_given") + F.col("_nulls")).alias("n")))).alias("_f"))
    matched = F.size("_f.p").cast("long")
    return rows.select(
        "item_id", matched.alias("matched"), (F.col("_f.n") - matched).alias("missing"), F.array_sort("_f.p").alias("phrases"),
    ).withColumn(
        "is_valid",
        (F.col("matched") >= 1)
        & (F.col("missing") <= F.floor((F.col("matched") + F.col("missing")) / 2)),
    )
