"""Request texts: one row per entity, ready for a batch model run elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col

CHUNKS_PER_REQUEST = 5
DIFFICULTY_GUIDES = {
    "beginner": "at least two clearly wrong options, none that differ by order only",
    "intermediate": "plausible options that are wrong by timing, context or a missing part",
    "advanced": "valid actions throughout that differ by order only",
}


def token_estimate(text: ColumnLike) -> Column:
    """Four characters a token."""
    return F.floor(F.length(col(text)) / 4)


def option_list(options: ColumnLike) -> Column:
    return F.array_join(F.transform(col(options), lambda o, i: F.concat(i.cast("string"), F.lit(") "), o)), "\n")


def lettered_options(options: ColumnLike) -> Column:
    return F.array_join(F.transform(col(options), lambda o, i: F.concat(F.chr(i + 65), F.lit(". "), o)), "\n")


def _pages(pages: Column, join: str = ", ") -> Column:
    listed = F.array_join(F.coalesce(pages, F.array().cast("array<int>")).cast("array<string>"), join)
    return F.when(listed == "", "N/A").otherwise(listed)


def quote_block(quotes: ColumnLike, most: int = 4) -> Column:
    """``array<struct<quote_id, text, page_numbers, section_heading>>`` -> text block."""
    line = lambda q: F.concat(
        F.lit("["), q["quote_id"], F.lit("] (p."), _pages(q["page_numbers"]), F.lit(")"),
        F.when(F.coalesce(q["section_heading"], F.lit("")) != "", F.concat(F.lit(" ["), q["section_heading"], F.lit("]"))).otherwise(""),
        F.lit(':\n"'), q["text"], F.lit('"'),
    )
    quotes = col(quotes)
    return F.when(F.coalesce(F.size(quotes), F.lit(0)) == 0, "(No anchor quotes extracted)").otherwise(
        F.array_join(F.transform(F.slice(quotes, 1, most), line), "\n\n")
    )


def anchor_block(anchors: ColumnLike) -> Column:
    line = lambda a, i: F.concat(
        F.lit("ANCHOR "), (i + 1).cast("string"), F.lit(" (p."), _pages(a["page_numbers"]), F.lit('):\n"'), a["text"], F.lit('"')
    )
    return F.array_join(F.transform(col(anchors), line), "\n\n")


def chunk_block(chunks: ColumnLike, most: int = CHUNKS_PER_REQUEST, chars: int = 500) -> Column:
    line = lambda c: F.concat(F.lit("[Source: p."), _pages(c["pages"]), F.lit("]\n"), F.substring(c["text"], 1, chars))
    return F.array_join(F.transform(F.slice(col(chunks), 1, most), line), "\n\n---\n\n")


def section_list(sections: ColumnLike, most: int = 10) -> Column:
    lines = F.transform(F.slice(F.coalesce(col(sections), T.words_array([])), 1, most), lambda s: F.concat(F.lit("- "), s))
    return F.when(F.size(lines) == 0, "(No section information available)").otherwise(F.array_join(lines, "\n"))


def plan_block() -> Column:
    """Text of a plan row, with ``quotes`` as an array column on the row."""
    quote_of = lambda s: F.get(F.filter("quotes", lambda q: q["quote_id"] == s["quote_id"]), F.lit(0))
    label = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    maybe = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", label(name, value))
    locks = F.transform(
        "decision_locks",
        lambda x, i: F.concat(
            F.lit("  Lock "), (i + 1).cast("string"), F.lit(" ("), x["lock_type"], F.lit('): "'), x["constraint_text"],
            F.lit('"\n    Eliminates: '), F.array_join(x["eliminates_options"], ", "),
        ),
    )
    evidence = F.transform(
        F.filter("support_mapping", lambda s: quote_of(s).isNotNull()),
        lambda s: F.concat(
            F.lit("  ["), s["quote_id"], F.lit("] ("), s["role"], F.lit('): "'), quote_of(s)["text"],
            F.lit('"\n    Supports: '), s["supports_claim"],
        ),
    )
    wrong = F.transform(
        "distractors",
        lambda d, i: F.concat(
            F.lit("  "), (i + 1).cast("string"), F.lit('. "'), d["text"], F.lit('"\n     Failure reason: '), d["failure_reason"],
            F.lit("\n     Stem fact violated: "), d["stem_fact_violated"],
            F.lit("\n     Why tempting: "), F.coalesce(d["plausibility_source"], F.lit("N/A")),
        ),
    )
    return F.concat_ws(
        "\n",
        label("QUESTION TYPE", F.col("question_type")),
        maybe("HAZARD CUES", F.array_join("hazard_cues", ", ")), maybe("SCENARIO", F.col("scenario_context")),
        F.when(F.size("decision_locks") > 0, F.concat(F.lit("DECISION LOCKS:\n"), F.array_join(locks, "\n"))),
        label("CORRECT ACTION", F.col("correct_action")), label("CORRECT OPTION", F.col("correct_option_text")),
        label("JUSTIFICATION", F.col("why_correct")), label("DISCRIMINATING FACTOR", F.col("discriminating_factor")),
        F.concat(F.lit("EVIDENCE:\n"), F.array_join(evidence, "\n")),
        F.concat(F.lit("DISTRACTORS:\n"), F.array_join(wrong, "\n")),
        label("STEM TYPE", F.col("stem_type")), maybe("STEM CONSTRAINTS", F.array_join("stem_constraints", ", ")),
        maybe("AVOID", F.col("out_of_scope_warning")),
    )


def exam_structure(components: ColumnLike) -> Column:
    """Readable structure of an exam's components."""
    text = lambda c: c.cast("string")
    domain = lambda d: F.concat(
        F.lit("  - "), d["name"],
        F.when(d["weight_min_pct"].isNotNull() & d["weight_max_pct"].isNotNull(), F.concat(F.lit(": "), text(d["weight_min_pct"]), F.lit("-"), text(d["weight_max_pct"]), F.lit("%")))
        .when(d["weight_pct"].isNotNull(), F.concat(F.lit(": "), text(d["weight_pct"]), F.lit("%"))).otherwise(""),
    )
    kind = lambda i: F.concat(
        F.lit("  - "), F.coalesce(i["display_name"], i["name"]), F.when(i["is_tei"], " [TEI]").otherwise(""),
        F.lit(": "), i["interaction_model"], F.lit(", "), i["grading"],
    )
    one = lambda c: F.concat_ws(
        "\n",
        F.concat(F.upper(c["name"]), F.lit(" COMPONENT")),
        F.when(c["adaptive"], F.concat(F.lit("Adaptive ("), F.coalesce(c["adaptive_algorithm"], F.lit("CAT")), F.lit("), questions "), F.coalesce(text(c["num_questions_min"]), F.lit("?")), F.lit("-"), F.coalesce(text(c["num_questions_max"]), F.lit("?"))))
        .otherwise(F.concat(F.lit("Questions: "), F.coalesce(text(c["num_questions"]), F.lit("?")))),
        F.concat(F.lit("Minutes: "), F.coalesce(text(c["time_limit_minutes"]), F.lit("?"))),
        F.when(F.size(c["domains"]) > 0, F.concat(F.lit("Domains:\n"), F.array_join(F.transform(c["domains"], domain), "\n"))),
        F.when(F.size(c["item_classes"]) > 0, F.concat(F.lit("Item types:\n"), F.array_join(F.transform(c["item_classes"], kind), "\n"))),
    )
    return F.array_join(F.transform(col(components), one), "\n\n")


def content_requests(items: DataFrame, chunks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Content request per item from its five nearest chunks.

    ``items(item_id, learning_target, difficulty, ..)``,
    ``chunks(item_id, chunk_pos, book_title, pages, text)``, ``images(item_id, place, path, description)``.
    """
    source = lambda c: F.concat(F.lit("[Source: "), c["book_title"], F.lit(", p."), _pages(c["pages"], ","), F.lit("]\n"), c["text"])
    # five chunks per item at most
    packed = (
        chunks.filter(F.col("chunk_pos") < CHUNKS_PER_REQUEST).groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_pos", "book_title", "pages", "text"))).alias("c"))
        .select("item_id", F.array_join(F.transform("c", source), "\n\n---\n\n").alias("source_chunks"))
    )
    out = items.join(packed, "item_id")
    if images is not None:
        listed = images.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "path", "description"))).alias("i")).select(
            "item_id", F.array_join(F.transform("i", lambda x: F.concat(F.lit("- "), x["path"], F.lit(": "), x["description"])), "\n").alias("_images")
        )
        out = out.join(listed, "item_id", "left")
    else:
        out = out.withColumn("_images", F.lit(None).cast("string"))
    fields = F.concat_ws(
        "\n",
        F.concat(F.lit("Learning target: "), F.col("learning_target")),
        F.concat(F.lit("Difficulty: "), F.coalesce("difficulty", F.lit("intermediate"))),
        F.lit("Sources:"), F.col("source_chunks"),
        F.concat(F.lit("Images:\n"), F.coalesce("_images", F.lit("No images available"))),
    )
    return out.select("item_id", fields.alias("request")).withColumn("tokens", token_estimate("request"))


def anchored_requests(items: DataFrame) -> DataFrame:
    """Request from ``items(item_id, learning_target, difficulty, anchors, chunks)`` rows.

    Items without anchors get none.
    """
    guide = F.create_map(*[F.lit(x) for kv in DIFFICULTY_GUIDES.items() for x in kv])
    ready = items.filter(F.size("anchors") > 0)
    return ready.select(
        "item_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Learning target: "), F.col("learning_target")),
            F.concat(F.lit("Anchors:\n"), anchor_block("anchors")),
            F.concat(F.lit("Evidence:\n"), chunk_block("chunks")),
            F.concat(F.lit("Distractors: "), F.coalesce(F.try_element_at(guide, F.col("difficulty")), F.lit(DIFFICULTY_GUIDES["intermediate"]))),
        ).alias("request"),
    ).withColumn("tokens", token_estimate("request"))


def query_requests(items: DataFrame) -> DataFrame:
    """Query-planning request for every item row (topic, subtopic, target, known sections)."""
    return items.select(
        "item_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Topic: "), F.col("topic_name")), F.concat(F.lit("Subtopic: "), F.col("subtopic_name")),
            F.concat(F.lit("Learning target: "), F.col("learning_target")),
            F.concat(F.lit("Sections:\n"), section_list("sections")),
        ).alias("request"),
    ).withColumn("tokens", token_estimate("request"))
