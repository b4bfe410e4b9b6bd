"""Distractor sets: balance, suggestions, review, reply ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import replies as R
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.ambiguity import similar_pairs


def _by_difficulty(difficulty: ColumnLike, pick) -> Column:
    """``pick(rule)`` of the row's difficulty; unknown ones use intermediate."""
    difficulty, out = col(difficulty), pick(lex.DISTRACTOR_RULES["intermediate"])
    for name, rule in lex.DISTRACTOR_RULES.items():
        if name != "intermediate":
            out = F.when(difficulty == name, pick(rule)).otherwise(out)
    return out


def balance_issues(patterns: ColumnLike, difficulty: ColumnLike) -> Column:
    """Issues of a distractor set's wrongness patterns; empty when balanced."""
    patterns, difficulty = col(patterns), col(difficulty)
    clear = F.size(F.filter(patterns, lambda p: p.isin(list(lex.CLEARLY_WRONG_PATTERNS))))
    least = _by_difficulty(difficulty, lambda r: F.lit(r[0]))
    banned = _by_difficulty(difficulty, lambda r: T.words_array(r[2]))
    other = F.size(F.filter(patterns, lambda p: p != "wrong_sequence"))
    return F.concat(
        T.array_of_issues((clear < least, F.concat(F.lit("Need "), least, F.lit(" clearly wrong, have "), clear))),
        F.transform(
            F.filter(patterns, lambda p: F.array_contains(banned, p)),
            lambda p: F.concat(F.lit("Forbidden pattern used: "), p),
        ),
        T.array_of_issues((
            (difficulty == "advanced") & (other > 0),
            F.concat(F.lit("Advanced has "), other, F.lit(" non-sequence distractors")),
        )),
    )


def suggest_patterns(answer: ColumnLike, stem: ColumnLike, difficulty: ColumnLike, most: int = 4) -> Column:
    """First suggestions as ``array<struct<pattern, hint>>`` from cues in answer and stem."""
    answer, stem = F.lower(col(answer)), F.lower(col(stem))
    allowed = _by_difficulty(difficulty, lambda r: T.words_array(r[1]))
    either = lambda words: T.contains_any(answer, words) | T.contains_any(stem, words)

    def suggestion(cond: Column, pattern: str, hint: str) -> Column:
        return F.when(
            cond & F.array_contains(allowed, pattern),
            F.struct(F.lit(pattern).alias("pattern"), F.lit(hint).alias("hint")),
        )

    safety = either(lex.SAFETY_CUES)
    rows = [suggestion(either(lex.SEQUENCE_CUES), "wrong_sequence", "another valid action first")]
    for verb in lex.SUGGESTION_VERBS:
        rows.append(suggestion(answer.contains(verb), "incomplete", f"{verb}, missing a key part"))
        rows.append(suggestion(answer.contains(verb), "wrong_context", f"{verb}, in the wrong situation"))
    rows.append(suggestion(safety, "violates_protocol", "skips a safety step"))
    rows.append(suggestion(safety, "common_misconception", "common but wrong safety belief"))
    return F.slice(F.filter(F.array(*rows), lambda x: x.isNotNull()), 1, most)


def review_issues(options: ColumnLike, correct_index: ColumnLike, difficulty: ColumnLike) -> Column:
    """Heuristic review of existing options."""
    options, difficulty = col(options), col(difficulty)
    wrong = F.transform(
        F.filter(
            F.transform(options, lambda o, i: F.struct(i.alias("i"), o.alias("o"))),
            lambda x: x["i"] != col(correct_index),
        ),
        lambda x: x["o"],
    )
    cartoonish = F.filter(wrong, lambda d: F.lower(d).rlike(lex.CARTOONISH_PATTERN))
    advanced = difficulty == "advanced"
    return F.concat(
        F.when(
            advanced, F.transform(cartoonish, lambda d: F.concat(F.lit("Remove cartoonish distractor: "), F.substring(d, 1, 50)))
        ).otherwise(T.words_array([])),
        T.array_of_issues(
            ((difficulty == "beginner") & (F.size(cartoonish) < 2), "Beginner needs 2+ clearly wrong distractors"),
            (advanced & (F.size(cartoonish) > 0), "Advanced should not have clearly wrong distractors"),
        ),
        F.transform(
            similar_pairs(wrong),
            lambda p: F.concat(F.lit("Distractors too similar: "), p["i"], F.lit(" and "), p["j"]),
        ),
    )


REPLY = "distractors array<struct<text string, pattern string, explanation string, plausibility double>>"


def ingest_distractors(replies: DataFrame) -> DataFrame:
    """``replies(item_id, difficulty, reply)`` -> the distractor set with its balance issues."""
    rows = replies.withColumn("r", R.read_as("reply", REPLY)).withColumn("ok", R.is_object("reply"))
    clean = F.transform(
        F.coalesce("r.distractors", F.expr("cast(array() as array<struct<text:string,pattern:string,explanation:string,plausibility:double>>)")),
        lambda d: F.struct(
            R.default_text(d["text"]).alias("text"),
            R.one_of(d["pattern"], lex.WRONGNESS_PATTERNS, "incomplete").alias("pattern"),
            R.default_text(d["explanation"]).alias("explanation"),
            F.coalesce(d["plausibility"], F.lit(0.5)).alias("plausibility"),
        ),
    )
    found = rows.withColumn("distractors", clean)
    issues = F.array_join(balance_issues(F.transform("distractors", lambda d: d["pattern"]), "difficulty"), "; ")
    return found.select(
        "item_id", "difficulty", F.col("ok").alias("success"), "distractors",
        F.when(F.col("ok"), issues).otherwise("Generation failed").alias("balance_check"),
    )
