"""Quality gates. Every gate is a Column over one item row, so the whole report is row-wise.

An item row has ``item_id, stem, correct_answer, distractors, explanation, scope_tags,
difficulty, learning_target``. A gate gives
``struct<gate_name, tier, result, message, details map<string,string>, repair_hint>``.

The report is built in three projections: :func:`prepare` lays down lower-case texts and word sets,
:func:`with_issues` each gate's list of issues, :func:`run_gates` the checks. A column that a later
projection names more than once is worked out once, so no text is lowered or split twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.unnest import unnest_structs

HARD, REPAIR, SOFT = "tier_1_hard", "tier_2_repair", "tier_3_soft"


def _details(**values: Column) -> Column:
    pairs = []
    for key, value in values.items():
        pairs += [F.lit(key), value.cast("string")]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _check(
    gate: str, tier: str, ok: Column, good: str, bad: ColumnLike,
    details: Column | None = None, hint: Column | None = None,
) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    bad = F.lit(bad) if isinstance(bad, str) else bad
    return F.struct(
        F.lit(gate).alias("gate_name"),
        F.lit(tier).alias("tier"),
        F.when(ok, "pass").otherwise("warn" if tier == SOFT else "fail").alias("result"),
        F.when(ok, F.lit(good)).otherwise(bad).alias("message"),
        (details if details is not None else _details()).alias("details"),
        F.when(~ok, hint if hint is not None else F.lit(None).cast("string")).alias("repair_hint"),
    )


def _with_issues(
    gate: str, tier: str, issues: Column, good: str, hint: Column | None = None, **more: Column
) -> Column:
    return _check(
        gate, tier, F.size(issues) == 0, good, F.array_join(issues, "; "),
        _details(issues=F.array_join(issues, "; "), issue_count=F.size(issues), **more), hint,
    )


def _has(text: Column, word: str) -> Column:
    """A whole word or phrase stands in the text; the cheap substring test spares most regexes."""
    return text.contains(word) & T.matches(text, rf"\b{word}\b")


# --- hard gates -----------------------------------------------------------------------


def quote_presence(all_found: ColumnLike, missing: ColumnLike) -> Column:
    missing = col(missing)
    return _check(
        "verbatim_quote_presence", HARD, col(all_found), "required quotes found",
        F.concat(F.lit("missing quotes: "), F.array_join(missing, ", ")),
        _details(missing_quote_ids=F.array_join(missing, ",")),
    )


def stem_answer_issues() -> Column:
    stem, distractors = F.col("_stem"), F.col("distractors")
    ending = F.col("_stem_end")
    article = F.when(ending.endswith(" an"), "an").when(ending.endswith(" a"), "a")
    vowel = lambda x: F.substring(F.lower(T.strip(x)), 1, 1).isin(list("aeiou"))
    fits = lambda x: (article == "an") == vowel(x)
    others = F.filter(distractors, lambda d: T.strip(d) != "")
    cue = article.isNotNull() & fits(F.col("correct_answer")) & ~F.exists(others, fits)
    both = F.size(F.col("_stem_answer"))
    shared = F.filter(
        F.transform(F.col("_distractor_words"), lambda d: F.size(F.array_except("_stem_answer", d))), lambda n: n > 1
    )
    negations = F.lit(0)
    for word in lex.STEM_NEGATIONS:
        negations = negations + _has(stem, word).cast("int")
    return F.concat(
        T.array_of_issues((cue, "article only matches the answer")),
        F.when(both > 1, F.transform(shared, lambda n: F.concat(F.lit("stem shares words only with the answer: "), n))).otherwise(T.words_array([])),
        T.array_of_issues((negations > 1, "several negations in stem")),
    )


def stem_answer_consistency() -> Column:
    return _with_issues("stem_answer_consistency", HARD, F.col("_leaks"), "stem does not leak the answer")


def out_of_scope(tags: ColumnLike, allowed: ColumnLike) -> Column:
    """Tags that are not allowed, repeats kept."""
    allowed = col(allowed)
    return F.filter(col(tags), lambda t: ~F.array_contains(allowed, t))


def scope_legality(allowed: ColumnLike, tags: ColumnLike = "scope_tags") -> Column:
    tags = F.coalesce(col(tags), T.words_array([]))
    outside = out_of_scope(tags, allowed)
    return _check(
        "scope_legality", HARD, (F.size(tags) > 0) & (F.size(outside) == 0), "within scope",
        F.when(F.size(tags) == 0, "no scope tags").otherwise(
            F.concat(F.lit("out of scope: "), F.array_join(outside, ", "))
        ),
        _details(out_of_scope_tags=F.array_join(outside, ",")),
    )


def single_best_issues() -> Column:
    low, plain = F.col("_text"), F.col("_options")
    equal = F.filter(
        T.pairs_within(
            plain,
            lambda a, i, b, j: F.when(a == b, F.concat(F.lit("equal options "), i, F.lit(" and "), j)),
        ),
        lambda x: x.isNotNull(),
    )
    opposed = F.lit(False)
    for affirm, negate in lex.EXPLANATION_OPPOSITES:
        opposed = opposed | (_has(low, affirm) & _has(low, negate))
    return F.concat(
        F.when(F.size(plain) > F.size(F.array_distinct(plain)), equal).otherwise(T.words_array([])),
        T.array_of_issues(
            (T.contains_any(low, ("also", "another valid", "either ")) & T.matches(low, lex.ALSO_CORRECT_PATTERN), "explanation allows several answers"),
            (opposed, "explanation contains opposed statements"),
        ),
    )


def single_best_answer() -> Column:
    return _with_issues("single_best_answer", HARD, F.col("_several"), "one defensible answer")


def alignment_words(text: ColumnLike) -> Column:
    return F.array_except(T.long_words(text), T.words_array(lex.ALIGNMENT_STOP_WORDS))


def alignment_issues() -> Column:
    target, low_stem, wanted = F.col("_target"), F.col("_stem"), F.col("_wanted")
    size = F.size(wanted)
    share = lambda words: F.size(F.array_intersect(wanted, words)) / size
    shifts = [
        (
            low_stem.contains(word) & ~target.contains(word) & ~target.contains(category),
            f"stem mentions {word} ({category})",
        )
        for word, category in lex.TOPIC_CATEGORIES.items()
    ]
    first = T.matches(low_stem, lex.FIRST_ACTION_PATTERN) & ~T.contains_any(target, lex.PRIORITY_TARGET_WORDS)
    issues = T.array_of_issues(
        (share(F.array_union("_stem_words", "_answer_words")) < 0.25, "too few target terms in stem and answer"),
        (share(F.col("_text_words")) < 0.2, "explanation lacks target terms"),
        *shifts,
        (first, "asks for a first action the target does not name"),
    )
    return F.when(size < 2, T.words_array([])).otherwise(issues)


def learning_target_alignment() -> Column:
    return _with_issues("learning_target_alignment", HARD, F.col("_drifts"), "aligned with the learning target")


def contradictions() -> Column:
    stem, answer, low = F.col("_stem"), F.col("_answer"), F.col("_text")
    same_topic = F.col("_same_topic")
    checks = [
        (
            _has(answer, a) & _has(low, b) & same_topic,
            f"explanation may contradict the answer ({a} / {b})",
        )
        for a, b in lex.ANSWER_OPPOSITES
    ]
    checks += [
        (_has(stem, "never") & _has(low, "always"), "stem never, explanation always"),
        (_has(stem, "always") & _has(low, "never"), "stem always, explanation never"),
    ]
    procedure = F.lit(False)
    for a, b in lex.PROCEDURE_OPPOSITES:
        starts = low.contains(a.split(".")[0]) & low.contains(b.split(".")[0])
        procedure = procedure | (starts & T.matches(low, a) & T.matches(low, b))
    checks.append((procedure, "contradictory procedure"))
    checks.append((
        T.contains_any(low, ("should not", "must not", "never", "incorrect")) & T.matches(low, lex.HOWEVER_PATTERN)
        & T.matches(F.substring(low, 1, 100), lex.MAIN_CLAIM_PATTERN),
        "clause contradicts the main claim",
    ))
    return T.array_of_issues(*checks)


def internal_consistency() -> Column:
    return _with_issues("internal_consistency", HARD, F.col("_contradictions"), "no contradictions")


# --- repair gates ----------------------------------------------------------------------


def distractor_issues(distractors: ColumnLike, answer: ColumnLike) -> Column:
    """``array<struct<issue, hint>>``."""
    answer = col(answer)
    first3 = lambda x: F.slice(T.split_words(F.lower(x)), 1, 3)

    def of_one(d: Column, i: Column) -> Column:
        name = F.concat(F.lit("distractor "), i + 1)
        issue = lambda cond, what, fix: F.when(
            cond,
            F.struct(F.concat(name, F.lit(what)).alias("issue"), F.concat(F.lit(fix), name).alias("hint")),
        )
        same_start = (
            (F.length(d) > 10) & (F.length(answer) > 10)
            & (first3(d) == first3(answer)) & (F.size(first3(d)) >= 2)
        )
        found = F.array(
            issue(F.length(T.strip(d)) < 5, " too short", "expand "),
            issue(T.contains_any(F.lower(d), lex.META_OPTIONS), " is a meta option", "give specific content to "),
            issue(same_start, " starts like the answer", "vary the start of "),
        )
        return F.filter(found, lambda x: x.isNotNull())

    return F.flatten(F.transform(col(distractors), of_one))


def distractor_quality() -> Column:
    found = F.col("_weak")
    issues = F.transform(found, lambda x: x["issue"])
    hints = F.array_join(F.transform(found, lambda x: x["hint"]), "; ")
    return _with_issues("distractor_quality", REPAIR, issues, "distractors are plausible", hints)


def levels_off(actual: ColumnLike, target: ColumnLike) -> Column:
    level = F.create_map(*[F.lit(x) for kv in lex.DIFFICULTY_LEVELS.items() for x in kv])
    of = lambda c: F.coalesce(F.try_element_at(level, col(c)), F.lit(2))
    return F.abs(of(target) - of(actual))


def difficulty_alignment(target: ColumnLike, actual: ColumnLike = "difficulty") -> Column:
    actual, target = F.coalesce(col(actual), F.lit("medium")), col(target)
    off = levels_off(actual, target)
    return _check(
        "difficulty_alignment", REPAIR, actual == target, "difficulty matches",
        F.concat_ws(" ", F.lit("target"), target, F.lit("actual"), actual),
        _details(target=target, actual=actual, levels_off=off),
        F.concat(
            F.when(off == 1, "adjust complexity to ").otherwise("large change needed to reach "), target
        ),
    )


def decision_grounding(has_quotes: ColumnLike) -> Column:
    refs = F.col("_refs")
    unreferenced = (F.size(refs) == 0) & col(has_quotes)
    longer = lambda words: F.filter(words, lambda w: F.length(w) >= 5)
    wanted = F.col("_long_answer")
    apart = (F.size(wanted) > 0) & (F.size(F.array_intersect(wanted, longer(F.col("_text_words")))) / F.size(wanted) < 0.3)
    return _check(
        "decision_grounding", REPAIR, ~unreferenced & ~F.coalesce(apart, F.lit(False)),
        "explanation grounds the decision",
        F.when(unreferenced, "no quote references").otherwise("answer terms missing from explanation"),
        _details(quote_refs=F.array_join(refs, ",")),
        F.when(unreferenced, "add quote references").otherwise("explain the answer by the source"),
    )


# --- soft gates -------------------------------------------------------------------------


def novelty(similarity: ColumnLike, similar_item: ColumnLike) -> Column:
    """From :func:`lectern.operators.novelty.soft_novelty` columns (null when novel)."""
    similarity = col(similarity)
    return _check(
        "novelty", SOFT, similarity.isNull(), "novel", "too similar to an earlier item",
        _details(similarity=similarity, similar_item_id=col(similar_item)),
    )


def verbosity(least: int = 20, most: int = 150) -> Column:
    count = F.col("_n_words")
    return _check(
        "verbosity", SOFT, count.between(least, most), "length fits",
        F.when(count < least, "explanation too brief").otherwise("explanation too long"),
        _details(word_count=count),
    )


def style_issues() -> Column:
    ending = F.col("_stem_end")
    return T.array_of_issues(
        (~(ending.endswith("?") | ending.endswith(":") | ending.endswith(".")), "stem lacks end punctuation"),
        (T.matches("_text", lex.INFORMAL_PATTERN), "informal language"),
        (F.col("explanation").rlike(lex.EMOJI_PATTERN), "emoji"),
    )


def style() -> Column:
    return _with_issues("style", SOFT, F.col("_style"), "style follows conventions")


# --- report -------------------------------------------------------------------------------


def prepare(items: DataFrame) -> DataFrame:
    """Lower-case texts, then word sets, one column each."""
    lowered = items.withColumns({
        "_stem": F.lower("stem"), "_answer": F.lower("correct_answer"), "_text": F.lower("explanation"), "_target": F.lower("learning_target"),
        "_stem_words": T.long_words("stem"), "_answer_words": T.long_words("correct_answer"), "_text_words": T.long_words("explanation"),
        "_distractor_words": F.transform("distractors", lambda d: T.long_words(d)), "_wanted": alignment_words("learning_target"),
        "_options": F.transform(F.concat(F.array("correct_answer"), "distractors"), lambda o: T.strip(F.regexp_replace(F.lower(o), r"(?U)[^\w\s]", ""))),
        "_refs": F.regexp_extract_all("explanation", F.lit(r"\[Q\d+\]"), F.lit(0)), "_n_words": T.word_count("explanation"),
    })
    return lowered.withColumns({
        "_stem_end": T.strip("_stem"), "_stem_answer": F.array_intersect("_stem_words", "_answer_words"),
        "_long_answer": F.filter("_answer_words", lambda w: F.length(w) >= 5), "_same_topic": F.exists("_answer_words", lambda w: F.col("_text").contains(w)),
    })


def with_issues(prepared: DataFrame) -> DataFrame:
    return prepared.withColumns({
        "_leaks": stem_answer_issues(), "_several": single_best_issues(), "_contradictions": contradictions(), "_drifts": alignment_issues(),
        "_weak": distractor_issues("distractors", "correct_answer"), "_style": style_issues(),
    })


def run_gates(
    items: DataFrame,
    allowed_tags: list[str] | ColumnLike,
    target_difficulty: str = "medium",
    with_quotes: bool = False,
    with_novelty: bool = False,
) -> DataFrame:
    """Add ``checks`` to each item row.

    With ``with_quotes`` the rows carry ``all_required_found, missing_quote_ids, has_quotes``
    (see ``quotes.verify_quotes``); with ``with_novelty`` they carry
    ``similarity, similar_item_id``.
    """
    allowed = T.words_array(allowed_tags) if isinstance(allowed_tags, list) else col(allowed_tags)
    has_quotes = F.col("has_quotes") if with_quotes else F.lit(False)
    checks = []
    if with_quotes:
        checks.append(quote_presence("all_required_found", "missing_quote_ids"))
    checks += [stem_answer_consistency(), scope_legality(allowed), single_best_answer(), internal_consistency()]
    aligned = learning_target_alignment()
    checks.append(F.when(F.coalesce("learning_target", F.lit("")) != "", aligned))
    checks += [distractor_quality(), difficulty_alignment(F.lit(target_difficulty)), decision_grounding(has_quotes)]
    if with_novelty:
        checks.append(novelty("similarity", "similar_item_id"))
    checks += [verbosity(), style()]
    rows = with_issues(prepare(items)).withColumn("checks", F.filter(F.array(*checks), lambda c: c.isNotNull()))
    return rows.select(*items.columns, "checks")


def gates_long(gated: DataFrame) -> DataFrame:
    """One row per item and check."""
    return unnest_structs(gated, "checks", ["item_id"])


def _names(test) -> Column:
    return F.transform(F.filter("checks", test), lambda c: c["gate_name"])


def gate_report(gated: DataFrame) -> DataFrame:
    """One report row per item, computed in place."""
    passed = lambda tier: F.forall(
        "checks", lambda c: (c["tier"] != tier) | (c["result"] == "pass")
    )
    hints = F.filter(
        "checks",
        lambda c: (c["tier"] == REPAIR) & (c["result"] == "fail") & (F.coalesce(c["repair_hint"], F.lit("")) != ""),
    )
    return (
        gated.withColumn("tier_1_passed", passed(HARD))
        .withColumn("tier_2_passed", passed(REPAIR))
        .withColumn("tier_3_flags", _names(lambda c: (c["tier"] == SOFT) & (c["result"] == "warn")))
        .withColumn("repair_targets", _names(lambda c: (c["tier"] == REPAIR) & (c["result"] == "fail")))
        .withColumn("overall_pass", F.col("tier_1_passed"))
        .withColumn("requires_repair", F.col("tier_1_passed") & ~F.col("tier_2_passed"))
        .withColumn(
            "repair_hints",
            F.map_from_entries(F.transform(hints, lambda c: F.struct(c["gate_name"], c["repair_hint"]))),
        )
    )
