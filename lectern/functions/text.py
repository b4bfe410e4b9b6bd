"""Text as Column expressions: tokens, terms, sentences, similarity.

Every pattern runs with Unicode classes (``(?U)``), since the texts are in many languages.
All functions stay on the row they are given: none of them shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex

ColumnLike = Column | str

# characters that count as surrounding white space
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: ColumnLike) -> Column:
    return F.btrim(col(text), F.lit(WHITE_SPACE))


def words_array(values: Iterable[str]) -> Column:
    """A literal array of strings; typed even when empty."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def find_all(text: ColumnLike, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(text), F.lit("(?U)" + pattern), F.lit(group))


def matches(text: ColumnLike, pattern: str) -> Column:
    return col(text).rlike("(?U)" + pattern)


def contains_any(text: ColumnLike, phrases: Iterable[str]) -> Column:
    """True when any phrase is a substring; one ``contains`` per phrase, no regex."""
    text, found = col(text), F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def split_words(text: ColumnLike) -> Column:
    """Split at white space, no empty parts."""
    return F.filter(F.split(col(text), r"(?U)\s+"), lambda w: w != "")


def word_count(text: ColumnLike) -> Column:
    return F.size(split_words(text))


def long_words(text: ColumnLike, least: int = 4) -> Column:
    """Distinct lower-case words of at least ``least`` characters."""
    return F.array_distinct(find_all(F.lower(col(text)), rf"\w{{{least},}}"))


def key_terms(text: ColumnLike, stop_words: Iterable[str] = lex.KEY_TERM_STOP_WORDS) -> Column:
    """Lower-case words longer than three characters without stop words; repeats stay."""
    stop = [w for w in stop_words if len(w) > 3]
    return F.filter(find_all(F.lower(col(text)), r"\w{4,}"), lambda w: ~w.isin(stop))


def concept_terms(text: ColumnLike, stop_words: Iterable[str] = lex.CONCEPT_STOP_WORDS) -> Column:
    """Like :func:`key_terms` with the longer stop list, and pure numbers dropped."""
    return F.filter(key_terms(text, stop_words), lambda w: ~w.rlike(r"^\p{Nd}+$"))


def normalize_tag(tag: ColumnLike) -> Column:
    spaced = F.regexp_replace(F.lower(col(tag)), r"(?U)[\s\-]+", "_")
    plain = F.regexp_replace(spaced, r"[^a-z0-9_]", "")
    return F.btrim(F.regexp_replace(plain, "_+", "_"), F.lit("_"))


def jaccard(left: ColumnLike, right: ColumnLike) -> Column:
    """Share of common distinct entries; 0 if either side is empty."""
    left, right = col(left), col(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))
    )


def tag_similarity(left: ColumnLike, right: ColumnLike) -> Column:
    """1 for equal normalised tags, else Jaccard of their ``_`` parts."""
    left, right = normalize_tag(left), normalize_tag(right)
    return F.when(left == right, F.lit(1.0)).otherwise(
        jaccard(F.split(left, "_"), F.split(right, "_"))
    )


def normalize_for_matching(text: ColumnLike) -> Column:
    """One space between words, no punctuation but the apostrophe, lower case."""
    spaced = F.regexp_replace(col(text), r"(?U)\s+", " ")
    return strip(F.lower(F.regexp_replace(spaced, r"(?U)[^\w\s']", "")))


def sentences(text: ColumnLike, enders: str = ".!?") -> Column:
    """Sentences in order, trimmed, none empty."""
    parts = F.split(col(text), rf"(?U)(?<=[{enders}])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def relevance(
    chunk: ColumnLike,
    target: ColumnLike,
    difficulty: ColumnLike,
    action_verbs: Iterable[str] = lex.RELEVANCE_ACTION_VERBS,
    priority_words: Iterable[str] = lex.RELEVANCE_PRIORITY_WORDS,
) -> Column:
    """Term overlap with the target plus phrase, action and difficulty bonuses, at most 1."""
    chunk, target, difficulty = col(chunk), col(target), col(difficulty)
    low = F.lower(chunk)
    wanted = F.array_distinct(key_terms(target))
    base = F.least(
        F.size(F.array_intersect(wanted, key_terms(chunk))) / F.size(wanted), F.lit(1.0)
    )
    phrase = F.when(low.contains(F.lower(target)), 0.2).otherwise(0.0)
    action = F.when(contains_any(low, action_verbs), 0.1).otherwise(0.0)
    fit = (
        F.when((difficulty == "advanced") & contains_any(low, priority_words), 0.1)
        .when((difficulty == "beginner") & matches(low, lex.DEFINITION_PATTERN), 0.1)
        .otherwise(0.0)
    )
    return F.when(F.size(wanted) == 0, F.lit(0.5)).otherwise(
        F.least(base + phrase + action + fit, F.lit(1.0))
    )


def _usable(sentence: Column, shortest: int, longest: int, bullets: Iterable[str]) -> Column:
    ok = F.length(sentence).between(shortest, longest) & ~sentence.endswith("?")
    for bullet in bullets:
        ok = ok & ~sentence.startswith(bullet)
    return ok


def anchor_sentences(
    text: ColumnLike,
    shortest: int = 30,
    longest: int = 200,
    action_words: Iterable[str] = lex.ANCHOR_ACTION_WORDS,
    factual_pattern: str = lex.ANCHOR_FACTUAL_PATTERN,
) -> Column:
    """Sentences that can anchor an answer: an action word or a statement of fact."""
    action_words = list(action_words)

    def wanted(s: Column) -> Column:
        low = F.lower(s)
        return _usable(s, shortest, longest, ("-", "•", "*", "–")) & (
            contains_any(low, action_words) | matches(low, factual_pattern)
        )

    return F.filter(sentences(text), wanted)


def target_words(target: ColumnLike) -> Column:
    """Distinct words (four or more characters) of a learning target."""
    return F.array_except(long_words(target), words_array(lex.TARGET_STOP_WORDS))


def quotable_sentences(
    text: ColumnLike,
    target: ColumnLike | None = None,
    shortest: int = 30,
    longest: int = 200,
    action_pattern: str = lex.QUOTE_ACTION_PATTERN,
    factual_pattern: str = lex.QUOTE_FACTUAL_PATTERN,
    procedural_pattern: str = lex.QUOTE_PROCEDURAL_PATTERN,
) -> Column:
    """Scored quotable sentences, best first and in text order within a score.

    Returns ``array<struct<sentence, score, sentence_pos, start_char, end_char>>``; offsets
    point at the first place the sentence stands in the whole text.
    """
    text = col(text)
    wanted = None if target is None else target_words(target)

    def scored(s: Column, pos: Column) -> Column:
        low = F.lower(s)
        score = (
            F.when(matches(low, action_pattern), 0.3).otherwise(0.0)
            + F.when(matches(low, factual_pattern), 0.2).otherwise(0.0)
            + F.when(matches(low, procedural_pattern), 0.2).otherwise(0.0)
        )
        if wanted is not None:
            shared = F.size(F.array_intersect(wanted, split_words(low)))
            score = score + F.least(shared * F.lit(0.1), F.lit(0.3))
        return F.struct((-score).alias("neg"), pos.alias("sentence_pos"), s.alias("sentence"))

    usable = F.filter(
        F.transform(sentences(text), lambda s, i: F.struct(s.alias("s"), i.alias("i"))),
        lambda x: _usable(x["s"], shortest, longest, ("-", "*", "1.", "2.", "3.")),
    )
    ranked = F.array_sort(
        F.filter(F.transform(usable, lambda x: scored(x["s"], x["i"])), lambda x: x["neg"] < 0)
    )

    def placed(x: Column) -> Column:
        start = F.position(x["sentence"], text) - 1
        return F.struct(
            x["sentence"].alias("sentence"),
            (-x["neg"]).alias("score"),
            x["sentence_pos"].alias("sentence_pos"),
            start.alias("start_char"),
            (start + F.length(x["sentence"])).alias("end_char"),
        )

    return F.transform(ranked, placed)


def array_of_issues(*checks: tuple[Column, ColumnLike]) -> Column:
    """Texts whose condition holds, in the given order."""
    parts = [F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in checks]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def pairs_within(
    values: Column, make: Callable[[Column, Column, Column, Column], Column]
) -> Column:
    """``make(a, i, b, j)`` for every i < j of one short array (the options of one item)."""
    return F.flatten(
        F.transform(
            values,
            lambda a, i: F.transform(
                F.filter(
                    F.transform(values, lambda b, j: F.struct(b.alias("b"), j.alias("j"))),
                    lambda x: x["j"] > i,
                ),
                lambda x: make(a, i, x["b"], x["j"]),
            ),
        )
    )
