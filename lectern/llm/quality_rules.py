"""Quality rules as a short-circuit cascade, ordered on a sample by rejections per cost.

DataFrame functions only. Everything about a text is worked out on its own row; the only job
besides is the one over the sample. The order decides how much is worked out, never the verdict.

Null texts count as texts without words. Repeated rows give repeated results, other columns are
not read, an empty table gives an empty one (its rules keep their given order).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import UPPER, let, positions, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Bound of the sample that orders the rules: the first rows that a scan gives, so only as many
#: files are opened as hold them.
SAMPLE_ROWS = 500


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the same text.

    Windows are told apart by 64-bit hashes. Sorting (hash, place) puts equal windows side by
    side; their places, sorted again, give the covered words. O(n log n) for any text.
    """
    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def in_order(rows: Column) -> Column:
        twin = F.transform(rows, lambda x, k: F.when(
            F.coalesce(F.get(rows, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(rows, k + 1)["h"] == x["h"], F.lit(False)), x["i"]))
        return let(F.sort_array(F.array_compact(twin)), covered)

    def windows(found: Column) -> Column:
        rows = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(F.sort_array(rows), in_order)).otherwise(0)

    def hashed(h: Column) -> Column:
        each = F.transform(positions(F.size(h) - (window - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))
        return let(each, windows)

    return F.when(F.size(tokens) > window, let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed)).otherwise(0)


@dataclass(frozen=True)
class Rule:
    """``rejects`` over the columns of ``measured``; integers only, so that it is exact."""

    name: str
    rejects: Column | None
    sql: str


def default_rules() -> list[Rule]:
    """Cuts far from prose in any of the languages: symbols, capitals, exclamation marks, repeated lines,
    and words that are very short or very long on average."""
    texts = {
        "symbols": "10 * n_symbols > n_words",
        "shouting": "2 * n_upper > word_chars",
        "exclaiming": "5 * n_exclaim > n_words",
        "lines": "10 * n_dup_lines > 3 * n_lines",
        "long_words": "word_chars > 15 * n_words",
        "short_words": "word_chars < 2 * n_words",
    }
    return [Rule(name, None, sql) for name, sql in texts.items()]


#: What each measure costs to work out is found on the sample; this only says what to work out.
def _measures(text: Column, tokens: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(tokens), "word_chars": F.length(text) - _without(text, BLANKS),
        "n_symbols": _without(text, SYMBOLS), "n_upper": _without(text, UPPER), "n_exclaim": _without(text, "!"),
        "n_lines": F.size(lines), "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(tokens),
    }


def _condition(sql: str, measures: dict[str, Column]) -> Column:
    """The rule's text over the measures, each put in where it is named, so that a rule that isn't
    reached works nothing out."""
    left, sign, right = sql.replace(">", "|>|").replace("<", "|<|").split("|")
    def side(x: str) -> Column:
        factor, _, name = x.strip().rpartition("*")
        value = measures[name.strip()]
        return value * int(factor) if factor.strip() else value
    return side(left) > side(right) if sign == ">" else side(left) < side(right)


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second over at most ``rows`` documents.

    Each rule runs alone over the sample, so its time holds what it has to work out. Ties keep
    the given order. An empty sample keeps it, too.
    """
    taken = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).take(rows)
    local = docs.sparkSession.createDataFrame([(r["text"],) for r in taken], "text string")
    sample = local.select("text", words(F.col("text")).alias("tokens")).persist()
    try:
        if not sample.count():
            return list(rules)
        rated = []
        for at, rule in enumerate(rules):
            hit = _condition(rule.sql, _measures(F.col("text"), F.col("tokens")))
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(hit)).first()[0]
            rated.append((-rejected / (time.perf_counter() - began), at, rule))
        return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: the base measures, ``base_failed`` and ``kept``."""
    ordered = order_rules(docs, default_rules() if rules is None else rules, text)
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = whole.select("*", words(F.col("text")).alias("tokens"))
    measures = _measures(F.col("text"), F.col("tokens"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = split.select("*", *[measures[m].cast("long").alias(m) for m in base])
    known = {**measures, **{m: F.col(m) for m in base}}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = failed
    for rule in ordered:  # OR stops at the first that holds
        rejected = rejected | _condition(rule.sql, known)
    return rows.select("doc_id", *base, failed.alias("base_failed"), (~rejected).alias("kept"))
