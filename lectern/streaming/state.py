"""Keyed state: concept registries and mastery, with timeouts that clear old keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.learner import MASTERY_CONFIDENCE, MASTERY_STREAK, MASTERY_STRENGTH
from lectern.operators.novelty import TAG_WEIGHT, TERM_WEIGHT, signatures


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _similarity(tag: str, terms: set, other_tag: str, other_terms: set) -> float:
    tags = 1.0 if tag == other_tag else _overlap(set(tag.split("_")), set(other_tag.split("_")))
    return tags * TAG_WEIGHT + _overlap(terms, other_terms) * TERM_WEIGHT


def novelty_registry(items: DataFrame, threshold: float = 0.85, keep_for: str | None = None) -> DataFrame:
    """Greedy novelty per capsule on a stream of ``(capsule_id, item_id, pos, concept_tag,
    learning_target)``.

    State holds a capsule's kept signatures. With ``keep_for`` a capsule that stays silent that
    long is forgotten; such a query looks for silent keys all the time and never runs dry.
    """
    signed = signatures(items).select("capsule_id", "item_id", "pos", "tag", "terms")
    milliseconds = keep_for and int(pd.Timedelta(keep_for).total_seconds() * 1000)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_for else GroupStateTimeout.NoTimeout

    def judge(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tags, terms = (list(v) for v in state.get) if state.exists else ([], [])
        known = [(t, set(w)) for t, w in zip(tags, terms)]
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for row in rows.itertuples():
            words = set(row.terms)
            best, best_tag = 0.0, None
            for tag, other in known:
                value = _similarity(row.tag, words, tag, other)
                if value > best:
                    best, best_tag = value, tag
            novel = best < threshold
            if novel:
                known.append((row.tag, words))
            out.append((key[0], row.item_id, novel, None if novel else best_tag, best))
        state.update(([t for t, _ in known], [sorted(w) for _, w in known]))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=["capsule_id", "item_id", "is_novel", "duplicate_of", "similarity"])

    ids = dict(items.dtypes)
    return signed.groupBy("capsule_id").applyInPandasWithState(
        judge,
        f"capsule_id {ids['capsule_id']}, item_id {ids['item_id']}, is_novel boolean, duplicate_of string, similarity double",
        "tags array<string>, terms array<array<string>>", "append", timeout,
    )


def mastery_state(reviews: DataFrame, last: int = 10) -> DataFrame:
    """Mastery per (learner, item) on a stream of ``(learner_id, item_id, ts, is_correct, confidence)``.

    State: results of the last reviews, the streak, and the last confidence.
    """
    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, streak, seen = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        confidence = None
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            recent = (recent + [bool(row.is_correct)])[-last:]
            streak = streak + 1 if row.is_correct else 0
            seen, confidence = seen + 1, float(row.confidence)
        strength = sum(recent) / len(recent)
        state.update((recent, streak, seen))
        mastered = strength >= MASTERY_STRENGTH and streak >= MASTERY_STREAK and confidence >= MASTERY_CONFIDENCE
        yield pd.DataFrame(
            [(key[0], key[1], seen, strength, streak, confidence, mastered)],
            columns=["learner_id", "item_id", "reviews", "strength", "streak", "last_confidence", "is_mastered"],
        )

    ids = dict(reviews.dtypes)
    return (
        reviews.select("learner_id", "item_id", "ts", "is_correct", F.col("confidence").cast("double").alias("confidence"))
        .groupBy("learner_id", "item_id")
        .applyInPandasWithState(
            update,
            f"learner_id {ids['learner_id']}, item_id {ids['item_id']}, reviews long, strength double, streak long,"
            " last_confidence double, is_mastered boolean",
            "recent array<boolean>, streak long, seen long", "update", GroupStateTimeout.NoTimeout,
        )
    )


class _OrderedMastery(StatefulProcessor):
    """Reviews wait in keyed state until the watermark has passed them and are counted in order then."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counted = handle.getValueState("counted", "recent array<boolean>, streak long, seen long, confidence double")
        self.waiting = handle.getListState("waiting", "at long, event_id long, is_correct boolean, confidence double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        self.waiting.appendList(list(frame[["at", "event_id", "is_correct", "confidence"]].itertuples(index=False, name=None)))
        self.handle.registerTimer(int(frame["at"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, open_rows = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if open_rows:
            self.waiting.put(open_rows)
            self.handle.registerTimer(open_rows[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if not ready:  # an earlier timer of this batch has counted them
            return
        recent, streak, seen, confidence = [], 0, 0, None
        if self.counted.exists():
            recent, streak, seen, confidence = self.counted.get()
        for _, _, right, confidence in ready:
            recent = (list(recent) + [bool(right)])[-self.last:]
            streak, seen = (streak + 1 if right else 0), seen + 1
        self.counted.update((recent, streak, seen, confidence))
        strength = sum(recent) / len(recent)
        mastered = strength >= MASTERY_STRENGTH and streak >= MASTERY_STREAK and confidence >= MASTERY_CONFIDENCE
        yield pd.DataFrame(
            [(*key, seen, strength, streak, confidence, mastered)],
            columns=["learner_id", "item_id", "reviews", "strength", "streak", "last_confidence", "is_mastered"],
        )

    def close(self) -> None:
        pass


def ordered_mastery(reviews: DataFrame, lateness: str, last: int = 10) -> DataFrame:
    """Mastery per (learner, item) by event time, ties by event id, on a stream of
    ``(learner_id, item_id, event_id, ts, is_correct, confidence)``.

    A review waits in its key's state until the watermark (``lateness`` behind the newest review) has
    passed it; then the waiting ones are counted in order and a row is given. As long as no review is later
    than that, the rows are those of :func:`lectern.operators.learner.mastery` for any cut into batches.
    Reviews without a time are left out; without a result they count as wrong, without a confidence as 0.
    Needs the RocksDB state store and the mode ``update``.
    """
    rows = reviews.filter("ts is not null").select(
        "learner_id", "item_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("event_id").cast("long").alias("event_id"), F.coalesce("is_correct", F.lit(False)).alias("is_correct"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
    )
    ids = dict(reviews.dtypes)
    return rows.withWatermark("ts", lateness).groupBy("learner_id", "item_id").transformWithStateInPandas(
        _OrderedMastery(last),
        f"learner_id {ids['learner_id']}, item_id {ids['item_id']}, reviews long, strength double, streak long,"
        " last_confidence double, is_mastered boolean",
        "Update", "EventTime",
    )
