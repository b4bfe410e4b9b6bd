"""Packing documents into training sequences by non-negative least squares.

1. Every text becomes token ids with an end id and is cut into whole windows and a rest.
2. Lengths are counted in classes of ``UNIT`` tokens, rounded up.
3. Combinations of up to three classes that fill a window are enumerated, and non-negative least
   squares finds how often each is to be used; the counts are rounded down.
4. What is left is packed greedily, the largest class first, on the counts alone.
5. The n-th piece of a class takes the n-th place that the combinations have for the class.

Only the counts per class (256 numbers) and the list of places (thousands at most, by the number
of classes, not of documents) pass through the driver.

Null and empty texts are just the end id. Repeated rows and rows with a null id are packed like
any others, each on its own. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import rows_per_batch, stored

WINDOW, UNIT, DEPTH, END = 2048, 8, 3, 1
#: What a worker holds at once: rows of a batch, characters of a run, words of a generation. As the pipeline's last
#: stage it shares its executor with all that the stages before have left there, so this is little.
ROWS, CHARS, KEPT = 1000, 1_000_000, 100_000
CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, class int, nth long"


def pieces(docs: DataFrame, path: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents; ``nth`` counts those of a class within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = tokens.encoder(path, drops_space=True, kept=KEPT), TaskContext.get().partitionId(), Counter()
        end = np.asarray([END], "<u4").tobytes()
        for batch in batches:
            rows, ids = [], []
            encoded = (ids for run in tokens.batches_of(batch.column("text").to_pylist(), CHARS) for ids in encoder.encode_all(run))
            for key, body in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                raw = body + end
                total = len(raw) // 4
                for start in range(0, total, WINDOW):
                    one = raw[4 * start:4 * (start + WINDOW)]
                    size = len(one) // 4
                    kind = -(-size // UNIT)
                    rows.append((key, start, size, zlib.crc32(one), total, part, kind, seen[kind]))
                    seen[kind] += 1
                    if with_ids:
                        ids.append(one)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "nth"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.binary())] if with_ids else []), names=names + (["ids"] if with_ids else []))

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(cut, CUT + (", ids binary" if with_ids else ""))


def combinations(full: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Falling classes, at most ``depth``, that add up to ``full``."""
    out: list[tuple[int, ...]] = []

    def grow(taken: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            out.append(taken)
        elif len(taken) == depth - 1:
            if rest <= (taken[-1] if taken else rest):
                out.append((*taken, rest))
        else:
            for c in range(min(taken[-1] if taken else rest, rest), 0, -1):
                grow((*taken, c), rest - c)

    grow((), full)
    return out


def non_negative_least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Active-set method: the column with the steepest gain enters, those driven below zero leave."""
    n = matrix.shape[1]
    rows = np.ascontiguousarray(matrix.T)
    x, inside = np.zeros(n), np.zeros(n, bool)
    ridge, slack = 1e-9, 1e-6 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * matrix.shape[0]):
        gain = rows @ (target - x[inside] @ rows[inside])
        gain[inside] = -np.inf
        enter = int(np.argmax(gain))
        if gain[enter] <= slack:
            break
        inside[enter] = True
        while True:
            at = np.flatnonzero(inside)
            own = rows[at]
            best = np.linalg.solve(own @ own.T + ridge * np.eye(len(at)), own @ target)
            if (best > slack).all():
                x[:] = 0
                x[at] = best
                break
            bad = best <= slack
            drop = x[at][bad] - best[bad]
            step = float(np.min(np.where(drop > 0, x[at][bad] / np.where(drop > 0, drop, 1), 0)))
            x[at] += step * (best - x[at])
            leave = at[bad & (x[at] <= slack)]
            leave = leave if len(leave) else at[[int(np.argmin(best))]]
            x[leave] = 0
            inside[leave] = False
            if not inside.any():
                break
    return x


def plan(counts: dict[int, int], full: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a sequence, how many such sequences); every counted piece has exactly one place."""
    left = Counter({c: n for c, n in counts.items() if n})
    made: list[tuple[tuple[int, ...], int]] = []

    def use(classes: tuple[int, ...], most: int) -> int:
        times = min([most, *(left[c] // k for c, k in Counter(classes).items())])
        if times > 0:
            made.append((classes, times))
            for c in classes:
                left[c] -= times
        return times

    use((full,), left[full])
    ways = [w for w in combinations(full) if len(w) > 1 and all(left[c] for c in w)]
    if ways:
        present = sorted({c for w in ways for c in w})
        row = {c: i for i, c in enumerate(present)}
        matrix = np.zeros((len(present), len(ways)))
        for j, w in enumerate(ways):
            for c in w:
                matrix[row[c], j] += 1
        times = non_negative_least_squares(matrix, np.array([left[c] for c in present], float))
        for j in np.argsort(-times):
            if times[j] >= 1:
                use(ways[j], int(times[j] + 1e-6))
    while any(left.values()):
        room, chosen, spare = full, [], Counter(left)
        while True:
            fits = max((c for c, n in spare.items() if n and c <= room), default=0)
            if not fits:
                break
            chosen.append(fits)
            spare[fits] -= 1
            room -= fits
        use(tuple(chosen), sum(left.values()))
    return made


def places(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, slot): ranks of a class in order of use."""
    used, base, out = Counter(), 0, []
    for classes, times in made:
        for slot, c in enumerate(classes):
            out.append((c, used[c], used[c] + times, base, slot))
            used[c] += times
        base += times
    return out


def pack(docs: DataFrame, path: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with ``with_ids`` the ids themselves."""
    spark = docs.sparkSession
    with rows_per_batch(spark, ROWS):
        cut = stored(pieces(docs, path, with_ids, doc_id, text))
    counts = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}  # one row per class
    rows = places(plan(counts, WINDOW // UNIT))
    where = spark.createDataFrame(rows, "class int, low long, high long, base long, slot int")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("class", "part").agg(F.count("*").alias("n")).select(
        "class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(parts, ["class", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    # The places are bounded by the number of classes, so they may be sent to every executor.
    placed = ranked.join(F.broadcast(where), (ranked["class"] == where["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("low"))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *(["ids"] if with_ids else []))
