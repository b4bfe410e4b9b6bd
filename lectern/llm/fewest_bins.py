"""Packing whole documents into as few sequences as possible: dominance reduction, then best fit.

1. Every text becomes token ids with an end id; only texts longer than a window are cut.
2. Pieces are counted by their exact length. All that follows works on these counts.
3. Martello and Toth's reduction goes through the lengths from the longest. A set of at most three
   pieces is fixed for good as a sequence of its own if it dominates every other set that the
   longest piece could stand in, that is, if some optimal packing holds it.
4. The rest is packed by best fit, the longest first, on groups of equal sequences.
5. The n-th piece of a length takes the n-th place that the plan has for the length.

Only the counts per length (one number for each length up to the window) pass through the driver;
the plan's size depends on the window, not on the number of documents, and goes to every task.

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
from lectern.llm.common import stored

WINDOW, END = 2048, 0
CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
#: A sequence's contents: (length, how many of it), the longest first.
Contents = tuple[tuple[int, int], ...]


def pieces(docs: DataFrame, path: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The pieces of all documents; ``nth`` counts those of a length within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = tokens.encoder(path, drops_space=True), TaskContext.get().partitionId(), Counter()
        end = np.asarray([END], "<u4").tobytes()
        for batch in batches:
            rows, ids = [], []
            encoded = (ids for run in tokens.batches_of(batch.column("text").to_pylist()) for ids in encoder.encode_all(run))
            for key, body in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                raw = body + end
                for number, start in enumerate(range(0, len(raw) // 4, window)):
                    one = raw[4 * start:4 * (start + window)]
                    size = len(one) // 4
                    rows.append((key, number, start, size, zlib.crc32(one), part, seen[size]))
                    seen[size] += 1
                    if with_ids:
                        ids.append(one)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.binary())] if with_ids else []), names=names + (["ids"] if with_ids else []))

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(cut, CUT + (", ids binary" if with_ids else ""))


class _Left:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int], window: int):
        self.n = np.zeros(window + 1, np.int64)
        for size, n in counts.items():
            self.n[size] = n

    def take(self, contents: Contents, times: int) -> None:
        for size, k in contents:
            self.n[size] -= k * times

    def times(self, contents: Contents) -> int:
        return min(int(self.n[size]) // k for size, k in contents)

    def fit_beside(self, size: int, window: int) -> int:
        """How many of the shortest other pieces fit beside one of ``size``; 3 stands for more."""
        room, k = window - size, 0
        for s in np.flatnonzero(self.n[:room + 1]):
            here = int(self.n[s]) - (s == size)
            fits = min(here, room // int(s))
            k, room = k + fits, room - fits * int(s)
            if k >= 3 or fits < here:
                break
        return min(k, 3)

    def largest(self, most: int, beside: Counter) -> int:
        """The longest piece of at most ``most`` besides those already chosen; 0 if there is none."""
        for s in np.flatnonzero(self.n[:max(0, most) + 1])[::-1]:
            if self.n[s] > beside[int(s)]:
                return int(s)
        return 0


def _dominant(left: _Left, size: int, window: int) -> Contents | None:
    """Contents that dominate all others with a piece of ``size``; None if no such set is known.

    One set dominates another if its pieces can stand for the other's: each for a group of them
    that is no longer than itself. Whatever packing uses the other set is then no worse after the swap.
    """
    room, fits = window - size, left.fit_beside(size, window)
    if fits == 0:
        return _contents(size)
    first = left.largest(room, Counter([size]))
    if fits == 1 or first == room:
        return _contents(size, first)
    if fits > 2:
        return None
    # At most two pieces fit beside it. The pair with the greatest sum that fits:
    best = (0, 0, 0)
    for a in np.flatnonzero(left.n[:room + 1])[::-1]:
        a = int(a)
        if left.n[a] > (a == size) and 2 * a >= best[0]:
            b = left.largest(min(a, room - a), Counter([size, a]))
            best = max(best, (a + b, a, b)) if b else best
    together, a, b = best
    if first >= together:
        return _contents(size, first)
    # The longest single piece is in the pair: only two pieces that both lie between the two could do more.
    between = np.flatnonzero(left.n[:a])
    low = [int(s) for s in between[between > b] for _ in range(min(2, int(left.n[s]) - (s == size)))][:2]
    if a == first and (len(low) < 2 or sum(low) > room):
        return _contents(size, a, b)
    return None


def _contents(*sizes: int) -> Contents:
    return tuple(sorted(Counter(sizes).items(), reverse=True))


def reduce(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[Contents, int]], dict[int, int]]:
    """(sequences that some optimal packing holds, with how often; the counts left). A set that
    dominates once does so as long as its pieces last: what is taken away only narrows the choice."""
    left, fixed = _Left(counts, window), []
    for size in range(window, 0, -1):
        while left.n[size]:
            contents = _dominant(left, size, window)
            if contents is None:
                break
            times = left.times(contents)
            left.take(contents, times)
            fixed.append((contents, times))
    return fixed, {int(s): int(left.n[s]) for s in np.flatnonzero(left.n)}


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[tuple[Contents, int]]:
    """Best fit, the longest first, on groups of sequences with equal contents. A piece goes where
    the least room is left that holds it, and so do the next of its length while they fit."""
    groups: dict[int, list[tuple[Contents, int]]] = {window: []}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        # Rooms from the tightest on; those that arise hold no more of this length.
        for room in sorted(r for r in groups if size <= r < window):
            here = groups.pop(room)
            each = room // size
            while here and n >= each:
                contents, times = here.pop()
                used = min(times, n // each)
                if used < times:
                    here.append((contents, times - used))
                groups.setdefault(room - each * size, []).append(((*contents, (size, each)), used))
                n -= used * each
            if here and n:
                contents, times = here.pop()
                groups.setdefault(room - n * size, []).append(((*contents, (size, n)), 1))
                if times > 1:
                    here.append((contents, times - 1))
                n = 0
            if here:
                groups.setdefault(room, []).extend(here)
            if not n:
                break
        if n:
            each = window // size
            for k, times in ((each, n // each), (n % each, 1)):
                if k and times:
                    groups.setdefault(window - k * size, []).append((((size, k),), times))
    return [g for here in groups.values() for g in here]


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[Contents, int]]:
    fixed, left = reduce(counts, window)
    return fixed + best_fit(left, window)


def least_bins(counts: dict[int, int], window: int = WINDOW) -> int:
    """Martello and Toth's bound: no packing has fewer sequences. For each k, pieces over window - k
    stand alone, those over half of it one to a sequence, and what their rooms can't hold of the rest
    (from k on) needs more."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes], np.int64)
    best = -(-int((sizes * n).sum()) // window) if len(sizes) else 0
    for k in [0, *(int(s) for s in sizes if 2 * s <= window)]:
        alone, half, small = sizes > window - k, (sizes <= window - k) & (2 * sizes > window), (2 * sizes <= window) & (sizes >= k)
        room = window * int(n[half].sum()) - int((sizes * n)[half].sum())
        over = int((sizes * n)[small].sum()) - room
        best = max(best, int(n[alone | half].sum()) + max(0, -(-over // window)))
    return best


def places(made: list[tuple[Contents, int]]) -> dict[int, np.ndarray]:
    """Of each length, rows (first rank, pieces in a sequence, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used, base = Counter(), 0
    for contents, times in made:
        offset = 0
        for size, k in contents:
            out.setdefault(size, []).append((used[size], k, base, offset))
            used[size] += k * times
            offset += k * size
        base += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(docs: DataFrame, path: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``with_ids`` the ids themselves."""
    cut = stored(pieces(docs, path, with_ids, doc_id, text, window))
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    where = places(plan(counts, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(parts, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[rows[0]])
                table, mine = where[size], rank[rows]
                first, k, base, start = table[np.searchsorted(table[:, 0], mine, "right") - 1].T
                sequence[rows] = base + (mine - first) // k
                offset[rows] = start + (mine - first) % k * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")
