"""Nearest chunks for query vectors, and what is done with the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import col
from lectern.operators.durable import durable, first_by

# queries up to this many bytes of vectors travel to every task at once; more go in several slices
BROADCAST_BYTES = 64 * 1024 * 1024
CELLS = 2_000_000  # distances worked out at a time
PIVOTS = 32
_SLACK = 1e-6  # distances this near the k-th, by the size of the vectors, are recomputed exactly

HITS = "query_id {q}, chunk_id {c}, distance double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if len(column) and (column.null_count or lengths["min"] != lengths["max"]):
        raise ValueError("vectors must be there and of one length")
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whole numbers as such, texts as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=object)


def tiles(queries: int, vectors: int, cells: int) -> Iterator[tuple[slice, slice]]:
    """Blocks of queries and vectors with at most ``cells`` distances, one at least."""
    side = max(1, min(queries, int(cells**0.5)))
    rows = max(1, cells // side)
    for q in range(0, queries, side):
        for v in range(0, vectors, rows):
            yield slice(q, min(q + side, queries)), slice(v, min(v + rows, vectors))


class NearestSoFar:
    """The k nearest vectors of each query among all that were shown (ties by id)."""

    def __init__(self, queries: np.ndarray, k: int, metric: str, cells: int = CELLS):
        self.k, self.metric, self.cells = k, metric, cells
        self.queries = self._unit(queries)
        self.squares = (self.queries**2).sum(axis=1)
        self.kept = np.full((len(queries), k), np.inf)  # distances in rising order
        self.names: np.ndarray | None = None  # their ids
        self.counts = np.zeros(len(queries), np.int64)
        self.worked_out = 0

    @property
    def _filled(self) -> np.ndarray:
        return np.arange(self.k) < self.counts[:, None]

    @property
    def at(self) -> np.ndarray:
        return np.nonzero(self._filled)[0]

    @property
    def distances(self) -> np.ndarray:
        return self.kept[self._filled]

    @property
    def ids(self) -> np.ndarray:
        return self.names[self._filled] if self.names is not None else np.zeros(0, object)

    def _unit(self, m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if self.metric == "cosine" else m

    def show(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Vectors are put beside their nearest pivot, some of themselves. A whole group is passed over
        for the queries that it is too far from by the triangle inequality; groups that nearly all queries
        want are compared together."""
        if self.names is None:
            self.names = np.zeros((len(self.queries), self.k), ids.dtype)
        vectors = self._unit(vectors)
        sizes = (vectors**2).sum(axis=1)
        pivots = vectors[:: max(1, len(vectors) // PIVOTS)][:PIVOTS]
        own = (sizes[:, None] - 2.0 * vectors @ pivots.T + (pivots**2).sum(axis=1)[None, :]).argmin(axis=1)
        slack = _SLACK * np.maximum(1.0, self.squares + sizes.max())
        limit = self.kept[:, -1] + slack
        together = []
        for group in np.unique(own):
            members = np.flatnonzero(own == group)
            middle = vectors[members].mean(axis=0)
            reach = float(np.sqrt(((vectors[members] - middle) ** 2).sum(axis=1).max()))
            apart = np.maximum(0.0, self.squares + (middle**2).sum() - 2.0 * self.queries @ middle - slack)
            wanted = np.flatnonzero(np.maximum(0.0, np.sqrt(apart) - reach) ** 2 <= limit)
            if len(wanted) > 0.9 * len(self.queries):
                together.append(members)
                continue
            self._compare_tiles(wanted, members, vectors, ids, slack)
        if together:
            self._compare_tiles(np.arange(len(self.queries)), np.sort(np.concatenate(together)), vectors, ids, slack)

    def _compare_tiles(self, which: np.ndarray, members: np.ndarray, vectors: np.ndarray, ids: np.ndarray, slack: np.ndarray) -> None:
        for q, v in tiles(len(which), len(members), self.cells):
            self._compare(which[q], vectors[members[v]], ids[members[v]], slack[which[q]])

    def _compare(self, which: np.ndarray, vectors: np.ndarray, ids: np.ndarray, slack: np.ndarray) -> None:
        queries = self.queries[which]
        rough = queries @ (-2.0 * vectors.T)
        rough += (vectors**2).sum(axis=1)[None, :]
        rough += self.squares[which][:, None]
        self.worked_out += rough.size
        near = rough <= (self.kept[which, -1] + slack)[:, None]
        if len(vectors) > self.k and np.count_nonzero(near) > 4 * self.k * len(which):
            near &= rough <= (np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + slack)[:, None]
        at, of = np.nonzero(near)
        if not len(at):
            return
        step = max(1, self.cells // max(1, vectors.shape[1]))
        exact = [((vectors[of[x:x + step]] - queries[at[x:x + step]]) ** 2).sum(axis=1) for x in range(0, len(at), step)]
        # only queries with a new candidate are sorted again
        rows, place = np.unique(at, return_inverse=True)
        changed = which[rows]
        old = np.arange(self.k) < self.counts[changed][:, None]
        at = np.concatenate([np.nonzero(old)[0], place])
        found = np.concatenate([self.names[changed][old], ids[of]])
        distances = np.concatenate([self.kept[changed][old], *exact])
        order = np.lexsort((found, distances, at))
        rank = np.arange(len(order)) - np.searchsorted(at[order], at[order], "left")
        best, rank = order[rank < self.k], rank[rank < self.k]
        self.kept[changed[at[best]], rank], self.names[changed[at[best]], rank] = distances[best], found[best]
        self.counts[changed] = np.bincount(at[best], minlength=len(changed))

    def hits(self, query_ids: np.ndarray, types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        far = self.distances / 2.0 if self.metric == "cosine" else self.distances
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[self.at], type=types[0]), pa.array(self.ids, type=types[1]), pa.array(far, type=pa.float64())],
            names=["query_id", "chunk_id", "distance"],
        )


def _arrow_type(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    ddl = df.schema[name].dataType.simpleString()
    return ddl, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[ddl]


def _keep_nearest(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    metric: str = "l2",
    broadcast_bytes: int = BROADCAST_BYTES,
    cells: int = CELLS,
) -> DataFrame:
    """Exact k nearest chunks of each query inside the query's own collection.

    ``queries(query_id, collection, vector)``, ``chunks(chunk_id, collection, vector)`` ->
    ``(query_id, chunk_id, distance, rank)``; squared L2 or cosine distance, ties by chunk id.

    Chunks are scanned where they lie and never shuffled. Queries go to every task, as many at a
    time as ``broadcast_bytes`` hold; if they are more, chunks are scanned once for each slice. A
    task keeps the k best hits of each query over all its chunks, working out at most ``cells``
    distances at a time, so that a hot collection is spread as its files are.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    q_ddl, q_type = _arrow_type(queries, "query_id")
    c_ddl, c_type = _arrow_type(chunks, "chunk_id")
    schema, types = HITS.format(q=q_ddl, c=c_ddl), (q_type, c_type)
    queries = queries.select("query_id", F.col("collection").cast("string"), "vector")
    chunks = chunks.select("chunk_id", F.col("collection").cast("string"), "vector")
    size = queries.agg(F.sum(F.size("vector") * 8 + 64).alias("bytes")).first()["bytes"] or 0
    slices = max(1, -(-size // max(1, broadcast_bytes)))
    if slices == 1:
        return _keep_nearest(_scan_with_queries(queries, chunks, k, metric, schema, types, cells), k)
    queries = durable(queries.withColumn("_slice", F.pmod(F.xxhash64("query_id"), F.lit(slices))))
    hits = None
    for number in range(slices):
        own = queries.filter(F.col("_slice") == number).drop("_slice")
        found = durable(_keep_nearest(_scan_with_queries(own, chunks, k, metric, schema, types, cells), k))
        hits = found if hits is None else hits.unionByName(found)
    return hits


def _scan_with_queries(queries, chunks, k, metric, schema, types, cells) -> DataFrame:
    table = queries.toArrow()  # at most a slice
    ids = _ids(table.column("query_id"))
    scopes = np.array(table.column("collection").to_pylist(), dtype=object)
    matrix = _matrix(table.column("vector"))
    groups = {s: (ids[scopes == s], matrix[scopes == s]) for s in set(scopes.tolist())}
    shared = chunks.sparkSession.sparkContext.broadcast(groups)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, NearestSoFar] = {}
        for batch in batches:
            chunk_ids = _ids(batch.column("chunk_id"))
            where = np.array(batch.column("collection").to_pylist(), dtype=object)
            vectors = _matrix(batch.column("vector"))
            for scope in set(where.tolist()) & shared.value.keys():
                if scope not in best:
                    best[scope] = NearestSoFar(shared.value[scope][1], k, metric, cells)
                here = where == scope
                best[scope].show(vectors[here], chunk_ids[here])
        for scope, found in best.items():
            yield found.hits(shared.value[scope][0], types)

    return chunks.mapInArrow(scan, schema)


def item_query_text(topic: str, subtopic: str, target: str) -> Column:
    """The retrieval text of an item."""
    return F.concat_ws(" ", col(topic), col(subtopic), col(target))


def items_without_hits(items: DataFrame, hits: DataFrame, key: str = "item_id") -> DataFrame:
    """Items for which nothing was retrieved, as failure rows."""
    return items.join(hits.select(key).distinct(), key, "left_anti").select(
        key, F.lit(False).alias("success"), F.lit("No relevant chunks found").alias("error")
    )


def merge_hits(hits: DataFrame, key: str = "item_id") -> DataFrame:
    """Hits of many queries per item: each chunk once, with its smallest distance."""
    distance = F.coalesce(F.col("distance"), F.lit(1.0))
    rest = [c for c in hits.columns if c not in (key, "chunk_id")]
    order = F.struct(distance, *[c for c in ("query_pos", "rank") if c in rest])
    return first_by([key, "chunk_id"], order, hits)


def fetch_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Source chunks by stored id: ``items(item_id, chunk_ids)`` -> one row per found chunk."""
    wanted = items.select("item_id", F.posexplode("chunk_ids").alias("chunk_pos", "chunk_id"))
    return wanted.join(chunks, "chunk_id")


def unretrievable(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Minor issue for items with source ids of which none is stored."""
    found = fetch_chunks(items, chunks.select("chunk_id")).select("item_id").distinct()
    return (
        items.filter(F.size("chunk_ids") > 0)
        .join(found, "item_id", "left_anti")
        .select(
            "item_id",
            F.lit("minor").alias("severity"),
            F.lit("source_chunks_retrievable").alias("rule_name"),
            F.lit("source_reference.chunk_ids").alias("field_path"),
            F.lit("Could not retrieve source chunks for validation").alias("description"),
        )
    )
