"""Token ids in files: a wavelet matrix per shard, with access, counting and occurrence lookup.

A shard is a run of documents in ascending order of their ids. Its tokens lie in segments of at most
``SEGMENT`` tokens. A segment keeps one plane of bits per bit of the ids, the highest first; below
each plane, tokens with a 0 come before those with a 1, in order. Ones are counted up to every
``STEP`` bits. Planes and counts are compressed each on its own, so a reader fetches what it needs.

    "WAVELET1" | compressed blocks | compressed JSON: segments, documents | its length (8 bytes) | "WAVELET1"

Null and empty texts are just the end id. Null ids come first; rows that repeat an id lie side by
side. Other columns are not read. An empty table makes no shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import scratch, stored

MAGIC, SEGMENT, STEP, END = b"WAVELET1", 1 << 21, 512, 2
MANIFEST = "shard long, path string, n_docs long, n_tokens long"


class WaveletMatrix:
    """Bit planes (packed, highest first), the zeros of each, and ones before every STEP bits."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ones = n, planes, zeros, ones

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        now, planes, zeros, ones = ids.astype(np.uint16 if width <= 16 else np.uint32), [], [], []
        for level in range(width - 1, -1, -1):
            bit = (now >> level) & 1 == 1
            packed = np.packbits(bit)
            planes.append(packed)
            ones.append(_directory(packed))
            low = now[~bit]
            zeros.append(len(low))
            now = np.concatenate([low, now[bit]])
        return cls(len(ids), planes, zeros, ones)

    def _rank1(self, level: int, i: int) -> int:
        block = i // STEP
        span = self.planes[level][block * STEP // 8:(i + 7) // 8]
        return int(self.ones[level][block]) + int(np.unpackbits(span)[: i - block * STEP].sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        at = np.arange(len(self.ones[level]), dtype=np.int64) * STEP
        before = self.ones[level] if bit else at - self.ones[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        span = np.unpackbits(self.planes[level][block * STEP // 8:(block + 1) * STEP // 8])
        return block * STEP + int(np.flatnonzero(span == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = (int(self.planes[level][i // 8]) >> (7 - i % 8)) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = 2 * value + bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if (token >> (len(self.planes) - 1 - level)) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the token stands in [start, end)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        at = self._range(token, 0, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            if (token >> (len(self.planes) - 1 - level)) & 1:
                at = self._select(level, 1, at - self.zeros[level])
            else:
                at = self._select(level, 0, at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty_like(now)
            above[~bit] = now[: self.zeros[level]]
            above[bit] = now[self.zeros[level]:] | now.dtype.type(1 << (len(self.planes) - 1 - level))
            now = above
        return now.astype("<u4")


def _directory(packed: np.ndarray) -> np.ndarray:
    per = np.bitwise_count(packed).astype(np.int64)
    starts = np.arange(0, max(1, len(per)), STEP // 8)
    sums = np.add.reduceat(per, starts) if len(per) else np.zeros(1, np.int64)
    return np.concatenate([[0], np.cumsum(sums)])


class ShardWriter:
    def __init__(self, stream):
        self.stream, self.codec, self.at, self.segments, self.docs = stream, pa.Codec("zstd"), 0, [], []
        self._write(MAGIC)
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def _write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, data: bytes) -> list[int]:
        start = self.at
        return [start, self._write(self.codec.compress(data, asbytes=True)), len(data)]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.total += len(ids) // 4
        for i in range(0, len(ids), 4 * SEGMENT):
            part = ids[i:i + 4 * SEGMENT]
            if self.held + len(part) // 4 > SEGMENT:
                self._flush()
            self.waiting.append(part)
            self.held += len(part) // 4

    def _flush(self) -> None:
        if not self.held:
            return
        matrix = WaveletMatrix.of(np.frombuffer(b"".join(self.waiting), "<u4"))
        blocks = [(self._block(p.tobytes()), self._block(o.astype("<u4").tobytes())) for p, o in zip(matrix.planes, matrix.ones, strict=True)]
        self.segments.append({"n": matrix.n, "zeros": matrix.zeros, "planes": [b[0] for b in blocks], "ones": [b[1] for b in blocks]})
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self._flush()
        ids, sizes = zip(*self.docs, strict=True) if self.docs else ((), ())
        place = self._block(json.dumps({"segments": self.segments, "doc_ids": ids, "sizes": sizes}).encode())
        self._write(np.asarray(place, "<u8").tobytes() + MAGIC)


class Shard:
    """A shard file, opened anywhere that pyarrow can reach."""

    def __init__(self, path: str):
        system, name = _system(path)
        self.file, self.codec = system.open_input_file(name), pa.Codec("zstd")
        size = self.file.size()
        tail = self.file.read_at(32, size - 32)
        if tail[24:] != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        head = json.loads(self._block(np.frombuffer(tail[:24], "<u8").tolist()))
        self.segments, self.doc_ids, self.sizes = head["segments"], head["doc_ids"], head["sizes"]
        self.starts = np.concatenate([[0], np.cumsum([s["n"] for s in self.segments])]).astype(np.int64)

    def _block(self, place: list[int]) -> bytes:
        start, stored_, size = (int(x) for x in place)
        return self.codec.decompress(self.file.read_at(stored_, start), size, asbytes=True)

    def segment(self, k: int) -> WaveletMatrix:
        s = self.segments[k]
        planes = [np.frombuffer(self._block(p), np.uint8) for p in s["planes"]]
        return WaveletMatrix(s["n"], planes, s["zeros"], [np.frombuffer(self._block(o), "<u4").astype(np.int64) for o in s["ones"]])

    def access(self, i: int) -> int:
        k = int(np.searchsorted(self.starts, i, "right")) - 1
        return self.segment(k).access(i - int(self.starts[k]))

    def count(self, token: int) -> int:
        return sum(self.segment(k).count(token) for k in range(len(self.segments)))

    def occurrences(self, token: int) -> Iterator[int]:
        for k in range(len(self.segments)):
            matrix = self.segment(k)
            for i in range(matrix.count(token)):
                yield int(self.starts[k]) + matrix.select(token, i)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in order, one segment in memory at a time."""
        held, k = b"", 0
        at = 0
        for key, size in zip(self.doc_ids, self.sizes, strict=True):
            parts, need = [], 4 * size
            while need:
                if at == len(held):
                    held, at, k = self.segment(k).tokens().tobytes(), 0, k + 1
                part = held[at:at + need]
                at, need = at + len(part), need - len(part)
                parts.append(part)
            yield key, b"".join(parts)


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def write_shards(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes one file per range of ids and returns what was written: shard, path, n_docs,
    n_tokens. A task that is run again writes a file of another name; only the files named in the
    result count."""
    folder = folder.replace("file:///", "file:/").replace("file:/", "file:///")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, writer = TaskContext.get(), tokens.encoder(path, drops_space=False), None
        end = np.asarray([END], "<u4").tobytes()
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.wm"
        for batch in batches:
            encoded = (ids for run in tokens.batches_of(batch.column("text").to_pylist()) for ids in encoder.encode_all(run))
            for key, body in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                if writer is None:
                    system, place = _system(name)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    writer = ShardWriter(system.open_output_stream(place))
                writer.add(key, body + end)
        if writer is not None:
            writer.close()
            writer.stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [name], "n_docs": [len(writer.docs)], "n_tokens": [writer.total]})

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # An id, or none, that many rows have is cut into ranges like any other run of rows.
    order = ["doc_id", "_hash", "_row"]
    keyed = source.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST))


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids,
    from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, ids in Shard(name).documents():
                    rows.append((key, start, len(ids) // 4, zlib.crc32(ids), ids))
                    start += len(ids) // 4
                    if len(rows) == 1000:
                        yield table(rows)
                        rows = []
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())] * with_ids
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    files = max(1, manifest.count())  # a number that is given is not coalesced: a task per file
    spread = placed.select("path", "start").repartition(files, "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Writes all documents to a fresh shared folder and reads them back."""
    return read_documents(write_shards(docs, scratch(spark), path))
