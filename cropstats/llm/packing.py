"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces (id ranges of at most ``capacity`` tokens); only their
lengths take part in the packing. Full pieces are sequences by themselves. The
rest is dealt evenly over shards of bounded size, and on each shard several
islands evolve packings: a crossover injects whole well-filled bins of one
parent into the other, drops the bins that share a piece with them, and places
the displaced pieces by best fit, longest first. Between epochs each island's
best packing migrates to the next island of its shard; at the end the shard's
best packing wins.

Defined cases: a null text counts as empty and packs its end id alone; rows
with equal or null ids are packed each on its own (the packing keys pieces by
the place of their row, not by ``doc_id``); an empty table gives no row. Extra
columns are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropstats.llm import batches, scratch
from cropstats.llm.token_files import encode_batches

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "shard long, island int, rows array<long>, lengths array<int>, bins array<int>, fitness double"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece; a document over ``capacity`` ids is cut so that only its first piece is shorter."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part, ids in encode_batches(parts, tokenizer, end_id):
            out = []
            for doc_id, x in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), ids, strict=True):
                stops = list(range(len(x) % capacity or capacity, len(x) + 1, capacity))
                for k, stop in enumerate(stops):
                    start = stops[k - 1] if k else 0
                    out.append((row, doc_id, k, start, stop - start, zlib.crc32(x[start:stop])))
                    row += 1
            columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return batches.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES)


class Room:
    """Open bins by the room left in them: best fit is the lowest set bit at or above a length."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, b: int, room: int) -> None:
        if room:
            self.bins[room].append(b)
            self.mask |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        """The fullest bin with room for ``length`` and its room, removed from here; None if there is none."""
        above = self.mask >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        b = self.bins[room].pop()
        if not self.bins[room]:
            self.mask &= ~(1 << room)
        return b, room


def best_fit(items: list[int], lengths: list[int], bins: list[int], rooms: list[int], capacity: int) -> None:
    """Put ``items`` into the bins by best fit, longest first; opens bins as needed. Changes ``bins`` and ``rooms``."""
    room = Room(capacity)
    for b, left in enumerate(rooms):
        room.add(b, left)
    for i in sorted(items, key=lambda i: -lengths[i]):
        found = room.take(lengths[i])
        b, left = found or (len(rooms), capacity)
        if found is None:
            rooms.append(capacity)
        bins[i] = b
        rooms[b] = left - lengths[i]
        room.add(b, rooms[b])


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: fewer and fuller bins score higher."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return float((fill[fill > 0] ** 2).sum() / max(1, int((fill > 0).sum())))


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Inject a random share of the well-filled bins of ``b`` into ``a``."""
    fill_b = np.bincount(b, weights=lengths)
    order = np.argsort(-fill_b, kind="stable")[: max(1, int((fill_b > 0).sum() * 0.8))]
    chosen = np.zeros(len(fill_b), dtype=bool)
    chosen[order[np.array([rng.random() < 0.5 for _ in range(len(order))], dtype=bool)]] = True
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, dtype=bool)
    hit[a[injected]] = True
    stays = ~injected & ~hit[a]
    child = np.full(len(a), -1, dtype=np.int64)
    child[injected] = np.unique(b[injected], return_inverse=True)[1]
    n = int(child.max()) + 1
    if stays.any():
        child[stays] = np.unique(a[stays], return_inverse=True)[1] + n
    placed = child >= 0
    rooms = (capacity - np.bincount(child[placed], weights=lengths[placed])).astype(int).tolist()
    out = child.tolist()
    best_fit(np.flatnonzero(~placed).tolist(), lengths.tolist(), out, rooms, capacity)
    return np.array(out, dtype=np.int64)


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], capacity: int, population: int, generations: int, rng: random.Random) -> tuple[np.ndarray, float]:
    """The best packing found, starting from ``seeds`` and randomised best fit; ends early at the least possible number of bins."""
    least = -(-int(lengths.sum()) // capacity)
    pool = [(fitness(lengths, s, capacity), k, s) for k, s in enumerate(seeds)]
    plain = lengths.tolist()
    while len(pool) < population:
        # the first is plain best fit decreasing; the others pack a random part of the pieces first
        bins, rooms = [-1] * len(plain), []
        early = [] if not pool else [i for i in range(len(plain)) if rng.random() < 0.3]
        best_fit(early, plain, bins, rooms, capacity)
        taken = set(early)
        best_fit([i for i in range(len(plain)) if i not in taken], plain, bins, rooms, capacity)
        s = np.array(bins, dtype=np.int64)
        pool.append((fitness(lengths, s, capacity), len(pool), s))
        if len(np.unique(s)) <= least:
            break
    pool.sort(reverse=True)
    for k in range(generations):
        if len(np.unique(pool[0][2])) <= least or len(pool) < 2:
            break
        # parents by rank: better packings are drawn more often
        x, y = (pool[min(rng.randrange(len(pool)), rng.randrange(len(pool)))][2] for _ in range(2))
        child = crossover(x, y, lengths, capacity, rng)
        score = fitness(lengths, child, capacity)
        if score > pool[-1][0]:
            pool[-1] = (score, population + k, child)
            pool.sort(key=lambda p: (-p[0], p[1]))
    return pool[0][2], pool[0][0]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, shard_pieces: int = 8192, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 6) -> DataFrame:
    """Pack all of ``docs``; one row per piece with its sequence and its place there.

    ``shard_pieces`` bounds what one task packs at a time. Sequence numbers are
    unique but not consecutive.
    """
    parts = scratch.stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    rest = parts.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_pieces))

    def epoch(last: bool):
        def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batch_iter:
                for r in batch.to_pylist():
                    lengths = np.array(r["lengths"], dtype=np.int64)
                    seeds = [np.array(s, dtype=np.int64) for s in (r["bins"], r["migrant"]) if s]
                    rng = random.Random(r["shard"] * 1_000_003 + r["island"] * 101 + last)
                    bins, score = evolve(lengths, seeds, capacity, population, generations, rng)
                    out = {"shard": r["shard"], "island": r["island"], "rows": r["rows"], "lengths": r["lengths"], "bins": bins.tolist(), "fitness": score}
                    yield pa.RecordBatch.from_pylist([out], schema=_ARROW)
        return run

    dealt = rest.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.struct("row", F.col("length").cast("int").alias("length")).alias("p"))
    state = (dealt.groupBy("shard").agg(F.array_sort(F.collect_list("p")).alias("p"))
             .select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("p.row").alias("rows"), F.col("p.length").alias("lengths"), F.lit(None).cast("array<int>").alias("bins"), F.lit(0.0).alias("fitness")))
    for k in range(epochs):
        migrants = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("migrant"))
        joined = state.join(migrants, ["shard", "island"]) if k else state.withColumn("migrant", F.lit(None).cast("array<int>"))
        state = scratch.stored(batches.mapped(joined.repartition(scratch.partitions(docs), "shard", "island"), epoch(k == epochs - 1), STATE), f"islands-{k}")
    best = state.groupBy("shard").agg(F.max_by(F.struct("rows", "lengths", "bins"), F.struct("fitness", -F.col("island"))).alias("s")).select("shard", "s.*")
    placed = batches.mapped(best, _places, "row long, sequence_id long, offset long")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = parts.where(F.col("length") == capacity).select(*columns[:5], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.join(placed, "row").select(*columns).unionByName(full)


_ARROW = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("rows", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("bins", pa.list_(pa.int32())), ("fitness", pa.float64())])


def _places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequence number and offset of each piece: pieces of a bin in row order, gapless from 0."""
    for part in parts:
        for r in part.to_pylist():
            used: dict[int, int] = {}
            sequence, offset = [], []
            for b, n in zip(r["bins"], r["lengths"], strict=True):
                at = used.get(b, 0)
                sequence.append((r["shard"] << 32) + b)
                offset.append(at)
                used[b] = at + n
            yield pa.RecordBatch.from_arrays([pa.array(r["rows"], type=pa.int64()), pa.array(sequence, type=pa.int64()), pa.array(offset, type=pa.int64())], names=["row", "sequence_id", "offset"])
