"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

Index. Each task turns its documents into shards of at most ``SHARD_DOCS``
documents, one row per shard and term, without a shuffle. A posting list is cut
into blocks of ``BLOCK`` postings, each packed by its own byte widths; beside a
block stand its last document and its frontier: the (frequency, length) pairs
that no other posting of the block beats in both. The score grows with the
frequency and falls with the length, so a block's greatest score follows from
its frontier, exactly, once the corpus totals are known; the index does not
depend on them. One more row per shard holds its documents' ids and lengths.

Search. The items' terms meet the lists by term; a shard's lists of one block of
items form a group, of bounded size whatever the corpus. For each item, lists
are ordered by their greatest score; those at the low end whose greatest scores
sum to less than the threshold (the k-th best score so far) are not essential: a
document in none of the others cannot be among the best. Documents come from
the essential lists, a window of ids at a time; a window whose block maxima sum
to less than the threshold is left out. Block maxima of the other lists bound
each candidate, and only blocks of those that can still reach the threshold are
unpacked, list by list. A task carries its best ``k`` from shard to shard, and the
tasks' bests are merged by a window over the items.

Score, in 64-bit integers: the sum over the item's terms, repeats included, of
``w * ((10**9 * tf) div (1000 * tf + 12 * m))``, where ``w`` is
``floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m`` is ``75 + (25 * n * N) div L``.

Defined cases: a null or empty text, or one without terms, is in no result and
does not count in ``N``; equal scores rank by id, a null id last; repeated rows
are documents each; rows with one ``item_id`` are one item with all their terms;
an item without known terms has no row; a long text is read in pieces of
``PIECE`` bytes and counts whole; empty tables give no row; other columns are not
read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropstats.llm import batches, scratch

#: Documents and postings of a shard, postings of a block, documents of a window, items searched together.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, WINDOW, ITEMS = 8192, 1 << 21, 128, 2048, 256
PIECE = 1 << 20
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    *[(n, pa.binary()) for n in ("last", "widths", "fronts", "front_tf", "front_n", "packed")]])
SCHEMA = "shard long, term string, df long, n_terms long, ids array<long>, lengths array<long>, last binary, widths binary, fronts binary, front_tf binary, front_n binary, packed binary"
_LIST = ["last", "widths", "fronts", "front_tf", "front_n", "packed"]


def counted(data: bytes | memoryview) -> Counter:
    """How often each term stands in a text given as UTF-8."""
    if len(data) <= PIECE:
        return Counter(bytes(data).translate(_BYTES).split())
    found, rest = Counter(), []
    for at in range(0, len(data), PIECE):
        piece = bytes(data[at:at + PIECE]).translate(_BYTES)
        head, blank, tail = piece.rpartition(b" ")
        if blank:
            found.update(b"".join([*rest, head]).split())
            rest = [tail]
        else:
            rest.append(piece)
    found.update(b"".join(rest).split())
    return found


class _Shard:
    """The documents of one shard, and their postings."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.ids: list = []
        self.lengths, self.distinct, self.tid, self.tf = array("q"), array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, data: bytes) -> None:
        found = counted(data)
        if found:
            self.ids.append(doc_id)
            self.lengths.append(found.total())
            self.distinct.append(len(found))
            self.tid.extend(map(self.terms.__getitem__, found))
            self.tf.extend(found.values())

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.tid) >= SHARD_POSTINGS

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The row of the documents, then the rows of the lists."""
        if not self.ids:
            return
        lengths = np.array(self.lengths, dtype=np.int64)
        nothing = [pa.array([None], type=pa.binary())] * len(_LIST)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], type=pa.string()), pa.array([len(self.ids)]), pa.array([int(lengths.sum())]),
                                          pa.array([self.ids], type=_INDEX.field("ids").type), pa.array([lengths], type=_INDEX.field("ids").type), *nothing], schema=_INDEX)
        tid, tf = np.array(self.tid), np.array(self.tf)
        order = np.argsort(tid, kind="stable")
        tid, tf, doc = tid[order], tf[order], np.repeat(np.arange(len(lengths)), np.array(self.distinct))[order]
        df = np.bincount(tid, minlength=len(self.terms))
        columns = [pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]) for at, data in packed(df, doc, tf, lengths[doc])]
        empty = pa.nulls(len(df), type=_INDEX.field("ids").type)
        lists = pa.RecordBatch.from_arrays([pa.array(np.full(len(df), number)), pa.array(list(self.terms), type=pa.binary()).view(pa.string()), pa.array(df), pa.nulls(len(df), type=pa.int64()), empty, empty, *columns], schema=_INDEX)
        for at in range(0, len(df), 10_000):
            yield lists.slice(at, 10_000)


def packed(df: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The binary columns of posting lists that stand one after the other: offsets and bytes of each column of ``_LIST``."""
    begin = np.cumsum(df) - df
    place = np.arange(len(doc)) - np.repeat(begin, df)
    heads = np.flatnonzero(place % BLOCK == 0)
    block = np.cumsum(place % BLOCK == 0) - 1
    size = np.diff(np.append(heads, len(doc)))
    gap = np.where(place == 0, doc, doc - np.concatenate(([0], doc[:-1])) - 1)
    width = lambda values: np.searchsorted([1 << 8, 1 << 16], np.maximum.reduceat(values, heads), side="right").astype(np.int64)
    wide_gap, wide_tf = np.array([1, 2, 4])[width(gap)], np.array([1, 2, 4])[width(tf)]
    start = np.cumsum(size * (wide_gap + wide_tf)) - size * (wide_gap + wide_tf)
    data = np.zeros(int((size * (wide_gap + wide_tf)).sum()), dtype=np.uint8)
    inside = place % BLOCK
    for values, wide, origin in ((gap, wide_gap, start), (tf, wide_tf, start + size * wide_gap)):
        at = origin[block] + inside * wide[block]
        for k in range(4):
            with_byte = wide[block] > k
            data[at[with_byte] + k] = (values[with_byte] >> (8 * k)) & 255
    # the frontier of a block: by rising length, frequencies above all before
    order = np.lexsort((-tf, n, block))
    key = (block[order] << 32) + tf[order]
    kept = np.concatenate(([True], key[1:] > np.maximum.accumulate(key)[:-1]))
    front = order[kept]
    fronts = np.bincount(block[order][kept], minlength=len(heads))
    blocks = np.concatenate(([0], np.cumsum(-(-df // BLOCK))))
    front_at = np.concatenate(([0], np.cumsum(fronts)))[blocks]
    data_at = np.append(start, len(data))[blocks]
    last = doc[heads + size - 1]
    return [(blocks * 4, last.astype("<i4")), (blocks * 2, np.stack((wide_gap, wide_tf), axis=1).astype(np.uint8).ravel()), (blocks * 4, fronts.astype("<i4")),
            (front_at * 4, tf[front].astype("<i4")), (front_at * 8, n[front].astype("<i8")), (data_at, data)]


def index(docs: DataFrame) -> DataFrame:
    """The index of every text of ``docs`` (``doc_id``, ``text``), written to the shared folder."""

    def inverted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 24
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if text.is_valid:
                    shard.add(doc_id, text.as_buffer())
                if shard.full():
                    yield from shard.rows(number)
                    shard, number = _Shard(), number + 1
        yield from shard.rows(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.stored(batches.mapped(rows, inverted, SCHEMA), "lexical-index")


class _Totals:
    """The corpus totals, and what scores need of them."""

    def __init__(self, docs: int, terms: int) -> None:
        self.docs, self.terms = docs, terms

    def scale(self, n: np.ndarray) -> np.ndarray:
        if len(n) and 25 * int(n.max()) * self.docs >= 1 << 63:
            return np.array([75 + 25 * int(x) * self.docs // self.terms for x in n], dtype=np.int64)
        return 75 + 25 * n * self.docs // self.terms

    @staticmethod
    def score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class PostingList:
    """One list of one shard; blocks are unpacked when first needed."""

    def __init__(self, row: dict, totals: _Totals, m: np.ndarray) -> None:
        self.df, self.m = row["df"], m
        self.last = np.frombuffer(row["last"], dtype="<i4")
        self.widths = np.frombuffer(row["widths"], dtype=np.uint8).reshape(-1, 2)
        fronts = np.frombuffer(row["fronts"], dtype="<i4")
        front = totals.score(np.frombuffer(row["front_tf"], dtype="<i4").astype(np.int64), totals.scale(np.frombuffer(row["front_n"], dtype="<i8")))
        self.best = np.append(np.maximum.reduceat(front, np.cumsum(fronts) - fronts), 0)  # past the last block there is nothing
        self.most = int(self.best.max())
        sizes = np.full(len(self.last), BLOCK, dtype=np.int64)
        sizes[-1] = self.df - BLOCK * (len(self.last) - 1)
        ends = np.cumsum(sizes * self.widths.sum(axis=1))
        self.sizes, self.at, self.data = sizes, np.concatenate(([0], ends)), row["packed"]
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ceilings: dict[int, int] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores (without the weight) of a block."""
        if b not in self.blocks:
            (wide_gap, wide_tf), size, at = self.widths[b].tolist(), int(self.sizes[b]), int(self.at[b])
            gap = np.frombuffer(self.data, dtype=f"<u{wide_gap}", count=size, offset=at).astype(np.int64)
            tf = np.frombuffer(self.data, dtype=f"<u{wide_tf}", count=size, offset=at + size * wide_gap).astype(np.int64)
            doc = np.cumsum(gap + 1) + (int(self.last[b - 1]) if b else -1)
            self.blocks[b] = doc, _Totals.score(tf, self.m[doc])
        return self.blocks[b]

    def _reach(self, w: int) -> tuple[int, int]:
        low, high = np.searchsorted(self.last, (w * WINDOW, (w + 1) * WINDOW - 1)).tolist()
        return low, min(high + 1, len(self.last))

    def ceiling(self, w: int) -> int:
        """The greatest score of the blocks that reach into a window."""
        if w not in self.ceilings:
            low, high = self._reach(w)
            self.ceilings[w] = int(self.best[low:high].max()) if low < high else 0
        return self.ceilings[w]

    def window(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a window, and scores."""
        if w not in self.windows:
            found = [self.block(b) for b in range(*self._reach(w))]
            doc, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
            low, high = np.searchsorted(doc, (w * WINDOW, (w + 1) * WINDOW))
            self.windows[w] = doc[low:high] - w * WINDOW, score[low:high]
        return self.windows[w]

    def scores(self, doc: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The scores of documents, given the blocks that may hold them."""
        needed = np.unique(block)
        found = [self.block(b) for b in needed[needed < len(self.last)].tolist()]
        if not found:
            return np.zeros(len(doc), dtype=np.int64)
        docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
        return np.where(docs[at] == doc, scores[at], 0)


class Best:
    """The ``k`` best documents so far: greatest score, then smallest id, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def threshold(self) -> int:
        """What a document must reach to count."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.append(self.score, score), np.append(self.id, ids), np.append(self.null, null)
        order = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def search_shard(lists: list[tuple[int, PostingList]], ids: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Add to ``best`` what one shard has for one item, given (weight times repeats, list) pairs."""
    lists = sorted([x for x in lists if x[0]], key=lambda x: x[0] * x[1].most)
    sums = np.cumsum([c * x.most for c, x in lists])
    for w in range(-(-len(ids) // WINDOW)):
        least = best.threshold
        idle = int(np.searchsorted(sums, least))  # lists whose greatest scores sum to less than the threshold
        if idle == len(lists) or sum(c * x.ceiling(w) for c, x in lists) < least:
            continue
        held = np.zeros(WINDOW, dtype=np.int64)
        for c, x in lists[idle:]:
            place, score = x.window(w)
            held[place] += c * score
        place = np.flatnonzero(held)
        score, doc = held[place], place + w * WINDOW
        others = lists[:idle][::-1]
        blocks = [np.searchsorted(x.last, doc) for _, x in others]
        bounds = [c * x.best[b] for (c, x), b in zip(others, blocks, strict=True)]
        open_ = np.sum(bounds, axis=0, dtype=np.int64) if bounds else np.zeros(len(doc), np.int64)
        alive = np.flatnonzero(score + open_ >= least)
        for (c, x), block, bound in zip(others, blocks, bounds, strict=True):
            if not len(alive):
                break
            open_[alive] -= bound[alive]
            hit = alive[bound[alive] > 0]
            score[hit] += c * x.scores(doc[hit], block[hit])
            alive = alive[score[alive] + open_[alive] >= least]
        if len(alive):
            best.add(score[alive], ids[doc[alive]], null[doc[alive]])


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``term``, ``times`` of the whole texts of ``items``."""

    def terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for item, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = counted(text.as_buffer()) if text.is_valid else {}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), type=pa.int64()), pa.array(list(found), type=pa.binary()).view(pa.string()), pa.array(list(found.values()), type=pa.int64())], names=["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return batches.mapped(rows, terms, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _slot() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(scratch.SLOTS)).cast("int")


def search(indexed: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: each item's ``k`` best documents with a score above 0."""
    wanted = scratch.stored(item_terms(items), "lexical-items")
    lists, shards = indexed.where("term IS NOT NULL"), indexed.where("term IS NULL")
    docs, terms = shards.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    groups = max(1, math.ceil(wanted.select("item_id").distinct().count() / ITEMS))
    # at most SLOTS rows are broadcast, to leave out the lists that no item asks for
    slots = F.broadcast(wanted.select(_slot().alias("slot")).distinct())
    near = lambda rows: rows.withColumn("slot", _slot()).join(slots, "slot", "left_semi").drop("slot")
    known = near(lists.select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    used = (wanted.join(known.select("term", weight.alias("weight")), "term")
            .groupBy(F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("group"), "term").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("item_id", "times")).alias("uses")))
    asked = near(lists.select("shard", "term", "df", *_LIST)).join(used, "term")
    uses = used.schema["uses"].dataType
    rows = asked.select("group", "shard", "term", "weight", "uses", "df", *_LIST, F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("lengths"))
    heads = shards.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "shard", "term", F.lit(0).cast("long").alias("weight"), F.lit(None).cast(uses).alias("uses"), "df", *_LIST, "ids", "lengths")
    dealt = rows.unionByName(heads).repartition("group", "shard").sortWithinPartitions("group", "shard", F.col("term").asc_nulls_first())

    def searched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = _Totals(docs, terms)
        group, found, shard, by_item, ids, null, m = None, {}, None, {}, None, None, None

        def close_shard() -> None:
            for item, pairs in by_item.items():
                search_shard(pairs, ids, null, found.setdefault(item, Best(k)))
            by_item.clear()

        def results() -> pa.RecordBatch:
            kept = [(item, best) for item, best in found.items() if len(best.score)]
            flat = lambda values, kind: pa.array(np.concatenate(values) if values else [], type=kind)
            doc = pa.array(np.concatenate([b.id for _, b in kept]), type=pa.int64(), mask=np.concatenate([b.null for _, b in kept])) if kept else pa.array([], type=pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([item for item, b in kept for _ in b.score], type=pa.int64()), doc, flat([b.score for _, b in kept], pa.int64())], names=["item_id", "doc_id", "score"])

        for part in parts:
            for row in part.to_pylist():
                if (row["group"], row["shard"]) != (group, shard):
                    close_shard()
                    if row["group"] != group:
                        yield results()
                        found = {}
                    group, shard = row["group"], row["shard"]
                    null = np.array([x is None for x in row["ids"]], dtype=bool)
                    ids, m = np.array([x or 0 for x in row["ids"]], dtype=np.int64), totals.scale(np.array(row["lengths"], dtype=np.int64))
                    continue
                made = PostingList(row, totals, m)
                for use in row["uses"]:
                    by_item.setdefault(use["item_id"], []).append((use["times"] * row["weight"], made))
        close_shard()
        yield results()

    best = batches.mapped(dealt, searched, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
