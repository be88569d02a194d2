"""Removal of repeated byte strings by suffix sorting, one bucket of suffixes at a time.

A byte goes when a string of ``length`` bytes covers it that also starts in a
document with a smaller id. Sorting every suffix of the corpus would shuffle
the corpus many times over, so anchors pick the suffixes worth sorting: in
each window of ``length`` bytes the grams with the least hash. Equal windows
have equal anchors, so only windows at an anchor that two documents share can
repeat. Where the whole surroundings of an anchor are equal the smallest id
settles all its windows at once. Otherwise the windows' suffixes, but for
those whose hash no other text of the bucket has, are sorted bucket by bucket
(a bucket: the surroundings of some anchors): by their first bytes, and where these tie, by the ranks of a difference-cover sample. For any
two suffixes of a tie the cover has one shift below its period at which both
are sampled, so two ranks decide. Neighbours in the order that agree for
``length`` bytes are one group, whose smallest id stays.

Defined cases: null text counts as empty; texts shorter than ``length`` lose
nothing; matches never cross documents; a string that repeats only within one
document stays; rows without id take no part and lose nothing; repeated rows
of a document are one document; extra columns are not read; an empty table
gives no row. An anchor with more rows than fill a block (a phrase that a large
share of the texts holds in unlike surroundings) is not sorted in one task:
its windows meet by aggregates over the whole window. Surroundings of an anchor
count as equal by a 64-bit hash beside the anchor's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropstats.llm import batches, scratch
from cropstats.llm.hashing import BYTE_VALUES, SPAN_VALUE, U64, mix, powers, prefix, spans

#: Period and residues of a perfect difference cover: every difference modulo 7 is one of two residues.
PERIOD, COVER = 7, (0, 1, 3)
_BLOCK = 1 << 18
#: Bytes of surroundings sorted at a time.
BUCKET = 4 << 20


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over every window of ``width`` elements."""
    n, size, cur = len(x) - width + 1, 1, x
    while size * 2 <= width:
        cur = best(cur[:-size], cur[size:])
        size *= 2
    return best(cur[:n], cur[width - size:width - size + n]) if size < width else cur[:n]


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the grams that are least in some window of ``length`` bytes, and their hashes.

    ``data`` holds texts one after the other, ``bounds`` where each starts and
    where the last ends; windows do not cross texts.
    """
    places, hashes = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=U64)]
    width = length - gram + 1
    edge = np.zeros(width - 1, dtype=U64)
    cut = np.maximum(bounds[1:] - length + 1, bounds[:-1])  # windows from here to the end of the text would leave it
    for at in range(0, len(data) - length + 1, _BLOCK):  # windows that start in [at, at + _BLOCK)
        a = data[at:at + _BLOCK + length - 1]
        sums = prefix(BYTE_VALUES[a])
        with np.errstate(over="ignore"):
            h = mix((sums[gram:] - sums[:-gram]) * powers(len(sums), inverse=True)[:len(sums) - gram] + U64(gram) * SPAN_VALUE)
        least = sliding(h, width, np.minimum)
        out = np.zeros(len(least) + 1, dtype=np.int32)
        near = slice(np.searchsorted(bounds[1:], at, side="right"), np.searchsorted(cut, at + len(least)))
        np.add.at(out, np.clip(cut[near] - at, 0, len(least)), 1)
        np.add.at(out, np.clip(bounds[1:][near] - at, 0, len(least)), -1)
        least[np.cumsum(out[:-1]) > 0] = 0
        found = np.flatnonzero(sliding(np.concatenate((edge, least, edge)), width, np.maximum) == h)
        places.append(found + at)
        hashes.append(h[found])
    p, first = np.unique(np.concatenate(places), return_index=True)  # blocks overlap
    return p, np.concatenate(hashes)[first]


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of one text."""
    return anchors_of(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), length, gram)


@cache
def shifts() -> np.ndarray:
    """For two residues, the least shift at which both are in the cover."""
    return np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def words_at(padded: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """``count`` big-endian 8-byte words of the text at each position, first word first."""
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return [np.ascontiguousarray(view[at + 8 * k]).view(">u8").ravel().astype(U64) for k in range(count)]


def sort_suffixes(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in the order of their suffixes, exact for ``depth`` bytes and more.

    ``padded`` holds at least ``depth`` + 2 * PERIOD + 8 bytes after the last position.
    """
    # ranks of the sample: positions of the cover near enough to be asked for
    asked = np.zeros(len(padded), dtype=bool)
    for d in range(PERIOD):
        asked[at + d] = True
    sample = np.flatnonzero(asked & np.isin(np.arange(len(padded)) % PERIOD, COVER))
    deep = words_at(padded, sample, -(-depth // 8))
    order = np.lexsort(deep[::-1])
    differs = np.zeros(len(order), dtype=bool)
    for w in deep:
        differs[1:] |= w[order[1:]] != w[order[:-1]]
    rank = np.zeros(len(padded), dtype=np.int64)
    rank[sample[order]] = np.cumsum(differs) + 1
    # first bytes, enough to reach beyond any shift
    first = words_at(padded, at, 2)
    order = np.lexsort(first[::-1])
    at = at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (first[0][order[1:]] != first[0][order[:-1]]) | (first[1][order[1:]] != first[1][order[:-1]])
    tie = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(at)))[tie] > 1
    # a suffix's place in its tie is the number of those in it that come before
    top = int(rank.max()) + 1
    place = np.zeros(len(at), dtype=np.int64)
    residue = at % PERIOD
    members = [np.flatnonzero(many & (residue == r)) for r in range(PERIOD)]
    for a in range(PERIOD):
        if not len(members[a]):
            continue
        for b in range(PERIOD):
            if not len(members[b]):
                continue
            d = shifts()[a, b]
            keys = np.sort(tie[members[b]] * top + rank[at[members[b]] + d])
            mine = tie[members[a]] * top + rank[at[members[a]] + d]
            low = np.searchsorted(keys, tie[members[a]] * top)
            place[members[a]] += np.searchsorted(keys, mine) - low
    return at[np.lexsort((at, place, tie))]


def _in_two(joined: np.ndarray, at: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``at`` have the hash slot of a window of another text; no repeated one is left out.

    The last window written to a slot differs in its text from some other one, or all are of one text.
    """
    slot = (spans(prefix(BYTE_VALUES[joined]), at, at + length) >> U64(64 - (8 * len(at)).bit_length())).astype(np.int64)
    last = np.empty(1 << (8 * len(at)).bit_length(), dtype=np.int32)
    last[slot] = text
    several = np.zeros(len(last), dtype=bool)
    several[slot[last[slot] != text]] = True
    return several[slot]


def repeats(texts: list[bytes], owners: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Runs of window starts that repeat in a text of a smaller owner: text number, first and last start.

    Looks at the windows of text ``i`` that start in [low[i], high[i]].
    """
    gap = bytes(length + 2 * PERIOD + 8)
    joined = np.frombuffer(b"".join(t + b"\0" for t in texts) + gap, dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    counts = high - low + 1
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + (starts + low)[text]
    met = _in_two(joined, at, text, length)
    at, text = at[met], text[met]
    if not len(at):
        return []
    owner = np.zeros(len(joined), dtype=np.int32)
    owner[at] = text
    ordered = sort_suffixes(joined, at, length)
    same = np.ones(len(ordered), dtype=bool)
    same[:1] = False
    full, rest = divmod(length, 8)
    for k, w in enumerate(words_at(joined, ordered, full + (rest > 0))):
        if k == full:
            w = w >> U64(8 * (8 - rest))
        same[1:] &= w[1:] == w[:-1]
    group = np.cumsum(~same) - 1
    begin = np.flatnonzero(~same)
    who = owners[owner[ordered]]
    least = np.minimum.reduceat(who, begin)[group] if len(begin) else who
    hit = np.sort(ordered[who > least])
    if not len(hit):
        return []
    number = owner[hit]
    cut = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (number[1:] != number[:-1]))))
    last = np.append(cut[1:], len(hit)) - 1
    return [(int(i), int(a), int(b)) for i, a, b in zip(number[cut], hit[cut] - starts[number[cut]], hit[last] - starts[number[cut]], strict=True)]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and where each starts and the last ends."""
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            data, bounds = _joined(batches.utf8(part, "text"))
            place, key = anchors_of(data, bounds, length, gram)
            text = np.searchsorted(bounds, place, side="right") - 1
            order = np.lexsort((key, text))
            key, text = key[order].view(np.int64), text[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), part.column(0).take(pa.array(text[new]))], names=["key", "doc_id"])

    return batches.mapped(docs.select("doc_id", "text"), find, "key long, doc_id long")


_AROUND = "key long, mark long, doc_id long, first long, high long, around binary"


def _pick(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after the other."""
    stops = np.cumsum(sizes)
    at = np.repeat(starts - (stops - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


def _binary(flat: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def _surroundings(joined: DataFrame, length: int, gram: int) -> DataFrame:
    """The surroundings of shared anchors, one row each; without bytes where a smaller id of the same batch settles it."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            data, bounds = _joined(batches.utf8(part, "text"))
            place, key = anchors_of(data, bounds, length, gram)
            text = np.searchsorted(bounds, place, side="right") - 1
            # anchors of a text that other texts share; two that fall together here only give a row that decides nothing
            with np.errstate(over="ignore"):
                lists = part.column(2)
                owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                shared = np.sort(lists.flatten().to_numpy().view(U64) ^ mix(owner.astype(U64)))
                mine = key ^ mix(text.astype(U64))
            if not len(shared):
                continue
            keep = shared[np.minimum(np.searchsorted(shared, mine), len(shared) - 1)] == mine
            place, key, text = place[keep], key[keep].view(np.int64), text[keep]
            if not len(key):
                continue
            starts, end = np.maximum(place + gram - length, bounds[text]), np.minimum(place + length, bounds[text + 1])
            sizes = end - starts
            mark = np.empty(len(place), dtype=U64)
            for at in range(0, len(data), _BLOCK):
                some = slice(*np.searchsorted(starts, (at, at + _BLOCK)))
                mark[some] = spans(prefix(BYTE_VALUES[data[at:at + _BLOCK + 2 * length]]), starts[some] - at, end[some] - at)
            mark, ids = mark.view(np.int64), part.column(0).to_numpy()[text]
            first, high = starts - bounds[text], np.minimum(place - starts, sizes - length)
            order = np.lexsort((ids, mark, key))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]])
            least = np.empty(len(order), dtype=np.int64)
            least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            valid = ids == least
            sizes = np.where(valid, sizes, 0)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in (key, mark, ids, first, high)], _binary(_pick(data, starts, sizes), sizes, valid)], names=["key", "mark", "doc_id", "first", "high", "around"])

    return batches.mapped(joined, cut, _AROUND)


def _settle(rows: DataFrame, length: int) -> DataFrame:
    """Runs of window starts to remove, from surroundings sorted by anchor, mark of the surroundings, and id."""

    def settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in parts:
            held.append(part)
            size += part.nbytes
            if size >= BUCKET:
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column("key").to_numpy()
                change = np.flatnonzero(key[1:] != key[:-1])
                if len(change):
                    stop = int(change[-1]) + 1
                    yield _bucket(whole.slice(0, stop), length)
                    whole = whole.slice(stop)
                held, size = whole.to_batches(), whole.nbytes
        if held:
            yield _bucket(pa.Table.from_batches(held), length)

    return batches.mapped(rows, settle, "doc_id long, low long, high long")


def _bucket(rows: pa.Table, length: int) -> pa.RecordBatch:
    key, mark, ids, first, high = (rows.column(k).to_numpy() for k in range(5))
    new_key = np.ones(len(key), dtype=bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= mark[1:] != mark[:-1]
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)  # rows come in the order of ids
    later = ids > ids[lead][group]
    out = [np.stack((ids[later], first[later], first[later] + high[later]))]
    per_key = np.bincount(np.cumsum(new_key) - 1, weights=new).astype(np.int64)
    open_ = np.flatnonzero(per_key[np.cumsum(new_key)[lead] - 1] > 1)  # groups of keys with several surroundings
    if len(open_):
        chosen = lead[open_]
        around = pa.concat_arrays(rows.column(5).chunks).take(pa.array(chosen))
        runs = repeats([x.as_buffer().to_pybytes() for x in around], ids[chosen], np.zeros(len(chosen), dtype=np.int64), high[chosen], length)
        if runs:
            # the runs hold wherever the first document has these surroundings
            number, low, top = np.array(runs, dtype=np.int64).T
            place = np.full(int(group[-1]) + 1, -1, dtype=np.int64)
            place[open_] = np.arange(len(open_))
            own = np.flatnonzero(~later & (place[group] >= 0))
            mine = place[group[own]]
            begin, end = np.searchsorted(number, mine), np.searchsorted(number, mine, side="right")
            times = end - begin
            row = np.repeat(own, times)
            stops = np.cumsum(times)
            run = np.arange(int(times.sum())) - np.repeat(stops - times - begin, times)
            out.append(np.stack((ids[row], first[row] + low[run], first[row] + top[run])))
    found = np.concatenate(out, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["doc_id", "low", "high"])


def removals(docs: DataFrame, length: int = 50, gram: int = 18, most: int | None = None) -> DataFrame:
    """Runs of window starts (``low`` to ``high``) in ``doc_id`` that repeat in a smaller id, stored.

    An anchor with more than ``most`` rows (by default as many as fill a block) is dealt by its windows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    alike = Window.partitionBy("key")
    found = _anchor_rows(rows, length, gram).withColumn("least", F.min("doc_id").over(alike)).withColumn("most", F.max("doc_id").over(alike))
    shared = scratch.stored(found.where("least < most").select("key", "doc_id"), "shared-anchors")
    by_doc = shared.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    around = scratch.stored(_surroundings(rows.join(by_doc, "doc_id").select("doc_id", "text", "keys"), length, gram), "surroundings")
    open_ = around.where("around IS NOT NULL")
    many = scratch.stored(open_.groupBy("key").count().where(F.col("count") > (most or BUCKET // (2 * length))).select("key"), "frequent-anchors")
    few = open_.join(many, "key", "left_anti").select(*around.columns)
    dealt = few.repartition(scratch.partitions(docs), "key").sortWithinPartitions("key", "mark", "doc_id")
    settled = around.where("around IS NULL").select("doc_id", F.col("first").alias("low"), (F.col("first") + F.col("high")).alias("high"))
    return scratch.stored(_settle(dealt, length).unionByName(settled).unionByName(_frequent(open_.join(many, "key", "left_semi"), length)), "removals")


def _frequent(rows: DataFrame, length: int) -> DataFrame:
    """Runs of window starts to remove at anchors with more rows than a block: nothing of such an anchor has to meet in one task.

    Equal surroundings are settled by a map-side minimum. Of the first holders
    the windows themselves are the buckets, which again meet by aggregates; joins
    back to the rows are dealt by mark or window, and skewed ones are split.
    """
    least = rows.groupBy("key", "mark").agg(F.min("doc_id").alias("least"))
    marked = scratch.stored(rows.join(least, ["key", "mark"]), "frequent-surroundings")
    later = marked.where("doc_id > least").select("doc_id", F.col("first").alias("low"), (F.col("first") + F.col("high")).alias("high"))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("high"))).alias("place")
    starts = marked.where("doc_id = least").select("doc_id", "first", "around", place)
    windows = starts.select("doc_id", (F.col("first") + F.col("place")).alias("low"), F.substring("around", F.col("place").cast("int") + 1, F.lit(length)).alias("window"))
    repeated = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest")).where("least < greatest").select("window", "least")
    found = windows.join(repeated, "window").where("doc_id > least").select("doc_id", "low", F.col("low").alias("high"))
    return later.unionByName(found)


def removed_bytes(size: int, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a text the windows that start in the runs [low, high] cover."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, np.minimum(high + length, size), -1)
    return np.cumsum(edge)[:size] > 0


def with_runs(docs: DataFrame, length: int = 50, gram: int = 18) -> DataFrame:
    """``doc_id`` and ``text`` of every row, with the runs of window starts to remove, null where there is none."""
    runs = removals(docs, length, gram)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_doc = runs.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    return rows.join(by_doc, "doc_id", "left")


def digests(docs: DataFrame, length: int = 50, gram: int = 18) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), and the SHA-256 of the bytes that stay."""

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            out = []
            for doc_id, text, runs in zip(part.column(0).to_pylist(), batches.utf8(part, "text"), part.column(2), strict=True):
                bytes_ = np.frombuffer(text, dtype=np.uint8)
                if runs.is_valid:
                    low, high = (x.to_numpy(zero_copy_only=False) for x in runs.values.flatten())
                    gone = removed_bytes(len(text), low, high, length)
                else:
                    gone = np.zeros(len(text), dtype=bool)
                spans_ = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc_id, len(text), int(gone.sum()), spans_, hashlib.sha256(bytes_[~gone].tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return batches.mapped(with_runs(docs, length, gram).select("doc_id", "text", "runs"), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
