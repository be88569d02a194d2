"""N-gram Jaccard join with PartEnum signatures, and the groups its links form.

A document is the set of its distinct word shingles. Sizes fall into bands so
that similar sets lie in the same or in adjacent bands; each set is signed for
both pairings that its band takes part in. Within a pairing, sets as similar as
the threshold differ in at most K shingles. Two levels: the shingle domain is
partitioned by hash into K div 2 + 1 + E first-level parts, so such sets differ in
at most one shingle in 1 + E of them; each is partitioned into three, and
every subset of two of the three is a signature: with one difference in the
part, one of these subsets is equal. Subsets without a shingle are not signed,
but by a set in which more than E parts have one, so no link is lost.

Equal sets are one class. Classes that share a signature are compared in full,
first with the group's smallest member, then, as long as the group's members
are in different components, with more and more of the others, until every pair
of the group is compared, connected, or shown unlike by a bound. So the components
are those of all links, though links within a component are not all listed. The
bound: a class carries the parities of its shingle counts in 512 buckets of the
hash domain. A shingle that only one of two sets has flips one bit, so sets whose
parities differ in more bits than similar sets have shingles apart are not similar;
such a pair is left out inside the join, and neither becomes a row nor moves a set.

Defined cases: a null text counts as empty; without words a set is empty and
linked with nothing; with fewer words than a shingle takes, the whole sequence
is the one shingle. ``doc_id`` names a document: repeated rows of one count
once for the links and each get their row; a row without id links with nothing.
Other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropstats.llm import batches, scratch
from cropstats.llm.components import components
from cropstats.llm.hashing import U64, mix, shingle_hashes, shingles_of_all, word_hashes

_PART, _FULL, _TAG = U64(0x8CB92BA72F3D8DD7), U64(0x2545F4914F6CDD1D), U64(0xD1B54A32D192ED03)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the text with A-Z lower-cased."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), words, short_whole=True))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """:func:`shingle_set` of every text."""
    return [np.unique(s) for s in shingles_of_all(texts, words, short_whole=True)]


@cache
def band_end(start: int, num: int, den: int) -> int:
    return start * den // num


@cache
def bands(size: int, num: int, den: int) -> tuple[int, int, int, int]:
    """Number of the band of ``size``, and the last sizes of the band before it, of its own, and of the next."""
    start, before, k = 1, 0, 1
    while True:
        end = band_end(start, num, den)
        if size <= end:
            return k, before, end, band_end(end + 1, num, den)
        start, before, k = end + 1, end, k + 1


@cache
def parts_of(low_end: int, high_end: int, num: int, den: int) -> tuple[int, int]:
    """First-level parts of a pairing of bands (0 if similar sets are equal), and how many weak ones E it allows for."""
    most = low_end + min(high_end, low_end * den // num)
    differ = (den - num) * most // (den + num)
    if not differ:
        return 0, 0
    least = differ // 2 + 1
    # sizes start at about low_end * num / den; subsets without a shingle are about Poisson
    weak = 3 * least * np.exp(-2 / 3 * (low_end * num / den) / least)
    extra = int(np.ceil(weak + 4 * np.sqrt(weak)))
    return least + extra, extra


def signatures(ordered: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set given by its sorted distinct hashes."""
    size = len(ordered)
    if size == 0:
        return np.empty(0, dtype=U64)
    number, before, end, after = bands(size, num, den)
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix(ordered ^ _PART))))
        for tag, low, high in ((number, before, end), (number + 1, end, after)):
            if low == 0:
                continue
            n, extra = parts_of(low, high, num, den)
            if n == 0:
                continue  # such sets are similar only when equal, and equal sets are one class
            part = ((ordered >> U64(32)) * U64(3 * n)) >> U64(32)  # rises with the hash
            edges = np.searchsorted(part, np.arange(3 * n + 1, dtype=U64))
            content = (sums[edges[1:]] - sums[edges[:-1]]).reshape(n, 3)
            count = np.diff(edges).reshape(n, 3)
            # the subset without the first, second, or third of a part's three
            both, held = content.sum(axis=1, dtype=U64)[:, None] - content, count.sum(axis=1)[:, None] - count
            salt = U64(tag * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            names = mix(np.arange(3 * n, dtype=U64) * _TAG + salt).reshape(n, 3)
            full = held > 0
            out.append(mix(both[full] + names[full]))
            if int((~full).any(axis=1).sum()) > extra:
                out.append(mix(names[~full] ^ _FULL))
    return np.concatenate(out) if out else np.empty(0, dtype=U64)


#: Longs of a class's parities, 64 buckets each.
PARITIES = 8
_PARITY_COLUMNS = [f"p{i}" for i in range(PARITIES)]


def parities(ordered: np.ndarray) -> np.ndarray:
    """Whether each bucket of the hash domain holds an odd number of the set's hashes, as longs."""
    odd = np.bincount(((ordered >> U64(32)) % U64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _flips(a: str, b: str) -> Column:
    """In how many bits two rows' parities differ: no more than their sets are apart."""
    return sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in _PARITY_COLUMNS), F.lit(0))


def _signed(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Each document's set size and fingerprint; and the signatures of the documents."""

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            sizes, marks, odd = [], [], []
            for s in shingle_sets(batches.utf8(part, "text"), words):
                sizes.append(len(s))
                odd.append(parities(s))
                with np.errstate(over="ignore"):
                    marks.append((int(np.sum(mix(s ^ _FULL), dtype=U64).astype(np.int64)), int(np.sum(mix(s + _TAG), dtype=U64).astype(np.int64))))
            bits = np.stack(odd, axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, type=pa.int64()), pa.array([m[0] for m in marks], type=pa.int64()), pa.array([m[1] for m in marks], type=pa.int64()), *map(pa.array, bits)],
                                             names=["doc_id", "n_shingles", "mark1", "mark2", *_PARITY_COLUMNS])

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            keys, ids, seen = [], [], set()
            for doc_id, s in zip(part.column(0).to_pylist(), shingle_sets(batches.utf8(part, "text"), words), strict=True):
                if doc_id is None or (mark := s.tobytes()) in seen:
                    continue  # a class member signed already stands for this one
                seen.add(mark)
                keys.append(signatures(s, num, den))
                ids.append(np.full(len(keys[-1]), doc_id, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (batches.mapped(rows, measure, "doc_id long, n_shingles long, mark1 long, mark2 long, " + ", ".join(f"{c} long" for c in _PARITY_COLUMNS)), batches.mapped(rows, sign, "key long, doc_id long"))


def _classes(measured: DataFrame) -> DataFrame:
    """The documents with ``cls``, the smallest id of those with the same set; an empty set is a class of its own."""
    same = ["n_shingles", "mark1", "mark2"]
    least = measured.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("least"))
    return measured.join(least, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("cls"), *_PARITY_COLUMNS)


def _sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the needed classes, as bytes."""

    def collect(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(batches.utf8(part, "text"), words)], type=pa.binary())], names=["cls", "members"])

    rows = scratch.in_slots(docs.select("doc_id", "text"), scratch.slots(needed.select(F.col("cls").alias("doc_id"))))
    rows = rows.select(F.col("doc_id").cast("long").alias("cls"), F.col("text").cast("string").alias("text")).join(needed, "cls", "left_semi")
    return batches.mapped(rows, collect, "cls long, members binary").dropDuplicates(["cls"])


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``a``, ``b``) with ``apart``, how many shingles only one of the sets has, and whether they are similar."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            apart, similar = [], []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                joined = np.frombuffer(x.as_buffer().to_pybytes() + y.as_buffer().to_pybytes(), dtype=U64)
                joined = np.sort(joined, kind="stable")
                common = int((joined[1:] == joined[:-1]).sum())
                apart.append(len(joined) - 2 * common)
                similar.append(den * common >= num * (len(joined) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(apart, type=pa.int64()), pa.array(similar, type=pa.bool_())], names=["a", "b", "apart", "similar"])

    left, right = sets.select(F.col("cls").alias("a"), F.col("members").alias("left")), sets.select(F.col("cls").alias("b"), F.col("members").alias("right"))
    return batches.mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), compare, "a long, b long, apart long, similar boolean")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the groups whose members are not all in one component."""
    named = labels.select(F.col("node").alias("cls"), F.col("component").alias("label"))
    alike = Window.partitionBy("key")
    marked = rows.drop("component").join(named, "cls", "left").withColumn("component", F.coalesce("label", "cls")).drop("label")
    return marked.withColumn("least", F.min("component").over(alike)).withColumn("most", F.max("component").over(alike)).where("least < most").drop("least", "most")


def groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Two documents link when ``den * |intersection| >= num * |union|``.

    Comparing each member of a group with its first one also tells how far each
    lies from it. In later rounds a pair whose distances from the first one
    differ by more than similar sets can differ is not compared: the number of
    shingles that only one of two sets has is a metric.
    """
    spark, before = docs.sparkSession, scratch.mark()
    measured, signed = _signed(docs, words, num, den)
    members = scratch.stored(_classes(scratch.stored(measured, "set-sizes")), "set-classes")
    alike = Window.partitionBy("key")
    shared = scratch.stored(signed.withColumn("low", F.min("doc_id").over(alike)).withColumn("high", F.max("doc_id").over(alike)).where("low < high").select("key", "doc_id"), "shared-signatures")
    named = members.where("cls IS NOT NULL").select("doc_id", "cls", "n_shingles").dropDuplicates(["doc_id"])
    by_class = shared.join(named, "doc_id").select("key", "cls", "n_shingles").distinct()
    group = scratch.stored(by_class.withColumn("lead", F.first(F.struct("cls", "n_shingles")).over(alike.orderBy("cls"))).withColumn("size", F.count("*").over(alike)).withColumn("place", F.row_number().over(alike.orderBy("cls"))).where("size > 1"), "signature-groups")
    sets = scratch.stored(_sets(docs, scratch.stored(group.select("cls").distinct(), "classes-in-groups"), words), "shingle-sets")

    def near(a: str, b: str) -> Column:
        return F.least(a, b) * den >= F.greatest(a, b) * num

    to_lead = group.where((F.col("place") > 1) & near("n_shingles", "lead.n_shingles")).select(F.col("cls").alias("a"), F.col("lead.cls").alias("b")).distinct()
    compared = scratch.stored(_compared(to_lead, sets, num, den), "compared")
    links = compared.where("similar").select("a", "b")
    labels = components(links)
    distance = compared.select(F.col("a").alias("cls"), F.col("b").alias("first"), "apart")
    rows = _open(group.select("key", "cls", "n_shingles", "size", "place", F.col("lead.cls").alias("first")), labels)
    rows = scratch.stored(rows.join(distance, ["cls", "first"], "left").withColumn("apart", F.when(F.col("cls") == F.col("first"), 0).otherwise(F.col("apart"))), "open-classes")
    bits = scratch.stored(members.where("doc_id = cls").select("cls", *_PARITY_COLUMNS).dropDuplicates(["cls"]).join(rows.select("cls").distinct(), "cls", "left_semi"), "class-parities")
    rows = scratch.stored(rows.join(bits, "cls"), "open-groups")
    low, high = 2, 5
    while not rows.where(F.col("size") > low).isEmpty():
        at = rows.where(F.col("size") > low)
        centre = at.where(F.col("place").between(low, high)).select("key", F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("place").alias("pb"), F.col("component").alias("cb"), F.col("apart").alias("apart_b"), *[F.col(c).alias(f"b_{c}") for c in _PARITY_COLUMNS])
        # a member or centre too unlike the first in size has no distance, and is compared
        reach = F.coalesce(F.abs(F.col("apart") - F.col("apart_b")) * (den + num) <= (F.col("n_shingles") + F.col("nb")) * (den - num), F.lit(True))
        may_be = _flips("", "b_") * (den + num) <= (F.col("n_shingles") + F.col("nb")) * (den - num)
        pairs = at.join(centre, (at["key"] == centre["key"]) & (F.col("place") > F.col("pb")) & (F.col("component") != F.col("cb")) & near("n_shingles", "nb") & reach & may_be)
        pairs = pairs.select(F.greatest("cls", "b").alias("a"), F.least("cls", "b").alias("b")).distinct()
        found = scratch.stored(_compared(pairs, sets, num, den).where("similar").select("a", "b"), "similar")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
            rows = scratch.stored(_open(rows, labels), "open-groups")
        low, high = high + 1, 4 * high + 1
    scratch.release(spark, before, members, labels)
    return members.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those of a group's documents other than its smallest id; all columns are kept."""
    spark, before = docs.sparkSession, scratch.mark()
    found = groups(docs, words, num, den)
    away = scratch.stored(found.where("component_id < doc_id").select("doc_id").distinct(), "similar-away")
    scratch.release(spark, before, away)
    taken = scratch.slots(away)
    near = scratch.in_slots(docs, taken).join(away, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return scratch.in_slots(docs, taken, outside=True).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(near)
