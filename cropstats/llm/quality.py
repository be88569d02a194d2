"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are hashed indicators: byte n-grams, and n-grams over what words look
like (their kinds of characters, and whether a word repeats the one before).
Each is scaled by its class log-count ratio, rows are brought to unit length,
and a linear model is fitted with hinge loss by dual coordinate descent. The
margin becomes a probability by a logistic curve fitted on rows the model has
not seen.

Fitting uses at most ``max_rows`` labelled rows, those first by a hash of their
id, so the fit is a bounded task at any size of the corpus; scoring is one
narrow pass over all whole texts.

Defined cases: a null text counts as empty; an empty text has no feature and
its score is the model's bias; labels that are null are not learned from, and
of repeated labels of a document the larger counts; of repeated rows of an id
with unlike texts the one with the least SHA-256 trains; without labels of both
classes every score is the share of label 1, or 0.5 without any; rows without
id are scored and count as not held out; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropstats.llm import batches
from cropstats.llm.hashing import U64, mix, prefix, spans, word_spans, BYTE_VALUES

BITS = 17
SIZE = 1 << BITS
#: Byte n-grams by length.
LENGTHS = (1, 2, 3, 4)
_KINDS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII
_KINDS[ord("a"):ord("z") + 1], _KINDS[ord("A"):ord("Z") + 1], _KINDS[ord("0"):ord("9") + 1], _KINDS[128:] = 1, 2, 3, 4
_BLOCK = 1 << 18


def features(text: bytes) -> np.ndarray:
    """Sorted hashed indicators of a whole text."""
    flags = np.zeros(SIZE, dtype=bool)
    for at in range(0, len(text), _BLOCK):  # blocks overlap by an n-gram's length, so none is missed
        _mark(text[at:at + _BLOCK + max(LENGTHS) - 1], flags)
    if text:
        _mark_words(text, flags)
    return np.flatnonzero(flags).astype(np.int32)


def _mark(block: bytes, flags: np.ndarray) -> None:
    a = np.frombuffer(block, dtype=np.uint8).astype(np.uint32)
    for n in LENGTHS:
        if len(a) >= n:
            h = np.full(len(a) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for j in range(n):
                h = (h ^ a[j:len(a) - n + 1 + j]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            flags[h >> np.uint32(32 - BITS)] = True


def _mark_words(text: bytes, flags: np.ndarray) -> None:
    """Indicators of n-grams (1 to 3) over the looks of words, in blocks cut at white space."""
    before = np.zeros(2, dtype=U64)
    last = U64(0)
    at = 0
    while at < len(text):
        stop = min(at + _BLOCK, len(text))
        while stop < len(text) and text[stop] not in b" \t\n\x0b\f\r":
            stop += 1
        block = text[at:stop]
        at = stop
        start, end = word_spans(block)
        if not len(start):
            continue
        a = np.frombuffer(block, dtype=np.uint8)
        words = spans(prefix(BYTE_VALUES[a]), start, end)
        repeats = words == np.concatenate(([last], words[:-1]))
        last = words[-1]
        looks = np.zeros(len(start), dtype=np.uint8)
        for kind in range(5):
            seen = np.concatenate(([0], np.cumsum(_KINDS[a] == kind)))
            looks |= ((seen[end] > seen[start]).astype(np.uint8) << np.uint8(kind))
        looks |= repeats.astype(np.uint8) << np.uint8(5)
        chain = np.concatenate((before, looks.astype(U64) + U64(1)))
        before = chain[-2:]
        with np.errstate(over="ignore"):
            for n in (1, 2, 3):
                h = U64(n) << U64(40)
                for j in range(n):
                    h = h ^ (chain[2 - j:len(chain) - j] << U64(8 * j))
                flags[(mix(h + U64(0x5EED)) >> U64(64 - BITS)).astype(np.int64)] = True


def ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's smoothed share in the two classes."""
    counts = [np.ones(SIZE), np.ones(SIZE)]
    for row, label in zip(rows, labels, strict=True):
        counts[int(label)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def scaled(row: np.ndarray, r: np.ndarray) -> np.ndarray:
    x = r[row]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def descend(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray, cost: float, passes: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model by dual coordinate descent; the bias is one more feature of value 1."""
    values = [scaled(row, r) for row in rows]
    square = np.array([float(v @ v) + 1 for v in values])
    sign = np.where(labels > 0, 1.0, -1.0)
    alpha, w, bias = np.zeros(len(rows)), np.zeros(SIZE), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            row, value, y = rows[i], values[i], sign[i]
            gradient = y * (float(w[row] @ value) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                w[row] += step * value
                bias += step
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 by margin, by Newton steps on smoothed targets."""
    up, down = float(labels.sum()), float(len(labels) - labels.sum())
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    slope, offset = 1.0, math.log((up + 1) / (down + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -35, 35)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins, d.sum()])
        h = np.array([[v @ (margins ** 2) + 1e-6, v @ margins], [v @ margins, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(slope, 0.0)), float(offset)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, passes: int = 12) -> tuple[np.ndarray, float, float]:
    """One weight per feature before row scaling is undone, the log ratios folded in; then bias and curve.

    Returns the array of ratios stacked on weights, and slope and offset with the bias folded in.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        return np.zeros((2, SIZE), dtype=np.float32), 0.0, math.log(share / (1 - share)) if 0 < share < 1 else 0.0 if not len(labels) else math.copysign(12.0, share - 0.5)
    aside = np.arange(len(rows)) % 5 == 4
    if not 0 < labels[~aside].mean() < 1 or not aside.any():
        aside[:] = False
    use = np.flatnonzero(~aside)
    r = ratios([rows[i] for i in use], labels[use])
    w, bias = descend([rows[i] for i in use], labels[use], r, cost, passes)
    seen = np.flatnonzero(aside) if aside.any() else use
    margins = np.array([float(w[rows[i]] @ scaled(rows[i], r)) + bias for i in seen])
    slope, offset = logistic(margins, labels[seen])
    return np.stack((r, w)).astype(np.float32), slope, slope * bias + offset


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> tuple[np.ndarray, float, float]:
    """Fit on at most ``max_rows`` labelled rows that are not held out; the model is all that reaches the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            rows = [features(t) for t in batches.utf8(part, "text")]
            ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))], names=["doc_id", "quality", "row"])

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for part in parts:
            for i, y, row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                found[i] = (y, row.values.to_numpy(zero_copy_only=False))
        order = sorted(found)
        model, slope, offset = fit([found[i][1] for i in order], np.array([found[i][0] for i in order], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()]), pa.array([slope]), pa.array([offset])], names=["model", "slope", "offset"])

    # no more than max_rows ids and labels are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # of repeated ids the text with the least digest trains
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    seen = batches.mapped(rows, look, "doc_id long, quality int, row array<int>")
    found = batches.mapped(seen.repartition(1), learn, "model binary, slope double, offset double").collect()
    if not found:
        return fit([], np.array([], dtype=np.int64))
    return np.frombuffer(found[0]["model"], dtype=np.float32).reshape(2, SIZE), found[0]["slope"], found[0]["offset"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float], carried: list[str], threshold: float = 0.7) -> DataFrame:
    """The carried columns as ``row``, with ``held_out``, ``score`` and ``predicted``."""
    weights, slope, offset = model
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = rows.select("row", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, product = weights[0].astype(np.float64), weights[0].astype(np.float64) * weights[1]
        square = r * r
        for part in batches.pieces(parts, "text"):
            out = []
            for text in batches.utf8(part, "text"):
                x = features(text)
                norm = math.sqrt(float(square[x].sum()))
                margin = float(product[x].sum()) / norm if norm else 0.0
                out.append(1 / (1 + math.exp(-min(max(slope * margin + offset, -35.0), 35.0))))
            scores = np.array(out)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["row", "held_out", "score", "predicted"])

    return batches.mapped(rows, score, schema)
