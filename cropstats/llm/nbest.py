"""N-best segmentation with a SentencePiece model's pieces and scores.

White space becomes the word mark, one is put in front, and pieces hold the
mark only at their start (or nothing but marks), so the lattice of a text is a
chain of the lattices of its words. Within a word, forward Viterbi scores are
the exact best score from the start to each place, so a backward A* search that
adds them to the score so far takes segmentations off its queue best first and
never expands one that is not needed. Over the chain the same search runs on
words: the forward score of a place is the sum of the best word scores before
it, and only words whose next-best segmentation costs little are ever changed.
Words are segmented once per worker and remembered.

Characters without a piece are spelled in byte pieces, whose score is that of
the worst piece. Among equal scores the segmentation that is longer in its
last piece comes first, so results do not depend on order or machine.

Defined cases: null text counts as empty, and an empty text has one
segmentation without pieces; a text has as many rows as it has segmentations,
``n`` at most; repeated rows each get theirs; rows without id keep null; extra
columns are not read. Decoding turns word marks into blanks, so a text that
holds a word mark itself comes back with a blank there; null ids decode to
null, ids that are neither piece nor byte (control symbols) spell nothing,
and bytes that are not UTF-8 become U+FFFD.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropstats.llm import batches
from cropstats.llm.bpe import Known
from cropstats.llm.hashing import U64, mix, powers, prefix, spans

MARK = "▁"
#: Words a worker remembers with their best segmentation, and with all; code points of texts taken together.
KEPT, _LISTS, _STEP = 1_500_000, 20_000, 1 << 19
#: The length up to which words are searched together, and how many are.
_SHORT, _TOGETHER = 48, 4096
#: Bits of the piece tables.
_SLOTS = 20
_LENGTH = U64(0xA24BAED4963EE407)
SCHEMA = "doc_id long, rank int, n_tokens long, score double, ids_crc32 long, decodes boolean"

Found = list[tuple[float, tuple[int, ...]]]


def _key(piece: str) -> np.uint64:
    """Hash of a piece, as it is found inside words."""
    points = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
    with np.errstate(over="ignore"):
        return mix((_symbols(points) * powers(len(points))).sum(keepdims=True) + U64(len(points)) * _LENGTH)[0]


class Lattice:
    """Pieces of a model, and the n best segmentations of words and texts."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[int], n: int):
        self.pieces, self.bytes, self.n = pieces, bytes_, n
        self.longest = max(map(len, pieces), default=1)
        self.worst = min((s for _, s in pieces.values() if s > -1e8), default=0.0)
        self.lists: dict[str, Found] = {}
        self.known = Known(max((i for i, _ in pieces.values()), default=0) + 257, more=3)
        self.spell = {i: p.encode("utf-8", "surrogatepass") for p, (i, _) in pieces.items()}
        self.spell.update({i: bytes([b]) for b, i in enumerate(bytes_)})
        # pieces by hash in two tables: of those that share a slot of the first, all but one are in the second
        self.keys = np.array([_key(p) for p in pieces] or [0], dtype=U64)
        self.ids = np.array([i for i, _ in pieces.values()] or [-1], dtype=np.int32)
        self.scores = np.array([s for _, s in pieces.values()] or [-np.inf])
        self.slots = np.zeros((2, 1 << _SLOTS), dtype=np.int32)
        rows = np.arange(len(self.keys), dtype=np.int32)
        for k in range(2):
            self.slots[k, self._slot(self.keys[rows], k)] = rows
            rows = rows[self.slots[k, self._slot(self.keys[rows], k)] != rows]
        if len(rows):
            raise ValueError("too many pieces for the tables")

    @classmethod
    def load(cls, path: str, n: int) -> Lattice:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        across = [p for p in plain if MARK in p.lstrip(MARK)]
        if across:
            raise ValueError(f"pieces that hold a word mark after other characters span words, e.g. {across[0]!r}")
        return cls(plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)

    def _ending(self, text: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """Edges of the lattice that end at ``end``: start, ids, score; longer pieces first."""
        out = []
        for start in range(max(0, end - self.longest), end):
            if (piece := self.pieces.get(text[start:end])) is not None:
                out.append((start, (piece[0],), piece[1]))
        if text[end - 1] not in self.pieces:
            spelled = tuple(self.bytes[b] for b in text[end - 1].encode("utf-8", "surrogatepass"))
            out.append((end - 1, spelled, self.worst * len(spelled)))
        return out

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return ((keys >> U64(64 - _SLOTS * (table + 1))) & U64((1 << _SLOTS) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the piece with each hash, and whether there is one."""
        at = self.slots[0][self._slot(keys, 0)]
        hit = self.keys[at] == keys
        miss = np.nonzero(~hit)
        second = self.slots[1][self._slot(keys[miss], 1)]
        found = self.keys[second] == keys[miss]
        at[miss], hit[miss] = second, found
        return at, hit

    def word(self, text: str) -> Found:
        """The n best segmentations of one word: score and ids, best first."""
        found = self.lists.get(text)
        if found is None:
            if len(self.lists) >= _LISTS:
                self.lists.clear()
            found = self.lists[text] = self._search(text)
        return found

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Find the best segmentation of many words, and how much worse each one's next best is."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= _SHORT]
        for at in range(0, len(short), _TOGETHER):
            rows = short[at:at + _TOGETHER]
            self.known.add(hashes[rows], *self._learn([words[i] for i in rows.tolist()]))
        for i in order[len(short):].tolist():
            found = self._search(words[i])
            values = (found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf, float(self.spelling(found[0][1]) == words[i]))
            self.known.add(hashes[i:i + 1], np.array(found[0][1], dtype=np.int64), np.array([len(found[0][1])]), *[np.array([v]) for v in values])

    def _learn(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Viterbi forwards and backwards over words of like length, all at once.

        Returns the ids, how many each word has, its score, the loss of its
        next best, and whether its ids spell it.
        """
        count, size = len(words), len(words[-1])
        lengths = np.array([len(w) for w in words])
        points = np.zeros((count, size), dtype=np.uint32)
        points[np.arange(size) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sums = np.zeros((count, size + 1), dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(_symbols(points) * powers(size), axis=1, out=sums[:, 1:])
        scores, ids = [], []  # by length: of the edge that starts at each place
        for n in range(1, min(self.longest, size) + 1):
            with np.errstate(over="ignore"):
                raw = (sums[:, n:] - sums[:, :-n]) * powers(size + 1, inverse=True)[: size + 1 - n]
                keys = mix(raw + U64(n) * _LENGTH)
            at, hit = self.find(keys)
            hit &= np.arange(n, size + 1) <= lengths[:, None]
            scores.append(np.where(hit, self.scores[at], -np.inf))
            ids.append(np.where(hit, self.ids[at], -1))
        spelled = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        lone = (ids[0] < 0) & (np.arange(size) < lengths[:, None])
        scores[0] = np.where(lone, self.worst * spelled, scores[0])
        ahead = np.full((count, size + 1), -np.inf)
        ahead[:, 0] = 0
        step = np.zeros((count, size + 1), dtype=np.int64)
        for end in range(1, size + 1):
            options = np.stack([ahead[:, end - n] + scores[n - 1][:, end - n] for n in range(min(end, len(scores)), 0, -1)])
            pick = options.argmax(axis=0)  # the longest of the best
            ahead[:, end] = options[pick, np.arange(count)]
            step[:, end] = min(end, len(scores)) - pick
        behind = np.full((count, size + 1), -np.inf)
        behind[np.arange(count), lengths] = 0
        for start in range(size - 1, -1, -1):
            for n in range(1, min(len(scores), size - start) + 1):
                np.maximum(behind[:, start], scores[n - 1][:, start] + behind[:, start + n], out=behind[:, start])
        # the next best uses an edge off the best path
        through = [ahead[:, : size + 1 - n] + scores[n - 1] + behind[:, n:] for n in range(1, len(scores) + 1)]
        pieces = np.full((count, size), -2, dtype=np.int64)
        place = lengths.copy()
        row = np.arange(count)
        while (on := place > 0).any():
            r, n = row[on], step[row[on], place[on]]
            start = place[on] - n
            for k in np.unique(n).tolist():
                m = n == k
                pieces[r[m], start[m]] = ids[k - 1][r[m], start[m]]
                through[k - 1][r[m], start[m]] = -np.inf
            place[on] = start
        total = ahead[row, lengths]
        gap = total - np.max([t.max(axis=1) for t in through], axis=0)
        # byte pieces for the places that no piece covers
        odd = np.flatnonzero((pieces == -1).any(axis=1))
        flat, counts = pieces[pieces >= 0], (pieces >= 0).sum(axis=1)
        if len(odd):
            lines = pieces.tolist()
            found = [[i for i in lines[r] if i >= 0] for r in range(count)]
            for r in odd.tolist():
                found[r] = [x for k, i in enumerate(lines[r]) if i != -2 for x in ([i] if i >= 0 else [self.bytes[b] for b in words[r][k].encode("utf-8", "surrogatepass")])]
            flat, counts = np.array([i for f in found for i in f], dtype=np.int64), np.array([len(f) for f in found])
        whole = b"".join(map(self.spell.__getitem__, flat.tolist()))
        right = whole == "".join(words).encode("utf-8", "surrogatepass")
        return flat, counts, total, gap, np.full(count, float(right))

    def spelling(self, ids) -> str:
        """The word that ids spell: pieces joined, byte pieces put together."""
        return b"".join([self.spell[i] for i in ids]).decode("utf-8", "surrogatepass")

    def decoded(self, ids: np.ndarray) -> str:
        """The text that ids spell, without the mark put in front of it."""
        spelled = b"".join([self.spell.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")
        return spelled.removeprefix(MARK).replace(MARK, " ")

    def _search(self, text: str) -> Found:
        size = len(text)
        edges: list[list[tuple[int, tuple[int, ...], float]]] = [[]]
        ahead = [0.0] + [float("-inf")] * size
        for end in range(1, size + 1):
            edges.append(self._ending(text, end))
            ahead[end] = max(ahead[start] + score for start, _, score in edges[end])
        # queue entries: total score, order of arrival, place, score behind, ids behind as linked pairs
        queue: list = [(-ahead[size], 0, size, 0.0, None)]
        out: Found = []
        arrived = 0
        visits = [0] * (size + 1)  # whatever reaches a place after n others completes no better than each of them
        while queue and len(out) < self.n:
            _, _, place, behind, chain = heapq.heappop(queue)
            visits[place] += 1
            if visits[place] > self.n:
                continue
            if place == 0:
                ids: list[int] = []
                while chain is not None:
                    ids += chain[0]
                    chain = chain[1]
                out.append((behind, tuple(ids)))
                continue
            for start, ids_, score in edges[place]:
                arrived += 1
                heapq.heappush(queue, (-(ahead[start] + score + behind), arrived, start, behind + score, (ids_, chain)))
        return out

    def texts(self, texts: list[str]) -> list[list[tuple[float, bytes, bool]]]:
        """The n best segmentations of each text: score, ids as bytes, and whether they spell the text."""
        out: list[list[tuple[float, bytes, bool]]] = []
        group: list[str] = []
        held = 0
        for t in texts:
            if group and held + len(t) > _STEP:
                out += self._texts(group)
                group, held = [], 0
            group.append(t)
            held += len(t)
        return out + (self._texts(group) if group else [])

    def _texts(self, texts: list[str]) -> list[list[tuple[float, bytes, bool]]]:
        lines = [normal(t) for t in texts]
        whole = "".join(lines)
        if not whole:
            return [[(0.0, b"", True)] for _ in texts]
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
        # a word starts at the first of its marks, and where a text starts
        mark = points == ord(MARK)
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(points))
        hashes = spans(prefix(_symbols(points)), starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.known.size() > KEPT:
            self.known.clear()
        offset, count, score, loss, right = self.known.find(distinct)
        missing = np.flatnonzero(count < 0)
        if len(missing):
            a, b = starts[where[missing]].tolist(), ends[where[missing]].tolist()
            self.learn([whole[x:y] for x, y in zip(a, b, strict=True)], distinct[missing])
            offset, count, score, loss, right = self.known.find(distinct)
        counts = count[inverse]
        ids = self.known.gather(offset[inverse], counts)
        at = np.concatenate(([0], np.cumsum(counts)))
        scores, losses, fine = score[inverse], loss[inverse], right[inverse]
        words = np.searchsorted(starts, bounds)
        out = []
        for k in range(len(texts)):
            low, high = int(words[k]), int(words[k + 1])
            if low == high:
                out.append([(0.0, b"", True)])
                continue
            lost = losses[low:high]
            m = min(self.n - 1, high - low)
            few = np.argpartition(lost, m - 1)[:m] if m < high - low else np.arange(high - low)
            places = sorted(low + int(i) for i in few if lost[i] != np.inf)
            options = {i: self.word(whole[starts[i]:ends[i]]) for i in places}
            spelled = bool(fine[low:high].all())
            base = ids[at[low]:at[high]].tobytes()
            begin = int(at[low])
            found = []
            for total, changes in self._chain(places, options):
                parts, done = [], 0
                ok = spelled
                for i, c in changes:
                    parts += [base[done:4 * (int(at[i]) - begin)], array("I", options[i][c][1]).tobytes()]
                    done = 4 * (int(at[i + 1]) - begin)
                    ok = ok and self.spelling(options[i][c][1]) == whole[starts[i]:ends[i]]
                found.append((float(scores[low:high].sum()) - total, b"".join([*parts, base[done:]]), ok))
            out.append(found)
        return out

    def _chain(self, places: list[int], options: dict[int, Found]) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """The n least losses over the chain of words, with the words changed; no more than n - 1 words differ in any of them.

        Scores ahead are the best of all words, so the loss so far is the whole estimate.
        """
        queue: list = [(0.0, 0, len(places), ())]
        out = []
        arrived = 0
        while queue and len(out) < self.n:
            loss, _, at, changes = heapq.heappop(queue)
            if at == 0:
                out.append((loss, changes))
                continue
            i = places[at - 1]
            for k, (score, _) in enumerate(options[i]):
                arrived += 1
                heapq.heappush(queue, (loss + options[i][0][0] - score, arrived, at - 1, ((i, k), *changes) if k else changes))
        return out


def _symbols(points: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point; 0 is no symbol."""
    return mix(points.astype(U64) + U64(0x632BE5AB)) * (points > 0)


def normal(text: str) -> str:
    """The text as the lattice sees it; empty stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


@cache
def lattice(path: str, n: int) -> Lattice:
    """The worker's lattice for a model file."""
    return Lattice.load(path, n)


def segmentations(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """Per row of ``docs`` and rank: the segmentation's number of ids, score, CRC-32 of the ids, and whether they decode to the text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            out = []
            for doc_id, found in zip(part.column(0).to_pylist(), lattice(model, n).texts(batches.strings(part, "text")), strict=True):
                out += [(doc_id, rank, len(ids) // 4, score, zlib.crc32(ids), right) for rank, (score, ids, right) in enumerate(found, 1)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "rank", "n_tokens", "score", "ids_crc32", "decodes"])

    return batches.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def encode(docs: DataFrame, model: str, n: int = 1) -> DataFrame:
    """Per row of ``docs`` and rank: ``doc_id``, ``rank``, ``score`` and the ``ids`` of its ``n`` best segmentations; one narrow pass."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "text"):
            out = []
            for doc_id, found in zip(part.column(0).to_pylist(), lattice(model, n).texts(batches.strings(part, "text")), strict=True):
                out += [(doc_id, rank, score, np.frombuffer(ids, dtype=np.int32)) for rank, (score, ids, _) in enumerate(found, 1)]
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "rank", "score", "ids"])

    return batches.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``rank`` and the ``text`` that ``ids`` spell, for every row of a table like that of ``encode``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [lattice(model, 1).decoded(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string())], names=["doc_id", "rank", "text"])

    return batches.mapped(encoded.select(F.col("doc_id").cast("long"), F.col("rank").cast("int"), F.expr("filter(ids, i -> i is not null)").cast("array<int>").alias("ids")), run, "doc_id long, rank int, text string")
