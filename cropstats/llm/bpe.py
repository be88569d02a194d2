"""Token ids of whole texts by the tokenizers library, one call for each distinct pre-token.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts, so a
text's ids are the ids of its pieces in order. The pieces are found with numpy
over code points, equal pieces are found by hash, and the library encodes only
those that this worker has not seen. On the made-up words of the test tables
this is several times as fast as encoding each text; the ids are the same,
which ``tests/llm/test_units.py`` checks.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np

from cropstats.llm.hashing import U64, mix, prefix, spans

#: Code points worked on at a time, and pre-tokens whose ids a worker keeps.
STEP = 1 << 19
KEPT = 2_000_000
_JOINED = 64
_FRESH = 1 << 17
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_APOSTROPHE, _BLANK = ord("'"), ord(" ")
#: The endings that the public byte-level pre-tokenizer cuts off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other, as the library's own pre-tokenizer has them.

    The pre-tokenizer cuts the string of all code points where the class
    changes; the first of each run is then tried beside one of a known class.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cuts = ByteLevel(add_prefix_space=False).pre_tokenize_str

    def kind(c: str) -> int:
        return next((k for k, known in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(cuts(known + c)) == 1), _SPACE)

    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x80):  # blanks and apostrophes join what is not of their class
        out[c] = kind(chr(c))
    for low, high in ((0x80, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(low, high)))
        for _, (start, end) in cuts(text):
            out[low + start:low + end] = kind(text[start])
    return out


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start in code points of several texts; ``firsts``: where the texts start."""
    n = len(points)
    kind = _classes()[points]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new[firsts] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    opens = np.zeros(n + 1, dtype=bool)
    opens[firsts] = True
    opens[n] = True
    space = kind[starts] == _SPACE
    cut = new  # reused: from run starts to piece starts
    # a white-space run that text follows gives its last character away; a blank joins what follows
    s, e = starts[space], ends[space]
    inner = ~opens[e]
    last = e[inner] - 1
    blank = points[last] == _BLANK
    cut[last] = True
    cut[last[blank] + 1] = False
    # an apostrophe alone, with no blank before it, takes one of the endings along
    lone = starts[(points[starts] == _APOSTROPHE) & (ends - starts == 1)]
    for i in lone.tolist():
        if not cut[i] or opens[i + 1]:
            continue
        for ending in _ENDINGS:
            m = len(ending)
            if i + m < n and not opens[i + 1:i + 1 + m].any() and all(points[i + 1 + j] == ord(c) for j, c in enumerate(ending)):
                cut[i + 1] = False
                if i + 1 + m < n:
                    cut[i + 1 + m] = True
                break
    return np.flatnonzero(cut)


class Encoder:
    """Encodes lists of texts with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library takes added tokens out of a text first, the longest where several begin
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in or ask for what is beside them are not supported")
        self.added = {t.content: i for i, t in added.items()}
        self.cuts = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if added else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.known = Known(max(vocabulary.values()) + 1)
        # a byte-level vocabulary spells each byte as one character
        self.token_bytes = np.zeros(max(vocabulary.values()) + 2, dtype=np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.cuts is None or not any(self.cuts.search(t) for t in texts):
            return self._plain(texts)
        pieces: list[list[str]] = [[x for x in self.cuts.split(t) if x is not None] for t in texts]
        plain = iter(self._plain([x for p in pieces for x in p if x not in self.added]))
        return [np.concatenate([np.array([self.added[x]], dtype="<u4") if x in self.added else next(plain) for x in p]) for p in pieces]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        out: list[np.ndarray] = []
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text) > STEP:
                out += self._encode(group)
                group, held = [], 0
            if len(text) > STEP:
                out.append(np.concatenate([self._encode([part])[0] for part in _parts(text)]))
                continue
            group.append(text)
            held += len(text)
        return out + (self._encode(group) if group else [])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        whole = "".join(texts)
        if not whole:
            return [np.empty(0, dtype="<u4") for _ in texts]
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        starts = piece_starts(points, np.unique(bounds[:-1][lengths > 0]))
        ends = np.append(starts[1:], len(points))
        with np.errstate(over="ignore"):
            hashes = spans(prefix(mix(points.astype(U64) + U64(0x51ED2701))), starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.known.size() > KEPT:
            self.known.clear()
        offset, count = self.known.find(distinct)
        missing = np.flatnonzero(count < 0)
        if len(missing):
            at = where[missing]
            flat, sizes = self._encode_pieces(whole, points, starts[at], ends[at])
            self.known.add(distinct[missing], flat, sizes)
            offset, count = self.known.find(distinct)
        counts = count[inverse]
        after = np.cumsum(counts)
        ids = self.known.gather(offset[inverse], counts)
        # ids before each text: those of the pieces that start before it
        cuts = np.concatenate(([0], after))[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


    def _encode_pieces(self, whole: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pieces, one after the other, and how many each has.

        Pieces of a blank and a word go to the library joined, since each call
        costs more than a piece: they come apart again at their blanks, and
        byte-level tokens say how many bytes each one covers.
        """
        joins = (points[starts] == _BLANK) & (_classes()[points[ends - 1]] != _SPACE)
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        a, b = starts[order].tolist(), ends[order].tolist()
        words = [whole[x:y] for x, y in zip(a, b, strict=True)]
        n = int(joins.sum())
        ids = array("I")
        for e in self.tokenizer.encode_batch_fast(["".join(words[i:min(i + _JOINED, n)]) for i in range(0, n, _JOINED)], add_special_tokens=False):
            ids.extend(e.ids)
        covered = np.cumsum(self.token_bytes[np.frombuffer(ids, dtype=np.uint32)])
        size = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)))
        stop = np.searchsorted(covered, np.cumsum(size[ends[order[:n]]] - size[starts[order[:n]]])) + 1
        sizes = np.diff(stop, prepend=0).tolist()
        for e in self.tokenizer.encode_batch_fast(words[n:], add_special_tokens=False):
            sizes.append(len(e.ids))
            ids.extend(e.ids)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        sizes = np.array(sizes, dtype=np.int64)
        from_ = (np.cumsum(sizes) - sizes)[back]
        sizes = sizes[back]
        end = np.cumsum(sizes)
        at = np.repeat(from_ - (end - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.frombuffer(ids, dtype=np.uint32)[at], sizes


class Known:
    """Ids of pieces by the pieces' hashes, with more values for each: sorted arrays, about 30 bytes a piece."""

    def __init__(self, vocabulary: int, more: int = 0):
        self.kind, self.more = np.uint16 if vocabulary <= 1 << 16 else np.uint32, more
        self.clear()

    def clear(self) -> None:
        self.ids = np.empty(0, dtype=self.kind)
        self.main = self.fresh = self._empty()

    def _empty(self) -> tuple[np.ndarray, ...]:
        return (np.empty(0, dtype=U64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), *[np.empty(0) for _ in range(self.more)])

    def size(self) -> int:
        return len(self.main[0]) + len(self.fresh[0])

    def find(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each hash where its ids start, how many there are (-1: unknown), and its other values."""
        out = [np.zeros(len(hashes), dtype=np.int64), np.full(len(hashes), -1, dtype=np.int64), *[np.zeros(len(hashes)) for _ in range(self.more)]]
        for keys, *values in (self.main, self.fresh):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                for x, v in zip(out, values, strict=True):
                    x[hit] = v[at[hit]]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, *more: np.ndarray) -> None:
        starts = np.cumsum(sizes) - sizes + len(self.ids)
        self.ids = np.concatenate((self.ids, ids.astype(self.kind)))
        self.fresh = _merged(self.fresh, (hashes, starts, sizes.astype(np.int32), *more))
        if len(self.fresh[0]) > _FRESH:
            self.main, self.fresh = _merged(self.main, self.fresh), self._empty()

    def gather(self, offset: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of pieces one after the other."""
        after = np.cumsum(counts)
        at = np.repeat(offset - (after - counts), counts)
        at += np.arange(len(at))
        return self.ids[at].astype("<u4")


def _merged(a: tuple, b: tuple) -> tuple:
    joined = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(joined[0], kind="stable")
    return tuple(x[order] for x in joined)


def _parts(text: str) -> list[str]:
    """Cut a long text where a piece surely starts: at a blank between two letters."""
    out, at = [], 0
    while len(text) - at > STEP:
        cut = -1
        probe = at + STEP
        while probe + 1 < len(text):
            probe = text.find(" ", probe)
            if probe < 0 or probe + 1 >= len(text):
                break
            if _classes()[ord(text[probe - 1])] == _classes()[ord(text[probe + 1])] == _LETTER:
                cut = probe
                break
            probe += 1
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)
