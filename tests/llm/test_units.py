"""The operators' task-side functions against brute force."""

from __future__ import annotations

import itertools
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest

from cropstats.llm import bpe, hashing, hnsw, html_text, jaccard, nbest, packing, passages, quality, suffix_dedup
from cropstats.llm.hashing import shingle_hashes, word_hashes


def test_bpe_ids_are_the_librarys():
    encoder = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    letters = list(" \n\t'straevmld0129.,!é中²½\x1c\x85😀ǅS ")
    texts = ["", "it's 'rel i'll'd 'v", "<|endoftext|> a", "a " * 400_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_letters_newer_than_pythons_are_the_librarys():
    encoder = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    kinds = {"L": 1, "N": 2}
    unlike = [c for c in range(0x80, 0x110000) if bpe._classes()[c] < 3 and kinds.get(unicodedata.category(chr(c))[0]) != bpe._classes()[c]]
    texts = [f"x'll{c}'ll {c}'s 1{c} !{c} a{c}" for c in map(chr, [0xA7CB, *unlike, *range(0x80, 0xD800, 97), *range(0xE000, 0x110000, 997)])]
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids(texts)] == whole


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(path)
    texts = ["a<|endoftext|> b", "", "<|endoftext|>", "x", "<|endoftext|><|endoftext|>it's\n <|endoftext| >", "a " * 300_000 + " <|endoftext|>b c"]
    assert [x.tolist() for x in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.ids(["a<|endoftext|> b"])[0].tolist() == [64, 50256, 275]


def test_word_hashes_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    text = b"ab cd\tef " * 5000
    whole = word_hashes(text)
    monkeypatch.setattr("cropstats.llm.hashing._STEP", 1000)
    assert (word_hashes(text) == whole).all() and len(set(whole.tolist())) == 3


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100)])
def test_similar_sets_share_a_signature(num, den):
    rng = np.random.default_rng(3)
    for _ in range(400):
        size = int(rng.integers(2, 400))
        u = rng.integers(1, 2**63, size, dtype=np.uint64)
        lost, more = int(rng.integers(0, size // 6 + 1)), int(rng.integers(0, size // 6 + 1))
        v = np.concatenate((u[lost:], rng.integers(1, 2**63, more, dtype=np.uint64)))
        u, v = np.unique(u), np.unique(v)
        common = len(np.intersect1d(u, v))
        if den * common >= num * (len(u) + len(v) - common) and len(np.setxor1d(u, v)):
            assert set(jaccard.signatures(u, num, den).tolist()) & set(jaccard.signatures(v, num, den).tolist())


def test_suffixes_come_in_order():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(90)) for _ in range(40)]
    texts[7] = texts[3]
    owners = np.arange(40)
    low, high = np.zeros(40, dtype=np.int64), np.full(40, 70, dtype=np.int64)
    for length in (8, 13, 20):
        seen: dict[bytes, int] = {}
        for i, t in enumerate(texts):
            for p in range(71):
                seen[t[p:p + length]] = min(i, seen.get(t[p:p + length], i))
        expected = {(i, p) for i, t in enumerate(texts) for p in range(71) if seen[t[p:p + length]] < i}
        got = {(i, p) for i, a, b in suffix_dedup.repeats(texts, owners, low, high, length) for p in range(a, b + 1)}
        assert got == expected


def test_windows_that_no_other_text_has_are_not_sorted(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.randrange(256) for _ in range(300)) for _ in range(20)]
    texts[9] = texts[4][:80] + texts[9][80:]
    sorted_, sort = [], suffix_dedup.sort_suffixes
    monkeypatch.setattr(suffix_dedup, "sort_suffixes", lambda padded, at, depth: sorted_.append(len(at)) or sort(padded, at, depth))
    got = suffix_dedup.repeats(texts, np.arange(20), np.zeros(20, dtype=np.int64), np.full(20, 250, dtype=np.int64), 50)
    assert got == [(9, 0, 30)] and 62 <= sum(sorted_) < 1500  # of 5,020 windows; a few share a hash slot
    assert suffix_dedup.repeats(texts[:4], np.arange(4), np.zeros(4, dtype=np.int64), np.full(4, 250, dtype=np.int64), 50) == []


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    shared = bytes(rng.randrange(97, 123) for _ in range(50))
    keys = [set(suffix_dedup.anchors(bytes(rng.randrange(97, 123) for _ in range(n)) + shared + b"x" * n, 50, 18)[1].tolist()) for n in (0, 7, 300)]
    assert keys[0] & keys[1] & keys[2]
    assert len(suffix_dedup.anchors(b"short", 50, 18)[0]) == 0


def test_shingles_of_all_texts_are_those_of_each():
    texts = [b"", b"One two three", b"a b c d e f g", b"   ", b"x", b"A B\tc\nd e", b"long " * 300_000]
    for short in (True, False):
        got = hashing.shingles_of_all(texts, 4, short)
        for text, s in zip(texts, got, strict=True):
            assert s.tolist() == hashing.shingle_hashes(hashing.word_hashes(text.lower()), 4, short).tolist()


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(3)
    for size, least in ((8, 1), (40, 1), (40, 4), (40, 7), (7, 7), (6, 7)):
        values = rng.integers(0, 30, 2 * size).astype(np.uint64) << np.uint64(32)
        low, high = np.array([0, size]), np.array([size, 2 * size])
        windows = list(zip(*passages.compact_windows(values, low, high, least), strict=True))
        for start, stop in zip(low, high, strict=True):
            for i, j in itertools.combinations_with_replacement(range(start, stop), 2):
                inside = [at for low_, at, high_ in windows if low_ <= i <= at <= j <= high_]
                if j - i + 1 >= least:
                    assert inside == [i + int(values[i:j + 1].argmin())]
        assert all(high_ - low_ + 1 >= least and (low_ < size) == (high_ < size) for low_, _, high_ in windows)


def test_passages_are_found_and_clean_text_is_left():
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(f"p{i}" for i in range(60))
    a = (" ".join(words[:80]) + " " + passage + " " + " ".join(words[80:150])).encode()
    b = (" ".join(words[200:260]) + " " + passage + " " + " ".join(words[260:300])).encode()
    found = passages.matched_spans(passages.shingles(a, 5), passages.shingles(b, 5), 46, 5, 0.8)
    assert (80, 140) in found and all(80 <= s and e <= 140 for s, e in found)
    kept, n, gone, runs = passages.cut(a, found)
    assert (n, gone, runs) == (210, 60, 1) and b"p0" not in kept and kept.split() == [w.encode() for w in words[:150]]
    assert passages.matched_spans(passages.shingles(a, 5), passages.shingles(b"x y", 5), 46, 5, 0.8) == []


def brute_spans(a: list[str], b: list[str], least: int, words: int, similarity: float) -> set[int]:
    """Words of ``a`` in stretches that reach the similarity with some stretch of ``b``, the ends of both being matches; by trying all."""
    x, y = ([tuple(t[k:k + words]) for k in range(len(t) - words + 1)] for t in (a, b))
    in_x, in_y = set(x), set(y)
    ends = [k for k, s in enumerate(x) if s in in_y]
    marks = [k for k, s in enumerate(y) if s in in_x]
    gone: set[int] = set()
    for i, j in itertools.combinations(ends, 2):
        mine = set(x[i:j + 1])
        if j - i + 1 < least or gone >= set(range(i, j + words)):
            continue
        for k, m in itertools.combinations(marks, 2):
            if similarity * (j - i + 1) <= m - k + 1 <= (j - i + 1) / similarity:
                other = set(y[k:m + 1])
                common = len(mine & other)
                if {x[i], x[j]} <= other and {y[k], y[m]} <= mine and common >= similarity * (len(mine) + len(other) - common):
                    gone |= set(range(i, j + words))
                    break
    return gone


def test_changed_passages_are_found_as_by_brute_force():
    rng = random.Random(11)
    found_any = 0
    for case in range(45):
        size, changes = rng.randint(14, 34), case % 3 + 1
        passage = [f"p{k}" for k in range(size)]
        other = list(passage)
        for c in range(changes):
            at = rng.randrange(1, len(other) - 1)
            kind = (case // 3 + c) % 3
            other[at:at + (kind != 1)] = [] if kind == 2 else [f"n{case}.{c}"]
        a = [f"a{k}" for k in range(rng.randint(0, 9))] + passage + [f"b{k}" for k in range(rng.randint(0, 9))]
        b = [f"c{k}" for k in range(rng.randint(0, 9))] + other + [f"d{k}" for k in range(rng.randint(0, 9))]
        for x, y in ((a, b), (b, a)):
            spans = passages.matched_spans(*(passages.shingles(" ".join(t).encode(), 2) for t in (x, y)), 12, 2, 0.8)
            got = {k for s, e in spans for k in range(s, e)}
            assert got == brute_spans(x, y, 12, 2, 0.8)
            found_any += bool(got)
    assert 20 < found_any < 90


@pytest.mark.parametrize("change", ["changed", "inserted", "deleted"])
def test_one_change_in_the_middle_of_a_short_passage(change):
    passage = [f"p{k}" for k in range(70)]
    other = passage[:35] + {"changed": ["new"], "inserted": ["new", "p35"], "deleted": []}[change] + passage[36:]
    a, b = (passages.shingles(" ".join(t).encode(), 5) for t in (["x"] * 9 + other + ["y"], ["z"] * 20 + passage))
    assert passages.matched_spans(a, b, 46, 5, 0.8) == [(9, 9 + len(other))]


def test_gaps_repeated_lines_and_stray_matches_do_not_part_a_passage():
    passage = [f"p{k}" for k in range(300)]
    line = passage[20:40]
    a = passage[:150] + [f"n{k}" for k in range(20)] + passage[150:]
    b = line + ["u"] + line + ["v"] + passage[100:110] + ["w"] + passage + line
    assert passages.matched_spans(*(passages.shingles(" ".join(t).encode(), 5) for t in (a, b)), 46, 5, 0.8) == [(0, 320)]


def brute_segmentations(lattice: nbest.Lattice, text: str, n: int) -> list[float]:
    text = nbest.normal(text)

    def scores(end: int) -> list[float]:
        return [0.0] if end == 0 else [s + more for start, _, s in lattice._ending(text, end) for more in scores(start)]

    return sorted(scores(len(text)), reverse=True)[:n]


def test_nbest_equals_brute_force_and_decodes():
    lattice = nbest.Lattice.load(public_tokenizers.path("piece_bpe_32k.model"), 4)
    rng = random.Random(3)
    texts = ["".join(rng.choice("thean do ▁ï中\n") for _ in range(rng.randint(0, 10))) for _ in range(300)]
    for text, found in zip(texts, lattice.texts(texts), strict=True):
        assert [s for s, _, _ in found] == brute_segmentations(lattice, text, 4)
        assert len({ids for _, ids, _ in found}) == len(found) and all(right for _, _, right in found)
    long = "x" * 200 + " " + "ab " * 50
    assert all(right for _, _, right in lattice.texts([long])[0])


def test_pieces_that_span_words_are_refused(monkeypatch):
    class Model:
        def __init__(self, model_file):
            self.pieces = ["a", "a▁b"]

        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return self.pieces[i]

        def get_score(self, i):
            return -1.0

        is_byte = is_control = is_unknown = is_unused = lambda self, i: False

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="span words"):
        nbest.Lattice.load("x", 1)


def test_best_fit_and_crossover_keep_every_piece():
    rng = random.Random(2)
    lengths = np.array([rng.randint(1, 100) for _ in range(300)])
    bins, score = packing.evolve(lengths, [], 100, 4, 6, rng)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 100 and fill.sum() == lengths.sum() and 0 < score <= 1
    other, _ = packing.evolve(lengths, [], 100, 1, 0, rng)
    child = packing.crossover(bins, other, lengths, 100, rng)
    assert (child >= 0).all() and np.bincount(child, weights=lengths).max() <= 100


def test_graph_recall_and_inner_product_of_unlike_norms():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 16)).astype(np.float32) * rng.uniform(0.5, 2, (800, 1)).astype(np.float32)
    norms = (x.astype(np.float64) ** 2).sum(axis=1)
    graph = hnsw.Graph.build(np.column_stack((x, np.sqrt(norms.max() - norms))).astype(np.float32), 12, 64, 1)
    hit = 0
    for i in range(60):
        best = set(np.argsort(-(x @ x[i]))[:10].tolist())
        hit += len(best & set(graph.search(np.append(x[i], np.float32(0)), 64)))
    assert hit / 600 >= 0.9


def test_classifier_separates_and_handles_one_class():
    good, bad = [b"plain words in a row %d" % i for i in range(60)], [b"PLAIN!! WORDS## %d" % i for i in range(60)]
    rows = [quality.features(t) for t in good + bad]
    labels = np.array([1] * 60 + [0] * 60)
    order = np.random.default_rng(1).permutation(120)
    (r, w), slope, offset = quality.fit([rows[i] for i in order], labels[order])
    margin = [float(w[x] @ quality.scaled(x, r)) * slope + offset for x in rows]
    assert min(margin[:60]) > max(margin[60:])
    assert quality.fit([], np.array([], dtype=np.int64))[1:] == (0.0, 0.0)
    assert quality.fit(rows[:5], np.ones(5, dtype=np.int64))[2] > 0 and len(quality.features(b"")) == 0


@pytest.mark.parametrize("page,text", [
    ("", ""), ("<p", ""), ("<p>a &amp b &#x41;</p>", "a & b A"),
    ("<body><nav><a href=x>Home</a></nav><div class='ad'>Buy, now.</div><article><h1>T</h1><p>One,  two.<p>Three.</article><footer>f</footer>", "T\nOne, two.\nThree."),
    ("<article><p>Text, it is long.</p><section class='comments'><p>I say, no.</p></section><form><p>x</p></form><script>'</p>'</script></article>", "Text, it is long."),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_main_text_is_chosen_by_ratios_not_by_the_article_element():
    body = [f"Sentence {k}, which is long enough to count, ends here. And a second one, as long, follows it." for k in range(6)]
    teaser = "A teaser, quite long as teasers go, that says: read on, there is more. It is one block, no more."
    page = f"<body><div><p>{'</p><p>'.join(body)}</p></div><article><p>{teaser}</p></article></body>"
    assert set(body) <= set(html_text.main_text(page).split("\n"))
    assert html_text.main_text(f"<body><div><h1>Title</h1><p>{body[0]}</p><p>Short.</p></div></body>").split("\n") == ["Title", body[0], "Short."]


def test_shingles_of_short_texts():
    assert len(shingle_hashes(word_hashes(b"a b"), 4, True)) == 1 and len(shingle_hashes(word_hashes(b"a b"), 4, False)) == 0
    assert len(shingle_hashes(word_hashes(b" \n"), 4, True)) == 0 and zlib.crc32(b"") == 0
