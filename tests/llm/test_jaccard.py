"""The n-gram join against brute force over whole small corpora."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropstats.llm import jaccard, scratch

SCHEMA = "doc_id long, text string, key long, cls string, lang string"


def shingles(text: str | None, words: int) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows: list[tuple], words: int, num: int, den: int) -> dict:
    sets = {i: shingles(t, words) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(rng: random.Random) -> list[tuple]:
    """Families of texts around the threshold, chains of small changes, and lines that very many share."""
    word = lambda: f"w{rng.randrange(4000)}"
    line = [word() for _ in range(30)]
    rows, at = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 4, 8, 25, 60, 150, 400]))]
        for _ in range(rng.randint(2, 14)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 18)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                base = text  # a chain: the next differs from this one
            rows.append((at, " ".join(text)))
            at += 1
    for _ in range(60):  # unlike texts with a common passage
        rows.append((at, " ".join([word() for _ in range(rng.randint(5, 12))] + line + [word() for _ in range(rng.randint(0, 8))])))
        at += 1
    return rows


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 80, 100)])
def test_components_are_those_of_all_links(spark, words, num, den):
    rng = random.Random(words)
    rows = corpus(rng)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c"), (906, "A  b\nC"), (907, "x " * 70_000), (908, "x " * 70_000 + "y")]
    odd = [rows[3], rows[3], (None, rows[5][1]), (None, None)]
    frame = spark.createDataFrame([(i, t, 7, "c", "l") for i, t in [*rows, *odd]], SCHEMA).repartition(5)
    made = jaccard.groups(frame, words, num, den).collect()
    assert len(made) == len(rows) + len(odd)
    want = brute(rows, words, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made if r.doc_id is not None} == want
    assert all(r.component_id is None for r in made if r.doc_id is None)
    kept = {r.doc_id for r in jaccard.deduplicated(frame, words, num, den).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i} | {None}


def test_parities_never_exceed_the_distance():
    rng = np.random.default_rng(4)
    for _ in range(300):
        common, mine, yours = (rng.integers(1, 2**63, rng.integers(0, n), dtype=np.uint64) for n in (800, 60, 60))
        a, b = np.unique(np.append(common, mine)), np.unique(np.append(common, yours))
        flips = sum(int(x).bit_count() for x in (jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64))
        assert flips <= len(np.setxor1d(a, b)) and (flips == 0 or len(np.setxor1d(a, b)))


def test_unlike_members_of_a_large_group_make_few_pairs(spark, monkeypatch):
    rng = random.Random(9)
    line = [f"l{i}" for i in range(60)]
    rows = [(i, " ".join([f"u{rng.randrange(10**6)}" for _ in range(25)] + line + [f"v{rng.randrange(10**6)}" for _ in range(12)])) for i in range(300)]
    seen = []
    compared = jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda pairs, *more: (seen.append(scratch.stored(pairs, "test-pairs").count()), compared(pairs, *more))[1])
    made = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert made.where(F.col("component_id") < F.col("doc_id")).isEmpty()
    assert sum(seen) < 3 * len(rows)


def test_inner_tables_are_deleted(spark):
    frame = spark.createDataFrame([(i, f"a b c d e f g h {'x' if i % 2 else 'y'} {i % 5}") for i in range(40)], "doc_id long, text string")
    before = scratch.mark()
    out = jaccard.deduplicated(frame, 4, 85, 100)
    assert scratch.mark() - before == 1  # what the result reads
    assert out.count() > 0
