"""Ranked search against brute force, and that blocks are left out before they are unpacked."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cropstats.llm import lexical

DOCS = "doc_id long, text string, shard int, term string, score string"
ITEMS = "item_id long, text string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def brute(docs: list[tuple], items: list[tuple], k: int) -> dict:
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = {}
    for item, query in asked.items():
        found = []
        for doc, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in query.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        if found:
            out[item] = [(rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(found)[:k], 1)]
    return out


def got(spark, docs: list[tuple], items: list[tuple], k: int = 20, parts: int = 5) -> dict:
    table = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS).repartition(parts)
    found: dict = {}
    for r in lexical.search(lexical.index(table), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS), k).collect():
        found.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {item: sorted(rows) for item, rows in found.items()}


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["Éa", "ça", "É", "日本", "x9", "İ"]
    return [(rng.choice([None, *range(n)]), "".join(rng.choice(words) + rng.choice(" \n,.-\x00_'") for _ in range(int(rng.paretovariate(0.6)) % 400))) for _ in range(n)]


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many shards, blocks, windows and groups of items
        for name, value in (("SHARD_DOCS", 150), ("BLOCK", 4), ("WINDOW", 32), ("ITEMS", 8), ("PIECE", 64)):
            monkeypatch.setattr(lexical, name, value)
    docs = [*corpus(1, 900), (None, None), (5, ""), (6, " -- "), (7, "same words"), (7, "same words"), (8, "same words"), (3, "long " * 300_000 + "w1"), (4, "x" * 70_000)]
    rng = random.Random(8)
    items = [(i, " ".join(t for _, x in rng.sample(docs[:900], 2) for t in x.split()[:20])) for i in range(30)]
    items += [(100, None), (101, ""), (102, "unknownword"), (103, "same same words W1"), (103, "W2"), (None, "w1 W1 w2"), (104, "x" * 70_000), (105, "É é"), (106, "same")]
    for k in (1, 20):
        assert got(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == {} and got(spark, [(1, "a")], []) == {} and got(spark, [], []) == {}


def test_lists_come_back_whole():
    rng = np.random.default_rng(4)
    df = np.array([1, 128, 129, 500, 3, 1000])
    lengths = rng.integers(1, 70_000, 200_000)
    doc = np.concatenate([np.sort(rng.choice(200_000, n, replace=False)) for n in df])
    tf = np.where(rng.random(len(doc)) < 0.05, rng.integers(1, 1 << 20, len(doc)), rng.integers(1, 200, len(doc)))
    columns = lexical.packed(df, doc, tf, lengths[doc])
    totals = lexical._Totals(200_000, int(lengths.sum()))
    m, ends = totals.scale(lengths), np.cumsum(df)
    for i, n in enumerate(df.tolist()):
        row = {"df": n, **{name: data.tobytes()[at[i]:at[i + 1]] for name, (at, data) in zip(lexical._LIST, columns, strict=True)}}
        made = lexical.PostingList(row, totals, m)
        found = [made.block(b) for b in range(len(made.last))]
        own = slice(ends[i] - n, ends[i])
        score = totals.score(tf[own], m[doc[own]])
        assert (np.concatenate([d for d, _ in found]) == doc[own]).all() and (np.concatenate([s for _, s in found]) == score).all()
        assert made.best[:-1].tolist() == [int(s.max()) for _, s in found]  # frontiers give the blocks' greatest scores exactly


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    n = 20_000
    lengths = np.full(n, 100, dtype=np.int64)
    common, rare = np.arange(n), np.arange(0, n, 997)
    tf = np.ones(n, dtype=np.int64)
    tf[rare[:3]] = 50
    totals = lexical._Totals(n, int(lengths.sum()))
    m = totals.scale(lengths)
    lists = []
    for doc, freq in ((common, tf), (rare, np.full(len(rare), 9))):
        row = {"df": len(doc), **{name: data.tobytes() for name, (_, data) in zip(lexical._LIST, lexical.packed(np.array([len(doc)]), doc, freq, lengths[doc]), strict=True)}}
        lists.append(lexical.PostingList(row, totals, m))
    best = lexical.Best(3)
    lexical.search_shard([(10, lists[0]), (5000, lists[1])], np.arange(n), np.zeros(n, dtype=bool), best)
    assert sorted(best.id.tolist()) == rare[:3].tolist()
    assert len(lists[0].blocks) < len(lists[0].last) // 4  # of the common list, which is not essential after the first window
