"""The Merkle manifest and the ranks against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cropstats.llm import merkle, ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank int"


def sha(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row: tuple) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The hash that remains, and each node's (before, after) by level."""
    paths: list[list] = [[] for _ in nodes]
    at, level = list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 3 * 3
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + 3])))
            at[i] = p // 3
        level = [sha(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: climb([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in order}
    root, above = climb([below[g][0] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for r, path in zip(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), below[g][1], strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            held = leaf((r[0], r[1].replace("\n", ""), *r[2:])) if bad else leaf(r)
            for before, after in path + up:
                held = sha(before, held, after)
            out.append((r[0], leaf(r), below[g][0], root, sha(*[b + a for b, a in path + up]), held, held == root))
    return sorted(out, key=str)


def got(spark, rows: list[tuple]) -> list[tuple]:
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in merkle.checked(frame).collect()], key=str)


@pytest.mark.parametrize("sizes", [[1], [4, 1, 28, 3, 2, 9]])
def test_small_trees(spark, sizes):
    rows = [(g * 1000 + i, f"t{i}\nend" if i % 3 else None, "en", f"s{g}", 5) for g, n in enumerate(sizes) for i in range(n)]
    assert got(spark, rows) == brute(rows)


def test_groups_over_many_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, "", "a\nb", "é\n" * 50, "x"]), rng.choice([None, "", "en"]), rng.choice(["hot"] * 9 + [None, "", "é", "z", "Z"]), rng.choice([None, 3])) for _ in range(300)]
    rows += [rows[0]] * 60  # repeated rows
    rows += [(i, "full", "en", "exactly nine", 1) for i in range(9)] + [(i, "full", "en", "exactly 81", 1) for i in range(81)]
    assert got(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_a_long_text_is_hashed_whole(spark):
    rows = [(1, "word\n" * 200_000, "en", "a", 1), (2, "word\n" * 200_000 + "x", "en", "a", 1)]
    assert got(spark, rows) == brute(rows)


def test_proofs_name_the_row(spark):
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(40)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    made = merkle.manifest(frame).collect()
    assert len({r.leaf for r in made}) == 40 and all(len(r.path) == 4 for r in made)
    swapped = merkle.manifest(frame).select(merkle.folded(merkle.leaf([F.lit("other")]), F.col("path")).alias("f"), "root").where("f = root")
    assert swapped.count() == 0


def test_ranks_over_ranges(spark):
    values = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", i % 50, i) for i in range(2000)]
    frame = spark.createDataFrame(values, "g string, v int, id int").repartition(5)
    out = ranks.ranked(frame, "g", [F.col("v").asc(), F.col("id").asc()], "test-ranks").collect()
    want = {}
    for g in {v[0] for v in values}:
        for k, v in enumerate(sorted([v for v in values if v[0] == g], key=lambda v: v[1:])):
            want[v[2]] = k
    assert {r.id: r["rank"] for r in out} == want
