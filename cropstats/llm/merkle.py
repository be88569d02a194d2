"""Merkle manifest of a dataset: every row's hash, a root over all, and a proof for each row.

A leaf is the SHA-256 of a row's columns. Per group (``source``) the leaves
stand in ascending order; while more than one node remains, every ``BRANCH``
consecutive ones become the SHA-256 of their hashes, and what remains is the
group's subroot. The subroots, ordered by group, give the root the same way.

Nested-struct rollup: a node's rank is written as digits in base ``BRANCH``.
The rows of a block (``BRANCH ** DEPTH`` consecutive ranks of one group) meet by
one shuffle, and the digits are grouped away one after the other, lowest first,
each step nesting the children's structs in their parent's; Spark needs no
further exchange for these steps. A block is then one row, a tree of at most 729
leaves, whatever the size of its group. Blocks' hashes are the leaves of the next
round, until a group has one block. Proofs come down the same way: a tree is
exploded level by level, each step adding the siblings' hashes to the path, so
rows never meet their siblings in a join. Only one row per block, with the path
from the block to the root, joins the block below it (keys are unique).

Defined cases: a null column counts as ``-`` and differs from empty text; a null
group is a group of its own and comes first; a null id comes first in its group;
rows with one id are ordered by their leaf; repeated rows are leaves each; an
empty table gives no row; other columns are not read. Texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropstats.llm import ranks, scratch

BRANCH = 3
#: Levels of a block's tree.
DEPTH = 6
BLOCK = BRANCH ** DEPTH
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(columns: list[Column]) -> Column:
    """The hash of a row: each value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """One row per block of ``nodes`` (group, rank, node): its tree, its hash, and whether it is its group's only one."""
    digits = [f"d{i}" for i in range(DEPTH)]
    rows = nodes.select("group", F.expr(f"rank div {BLOCK}").alias("block"), *[F.expr(f"CAST(rank div {BRANCH ** i} % {BRANCH} AS INT)").alias(d) for i, d in enumerate(digits)], "node", F.lit(1).alias("n"))
    rows = rows.repartition("group", "block")
    for i, digit in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("place"), "node")))
        rows = rows.groupBy("group", "block", *digits[i + 1:]).agg(kids.alias("kids"), F.sum("n").alias("n"))
        rows = rows.withColumn("node", F.struct(sha(F.concat_ws("", F.transform("kids", lambda k: hexed(k["node"]["hash"])))).alias("hash"), "kids")).drop("kids")
    # a block that is not full is its group's last one; if it is the first too, levels with one node were not needed
    alone = (F.col("block") == 0) & (F.col("n") < BLOCK)
    return scratch.stored(rows.select("group", "block", "node", alone.alias("alone"), F.when(alone, _lone(F.col("node"), DEPTH)).otherwise(F.col("node.hash")).alias("hash")), name)


def _lone(node: Column, depth: int) -> Column:
    """The hash of the topmost node with more than one child, or of the only leaf."""
    if not depth:
        return node["hash"]
    return F.when(F.size(node["kids"]) == 1, _lone(node["kids"][0]["node"], depth - 1)).otherwise(node["hash"])


def _tree(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of every round, lowest first; in the last each group has one block."""
    rounds = [_blocks(nodes, name)]
    while (rounds[-1].agg(F.max("block")).first()[0] or 0) > 0:
        rounds.append(_blocks(rounds[-1].select("group", F.col("block").alias("rank"), F.struct("hash").alias("node")), name))
    return rounds


def _down(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The leaves' nodes with their paths: ``paths`` (group, path and more) is taken down through the blocks of all rounds.

    A path is an array of the hashes before and after the node at each level, as
    hex text, from the leaf to the root.
    """
    carried = [c for c in paths.columns if c not in ("group", "path")]
    at = paths.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        up = at.withColumnsRenamed({"group": "__group", "block": "__block"})
        rows = blocks.join(up, blocks["group"].eqNullSafe(up["__group"]) & (blocks["block"] == up["__block"])).select("group", "block", *carried, "node", "path", "alone")
        rows = rows.withColumn("rank", F.col("block"))
        for _ in range(DEPTH):
            rows = rows.withColumn("hashes", F.transform("node.kids", lambda k: hexed(k["node"]["hash"])))
            rows = rows.select("group", *carried, "rank", "alone", "path", "hashes", F.posexplode("node.kids").alias("place", "kid"))
            only = F.col("alone") & (F.size("hashes") == 1)
            step = F.struct(F.concat_ws("", F.slice("hashes", F.lit(1), F.col("place"))).alias("before"), F.concat_ws("", F.slice("hashes", F.col("place") + 2, F.lit(BRANCH))).alias("after"))
            rows = rows.select("group", *carried, (F.col("rank") * BRANCH + F.col("place")).alias("rank"), only.alias("alone"),
                               F.when(only, F.col("path")).otherwise(F.concat(F.array(step), "path")).alias("path"), F.col("kid.node").alias("node"))
        at = rows.select("group", *carried, F.col("rank").alias("block"), "path")
    return rows.select("group", *carried, "path", "node")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (32 bytes) and its path lead to, as hex text."""
    return F.aggregate(path, hexed(leaf), lambda held, step: F.sha2(F.concat(step["before"], held, step["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings' hashes of a path, level by level, left to right, as one hex text."""
    return F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"])))


def manifest(docs: DataFrame, columns: list[str] = COLUMNS, group: str = "source", order: str = "doc_id", carried: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: its ``order`` column, ``leaf``, ``subroot``, ``root`` (hex texts) and ``path``.

    ``carried`` adds columns computed from ``docs`` beside each leaf.
    """
    more = carried or {}
    node = F.struct(leaf([F.col(f"`{c}`") for c in columns]).alias("hash"), F.col(f"`{order}`").alias("id"), *[c.alias(n) for n, c in more.items()])
    leaves = scratch.stored(docs.select(F.col(f"`{group}`").cast("string").alias("group"), node.alias("node")), "merkle-leaves")
    # the row's place in the written table parts repeated rows, of which one range could not hold a third of a table
    placed = ranks.ranked(leaves.withColumn("copy", F.monotonically_increasing_id()), "group", [F.col("node.id").asc_nulls_first(), F.col("node.hash").asc(), F.col("copy").asc()], "merkle-ranks")
    rounds = _tree(placed.select("group", "rank", "node"), "merkle-blocks")
    subroots = rounds[-1].select(F.lit(0).alias("group"), F.struct("hash", F.col("group").alias("of")).alias("node"))
    ordered = ranks.ranked(subroots, "group", [F.col("node.of").asc_nulls_first()], "merkle-subroots")
    top = _tree(ordered.select("group", "rank", "node"), "merkle-top")
    no_path = F.lit([]).cast("array<struct<before:string,after:string>>")
    root = top[-1].select("group", no_path.alias("path"), hexed(F.col("hash")).alias("root"))
    groups = _down(top, root).select(F.col("node.of").alias("group"), "path", "root", hexed(F.col("node.hash")).alias("subroot"))
    rows = _down(rounds, scratch.stored(groups, "merkle-groups"))
    return rows.select(F.col("node.id").alias(order), hexed(F.col("node.hash")).alias("leaf"), "subroot", "root", "path", *[F.col(f"node.{n}").alias(n) for n in more])


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, each row folded to the root from a leaf of which some were tampered with.

    Where 2 divides the CRC-32 of the decimal ``doc_id``, tampering deletes the
    text's line feeds. ``doc_id``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root``, ``verified``.
    """
    fields = [F.col(c) if c != "text" else F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")) for c in COLUMNS]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col("text").cast("string"), F.lit("\n"))
    rows = manifest(docs, carried={"tampered": F.when(hit, leaf(fields))})
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", F.unhex("leaf")), F.col("path")))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
