"""Merkle manifest of a dataset: levels as strings of hexadecimal digests, cut up by SQL.

Rows become leaves; the leaves of a group, in order, are dealt to aligned blocks of 2^HEIGHT.
A block is one row that keeps each of its levels as one string of concatenated digests, so a
parent is the hash of a fixed-width substring of the level below, and the siblings on the way
of a node are the substrings beside it. What a block comes to is a node of the next round, until
each group is one node, its subroot; the subroots, in order of their groups, make the root in
the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import let, stored

#: Hexadecimal digits of a digest, nodes under one parent (two), and levels within a block.
WIDTH, ARITY, HEIGHT = 64, 2, 6
BLOCK = ARITY ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The siblings of a node at one level, before and behind it.
STEP = "array<struct<before: string, after: string>>"


def hashed(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, so that fields cannot run together."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return hashed(*(framed(f) for f in fields))


def group_key(value: Column) -> Column:
    """A key that is never null and sorts as the group does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos``, the number from 0 of each row in its ``group`` by ``order``, and
    ``n``, the rows of the group.

    Rows are dealt out by ranges of group and order and stored with their place in the
    partition; the counts of the partitions before it make a row's number. No group is sorted by
    a single task.
    """
    sort = [group, *order]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = stored(
        dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), f"{label}-placed")
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
        .withColumn("n", F.sum("_n").over(Window.partitionBy(group))).select(group, "_part", "_start", "n"),
        f"{label}-starts")
    return placed.join(starts, [group, "_part"]).withColumn("pos", F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def levels_of(lowest: Column, height: Column) -> Column:
    """The levels of a block from ``lowest`` up, each one string of digests."""
    def parents(level: Column) -> Column:
        run = ARITY * WIDTH
        last = F.ceil(F.length(level) / run).cast("int") - 1
        return F.array_join(F.transform(
            F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)).cast("binary"), 256)), "")

    steps = F.slice(F.array(*(F.lit(i) for i in range(HEIGHT))), F.lit(1), height)
    return F.aggregate(steps, F.array(lowest), lambda levels, i: F.array_append(levels, let(F.get(levels, i), parents)))


def siblings(levels: Column, place: Column) -> Column:
    """For each level but the last, the digests beside the ancestor of node ``place``, in its
    run: the substrings that flank it."""
    def beside(level: Column, i: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(float(ARITY)), i)).cast("int")
        first = node - node % ARITY
        before = F.substring(level, first * WIDTH + 1, (node - first) * WIDTH)
        after = F.substring(level, (node + 1) * WIDTH + 1, (first + ARITY - 1 - node) * WIDTH)
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


@dataclass
class Tree:
    """Rounds of blocks, lowest first: ``key, block, levels, nodes``. In the last one each key
    has one block, whose last level is its root."""

    rounds: list[DataFrame]

    def roots(self) -> DataFrame:
        return self.rounds[-1].select("key", F.element_at("levels", -1).alias("digest"))

    def paths(self, above: DataFrame) -> DataFrame:
        """The lowest nodes, as they came in, with ``path``: their siblings up to the root of
        their key and on along its path in ``above(key, path, ...)``, whose columns they get."""
        state = above.withColumn("block", F.lit(0).cast("long"))
        carried = [c for c in above.columns if c not in ("key", "path")]
        for number, blocks in reversed(list(enumerate(self.rounds))):
            each = blocks.join(state, ["key", "block"]).select(
                "key", "levels", "path", *carried, F.posexplode("nodes").alias("_i", "node"))
            path = F.concat(siblings(F.col("levels"), F.col("_i")), F.col("path")).alias("path")
            if number == 0:
                return each.select("key", "node.*", path, *carried)
            state = stored(each.select("key", F.col("node.pos").alias("block"), path, *carried), "merkle-paths")
        raise ValueError("a tree has one round at least")


def tree(nodes: DataFrame, label: str) -> Tree:
    """The tree over each key's ``nodes(key, pos, n, digest, ...)``; further columns stay with them."""
    rounds: list[DataFrame] = []
    while True:
        own = [c for c in nodes.columns if c not in ("key", "n")]
        height = F.when(F.col("n") > 1, F.least(F.length(F.bin(F.col("n") - 1)), F.lit(HEIGHT))).otherwise(0)
        grouped = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", *(c for c in own if c != "pos")))).alias("nodes"),
            F.first("n").alias("n"), F.first(height).alias("height"))
        lowest = F.array_join(F.transform("nodes", lambda x: x["digest"]), "")
        blocks = stored(
            grouped.select("key", "block", "n", "nodes", levels_of(lowest, F.col("height")).alias("levels")), f"{label}-blocks")
        rounds.append(blocks)
        if blocks.filter(F.col("n") > BLOCK).isEmpty():
            return Tree(rounds)
        nodes = blocks.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("levels", -1).alias("digest"))


@dataclass
class Manifest:
    """The trees of the groups and the tree of their subroots."""

    groups: Tree
    whole: Tree

    def proofs(self) -> DataFrame:
        """Every leaf's row with ``subroot``, ``root`` and ``path``, the siblings from the leaf
        to the root."""
        top = self.whole.roots().select("key", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
        of_group = self.whole.paths(top).select(F.col("group").alias("key"), "path", F.col("digest").alias("subroot"), "root")
        return self.groups.paths(of_group)


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves(key, doc_id, digest, ...)``: a tree per key, leaves in order of
    doc_id, nulls first, then of their digests; and a tree over the keys in their order."""
    order = ["doc_id", "digest", "_row"]
    rows = numbered(stored(leaves.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves"), "key", order, "merkle")
    groups = tree(rows.drop("_row"), "merkle")
    subroots = groups.roots().select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    return Manifest(groups, tree(numbered(subroots, "key", ["group"], "merkle-groups"), "merkle-groups"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path come to."""
    return F.aggregate(path, leaf, lambda node, step: hashed(step["before"], node, step["after"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def verified(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """Every row of ``docs`` against the root, those that ``tampered`` names with ``changed`` for
    their n_chars: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Null fields are leaves like any other and differ from empty ones. A null lang is a group of
    its own, the first; null ids come first in their group. Rows that repeat are leaves of
    their own, one behind the other, so their order does not matter. A group of one row is its
    own subroot, one group its own root; an empty table gives no rows. Only the five columns
    named are read, so further ones cannot clash.
    """
    fields = {name: F.col(name) for name in FIELDS}
    other = leaf_of(*(fields | {"n_chars": changed}).values())
    leaves = docs.select(
        group_key(F.col("lang")).alias("key"), "doc_id", leaf_of(*fields.values()).alias("digest"),
        F.when(tampered & F.col("n_chars").isNotNull(), other).alias("other"))
    proofs = manifest(leaves).proofs()
    told = proofs.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
