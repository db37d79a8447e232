"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations are rebuilt (``rebuilt``), and each distinct sequence of their first d turns is a
node. A node's key is the exclusive-or of 128 bits of a SHA-256 per (place, role, text) up to
it, so keys come from running aggregates instead of walking down the trie, and a
conversation of any length is cut into blocks. Of a node's members the smallest conversation owns it.

Totals over subtrees come from a centroid decomposition of the forest of parent edges. A
component's centroid is its deepest node with more than half of the component's nodes in its
subtree; removing it leaves one component per child and the one above, each of at most half
the nodes. What the centroid's subtree holds in this component is summed and added to the nodes on the path
from the centroid to the component's top (those whose subtrees hold more than half, so the path needs no walk), and every
component is split again, all at once. Components of at most ``SMALL`` nodes are finished by
the same recursion inside a task, so Spark rounds grow with the logarithm of the nodes over ``SMALL``.
A node finds the child of the centroid that it hangs from in its owner's row of that depth.

Defined results: rows of a null conv_id take no part; null turns come first, rows of one turn go by role and then by the
SHA-256 of their text, and repeated rows are turns of their own; a null role or text is empty; ids
are taken modulo as Spark's ``%`` does; an empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credlake.llm.common import grouped_runs, with_group, written
from credlake.operators.common import numbered

SMALL = 4096
BLOCK = 4096
SHARED = 20  # conversations c - c % SHARED .. lend their first turns
HEADS = 4  # crc32 of the id modulo this is the number of turns borrowed
PIECE = 65_536
WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and their turns (conv_id, place from 1, n turns, role, text).

    A conversation takes the first h turns of conversation c - c % 20 and then its own after the h-th, h = crc32(c) % 4.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("sha", F.sha2("text", 256))
    own = written(numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")], "at").drop("sha", "turn"), "numbered-turns")
    borrowed = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    everyone = written(own.select("conv_id").distinct(), "conversations")
    heads = own.where((F.col("conv_id") % SHARED == 0) & (F.col("at") < HEADS - 1)).withColumnRenamed("conv_id", "lender")
    lent = (
        everyone.withColumn("lender", F.col("conv_id") - F.col("conv_id") % SHARED).join(heads, "lender")
        .where(F.col("at") < borrowed).select("conv_id", "at", "role", "text", F.lit(True).alias("lent"))
    )
    rest = own.where(F.col("at") >= borrowed).select("conv_id", "at", "role", "text", F.lit(False).alias("lent"))
    turns = with_group(lent.unionByName(rest), ["conv_id"], F.col("at"), n=(F.sum, F.lit(1).cast("long")), n_lent=(F.sum, F.col("lent").cast("long")))
    place = F.when(F.col("lent"), F.col("at") + 1).otherwise(F.col("at") - borrowed + F.col("n_lent") + 1)
    return everyone, turns.select("conv_id", place.cast("long").alias("place"), "n", "role", "text")


def memberships(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n, node, parent, words) for every turn: the node it leads to, and from which."""
    digest = F.sha2(F.concat_ws(":", F.col("place").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    keyed = turns.select("conv_id", "place", "n", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), digest.alias("digest"))
    half = [F.conv(F.substring("digest", at, 16), 16, -10).cast("long") for at in (1, 17)]
    keyed = written(keyed.select("conv_id", "place", "n", "words", F.floor((F.col("place") - 1) / BLOCK).alias("block"), half[0].alias("a"), half[1].alias("b")), "turn-keys")
    blocks = keyed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("xa", "xb")])
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = keyed.join(before, ["conv_id", "block"]).withColumns({c: F.bit_xor(c).over(inside).bitwiseXOR(F.col(f"x{c}")) for c in ("a", "b")} | {"da": F.col("a"), "db": F.col("b")})
    return run.select("conv_id", "place", "n", _key(F.col("a"), F.col("b")).alias("node"), _key(F.col("a").bitwiseXOR(F.col("da")), F.col("b").bitwiseXOR(F.col("db"))).alias("parent"), "words")


def _key(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (a, b)]))


def subtree_sums(parent: list[int], weights: np.ndarray) -> np.ndarray:
    """Sums of ``weights`` (a row a node) over subtrees of one tree, by centroid decomposition.

    Node 0 is the top (parent -1), and a parent comes before its children.
    """
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        children[parent[v]].append(v)
    size = [1] * n
    for v in range(n - 1, 0, -1):
        size[parent[v]] += size[v]
    gone = [False] * n
    sums = np.zeros_like(weights)
    tops = [0]
    while tops:
        top = tops.pop()
        whole, centre, path = size[top], top, []
        while True:
            heavy = next((c for c in children[centre] if not gone[c] and 2 * size[c] > whole), None)
            if heavy is None:
                break
            path.append(centre)
            centre = heavy
        below, reached = [centre], 0
        while reached < len(below):
            below += [c for c in children[below[reached]] if not gone[c]]
            reached += 1
        total = weights[below].sum(0)
        sums[centre] += total
        if path:
            sums[path] += total
            for v in path:
                size[v] -= size[centre]
            tops.append(top)
        gone[centre] = True
        tops += [c for c in children[centre] if not gone[c]]
    return sums


def _finished(parts: DataFrame) -> DataFrame:
    """(node, leaves, saved) of components that fit in a task; a component is named by its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, results, rows = [], [], 0
        for _, part in grouped_runs(batches, "top"):
            names = part.column("node").to_pylist()
            where = {name: k for k, name in enumerate(names)}
            parent = [where.get(p, -1) if k else -1 for k, p in enumerate(part.column("parent").to_pylist())]
            own = np.stack([part.column(c).to_numpy() for c in ("leaf", "save")], axis=1)
            more = np.stack([part.column(c).to_numpy() for c in ("leaves", "saved")], axis=1)
            out.append(part.column("node").combine_chunks())
            results.append(subtree_sums(parent, own) + more)
            rows += len(names)
            if rows >= SMALL:
                yield _rows(out, results)
                out, results, rows = [], [], 0
        if out:
            yield _rows(out, results)

    dealt = parts.select("top", "depth", "node", "parent", "leaf", "save", "leaves", "saved").repartition("top").sortWithinPartitions("top", "depth")
    return dealt.mapInArrow(run, "node binary, leaves bigint, saved bigint")


def _rows(names: list[pa.Array], results: list[np.ndarray]) -> pa.RecordBatch:
    sums = np.concatenate(results)
    return pa.record_batch([pa.concat_arrays(names), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["node", "leaves", "saved"])


def rolled_up(forest: DataFrame, members: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, leaves, saved): ``leaf`` and ``save`` summed over each node's subtree.

    ``forest``: (node, parent, owner, depth, size, leaf, save) of one tree whose root is ``ROOT``; ``size`` counts the
    subtree's nodes. ``members``: (conv_id, place, node, parent), which tells a node's ancestors by its owner and a depth.
    """
    steps = members.select(F.col("conv_id").alias("owner"), F.col("place").alias("step"), F.col("node").alias("child"), F.col("parent").alias("above"))
    zero = F.lit(0).cast("long")
    open_ = forest.withColumns({"top": F.lit(ROOT), "leaves": zero, "saved": zero})
    done, finished = [], []
    while True:
        state = written(with_group(open_, ["top"], F.col("node"), whole=(F.max, F.col("size"))), "components")
        done.append(state.where(F.col("whole") <= small))
        large = state.where(F.col("whole") > small)
        if large.isEmpty():
            break
        parts = F.ceil(F.col("whole") / small)
        centres = large.where(2 * F.col("size") > F.col("whole")).groupBy("top").agg(F.max("whole").alias("whole"), F.min(F.struct("size", "depth", "node")).alias("centre"))
        centres = centres.select("top", "centre", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        placed = large.withColumn("part", F.pmod(F.xxhash64("node"), parts)).join(centres, ["top", "part"]).drop("part")
        placed = placed.withColumn("step", F.col("centre.depth") + 1).join(steps, ["owner", "step"], "left")
        is_centre = F.col("node") == F.col("centre.node")
        under = (F.col("depth") >= F.col("step")) & F.coalesce(F.col("above") == F.col("centre.node"), F.lit(False))
        inside = is_centre | under
        placed = with_group(
            placed.withColumns({"is_centre": is_centre, "under": under}), ["top"], F.col("node"),
            add_leaves=(F.sum, F.when(inside, F.col("leaf")).otherwise(zero)), add_saved=(F.sum, F.when(inside, F.col("save")).otherwise(zero)),
        )
        on_path = ~F.col("under") & (2 * F.col("size") > F.col("whole"))
        split = placed.withColumns({
            "leaves": F.col("leaves") + F.when(on_path, F.col("add_leaves")).otherwise(zero),
            "saved": F.col("saved") + F.when(on_path, F.col("add_saved")).otherwise(zero),
            "size": F.when(on_path & ~F.col("is_centre"), F.col("size") - F.col("centre.size")).otherwise(F.col("size")),
            "top": F.when(F.col("under"), F.col("child")).otherwise(F.col("top")),
        })
        split = written(split.select(*open_.columns, "is_centre"), "split")
        finished.append(split.where("is_centre").select("node", "leaves", "saved"))
        open_ = split.where("not is_centre").drop("is_centre")
    columns = [c for c in open_.columns]
    small_parts = reduce(DataFrame.unionByName, [d.select(columns) for d in done])
    return reduce(DataFrame.unionByName, [_finished(small_parts), *finished])


def joined_ids(ends: DataFrame) -> DataFrame:
    """(node, sha256): digest of the node's conversation ids, ascending and joined by commas.

    Range partitions of (node, conv_id) join their ids into pieces; a node's pieces, not its
    rows, then stream through one digest.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, run in grouped_runs(batches, "node"):
            ids = run.column("conv_id").to_numpy()
            for at in range(0, len(ids), PIECE):
                some = ids[at : at + PIECE]
                yield pa.record_batch([pa.array([node], pa.binary()), pa.array([some[0]], pa.int64()), pa.array([",".join(map(str, some)).encode()], pa.binary())], ["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            names, values = [], []
            for node, ids in zip(batch.column(0), batch.column(2)):
                node = node.as_py()
                if node != at:
                    if digest is not None:
                        names.append(at)
                        values.append(digest.hexdigest())
                    at, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py())
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(values, pa.string())], ["node", "sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([at], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "sha256"])

    ranged = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = ranged.mapInArrow(pieces, "node binary, first bigint, ids binary")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, sha256 string")


def trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    everyone, turns = rebuilt(conversations)
    members = memberships(turns)
    one = F.lit(1).cast("long")
    members = written(with_group(members, ["node"], F.col("conv_id"), owner=(F.min, F.col("conv_id")), n_convs=(F.sum, one)), "members")
    owned = F.col("conv_id") == F.col("owner")
    # a conversation owns the nodes of its path from some depth on, so its part of any subtree is a difference of depths
    since = with_group(members.select("conv_id", "place", "n", "node", "owner"), ["conv_id"], F.col("place"), since=(F.min, F.when(owned, F.col("place"))))
    part = F.greatest(F.lit(0).cast("long"), F.col("n") - F.greatest(F.coalesce("since", F.col("n") + 1), "place") + 1)
    sizes = since.groupBy("node").agg(F.sum(part).alias("size"))
    children = members.where(owned).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    above = members.select(F.col("conv_id").alias("owner"), (F.col("place") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    nodes = members.where(owned).select("node", "parent", "owner", F.col("place").alias("depth"), "n_convs", "words").join(sizes, "node").join(above, ["owner", "depth"], "left")
    n_nodes = members.agg(F.coalesce(F.sum(owned.cast("long")), F.lit(0).cast("long"))).scalar()
    first = everyone.agg(F.min("conv_id")).scalar()
    root = everyone.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), "owner", F.lit(0).cast("long").alias("depth"), "n_convs",
        F.lit(0).cast("long").alias("words"), (n_nodes + 1).alias("size"), F.lit(None).cast("long").alias("parent_conv_id"),
    )
    nodes = nodes.unionByName(root).join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, first).otherwise(F.col("parent_conv_id"))), "trie-nodes")
    forest = nodes.select("node", "parent", "owner", "depth", "size", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("save"))
    sums = rolled_up(forest, members, small)
    stopped = members.where("place = n").select("node", "conv_id")
    turnless = everyone.join(stopped.select("conv_id"), "conv_id", "left_anti").select(F.lit(ROOT).alias("node"), "conv_id")
    ends = joined_ids(stopped.unionByName(turnless))
    return nodes.join(sums, "node").join(ends, "node", "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
