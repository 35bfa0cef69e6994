"""Merkle manifest of a table: a tree for each group of rows, and one over the roots of the groups.

A level of a tree is kept as concatenated hexadecimal digests, one string for each aligned block of FAN ** DEEP nodes. A
parent is the hash of one fixed-width piece of the level below it, the siblings of a node are the pieces that flank it in
its run, and the tops of the blocks are the leaves of the next round. So a task holds one block, rounds grow with the
logarithm of the table, and all rows of a group may be in one tree: places in it come from one range partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import cut

FAN, DEEP = 8, 3
BLOCK = FAN**DEEP
HEX = 64  #: characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(fields: dict[str, Column]) -> Column:
    """Hash of the fields one after the other: `-` for null, else UTF-8 byte count, `:` and the value."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*framed), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(tree, ...) with pos, the place in its tree by `order`, and total, the rows of the tree. Equal rows take places
    side by side, whichever comes first. No task sees more than a range of the order, whatever the tree."""
    rows = cut(rows, "leaves").withColumn("_tie", F.monotonically_increasing_id())
    sort = ["tree", *order, "_tie"]
    ranged = cut(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = cut(starts.select("tree", "_range", "_first", before.alias("_before"), F.sum("_n").over(tree).alias("total")), "starts")
    return ranged.join(starts, ["tree", "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")


def _parents(level: str) -> str:
    runs = f"sequence(0, (octet_length({level}) - 1) div {FAN * HEX})"
    return f"cast(array_join(transform({runs}, i -> sha2(substring({level}, i * {FAN * HEX} + 1, {FAN * HEX}), 256)), '') as binary)"


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """nodes(tree, pos, total, digest) -> a row for each block with its levels and top. `up` is the number of levels that
    the block adds: as long as the tree has several nodes, DEEP at most."""
    up = F.lit(DEEP)
    for k in reversed(range(DEEP)):
        up = F.when(F.col("total") <= FAN**k, k).otherwise(up)
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried)))
    rows = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("tree", "block", "total").agg(items.alias("items")).withColumn("up", up)
    rows = rows.withColumn("l0", F.expr("cast(array_join(transform(items, x -> x.digest), '') as binary)"))
    for k in range(DEEP):
        rows = rows.withColumn(f"l{k + 1}", F.expr(f"if(up > {k}, {_parents(f'l{k}')}, null)"))
    return rows.withColumn("top", F.coalesce(*(F.col(f"l{k}") for k in range(DEEP, -1, -1))).cast("string"))


def _stages(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Rounds of blocks until each tree has one; each is written, as the way up and the way down both read it."""
    stages, most = [cut(_blocks(nodes, carried), "blocks")], None
    while True:
        last = stages[-1]
        most = last.agg(F.max("total")).first()[0] if most is None else -(-most // BLOCK)
        if most is None or most <= BLOCK:
            return stages
        above = last.select("tree", F.col("block").alias("pos"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("top").alias("digest"))
        stages.append(cut(_blocks(above, []), "blocks"))


def _siblings(j: str) -> str:
    """Siblings of node j of a block by level, from the node up: the pieces before and after it in its run."""
    out = []
    for k in range(DEEP):
        node = f"({j} div {FAN**k})"
        run = f"({node} div {FAN} * {FAN})"
        out.append(f"struct(substring(l{k}, {run} * {HEX} + 1, ({node} - {run}) * {HEX}) as l, substring(l{k}, ({node} + 1) * {HEX} + 1, ({run} + {FAN - 1} - {node}) * {HEX}) as r)")
    return f"slice(array({', '.join(out)}), 1, up)"


def _unfolded(stages: list[DataFrame], carried: list[str]) -> DataFrame:
    """(tree, pos, digest, carried, path): the siblings of each leaf in its tree, level by level up to the tree's root."""
    above = None
    for k in reversed(range(len(stages))):
        blocks, names = stages[k], carried if k == 0 else []
        blocks = blocks.join(above, ["tree", "block"]) if above is not None else blocks.withColumn("above", F.expr("cast(array() as array<struct<l: binary, r: binary>>)"))
        made = "".join(f", x.`{c}` as `{c}`" for c in names)
        rows = blocks.select("tree", F.expr(f"inline(transform(items, (x, j) -> struct(x.pos as pos, x.digest as digest{made}, concat({_siblings('j')}, above) as path)))"))
        above = rows.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"))
    return rows


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h.cast("binary"), s["r"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings on the way up, level by level, left to right."""
    return F.sha2(F.aggregate(path, F.lit(b""), lambda b, s: F.concat(b, s["l"], s["r"])), 256)


def merkle_manifest(docs: DataFrame, carry: dict[str, Column] | None = None, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row for each row of docs: `order`, `group`, the carried columns (computed from docs), leaf, subroot of the group's
    tree, root of the manifest, and path, the siblings (l before, r after) from the leaf to the root.

    A null field is `-` in its leaf and a null group is a tree of its own, the first; null order values come first. Rows of
    equal order go by their leaf, and equal rows are leaves of their own side by side. Empty and very long texts are hashed
    whole. An empty table gives an empty one. Other columns, whatever their names, are neither hashed nor returned."""
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    named = {f"c{k}": c for k, c in enumerate(carry.values())}
    leaves = docs.select(tree.alias("tree"), F.col(group).alias("g"), F.col(order).alias("o"), leaf_of({c: F.col(c) for c in fields}).alias("digest"), *(c.alias(k) for k, c in named.items()))
    carried = ["g", "o", *named]
    stages = _stages(_placed(leaves, ["o", "digest"]), carried)
    subroots = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest"))
    over = _stages(_placed(subroots, ["of"]), ["of"])
    root = F.broadcast(over[-1].select(F.col("top").alias("root")))  # one row
    tops = cut(_unfolded(over, ["of"]).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("top_path")).join(root), "tops")
    rows = _unfolded(stages, carried).join(tops, "tree")
    return rows.select(F.col("o").alias(order), F.col("g").alias(group), *(F.col(k).alias(name) for k, name in zip(named, carry, strict=True)), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "top_path").alias("path"))
