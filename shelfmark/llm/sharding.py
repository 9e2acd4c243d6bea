"""Sharding by a weighted hash tree of regions, racks and shards.

A key starts at the root. Each child of the node where it stands draws ln(u) / weight, with u from
a hash of key and child; the largest draw takes the key one level down. A child's draws depend on
nothing but itself, so a change of weights moves keys only between the child that changed and its
siblings, and below nodes without changes every key stays where it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.work import keep


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_tree(shards: int, per_rack: int = 2, per_region: int = 6) -> list[Leaf]:
    """Shards of equal weight, filled rack by rack."""
    return [Leaf(f"region{i // per_region}", f"rack{i // per_rack}", i) for i in range(shards)]


def grown_tree(tree: Sequence[Leaf]) -> list[Leaf]:
    """The tree with one more shard, in a region and rack of its own: of all subtrees only the
    new one gains weight, so keys move into the new shard and nowhere else."""
    n = max(x.shard for x in tree) + 1
    weight = sum(x.weight for x in tree) / len(tree)
    return [*tree, Leaf(f"region+{n}", f"rack+{n}", n, weight)]


def _uniform(key: Column, node: str) -> Column:
    """A number in (0, 1) from key and node."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node), key), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _descend(key: Column, leaves: Sequence[Leaf], level: int) -> Column:
    """Shard of the key below the node that holds `leaves`."""
    if level == 2:
        children = {f"shard/{x.shard}": [x] for x in leaves}
    else:
        children: dict[str, list[Leaf]] = {}
        for x in leaves:
            children.setdefault("/".join(x[:level + 1]), []).append(x)
    names = list(children)
    below = [F.lit(children[n][0].shard) if level == 2 else
             _descend(key, children[n], level + 1) for n in names]
    if len(names) == 1:
        return below[0]
    draws = [F.struct((F.ln(_uniform(key, n)) / F.lit(float(sum(x.weight for x in children[n]))))
                      .alias("draw"), F.lit(-i).alias("child")) for i, n in enumerate(names)]
    child = F.array_max(F.array(*draws))["child"]
    out = F.when(child == 0, below[0])
    for i in range(1, len(names)):
        out = out.when(child == -i, below[i])
    return out


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard a key falls on. Shards of weight 0 take nothing."""
    return _descend(key, [x for x in tree if x.weight > 0], 0).cast("int")


def number_within(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Gapless position from 0 within each group, by `order`.

    Rows are spread by ranges of (group, order), so a group of any size lies in many tasks; each
    task numbers its own stretch of a group, and what stretches before it hold is added from one
    small row per task and group.
    """
    placed = keep(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                  .withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_task", F.shiftright("_at", 33))
    parts = placed.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_at").alias("_from"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = keep(parts.select(group, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0))
                                               - F.col("_from")).alias("_shift")), "stretches")
    return placed.join(parts, [group, "_task"]).withColumn(
        name, F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def assign(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 8), text_crc32, shard, slot, grown_shard.

    The id alone decides the shard; null ids share one. `slot` is the position in the shard by id;
    repeated rows take neighbouring slots. Null texts are empty. Other columns are not read.
    """
    grown = grown_tree(tree) if grown is None else grown
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = keep(docs.select(
        F.col(id_col), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), shard_of(key, tree).alias("shard"),
        shard_of(key, grown).alias("grown_shard")), "shards")
    return number_within(rows, "shard", [id_col, "size", "text_crc32"], "slot")
