"""Merkle trees over whole logs, 256 nodes to a tile and one shuffle per tile level.

A tile row keeps its nine in-tile levels as arrays of hashes: `levels[0]` is the stored hash tile,
`levels[8]` holds the single root, which is a node of the tile level above. A node without a right
neighbour moves up unchanged, so every prefix length works the same way.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.constants import DIGEST_BYTES, TILE_HEIGHT, TILE_WIDTH
from merklake.functions.hashing import node_hash, pack_hashes, unpack_hashes
from merklake.functions.paths import bundle_of, leaf_index, slot_of
from merklake.sources.scratch import materialize

CHAIN_TYPE = "array<struct<level:int,own:binary,sib:binary>>"


def _pair_up(nodes: Column) -> Column:
    """The next level: pairs hashed, an odd last node kept."""

    def parent(i: Column) -> Column:
        left = F.element_at(nodes, i * 2 + 1)
        return F.when(
            F.size(nodes) > i * 2 + 1, node_hash(left, F.element_at(nodes, i * 2 + 2))
        ).otherwise(left)

    last = F.call_function("div", F.size(nodes) - 1, F.lit(2)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), parent)


def in_tile_levels(nodes: Column) -> Column:
    # aggregate() carries each level along; nested lambdas would compute lower levels again and again.
    return F.aggregate(
        F.array(*[F.lit(k) for k in range(TILE_HEIGHT)]),
        F.array(nodes),
        lambda levels, _: F.concat(levels, F.array(_pair_up(F.element_at(levels, -1)))),
    )


def tile_level(nodes: DataFrame) -> DataFrame:
    """Group nodes (log_id, index, hash, covered) into tiles.

    The slot leads each entry, so sorting the entries is sorting by position. Repeated copies of
    a node fall together before the shuffle, which bounds a group by the tile width. A tile with a gap,
    with two hashes for one slot or with a node above such a tile has null `levels`, and so has all above it:
    a hash never takes another's slot.
    """
    slot = F.unhex(F.lpad(F.hex(slot_of(F.col("index"))), 2, "0"))
    last = F.conv(F.hex(F.substring(F.element_at("entries", -1), 1, 1)), 16, 10).cast("int")
    dense = (F.col("lost") == 0) & (last + 1 == F.size("entries"))
    hashes = F.transform(F.col("entries"), lambda e: F.substring(e, 2, DIGEST_BYTES))
    return (
        nodes.groupBy("log_id", bundle_of(F.col("index")).alias("tile_index"))
        .agg(
            F.sort_array(F.collect_set(F.concat(slot, F.col("hash")))).alias("entries"),
            F.sum("covered").alias("covered"),
            F.count_if(F.col("hash").isNull()).alias("lost"),
        )
        .select(
            "log_id",
            "tile_index",
            F.size("entries").alias("width"),
            "covered",
            F.when(F.coalesce(dense, F.lit(False)), in_tile_levels(hashes)).alias("levels"),
        )
    )


def tile_root(levels: Column) -> Column:
    return F.element_at(F.element_at(levels, TILE_HEIGHT + 1), 1)


def levels_needed(max_tree_size: int) -> int:
    """Tile levels until one tile is left."""
    count, tiles = 1, (max_tree_size + TILE_WIDTH - 1) // TILE_WIDTH
    while tiles > 1:
        tiles = (tiles + TILE_WIDTH - 1) // TILE_WIDTH
        count += 1
    return count


@dataclass
class Tree:
    """Tiles of all logs, one DataFrame per tile level, lowest first."""

    tiles: list[DataFrame]

    def roots(self) -> DataFrame:
        """(log_id, tree_size, root_hash), one row per log that has leaves."""
        top = self.tiles[-1]
        return top.select("log_id", F.col("covered").alias("tree_size"), tile_root(F.col("levels")).alias("root_hash"))

    def hash_tiles(self) -> DataFrame:
        """The stored form: tiles of perfect nodes only (log_id, tile_level, tile_index, width, hashes)."""
        out = None
        for level, tiles in enumerate(self.tiles):
            span = TILE_WIDTH**level
            width = F.least(F.lit(TILE_WIDTH), F.call_function("div", F.col("covered"), F.lit(span))).cast("int")
            stored = tiles.select(
                "log_id",
                F.lit(level).alias("tile_level"),
                "tile_index",
                width.alias("width"),
                pack_hashes(F.slice(F.element_at("levels", 1), F.lit(1), width)).alias("hashes"),
            ).where("width > 0")
            out = stored if out is None else out.unionByName(stored)
        return out

    def paths(self) -> DataFrame:
        """Lowest tiles with the chain of nodes above each one (log_id, tile_index, width, levels, upper).

        Chains run from the top down: a tile hands its own chain to its at most 256 children. Every
        join is one row to one row, so the top tile, which lies above all leaves, is no hot key.
        """
        top = self.tiles[-1]
        upper = top.select("log_id", "tile_index", F.array().cast(CHAIN_TYPE).alias("upper"))
        for level in range(len(self.tiles) - 1, 0, -1):
            upper = (
                self.tiles[level]
                .join(upper, ["log_id", "tile_index"])
                .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
                .select(
                    "log_id",
                    leaf_index(F.col("tile_index"), F.col("slot")).alias("tile_index"),
                    F.when(
                        F.col("levels").isNotNull(),
                        F.concat(in_tile_chain(F.col("levels"), F.col("slot"), level * TILE_HEIGHT), F.col("upper")),
                    ).alias("upper"),
                )
            )
        return self.tiles[0].join(upper, ["log_id", "tile_index"]).drop("covered")


def frontier_nodes(frontier: DataFrame, level: int) -> DataFrame:
    """Nodes of a tile level (log_id, index, hash, covered) that lie in the incomplete tiles at the right edge of trees.

    `frontier`: log_id, tree_size, tile_level, hashes.
    """
    first = F.shiftleft(F.shiftright(F.col("tree_size"), TILE_HEIGHT * (level + 1)), TILE_HEIGHT)
    rows = frontier.where(F.col("tile_level") == level).select("log_id", first.alias("first"), F.posexplode(unpack_hashes(F.col("hashes"))))
    return rows.select(
        "log_id", (F.col("first") + F.col("pos")).alias("index"), F.col("col").alias("hash"), F.lit(TILE_WIDTH**level if level else 0).cast("bigint").alias("covered")
    )


def build_tree(leaves: DataFrame, max_tree_size: int | None = None, frontier: DataFrame | None = None) -> Tree:
    """Tree of leaves (log_id, leaf_index, merkle_leaf_hash), all logs at once.

    The lowest tiles, 64 bytes per leaf, are written out once; each level above is 256 times
    smaller. The depth comes from the known size or from one aggregate over the index column.

    With the `frontier` of trees that are there already, `leaves` are those past their sizes, and the tiles are those that differ
    from the ones stored: every other tile of the grown tree is as it was.
    """
    if max_tree_size is None:
        last = leaves.agg(F.max("leaf_index").alias("last")).first()["last"]
        max_tree_size = 0 if last is None else last + 1
    nodes = leaves.select(
        "log_id",
        F.col("leaf_index").alias("index"),
        F.col("merkle_leaf_hash").alias("hash"),
        F.lit(0).cast("bigint").alias("covered"),
    )
    if frontier is not None:
        nodes = nodes.unionByName(frontier_nodes(frontier, 0))
    lowest = tile_level(nodes).withColumn("covered", F.col("width").cast("bigint"))
    return _roll_up(materialize(lowest, "tiles", ["log_id", "tile_index"]), max_tree_size, frontier)


def tree_from_tiles(stored: DataFrame) -> Tree:
    """Tree from stored lowest tiles (log_id, tile_index, hashes): no leaf is read, nothing is regrouped."""
    lowest = stored.select(
        "log_id",
        "tile_index",
        F.call_function("div", F.length("hashes"), F.lit(DIGEST_BYTES)).cast("int").alias("width"),
        F.call_function("div", F.length("hashes"), F.lit(DIGEST_BYTES)).cast("bigint").alias("covered"),
        F.when(F.col("hashes").isNotNull(), in_tile_levels(unpack_hashes(F.col("hashes")))).alias("levels"),
    )
    written = materialize(lowest, "tiles", ["log_id", "tile_index"])
    last = written.agg(F.max("tile_index").alias("last")).first()["last"]
    return _roll_up(written, 0 if last is None else (last + 1) * TILE_WIDTH)


def _roll_up(lowest: DataFrame, max_tree_size: int, frontier: DataFrame | None = None) -> Tree:
    tiles = [lowest]
    for level in range(1, levels_needed(max_tree_size)):
        below = tiles[-1].select(
            "log_id",
            F.col("tile_index").alias("index"),
            tile_root(F.col("levels")).alias("hash"),
            "covered",
        )
        if frontier is not None:
            below = below.unionByName(frontier_nodes(frontier, level))
        tiles.append(tile_level(below))
    return Tree(tiles)


def in_tile_chain(levels: Column, slot: Column, base_level: int) -> Column:
    """The eight nodes from a slot to the tile root, each with its sibling if there is one."""

    def step(k: Column) -> Column:
        nodes = F.element_at(levels, k + 1)
        position = F.call_function("shiftright", slot, k)
        return F.struct(
            (k + base_level).alias("level"),
            F.get(nodes, position).alias("own"),
            F.get(nodes, position.bitwiseXOR(F.lit(1))).alias("sib"),
        )

    return F.transform(F.array(*[F.lit(k) for k in range(TILE_HEIGHT)]), step)


def leaf_chain(index: Column, levels: Column, upper: Column) -> Column:
    """All nodes from a leaf to the root, from the path tile that holds the leaf."""
    return F.concat(in_tile_chain(levels, slot_of(index).cast("int"), 0), upper)
