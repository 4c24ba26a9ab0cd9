"""Proofs as expressions over leaf chains.

Every proof reads the chain of one leaf. A proof for an older size also reads the chain of the
first leaf past that size: its left siblings are the perfect subtrees the older tree is made of.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.constants import TILE_HEIGHT
from merklake.functions.binding import let
from merklake.functions.hashing import empty_root, node_hash
from merklake.functions.paths import bundle_of, leaf_index, part_of, slot_of
from merklake.operators.joins import HOT_ROWS, lookup_join, small_join
from merklake.operators.merkle import leaf_chain


def _shift(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, bits)


def _is_set(number: Column, bit: Column) -> Column:
    return _shift(number, bit).bitwiseAND(F.lit(1)) == 1


def siblings(chain: Column, from_level: Column | None = None) -> Column:
    keep = (lambda s: s["sib"].isNotNull()) if from_level is None else (
        lambda s: s["sib"].isNotNull() & (s["level"] >= from_level)
    )
    return F.transform(F.filter(chain, keep), lambda s: s["sib"])


def inclusion(chain: Column) -> Column:
    return siblings(chain)


def trailing_zeros(number: Column) -> Column:
    return (F.bit_count(number.bitwiseXOR(number - 1)) - 1).cast("int")


def consistency(first: Column, chain: Column) -> Column:
    """Proof that the tree of size `first` is a prefix; `chain` is that of leaf first-1 in the larger tree."""
    zeros = trailing_zeros(first)
    power_of_two = first.bitwiseAND(first - 1) == 0

    def from_chain(nodes: Column) -> Column:
        start = F.transform(F.filter(nodes, lambda s: s["level"] == zeros), lambda s: s["own"])
        rest = siblings(nodes, zeros)
        return F.when(power_of_two, rest).otherwise(F.concat(start, rest))

    return let(chain, from_chain)


def older_edge(size: Column, next_chain: Column) -> Column:
    """Right-edge nodes of the tree of `size` leaves, by level: the fold of its perfect subtrees.

    `next_chain` is the chain of leaf `size`. Element l covers the set bits of `size` below l and is
    null when there are none; the last element is the root of that tree.
    """
    empty = F.array(F.lit(None).cast("binary"))

    def add_level(edge: Column, step: Column) -> Column:
        last = F.element_at(edge, -1)
        grown = (
            F.when(~_is_set(size, step["level"]), last)
            .when(last.isNull(), step["sib"])
            .otherwise(node_hash(step["sib"], last))
        )
        return F.concat(edge, F.array(grown))

    return F.aggregate(next_chain, empty, add_level)


def older_chain(index: Column, size: Column, chain: Column, next_chain: Column) -> Column:
    """The chain of a leaf as it was when the tree had `size` leaves."""

    def node_then(edge: Column, level: Column, position: Column, node: Column) -> Column:
        first_leaf = F.call_function("shiftleft", position, level)
        past_leaf = F.call_function("shiftleft", position + 1, level)
        return F.when(first_leaf >= size, F.lit(None)).when(past_leaf <= size, node).otherwise(
            F.element_at(edge, level + 1)
        )

    def step_then(edge: Column, step: Column) -> Column:
        level = step["level"]
        position = _shift(index, level)
        return F.struct(
            level.alias("level"),
            node_then(edge, level, position, step["own"]).alias("own"),
            node_then(edge, level, position.bitwiseXOR(F.lit(1).cast("bigint")), step["sib"]).alias("sib"),
        )

    return let(
        older_edge(size, next_chain), lambda edge: F.transform(chain, lambda step: step_then(edge, step))
    )


def moved_chain(index: Column, chain: Column, boundary: Column, newer: Column, from_level: int = 0) -> Column:
    """The chain of a leaf after its tree has grown from `boundary` leaves.

    `newer` is the chain of leaf `boundary` in the grown tree. Nodes left of it were whole before and are the same; so only nodes of
    that chain can differ from what was stored. Chains begin at `from_level`; a chain that is not known stays null.
    """

    def moved(old: Column) -> Column:
        def step(new: Column) -> Column:
            level = new["level"]
            here, edge = _shift(index, level), _shift(boundary, level)
            one, was = F.lit(1).cast("bigint"), F.get(old, level - from_level)

            def node(position: Column, before: Column) -> Column:
                return F.when(position == edge, new["own"]).when(position == edge.bitwiseXOR(one), new["sib"]).otherwise(before)

            return F.struct(level.alias("level"), node(here, was["own"]).alias("own"), node(here.bitwiseXOR(one), was["sib"]).alias("sib"))

        return F.transform(F.filter(newer, lambda s: s["level"] >= from_level), step)

    return F.when(chain.isNotNull(), let(chain, moved))


def root_from_inclusion(index: Column, size: Column, leaf_hash: Column, hashes: Column) -> Column:
    """Root that an inclusion proof leads to (RFC 9162, section 2.1.3.2)."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(index.alias("fn"), (size - 1).alias("sn"), leaf_hash.alias("r"))

    def step(acc: Column, sibling: Column) -> Column:
        fn, sn, r = acc["fn"], acc["sn"], acc["r"]
        odd = fn.bitwiseAND(F.lit(1)) == 1
        last = fn == sn
        # A last node with no right neighbour rises until it is a right child.
        lift = F.when(last & ~odd & (fn != zero), trailing_zeros(fn)).otherwise(F.lit(0))
        return F.struct(
            _shift(_shift(fn, lift), F.lit(1)).alias("fn"),
            _shift(_shift(sn, lift), F.lit(1)).alias("sn"),
            F.when(odd | last, node_hash(sibling, r)).otherwise(node_hash(r, sibling)).alias("r"),
        )

    return F.aggregate(hashes, start, step, lambda acc: acc["r"])


def roots_from_consistency(first: Column, second: Column, first_root: Column, hashes: Column) -> Column:
    """STRUCT<first_root, second_root> a consistency proof leads to (RFC 9162, section 2.1.4.2)."""
    zeros = trailing_zeros(first)
    whole = first.bitwiseAND(first - 1) == 0
    path = F.when(whole, F.concat(F.array(first_root), hashes)).otherwise(hashes)
    seed = F.element_at(path, 1)
    start = F.struct(
        _shift(first - 1, zeros).alias("fn"),
        _shift(second - 1, zeros).alias("sn"),
        seed.alias("fr"),
        seed.alias("sr"),
    )

    def step(acc: Column, sibling: Column) -> Column:
        fn, sn = acc["fn"], acc["sn"]
        odd = fn.bitwiseAND(F.lit(1)) == 1
        left = odd | (fn == sn)
        lift = F.when(left & ~odd & (fn != 0), trailing_zeros(fn)).otherwise(F.lit(0))
        return F.struct(
            _shift(_shift(fn, lift), F.lit(1)).alias("fn"),
            _shift(_shift(sn, lift), F.lit(1)).alias("sn"),
            F.when(left, node_hash(sibling, acc["fr"])).otherwise(acc["fr"]).alias("fr"),
            F.when(left, node_hash(sibling, acc["sr"])).otherwise(node_hash(acc["sr"], sibling)).alias("sr"),
        )

    return F.aggregate(
        F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))),
        start,
        step,
        lambda acc: F.struct(acc["fr"].alias("first_root"), acc["sr"].alias("second_root")),
    )


def with_chain(
    rows: DataFrame,
    paths: DataFrame,
    index: Column,
    name: str,
    hot_rows: int = HOT_ROWS,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Add the chain of a leaf to each row; null where the index is null or outside the log."""

    on = ["log_id", "_tile"]
    if "part" in paths.columns:
        on.append("part")

    def keyed(df: DataFrame) -> DataFrame:
        out = df.withColumn("_index", index).withColumn("_tile", bundle_of(F.col("_index")))
        return out.withColumn("part", part_of(F.col("_tile"))) if "part" in on else out

    tiles = paths.select(
        *[c for c in on if c != "_tile"],
        F.col("tile_index").alias("_tile"),
        F.col("width").alias("_width"),
        F.col("levels").alias("_levels"),
        F.col("upper").alias("_upper"),
    )
    found = F.col("_upper").isNotNull() & F.col("_levels").isNotNull() & (slot_of(F.col("_index")) < F.col("_width"))
    chain = leaf_chain(F.col("_index"), F.col("_levels"), F.col("_upper"))
    return (
        lookup_join(
            keyed(rows),
            tiles,
            on,
            hot_rows=hot_rows,
            keys_from=None if keys_from is None else keyed(keys_from),
        )
        .withColumn(name, F.when(found, chain))
        .drop("_index", "_tile", "part", "_width", "_levels", "_upper")
    )


def all_inclusion_proofs(paths: DataFrame) -> DataFrame:
    """Proof of every leaf (log_id, leaf_index, leaf_hash, hashes), straight from the tiles, without a join."""

    def leaf(slot: Column, above: Column) -> Column:
        within = F.transform(
            F.array(*[F.lit(k) for k in range(TILE_HEIGHT)]),
            lambda k: F.get(
                F.element_at("levels", k + 1), F.call_function("shiftright", slot, k).bitwiseXOR(F.lit(1))
            ),
        )
        return F.struct(
            leaf_index(F.col("tile_index"), slot).alias("leaf_index"),
            F.get(F.element_at("levels", 1), slot).alias("leaf_hash"),
            F.concat(F.array_compact(within), above).alias("hashes"),
        )

    # Proofs are made inside the tile and then unrolled, so a tile is not copied once per leaf.
    slots = F.sequence(F.lit(0), F.col("width") - 1)
    leaves = let(siblings(F.col("upper")), lambda above: F.transform(slots, lambda slot: leaf(slot, above)))
    return paths.select("log_id", F.explode(leaves).alias("leaf")).select("log_id", "leaf.*")


def _fold_left(nodes: Column) -> Column:
    """Root of a tree from its perfect subtrees, the smallest first."""

    def step(acc: Column, node: Column) -> Column:
        return F.when(acc.isNull(), node).otherwise(node_hash(node, acc))

    return F.aggregate(nodes, F.lit(None).cast("binary"), step)


def _left_within(slot: Column) -> Column:
    """Perfect subtrees of a tile to the left of a slot, the smallest first."""

    def node(k: Column) -> Column:
        position = F.call_function("shiftright", slot, k)
        return F.when(position % 2 == 1, F.get(F.element_at("levels", k + 1), position - 1))

    return F.array_compact(F.transform(F.array(*[F.lit(k) for k in range(TILE_HEIGHT)]), node))


def _left_above() -> Column:
    """Perfect subtrees to the left of a whole tile, the smallest first."""
    return F.transform(F.filter("upper", lambda s: _is_set(F.col("tile_index"), s["level"] - TILE_HEIGHT)), lambda s: s["sib"])


def prefix_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(log_id, tree_size, root_hash) of every size from 1 to each log's own, straight from the tiles, without a join.

    A size is made of the perfect subtrees to the left of the leaf that would come next. Above the tile these are the left
    siblings of the tile's chain, which all its sizes share; within it they are nodes of the tile itself. So a size costs
    as many hashes as it has bits set, and nothing is built again. `roots` (log_id, tree_size, root_hash) gives the whole
    logs, which no leaf follows. A size whose tile is not whole has a null root.
    """

    whole = F.col("levels").isNotNull() & F.col("upper").isNotNull()

    def sizes(shared: Column) -> Column:
        def size(slot: Column) -> Column:
            root = F.when(whole, _fold_left(F.concat(_left_within(slot), shared)))
            return F.struct(leaf_index(F.col("tile_index"), slot).alias("tree_size"), root.alias("root_hash"))

        return F.transform(F.sequence(F.lit(0), F.col("width") - 1), size)

    within = paths.select("log_id", F.explode(let(_left_above(), sizes)).alias("at")).select("log_id", "at.*").where("tree_size > 0")
    return within.unionByName(roots.where("tree_size > 0").select("log_id", "tree_size", "root_hash"))


def adjacent_consistency(paths: DataFrame) -> DataFrame:
    """(log_id, first_tree_size, second_tree_size, hashes): a proof from every size n to n + 1, straight from the tiles, without a join.

    The tree of n leaves is the fold of its perfect subtrees, and the next one only adds leaf n to the right of the smallest. So a proof
    is that subtree, the leaf, and the other subtrees; or the leaf alone where n is a power of two and so the old root is known.
    There are as many proofs as leaves, not pairs of sizes, and as a chain they lead from any size to any other. The proof of a
    tile that is not whole has null hashes.
    """
    whole = F.col("levels").isNotNull() & F.col("upper").isNotNull()

    def proved(shared: Column) -> Column:
        def at(slot: Column) -> Column:
            leaf = F.array(F.get(F.element_at("levels", 1), slot))

            def around(nodes: Column) -> Column:
                rest = F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0)))
                return F.when(F.size(nodes) == 1, leaf).otherwise(F.concat(F.slice(nodes, 1, 1), leaf, rest))

            size = leaf_index(F.col("tile_index"), slot)
            hashes = F.when(whole, let(F.concat(_left_within(slot), shared), around))
            return F.struct(size.alias("first_tree_size"), (size + 1).alias("second_tree_size"), hashes.alias("hashes"))

        return F.transform(F.sequence(F.lit(0), F.col("width") - 1), at)

    each = paths.select("log_id", F.explode(let(_left_above(), proved)).alias("at"))
    return each.select("log_id", "at.*").where("first_tree_size > 0")


def verify_adjacent(proved: DataFrame, known: DataFrame) -> DataFrame:
    """Add `first_ok` and `second_ok` to adjacent proofs: whether they lead to the known roots (log_id, tree_size, root_hash) of both sizes.

    Sizes of a log are joined once each, so no key is hot. A root that is not known, or a proof that is not there, is not ok.
    """
    roots = known.select("log_id", F.col("tree_size").alias("first_tree_size"), F.col("root_hash").alias("_first"))
    # One join key for both roots: a root travels with the proof from its size, and with the one to it.
    nexts = known.select("log_id", (F.col("tree_size") - 1).alias("first_tree_size"), F.col("root_hash").alias("_second"))
    rows = proved.join(roots, ["log_id", "first_tree_size"], "left").join(nexts, ["log_id", "first_tree_size"], "left")
    led = roots_from_consistency(F.col("first_tree_size"), F.col("second_tree_size"), F.col("_first"), F.col("hashes"))
    checked = rows.withColumn("_led", led)
    return checked.select(
        *proved.columns,
        F.coalesce(F.col("_led.first_root") == F.col("_first"), F.lit(False)).alias("first_ok"),
        F.coalesce(F.col("_led.second_root") == F.col("_second"), F.lit(False)).alias("second_ok"),
    )


def roots_at(sizes: DataFrame, paths: DataFrame, roots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add `root_hash` to rows (log_id, tree_size); null where the log never had that size or the tile needed is missing."""
    size = F.col("tree_size")
    known = roots.select("log_id", F.col("tree_size").alias("_whole"), F.col("root_hash").alias("_root"))
    rows = small_join(sizes, known, ["log_id"])
    rows = with_chain(rows, paths, F.when((size > 0) & (size < F.col("_whole")), size), "_chain", hot_rows)
    root = (
        F.when((size == 0) & F.col("_whole").isNotNull(), empty_root())
        .when(size == F.col("_whole"), F.col("_root"))
        .when(F.col("_chain").isNotNull(), F.element_at(older_edge(size, F.col("_chain")), -1))
    )
    return rows.select(*sizes.columns, root.alias("root_hash"))
