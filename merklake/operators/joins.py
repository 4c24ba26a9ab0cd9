"""Lookup joins that hold when one key carries a large share of the rows."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.sources.scratch import materialize

# A key is split when it has more rows than this and than a task's fair share of all rows.
HOT_ROWS = 1_000_000
# Bound on what is broadcast: the keys that cut down the other side of a lookup, and tables of one row per log.
BROADCAST_BYTES = 64 << 20
ELEMENT_BYTES = 128  # a level of a chain: two hashes and their headers


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the values of `df` are within the bound: eight bytes each, the bytes of strings and binaries, and ELEMENT_BYTES an
    element of an array."""
    size = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            size = size + F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) * ELEMENT_BYTES
    return (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES


@dataclass(frozen=True)
class Wanted:
    """Distinct non-null keys with their `_rows`; the heaviest key, and the rows that make a key hot."""

    keys: DataFrame
    heaviest: int
    hot_rows: int

    @property
    def counts(self) -> DataFrame | None:
        return self.keys if self.heaviest > self.hot_rows else None


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def wanted_keys(rows: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> Wanted:
    """Count the keys. A hot key has more than the fair share of a task, so there are fewer of them than partitions."""
    present = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in on])
    keys = materialize(rows.where(present).groupBy(*on).agg(F.count("*").alias("_rows")), "keys")
    stats = keys.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"), F.coalesce(F.max("_rows"), F.lit(0)).alias("heaviest")).first()
    return Wanted(keys, stats["heaviest"], max(hot_rows, -(-stats["n"] // _partitions(rows))))


def keep_wanted(one: DataFrame, wanted: Wanted, on: list[str]) -> DataFrame:
    """Rows of `one` that are asked for. Keys within the bound are broadcast, so a small batch never shuffles a whole log.

    Where `one` is stored in directories by a key, only those asked for are read; Spark prunes them only
    for a filtered key table, hence the filter that all keys pass.
    """
    keys = wanted.keys.where("_rows > 0").select(*on)
    return one.join(F.broadcast(keys), on, "left_semi") if fits_broadcast(keys) else one


def lookup_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    spread: Column | None = None,
    hot_rows: int = HOT_ROWS,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Left join of `many` (any number of rows per key) with `one` (at most one row per key).

    The keys are counted first, from `keys_from` where `many` is costly to compute. With that, `one`
    is cut down to the keys asked for and completed by `prepare`, and hot keys are split.
    """
    wanted = wanted_keys(many if keys_from is None else keys_from, on, hot_rows)
    one = keep_wanted(one, wanted, on)
    one = one if prepare is None else prepare(one)
    return split_join(many, one, on, wanted.counts, spread, wanted.hot_rows)


def split_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    counts: DataFrame | None,
    spread: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join with one row per key, rows of hot keys dealt over several pieces.

    `counts` holds keys with their `_rows` in `many`, the hot ones at least; None when no key is hot.
    Rows are dealt by `spread`, which must differ between them (by default the request id, or else all
    plain columns), and the single row of `one` is repeated once per piece. The split depends on row
    values only, so a task that runs again deals its rows the same way.
    """
    keyless = reduce(or_, [F.col(key).isNull() for key in on])
    spread = _row_hash(many) if spread is None else spread

    def piece(pieces: Column) -> Column:
        # Rows without a key match nothing; dealt out so that they do not meet in one task.
        return F.pmod(F.xxhash64(spread), F.when(keyless, F.lit(_partitions(many)).cast("bigint")).otherwise(pieces))

    if counts is None:
        dealt = many.withColumn("_piece", piece(F.lit(1).cast("bigint")))
        return dealt.join(one.withColumn("_piece", F.lit(0).cast("bigint")), [*on, "_piece"], "left").drop("_piece")
    hot = counts.where(F.col("_rows") > hot_rows).select(*on, F.ceil(F.col("_rows") / hot_rows).alias("_pieces"))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    # Fewer hot keys than partitions where `hot_rows` is a fair share at least, as wanted_keys() gives it.
    dealt = many.join(F.broadcast(hot), on, "left").withColumn("_piece", piece(pieces))
    repeated = one.join(F.broadcast(hot), on, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), (pieces - 1).cast("bigint")))
    )
    return dealt.drop("_pieces").join(repeated.drop("_pieces"), [*on, "_piece"], "left").drop("_piece")


def match_join(many: DataFrame, other: DataFrame, on: list[str], spread: Column, other_spread: Column, hot_pairs: int = HOT_ROWS) -> DataFrame:
    """Inner join in which a key may have any number of rows on both sides.

    Pairs are counted per key first. A key with more than `hot_pairs`, and more than a task's fair share of all pairs, becomes a grid: rows
    of `many` are dealt over its lines and those of `other` over its columns, by `spread` and `other_spread`, and each row is repeated along
    the other direction. So a cell has about `hot_pairs` pairs, whichever side is large, and rows are repeated far less often than they
    have partners. Other keys are joined as they are. There are fewer hot keys than partitions, so their table is small.
    """
    wanted = wanted_keys(many, on)
    other = keep_wanted(other, wanted, on)
    partners = other.groupBy(*on).agg(F.count("*").alias("_partners"))
    pairs = F.col("_rows").cast("double") * F.col("_partners")
    counts = materialize(wanted.keys.join(partners, on).withColumn("_pairs", pairs), "pairs")
    stats = counts.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0)).alias("n"), F.coalesce(F.max("_pairs"), F.lit(0.0)).alias("most")).first()
    fair = max(float(hot_pairs), stats["n"] / _partitions(many))
    if stats["most"] <= fair:
        return many.join(other, on)
    cells = F.ceil(F.col("_pairs") / fair)
    lines = F.least(F.greatest(F.ceil(F.sqrt(cells * F.col("_rows") / F.col("_partners"))), F.lit(1)), cells)
    hot = counts.where(F.col("_pairs") > fair).select(*on, lines.alias("_lines"), cells.alias("_cells"))
    hot = F.broadcast(hot.select(*on, "_lines", F.ceil(F.col("_cells") / F.col("_lines")).alias("_columns")))

    def dealt(rows: DataFrame, own: str, along: str, by: Column) -> DataFrame:
        marked = rows.join(hot, on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(1)).cast("bigint") for c in ("_lines", "_columns")})
        marked = marked.withColumn(f"_{own}", F.pmod(F.xxhash64(by), F.col(f"_{own}s")))
        return marked.withColumn(f"_{along}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_{along}s") - 1))).drop("_lines", "_columns")

    left, right = dealt(many, "line", "column", spread), dealt(other, "column", "line", other_spread)
    return left.join(right, [*on, "_line", "_column"]).drop("_line", "_column")


def _row_hash(rows: DataFrame) -> Column:
    if "request_id" in rows.columns:
        return F.col("request_id")
    return F.xxhash64(*[name for name, kind in rows.dtypes if kind in ("bigint", "int", "string")])


def small_join(many: DataFrame, one: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a table of one row per log: broadcast within the bound of bytes, else by hot key."""
    if fits_broadcast(one):
        return many.join(F.broadcast(one), on, how)
    marked = lookup_join(many, one.withColumn("_here", F.lit(True)), on)
    return (marked if how == "left" else marked.where("_here")).drop("_here")


def explode_range(df: DataFrame, first: Column, last: Column, name: str, chunk_bits: int = 14) -> DataFrame:
    """One row per integer of [first, last], in three steps, so that no step makes more than 2^chunk_bits rows of one for
    any range under 2^(3 * chunk_bits), and no long array is ever built.

    Rows are spread again between the steps: one wide range does not stay in one task. The number
    of partitions is given, because the rows are small before the last step and large after it.
    """
    chunk, keys = f"_{name}_chunk", [c for c in df.columns if not c.startswith("_")]
    out = df.withColumn("_first", first).withColumn("_last", last).where(F.col("_first") <= F.col("_last")).withColumn(chunk, F.lit(0).cast("bigint"))
    for bits in (2 * chunk_bits, chunk_bits, 0):
        low, high = F.shiftright("_first", bits), F.shiftright("_last", bits)
        if bits < 2 * chunk_bits:
            out = out.repartition(_partitions(df), *keys, chunk)
            low = F.greatest(low, F.shiftleft(F.col(chunk), chunk_bits))
            high = F.least(high, F.shiftleft(F.col(chunk), chunk_bits) + ((1 << chunk_bits) - 1))
        out = out.withColumn(chunk, F.explode(F.sequence(low, high)))
    return out.withColumn(name, F.col(chunk)).drop("_first", "_last", chunk)
