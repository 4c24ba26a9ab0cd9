"""Approximate nearest neighbours by largest inner product: multi-probe hashing with p-stable (Gaussian) projections.

Vectors are scaled by the largest norm and given one more coordinate that brings them to length one; queries are scaled to
length one. Then the largest inner product is the smallest distance. Each of several tables cuts `width`-wide slots along
random directions; a vector lies in one cell of a table. A query visits its own cell and the cells next to it in the order
of their estimated chances (the smaller the sum of squared distances to the slots' edges crossed, the likelier), and every
candidate there is scored exactly; the best of all tables and probes are merged. Queries that met fewer than k rows so visit
ever more cells, and those still short then meet all rows, in blocks: every query gets k neighbours, or all there are.

Vectors and probes meet by cell. A cell with more than `piece` vectors or probes (copies of one vector, say) is split by hash
into a grid of pieces, each of bounded size, so nothing is left out and no task holds a whole hot cell.

Vectors that are null, zero, of another length than the longest, or hold null or non-finite components take no part, nor
do rows without an id. Repeated rows of one id and vector count once. An empty table gives an empty result.
"""

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from merklake.sources.scratch import materialize


@dataclass(frozen=True)
class Settings:
    """Chosen for 64 dimensions, where near and far hardly differ: a recall of 0.9 needs large cells."""

    tables: int = 6
    hashes: int = 4
    width: float = 1.8
    probes: int = 10
    piece: int = 16_384
    seed: int = 11


def probe_order(below: np.ndarray, probes: int) -> list[np.ndarray]:
    """Steps from the own cell to each of the likeliest, by subsets of edges crossed. below: distances to the lower edges, as
    shares of a slot."""
    hashes = len(below)
    gaps = np.concatenate((below, 1 - below)) ** 2
    order = np.argsort(gaps, kind="stable")
    cost = gaps[order]
    out, queue = [np.zeros(hashes, dtype=np.int64)], [(float(cost[0]), (0,))]
    while len(out) < probes and queue:
        total, chosen = heapq.heappop(queue)
        edges = order[list(chosen)]
        if len({int(e) % hashes for e in edges}) == len(edges):  # never both edges of one slot
            step = np.zeros(hashes, dtype=np.int64)
            step[edges % hashes] = np.where(edges < hashes, -1, 1)
            out.append(step)
        last = chosen[-1]
        if last + 1 < len(cost):
            heapq.heappush(queue, (total - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(queue, (total + float(cost[last + 1]), (*chosen, last + 1)))
    return out


class Hasher:
    def __init__(self, dim: int, largest: float, settings: Settings):
        random = np.random.default_rng(settings.seed)
        self.settings, self.largest = settings, largest
        self.directions = random.standard_normal((settings.tables, dim + 1, settings.hashes))
        self.shifts = random.uniform(0, 1, (settings.tables, settings.hashes))

    def _slots(self, points: np.ndarray, table: int) -> np.ndarray:
        return points @ self.directions[table] / self.settings.width + self.shifts[table]

    def _cell(self, slots: np.ndarray) -> np.ndarray:
        return (slots + (1 << 14)) @ (1 << 15) ** np.arange(self.settings.hashes)

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        scaled = vectors / self.largest
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        return self._cell(np.floor(self._slots(np.column_stack((scaled, rest)), table)).astype(np.int64))

    def probes(self, queries: np.ndarray, table: int) -> list[np.ndarray]:
        scaled = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        at = self._slots(np.column_stack((scaled, np.zeros(len(scaled)))), table)
        low = np.floor(at)
        return [self._cell(base + np.array(probe_order(gap, self.settings.probes))) for base, gap in zip(low.astype(np.int64), at - low, strict=True)]

    def of_vectors(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each table: cells, and the vector that lies in each."""
        for t in range(self.settings.tables):
            yield self.cells(vectors, t), np.arange(len(vectors))

    def of_queries(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each table: cells, and the query that probes each."""
        for t in range(self.settings.tables):
            cells = self.probes(queries, t)
            yield np.concatenate(cells), np.repeat(np.arange(len(cells)), [len(c) for c in cells])


def _one_cell(vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield np.zeros(len(vectors), dtype=np.int64), np.arange(len(vectors))


def _usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


_ROW = "t int, cell bigint, id bigint, vector binary"


def _spread(rows: DataFrame, places: Callable) -> DataFrame:
    """A row per place: of each table, or of each table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            raw = pa.array([v.tobytes() for v in vectors], pa.binary())
            for t, (cells, at) in enumerate(places(vectors)):
                tables = pa.array(np.full(len(at), t, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([tables, pa.array(cells), batch.column("id").take(pa.array(at)), raw.take(pa.array(at))], ["t", "cell", "id", "vector"])

    return rows.mapInArrow(run, _ROW)


def _first(k: int, ids: np.ndarray, vectors: np.ndarray, close: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of the rows `close`; one id with one score takes one place, as in the merged result."""
    exact = (vectors[close] * query).sum(axis=1)  # summed in one order, so equal vectors get equal scores
    order = np.lexsort((ids[close], -exact))
    best, scores = ids[close][order], exact[order]
    new = np.append(True, (best[1:] != best[:-1]) | (scores[1:] != scores[:-1]))[: len(best)]
    return best[new][:k], scores[new][:k]


def _best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, queries = (x["id"].combine_chunks().to_numpy() for x in (left, right))
        vectors, wanted = (np.frombuffer(b"".join(x["vector"].to_pylist()), dtype=np.float64).reshape(x.num_rows, -1) for x in (left, right))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), 256):
            rough = wanted[at : at + 256] @ vectors.T
            for query, q, near in zip(queries[at : at + 256], wanted[at : at + 256], rough, strict=True):
                near[ids == query] = -np.inf
                least = np.partition(near, -k)[-k] if len(near) > k else -np.inf
                close = np.flatnonzero((near >= least - 1e-9 * (1 + abs(least))) & (near > -np.inf) if np.isfinite(least) else near > -np.inf)
                best, scores = _first(k, ids, vectors, close, q)
                if len(best) < k and len(close) < len(near):  # vectors of one id and score had taken several places
                    best, scores = _first(k, ids, vectors, np.flatnonzero(near > -np.inf), q)
                found.append((np.full(len(best), query), best, scores))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=schema)

    return run


def _met(cells: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best met. Both sides have their v_pieces and q_pieces."""

    def pieces(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row goes to one piece of its own side, and to every piece of the other side."""
        mine = F.pmod(F.xxhash64("id", "vector"), F.col(f"{own}_pieces")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_pieces") - 1)).alias(other)
        return rows.select("t", "cell", mine, every, "id", "vector")

    keys = ["t", "cell", "v", "q"]
    met = pieces(cells, "v", "q").groupBy(*keys).cogroup(pieces(probes, "q", "v").groupBy(*keys))
    found = met.applyInArrow(_best(k), "query_id bigint, vec_id bigint, score double")
    # A vector found in several cells has the same score in each, so it takes one place.
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()


def _met_in_cells(known: DataFrame, wanted: DataFrame, hasher: Hasher, k: int) -> DataFrame:
    cells, probes = _spread(known, hasher.of_vectors), _spread(wanted, hasher.of_queries)
    size = F.ceil(F.col("count") / hasher.settings.piece).cast("int")
    v_pieces = cells.groupBy("t", "cell").count().where(size > 1).select("t", "cell", size.alias("v_pieces"))
    q_pieces = probes.groupBy("t", "cell").count().where(size > 1).select("t", "cell", size.alias("q_pieces"))

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(v_pieces, ["t", "cell"], "left").join(q_pieces, ["t", "cell"], "left").na.fill(1, ["v_pieces", "q_pieces"])

    return _met(sized(cells), sized(probes), k)


def _met_in_blocks(known: DataFrame, wanted: DataFrame, piece: int, k: int) -> DataFrame:
    """Every query meets every row."""
    pieces = {f"{name}_pieces": F.lit(max(1, -(-rows.count() // piece))) for name, rows in (("v", known), ("q", wanted))}
    return _met(*(_spread(rows, _one_cell).withColumns(pieces) for rows in (known, wanted)), k)


def _short(wanted: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Queries with fewer than k neighbours so far."""
    whole = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    return materialize(wanted.join(whole, "id", "left_anti"), "short")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of each row of `queries` among the rows of `vectors`,
    which have the same columns; a row is no neighbour of its own id. Equal scores go by smaller id."""

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
        return rows.where(F.col("id").isNotNull() & _usable("vector"))

    known, wanted = usable(vectors), usable(queries)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    # Vectors of other lengths than the commonest (of two, the longer) have no inner product with the rest.
    lengths = known.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("largest"))
    facts = lengths.orderBy(F.desc("n"), F.desc("dim")).first() or {"dim": 0, "largest": None}
    dim = facts["dim"]
    # Repeated rows go before they are hashed: in a cell or a piece they would take the places of others.
    known, wanted = (rows.where(F.size("vector") == dim).dropDuplicates(["id", "vector"]) for rows in (known, wanted))
    probes, every = settings.probes, 3**settings.hashes
    found = materialize(_met_in_cells(known, wanted, Hasher(dim, facts["largest"] or 1.0, settings), k), "found")
    while (wanted := _short(wanted, found, k)).take(1):
        in_cells = probes < every and known.count() > settings.piece  # fewer rows are met at once
        if in_cells:
            probes = min(3 * probes, every)
            more = _met_in_cells(known, wanted, Hasher(dim, facts["largest"], replace(settings, probes=probes)), k)
        else:
            more = _met_in_blocks(known, wanted, settings.piece, k)
        again = wanted.select(F.col("id").alias("query_id"))
        found = materialize(found.join(again, "query_id", "left_anti").unionByName(more).select(*found.columns), "found")
        if not in_cells:
            break
    return found
