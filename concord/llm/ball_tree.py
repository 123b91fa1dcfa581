"""Exact top-k search by inner product: ball-tree branch and bound in shards.

Space is split coarsely: vectors go to the nearest of some pivots, a sample, and make cells, each a ball around its pivot. A cell
is dealt to shards of about SHARD rows, and each shard becomes one ball tree. Queries go in blocks: a task has one tree and one
block. It walks the tree for all queries of the block together; at a node only those queries go on whose upper bound (inner
product with the centre, plus the query's length times the radius) reaches their kth score, and each goes first to the child
with the higher bound. The kth scores are shared: a first round searches one shard, of the cell whose pivot has the highest
product, and the kth score there is the floor with which a query asks the others, and only those cells whose bound reaches it.

Scores are exact integers; a bound is widened by its rounding error, and a node whose bound equals the floor is searched, so
ties are decided by id and not by order.

Defined results: vectors that are null, or hold a null or a non-finite component, and rows without an id take no part; vectors
of different length have no score; a query with fewer candidates than k gets all; rows that repeat an id are rows of their own,
also as queries; scores beyond 64 bits are held at its ends; an empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, cut, cut_small

#: Rows of a shard, queries of a block, rows of a leaf; queries that are parted by the child they go to first.
SHARD, BLOCK, LEAF, PARTED = 8192, 4096, 64, 256
#: Pivots of one dimension at most, and their bytes: they are broadcast. Larger cells have more shards.
CELLS, CELL_BYTES = 4096, 32 << 20
LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, dim, q (the components as integers) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    q = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(v).alias("dim"), q.alias("q"))


def matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table as rows: floats where all products are exact in them, else Python's integers."""
    column = table.column("q").combine_chunks()
    flat = column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)
    return flat


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact, as 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    found = a.astype(object) @ b.astype(object).T
    return np.clip(found, LEAST + 1, 2**63 - 1).astype(np.int64)


def upper_bounds(queries: np.ndarray, length: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """queries x balls: what no inner product of a query with a vector in the ball exceeds, rounding included."""
    middle, reach = queries @ centre.T, length[:, None] * radius[None, :]
    return middle + reach + 1e-9 * (np.abs(middle) + reach + length[:, None] * np.sqrt((centre**2).sum(axis=1))[None, :]) + 1e-6


class BallTree:
    """rows (in tree order), and for each node: lo, hi (its rows), left, right (children or -1), centre, radius."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, rows: np.ndarray, rid: np.ndarray, ids: np.ndarray, most: int | None = None) -> BallTree:
        """most: of equal vectors that make a leaf, only so many with the least ids are looked at."""
        x = rows.astype(np.float64)
        order = np.argsort(ids, kind="stable")
        lo, hi, left, right, centre, radius = [], [], [], [], [], []

        def add(a: int, b: int) -> int:
            own = x[order[a:b]]
            c = own.mean(axis=0)
            lo.append(a), hi.append(b), left.append(-1), right.append(-1), centre.append(c)
            radius.append(float(np.sqrt(((own - c) ** 2).sum(axis=1).max())))
            return len(lo) - 1

        waiting = [add(0, len(x))]
        while waiting:
            k = waiting.pop()
            a, b = lo[k], hi[k]
            own = x[order[a:b]]
            if (rows[order[a:b]] == rows[order[a]]).all():
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
                hi[k] = min(b, a + most) if most else b
                continue
            if b - a <= LEAF:
                continue
            far = own[((own - centre[k]) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
            left[k], right[k] = add(a, (a + b) // 2), add((a + b) // 2, b)
            waiting += [left[k], right[k]]
        return cls({"rows": rows[order], "rid": rid[order], "ids": ids[order], "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left), "right": np.array(right), "centre": np.array(centre), "radius": np.array(radius)})

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> BallTree:
        with np.load(io.BytesIO(raw), allow_pickle=False) as arrays:
            return cls(dict(arrays))

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, found) of the best k rows of each query: queries x k, found is False where there are fewer."""
        m = len(queries)
        score, ids = np.full((m, k), LEAST), np.full((m, k), np.iinfo(np.int64).max)
        q = queries.astype(np.float64)
        length = np.sqrt((q * q).sum(axis=1))

        def bound(node: int, some: np.ndarray) -> np.ndarray:
            return upper_bounds(q[some], length[some], self.centre[node][None, :], self.radius[node : node + 1])[:, 0]

        waiting = [(0, np.arange(m))]
        while waiting:
            node, some = waiting.pop()
            some = some[bound(node, some) >= np.maximum(floor[some], score[some, -1])]
            if not len(some):
                continue
            if self.left[node] < 0:
                self.look(node, some, queries, own, score, ids)
                continue
            left, right = int(self.left[node]), int(self.right[node])
            first = bound(left, some) >= bound(right, some)
            if len(some) < PARTED:  # too few to part: all go where most would
                first[:] = 2 * first.sum() >= len(some)
            # The last one in is the first to be looked at.
            waiting += [(c, part) for c, part in ((right, some[first]), (left, some[~first]), (left, some[first]), (right, some[~first])) if len(part)]
        return score, ids, score > LEAST

    def look(self, node: int, some: np.ndarray, queries: np.ndarray, own: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Score the rows of a leaf for some queries, and keep the best."""
        at = slice(self.lo[node], self.hi[node])
        new = exact(queries[some], self.rows[at])
        new[own[some][:, None] == self.rid[at][None, :]] = LEAST
        better = new.max(axis=1) >= score[some, -1]
        some, new = some[better], new[better]
        every = np.concatenate([score[some], new], axis=1)
        names = np.concatenate([ids[some], np.broadcast_to(self.ids[at], new.shape)], axis=1)
        best = np.lexsort((names, -np.maximum(every, LEAST + 1)), axis=1)[:, : score.shape[1]]
        score[some], ids[some] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)


def pivots(rows: DataFrame, shard: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension that has more rows than a shard, distinct vectors with the least hashes: at most CELLS, and CELL_BYTES, of one dimension."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > shard)
    cells = F.least(F.ceil(F.col("n") / shard), F.lit(CELLS), F.greatest(F.floor(F.lit(CELL_BYTES) / (8 * F.col("dim"))), F.lit(1)))
    sizes = cut_small(sizes.select("dim", "n", cells.alias("cells")), "sizes")
    span = 1 << 40
    h = F.pmod(F.xxhash64("q"), F.lit(span))
    near = rows.join(sizes, "dim").withColumn("h", h).filter(F.col("h") < F.ceil(F.lit(float(span)) * (4 * F.col("cells") + 20) / F.col("n")))
    once = near.groupBy("dim", "h").agg(F.any_value("q").alias("q"), F.any_value("cells").alias("cells"))
    rank = F.row_number().over(W.partitionBy("dim").orderBy("h"))
    table = once.withColumn("rank", rank).filter(F.col("rank") <= F.col("cells")).select("dim", "rank", "q").toArrow().sort_by([("dim", "ascending"), ("rank", "ascending")])
    return {d: matrix(table.filter(pc.equal(table.column("dim"), d))).astype(np.float64) for d in pc.unique(table.column("dim")).to_pylist()}


def in_slices(n: int, size: int = 512) -> list[slice]:
    return [slice(k, min(k + size, n)) for k in range(0, n, size)]


def top_k(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query (over vec_id) picks, the k other rows with the highest inner products of components floor(scale * x).

    report: gets the number of shards, of queries, and of shards that queries asked.
    """
    vectors = bounded(vectors, 4096, 8 << 20)
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, vector, scale)
    shared = spark.sparkContext.broadcast(pivots(rows, shard))

    def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
        table = pa.Table.from_batches([batch])
        for d in pc.unique(table.column("dim")).to_pylist():
            yield d, table.filter(pc.equal(table.column("dim"), d))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own in by_dimension(batch):
                x = matrix(own).astype(np.float64) if d else np.zeros((own.num_rows, 0))
                centre = shared.value.get(d, np.zeros((1, d)))
                cell = np.concatenate([((centre**2).sum(axis=1) / 2 - x[s] @ centre.T).argmin(axis=1) for s in in_slices(len(x))])
                far = np.sqrt(((x - centre[cell]) ** 2).sum(axis=1))
                yield from own.append_column("cell", pa.array(cell, pa.int64())).append_column("far", pa.array(far)).combine_chunks().to_batches()

    dealt = rows.mapInArrow(assign, "vec_id long, dim int, q array<long>, cell long, far double")
    dealt = cut(dealt.select(F.monotonically_increasing_id().alias("rid"), "*"), "vectors")
    cells = cut_small(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).alias("shards"), F.max("far").alias("radius")), "cells")
    queries = dealt.filter(is_query).select("rid", "vec_id", "dim", "q")
    blocks = cut_small(queries.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
    # Cells are at most CELLS a dimension.
    listed: dict[int, dict[int, float]] = {}
    for r in cells.join(blocks, "dim").select("dim", "cell", "radius").collect():
        listed.setdefault(r.dim, {})[r.cell] = r.radius
    balls = spark.sparkContext.broadcast({d: (np.array(sorted(own)), np.array([own[c] for c in sorted(own)])) for d, own in listed.items()})

    def build(table: pa.Table) -> pa.Table:
        tree = BallTree.build(matrix(table), table.column("rid").to_numpy(), table.column("vec_id").to_numpy(), k + 1)
        return pa.table({**{c: table.column(c)[:1] for c in ("dim", "cell", "shard")}, "tree": pa.array([tree.dump()], pa.binary())})

    sharded = dealt.join(cells, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards")))
    trees = cut(sharded.select("dim", "cell", "shard", "rid", "vec_id", "q").groupBy("dim", "cell", "shard").applyInArrow(build, "dim int, cell long, shard long, tree binary"), "trees")

    def reached(first: bool):
        """rid, cell of the cells that each query asks: the one whose pivot has the highest product, or all whose bound reaches its floor."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, own in by_dimension(batch):
                    names, radius = balls.value[d]
                    centre = shared.value.get(d, np.zeros((1, d)))[names]
                    x = matrix(own).astype(np.float64) if d else np.zeros((own.num_rows, 0))
                    rid, floor = own.column("rid").to_numpy(), own.column("floor").to_numpy()
                    for s in in_slices(len(x)):
                        if first:
                            row, cell = np.arange(s.stop - s.start), (x[s] @ centre.T).argmax(axis=1)
                        else:
                            row, cell = np.nonzero(upper_bounds(x[s], np.sqrt((x[s] ** 2).sum(axis=1)), centre, radius) >= floor[s][:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(rid[s][row]), pa.array(names[cell])], ["rid", "cell"])

        return run

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        own = cut(asking.select("dim", "rid", "q", "floor").mapInArrow(reached(first), "rid long, cell long"), "reached")
        own = asking.join(own, "rid").join(cells.select("dim", "cell", "shards"), ["dim", "cell"]).join(blocks, "dim")
        each = F.array(F.pmod(F.xxhash64("rid", F.lit(1)), F.col("shards"))) if first else F.expr("sequence(0L, shards - 1)")
        asked = own.select("rid", F.col("vec_id").alias("query_id"), "dim", "cell", "q", "floor", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("blocks")).alias("block"), F.explode(each).alias("shard"))
        if report is not None and not first:
            report.update(shards=trees.count(), queries=queries.count(), asked=asked.count())
        keys = ["dim", "cell", "shard", "block"]
        wanted = trees.join(asked.select(*[F.col(c).alias(c) for c in keys]).distinct(), keys[:3])

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            kinds = pa.schema([("rid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
            if not left.num_rows or not right.num_rows:
                return kinds.empty_table()
            tree = BallTree.load(left.column("tree")[0].as_py())
            rid = right.column("rid").to_numpy()
            score, ids, found = tree.search(matrix(right), rid, right.column("floor").to_numpy(), k)
            return pa.table([np.repeat(rid, k)[found.ravel()], np.repeat(right.column("query_id").to_numpy(), k)[found.ravel()], ids[found], score[found]], schema=kinds)

        return wanted.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "rid long, query_id long, vec_id long, score long")

    none = F.lit(int(LEAST)).cast("long")
    kth = searched(queries.withColumn("floor", none), True).groupBy("rid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    floors = queries.join(cut_small(kth, "floors"), "rid", "left").withColumn("floor", F.coalesce("floor", none))
    found = cut(searched(floors, False), "found")
    rank = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
