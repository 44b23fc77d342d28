"""Exact top-k inner products by M-tree best-first search.

Vectors get one more coordinate, sqrt(M^2 - |x|^2), where M is the largest norm; then |q - x|^2 = |q|^2 + M^2 - 2 q.x for a query
with 0 there, so nearest means highest inner product and the metric holds.

The root page of the tree has at most ``CELLS`` entries: pivots from a sample, with the covering radius of the rows nearest to each.
A cell's rows are dealt by hash into blocks of bounded size, and each block becomes an M-tree: pages of entries with pivots, covering
radii and distances to the parent. A query visits pages in order of their bounds; stored parent distances rule entries out by the
triangle inequality before any distance is computed. Scores of the leaf entries that remain are exact integers, and a page is skipped
only if its bound is below the k-th score, so ties go to the smaller id.

A query is first answered in the block that holds it, while that block's tree is built; its k-th score there goes along as a floor. It
then visits only those cells whose bound reaches the floor. Packed queries meet each block in groups of bounded size (a stated query
set against all rows, in blocks).

Where vectors are spread evenly over a sphere of many dimensions no bound excludes anything, and each query reads every page; the tree
pays only where vectors cluster. ``search`` counts what it reads, and the tests hold both cases.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors of
another length are searched on their own (an error beyond ``LENGTHS`` lengths); empty vectors score 0 with each other; queries with
fewer than k candidates return all; repeated vectors tie by id; of repeated ids, each row is a query or candidate of its own, and only
the query's own row is left out; components of any size are exact up to squared norms of 2^62, beyond which scores may not fit 64 bits and the table is an error;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlake.llm.common import kept_only, parallelism, written
from questlake.session import importable

PAGE = 256
BLOCK = 8192
#: Entries of the root page.
CELLS = 1024
#: Different vector lengths that one table may have.
LENGTHS = 64
#: Queries that meet a block at once.
CHUNK = 1 << 15
EPS = 1e-6


@dataclass
class Node:
    """A page. leaf: rows of the block; else children. pivots: (n, d); radii (0 in leaves), parent: distance to the page's pivot."""

    leaf: bool
    rows: np.ndarray
    pivots: np.ndarray
    radii: np.ndarray
    parent: np.ndarray
    children: list["Node"]


def build(ids: np.ndarray, vectors: np.ndarray, top: float, page: int = PAGE) -> tuple[Node, np.ndarray]:
    """Bulk-load: split by farthest pivots until a page holds the rows."""
    points = _lifted(vectors, top)

    def leaf(rows: np.ndarray, pivot: np.ndarray) -> Node:
        return Node(True, rows, points[rows], np.zeros(len(rows)), np.linalg.norm(points[rows] - pivot, axis=1), [])

    def split(rows: np.ndarray, pivot: np.ndarray) -> Node:
        if len(rows) <= page:
            return leaf(rows, pivot)
        k = min(page, -(-len(rows) // page))
        chosen, far = [], np.linalg.norm(points[rows] - pivot, axis=1)
        for _ in range(k):
            i = int(far.argmax())
            if chosen and far[i] <= 0:
                break
            chosen.append(i)
            far = np.minimum(far, np.linalg.norm(points[rows] - points[rows[i]], axis=1))
        centres = points[rows[chosen]]
        near = np.stack([np.linalg.norm(points[rows] - c, axis=1) for c in centres], axis=1)
        own = near.argmin(axis=1)
        groups = [np.flatnonzero(own == g) for g in range(len(centres))]
        if max(map(len, groups)) == len(rows):  # equal points: cut by position
            groups = list(np.array_split(np.arange(len(rows)), k))
            centres, near = np.repeat(centres[:1], k, 0), np.repeat(near[:, :1], k, 1)
        kept = [(g, x) for g, x in enumerate(groups) if len(x)]
        pivots = np.stack([centres[g] for g, _ in kept])
        return Node(False, rows[:0], pivots, np.array([near[x, g].max() for g, x in kept]), np.linalg.norm(pivots - pivot, axis=1), [split(rows[x], centres[g]) for g, x in kept])

    root = points.mean(axis=0) if len(points) else np.zeros(vectors.shape[1] + 1)
    return split(np.arange(len(ids)), root), root


def search(tree: tuple[Node, np.ndarray], ids: np.ndarray, query: np.ndarray, own: int, k: int, top: float, floor: float = -np.inf, seen: Counter | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of a block, best-first over page bounds; scores below ``floor`` are of no use and may be missing.

    ``own`` is the row that isn't a candidate (-1 for none). ``seen`` counts the pages read and the entries scored.
    """
    root, pivot = tree
    q = np.append(query, 0.0)
    shift = query @ query + top
    bound = lambda dist: (shift - dist * dist) / 2 + EPS * (1 + shift)  # noqa: E731  the highest score at that distance
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
    queue = [(-np.inf, 0, root, float(np.linalg.norm(q - pivot)))]
    tick = 0
    while queue:
        low, _, node, d_parent = heapq.heappop(queue)
        worst = max(floor, best[0][0]) if len(best) == k else floor
        if -low < worst:
            break
        if not len(node.parent):
            continue
        # triangle inequality over stored distances: no computation for entries that it rules out
        least = np.maximum(np.abs(d_parent - node.parent) - node.radii, 0.0)
        live = np.flatnonzero(bound(least) >= worst)
        if not len(live):
            continue
        if seen is not None:
            seen["pages"] += 1
            seen["entries"] += len(live) if node.leaf else 0
        if node.leaf:
            whole = len(live) == len(node.rows)
            points = node.pivots if whole else node.pivots[live]
            # beyond 2^53 floating sums may round; products and their sums are at most top, which fits 64 bits
            scores = np.rint(points @ q).astype(np.int64) if top < 2.0**53 else points[:, :-1].astype(np.int64) @ query.astype(np.int64)
            near = np.flatnonzero(scores >= worst)
            rows = node.rows[live[near]]
            for s, i, r in zip(scores[near].tolist(), ids[rows].tolist(), rows.tolist()):
                if r == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            continue
        dist = np.linalg.norm(node.pivots[live] - q, axis=1)
        highest = bound(np.maximum(dist - node.radii[live], 0.0))
        for j, d, h in zip(live.tolist(), dist.tolist(), highest.tolist()):
            if h >= worst:
                tick += 1
                heapq.heappush(queue, (-h, tick, node.children[j], d))
    return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Rows with the coordinate that makes all norms equal."""
    return np.concatenate([vectors, np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", vectors, vectors)))[:, None]], axis=1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * (points @ pivots.T)
    return np.sqrt(np.maximum(0.0, squares))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _search_length(rows: DataFrame, d: int, n: int, top: float, k: int, block: int, cells: int, chunk: int) -> DataFrame:
    """(row, query_id, vec_id, score): hits of the vectors of one length ``d`` (columns row, id, v, q)."""
    sc = rows.sparkSession.sparkContext
    block = max(16, min(block, (1 << 19) // d))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, min(cells, -(-n // block)))).select("v").collect()  # at most CELLS rows
    pivots = np.unique(_lifted(np.array([r.v for r in sample]), top), axis=0)
    sent = sc.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_lifted(_matrix(batch.column(2), d), top), sent.value)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=["row", "id", "v", "q", "cell", "far"])

    dealt = written(rows.mapInArrow(nearest, "row long, id long, v array<double>, q boolean, cell int, far double"), "cells")
    radius, size = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # at most CELLS rows
        radius[r.cell], size[r.cell] = r.far, -(-r.n // block)
    first = np.cumsum(size) - size
    bounds = sc.broadcast((radius, first, size))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first_, size_ = bounds.value
        for batch in batches:
            row, cell = batch.column(0).to_numpy().astype(np.uint64), batch.column(4).to_numpy()
            salt = ((row * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % size_[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first_[cell] + salt.astype(np.int64))], names=["row", "id", "v", "q", "block"])

    shape = "block long, tree binary, row long, query_id long, query binary, floor double, vec_id long, score long"
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in shape.split(", ")]
    as_table = lambda out: pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names=names)

    def grow(table: pa.Table) -> pa.Table:
        """The block's tree, its queries with their floors, and the hits that it holds itself."""
        at = int(table.column("block")[0].as_py())
        row, ids, q = (table.column(c).to_numpy() for c in ("row", "id", "q"))
        v = _matrix(table.column("v").combine_chunks(), d)
        tree = build(ids, v, top)
        out = [(at, pickle.dumps((ids, tree)), None, None, None, None, None, None)]
        for i in np.flatnonzero(q).tolist():
            got = search(tree, ids, v[i], i, k, top)
            floor = np.nextafter(float(got[-1][0]), -np.inf) if len(got) == k else -np.inf
            out.append((at, None, int(row[i]), int(ids[i]), v[i].tobytes(), floor, None, None))
            out += [(at, None, int(row[i]), int(ids[i]), None, None, n, s) for s, n in got]
        return as_table(out)

    grown = written(dealt.mapInArrow(number, "row long, id long, v array<double>, q boolean, block long").groupBy("block").applyInArrow(grow, shape), "mtree")
    asked = grown.where("query IS NOT NULL")
    chunks = -(-asked.count() // chunk) or 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries packed for each block whose cell their floor doesn't rule out."""
        from pyspark import TaskContext

        radius_, first_, size_ = bounds.value
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            if not batch.num_rows:
                continue
            home, row, qid, floor = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            v = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(-1, d)
            shift = np.einsum("ij,ij->i", v, v)[:, None] + top
            least = np.maximum(_distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), sent.value) - radius_ - 1e-6 * np.sqrt(shift), 0.0)
            live = (shift - least * least) / 2 + EPS * (1 + shift) >= floor[:, None]
            turn += 1
            for cell in np.flatnonzero(live.any(axis=0)).tolist():
                for at in range(first_[cell], first_[cell] + size_[cell]):
                    m = live[:, cell] & (home != at)
                    if m.any():
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([turn % chunks]), *(pa.array([x[m].tobytes()], pa.binary()) for x in (row, qid, floor, v))], names=["block", "chunk", "rows", "ids", "floors", "vectors"])

    packed = asked.select("block", "row", "query_id", "query", "floor").mapInArrow(route, "block long, chunk long, rows binary, ids binary, floors binary, vectors binary")
    trees = grown.where("tree IS NOT NULL").select("block", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, tree = pickle.loads(left.column("tree")[0].as_py())
            for raw in zip(*(right.column(c).to_pylist() for c in ("rows", "ids", "floors", "vectors"))):
                row, qid, floor, v = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int64, np.float64, np.float64)))
                for r, q, f, x in zip(row.tolist(), qid.tolist(), floor.tolist(), v.reshape(-1, d)):
                    out += [(None, None, r, q, None, None, n, s) for s, n in search(tree, ids, x, -1, k, top, f)]
        return as_table(out)

    n_tasks = parallelism(rows, 2)
    met = trees.repartition(n_tasks, "block", "chunk").groupBy("block", "chunk").cogroup(packed.repartition(n_tasks, "block", "chunk").groupBy("block", "chunk")).applyInArrow(find, shape)
    return grown.where("vec_id IS NOT NULL").unionByName(met).select("row", "query_id", "vec_id", "score")


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, cells: int = CELLS, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which ``is_query`` (a condition on ``id``) holds, against all rows."""
    spark = df.sparkSession
    importable(spark)
    with kept_only(spark, "top") as path:
        clean = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        v = F.transform("vector", lambda x: F.floor(x.cast("double") * 256).cast("double"))
        clean = clean.where(F.coalesce(finite, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "id", F.when(F.size("vector") == 0, F.array(F.lit(0.0))).otherwise(v).alias("v"), F.size("vector").alias("length"))
        rows = written(clean.withColumn("q", F.coalesce(is_query, F.lit(False))), "vectors")
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        lengths = rows.groupBy("length").agg(F.count("*").alias("n"), F.max(square).alias("top")).orderBy("length").limit(LENGTHS + 1).collect()
        if len(lengths) > LENGTHS:
            raise ValueError(f"vectors of more than {LENGTHS} lengths")
        if any(r.top >= 2.0**62 for r in lengths):
            raise ValueError("scores beyond 64 bits")
        hits = spark.createDataFrame([], "row long, query_id long, vec_id long, score long")
        for r in lengths:
            hits = hits.unionByName(_search_length(rows.where(F.col("length") == r.length).select("row", "id", "v", "q"), max(1, r.length), r.n, r.top, k, block, cells, chunk))
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return written(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top", path)
