"""Exact top-k inner products by a dual-tree search over cover trees.

Rows are dealt to cells round pivots (a bounded sample: `PIVOTS` rows at most)
and each cell is cut into blocks; every block holds a cover tree. A pair of
nodes, one of queries with centre q and covering radius r, one of data with
centre d and radius s, can hold no score above q.d + |q|s + |d|r + rs; it is
left out if that is below the worst kth score of the node's queries. The same
bound first prunes cells and then blocks: each query block is searched in the
block that promises most in the cell that promises most; then only cells that
can still reach its worst kth score are opened, and of their blocks only those
that can are joined to it. Blocks of queries are searched in groups, so that a
data block travels once for each group.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrays, materialize

#: Results of a query.
K = 20
#: Components are floor(SCALE * x).
SCALE = 64
#: Queries are the rows whose id this divides.
EVERY = 20
#: Pivots, at most; about one for so many rows.
PIVOTS, ROWS_PER_PIVOT = 256, 4096
#: Rows in a block, about, and in a leaf of a tree.
BLOCK, LEAF = 2048, 128
QUERY_BLOCK, QUERY_LEAF = 512, 64
#: Rows that a node's children hold in the mean, at least.
THIN = 8
#: Query blocks that are searched together, and the data blocks that one task searches for them.
GROUP, PART = 8, 16


class CoverTree:
    """A cover tree over the rows of a block, without the levels at which a node has one child.

    A node of level l holds points within 2**l of its centre, which is one of
    them (covering). Its children's centres lie more than 2**(l - 1) from each
    other (separation), and each point goes to the nearest of them, not
    farther than that: a child is of level l - 1 or less. They are chosen
    greedily, each the point farthest from those before. A node of few rows,
    or one whose children would hold fewer than `THIN` rows in the mean, is a
    leaf: below, bounds cost more than the scores that they spare. Rows are
    reordered so that a node's points are one range.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.range: list[tuple[int, int]] = []
        self.level: list[int | None] = []
        self.children: list[list[int]] = []
        self._points, self._leaf = points, leaf
        self._centres: list[int] = []
        self._radii: list[float] = []
        if len(points):
            mean = points.mean(0)
            self._build(0, len(points), int(np.argmin(((points - mean) ** 2).sum(1))))
        self.centre = points[self._centres]
        self.radius = np.array(self._radii)
        self.norm = np.sqrt((self.centre**2).sum(1))
        del self._points, self._centres, self._radii

    def _build(self, lo: int, hi: int, centre: int) -> int:
        rows = self.order[lo:hi]
        p = self._points[rows]
        dist = np.sqrt(((p - self._points[centre]) ** 2).sum(1))
        me, far = len(self._centres), float(dist.max())
        self._centres.append(centre)
        self._radii.append(far * (1 + 1e-12))
        self.range.append((lo, hi))
        self.children.append([])
        self.level.append(math.ceil(math.log2(far)) if far else None)
        if hi - lo <= self._leaf or not far:
            return me
        reach = 2.0 ** (self.level[me] - 1)
        picks, near, who = [centre], dist.copy(), np.zeros(hi - lo, np.int64)
        while near.max() > reach:
            if (len(picks) + 1) * THIN > hi - lo:
                return me
            pick = int(np.argmax(near))
            d = np.sqrt(((p - p[pick]) ** 2).sum(1))
            closer = d < near
            near[closer], who[closer] = d[closer], len(picks)
            picks.append(int(rows[pick]))
        by = np.argsort(who, kind="stable")
        self.order[lo:hi] = rows[by]
        ends = np.cumsum(np.bincount(who, minlength=len(picks)))
        start = 0
        for pick, end in zip(picks, ends.tolist(), strict=True):
            if end > start:
                self.children[me].append(self._build(lo + start, lo + end, pick))
            start = end
        return me


class Best:
    """The k best of each query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray | float = -np.inf):
        """floor: scores of no use below, for each query."""
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.score[:] = np.reshape(floor, (-1, 1))
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.score[at, -1][:, None]) & (scores > -np.inf)
        for i in np.flatnonzero(good.any(1)):
            g, q = good[i], at[i]
            s, d = np.concatenate([self.score[q], scores[i, g]]), np.concatenate([self.id[q], ids[g]])
            top = np.lexsort((d, -s))[: self.k]
            self.score[q], self.id[q] = s[top], d[top]


def search(queries: tuple, data: tuple, best: Best) -> None:
    """The dual-tree walk, which betters `best`. queries, data: (ids, vectors in the tree's order, tree)."""
    q_ids, q_vectors, q_tree = queries
    d_ids, d_vectors, d_tree = data

    def bounds(a: list[int], b: list[int]) -> np.ndarray:
        """No score between the nodes a and the nodes b lies above (one of the two lists holds one node)."""
        r, s = q_tree.radius[a], d_tree.radius[b]
        return (q_tree.centre[a] * d_tree.centre[b]).sum(1) + q_tree.norm[a] * s + d_tree.norm[b] * r + r * s

    stack = [(float(bounds([0], [0])[0]), 0, 0)]
    while stack:
        most, a, b = stack.pop()
        lo, hi = q_tree.range[a]
        if most * (1 + 1e-9) + 1e-6 < best.score[lo:hi, -1].min():
            continue
        qs, ds = q_tree.children[a], d_tree.children[b]
        if not qs and not ds:
            s, e = d_tree.range[b]
            scores = q_vectors[lo:hi] @ d_vectors[s:e].T
            scores[q_ids[lo:hi, None] == d_ids[s:e]] = -np.inf
            best.offer(np.arange(lo, hi), scores, d_ids[s:e])
            continue
        if not ds or (qs and q_tree.radius[a] > d_tree.radius[b]):
            pairs = [(x, c, b) for x, c in zip(bounds(qs, [b]).tolist(), qs, strict=True)]
        else:
            pairs = [(x, a, c) for x, c in zip(bounds([a], ds).tolist(), ds, strict=True)]
        stack.extend(sorted(pairs, key=lambda p: p[0]))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the components as floor(SCALE * x), without vectors that are null or hold null or non-finite ones."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _cells(rows: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """rows with dim and the cell of the nearest pivot of that dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict[int, np.ndarray] = {}
        for p in pivots:
            of[len(p)] = np.vstack([of[len(p)], p]) if len(p) in of else p[None]
        for pdf in batches:
            if not len(pdf):
                continue
            pdf["dim"] = pdf["v"].map(len).astype("int32")
            pdf["cell"] = np.int32(0)
            for dim, g in pdf.groupby("dim"):
                if dim and dim in of:
                    x = np.stack(g["v"].to_numpy())
                    pdf.loc[g.index, "cell"] = np.argmin((of[dim] ** 2).sum(1) - 2 * x @ of[dim].T, 1).astype("int32")
            yield pdf

    return rows.mapInPandas(run, "vec_id long, v array<double>, dim int, cell int")


def _blocks(rows: DataFrame, counts: dict[tuple[int, int], int], size: int, leaf: int) -> tuple[DataFrame, int]:
    """A row a block: block, dim, cell, centre, radius, norm, payload; and how many block numbers there are."""
    offset, first, parts = 0, {}, {}
    for key, n in sorted(counts.items()):
        first[key], parts[key] = offset, -(-n // size)
        offset += parts[key]
    if not offset:
        return rows.select(F.lit(0).alias("block")).limit(0), 0
    table = rows.sparkSession.createDataFrame([(d, c, first[d, c], parts[d, c]) for d, c in first], "dim int, cell int, first int, parts int")
    dealt = rows.join(F.broadcast(table), ["dim", "cell"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["v"].to_numpy()).reshape(len(pdf), -1)
        tree = CoverTree(x, leaf)
        ids, x = pdf["vec_id"].to_numpy()[tree.order], x[tree.order]
        kind = np.float32 if len(x[0]) == 0 or np.abs(x).max() < 2**24 else np.float64
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "centre": [tree.centre[0].tolist()], "radius": [tree.radius[0]], "norm": [tree.norm[0]], "payload": [pickle.dumps((ids, x.astype(kind), tree))]})

    return dealt.select("vec_id", "v", "dim", "cell", "block").groupBy("block").applyInPandas(run, "block int, dim int, cell int, centre array<double>, radius double, norm double, payload binary"), offset


def _load(payload: bytes) -> tuple:
    ids, x, tree = pickle.loads(payload)
    return ids, x.astype(np.float64), tree


FOUND = "query_id long, vec_id long, score double"


def _search_blocks(asking: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """FOUND by each row of asking (q_group, part, query, floors, home) in the blocks of its group and part (q_group, part, d_block, bound, data), home left out.

    The blocks of a part are searched one after another, the most promising
    first, and each betters what the next has to reach.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("bound", ascending=False)
        data = [(block, _load(x)) for block, x in zip(right["d_block"], right["data"], strict=True)]
        for query, floors, home in zip(left["query"], left["floors"], left["home"], strict=True):
            queries = _load(query)
            floor = -np.inf if floors is None else np.array([-np.inf if x is None else x for x in floors], float)
            best = Best(len(queries[0]), k, np.nan_to_num(floor, nan=-np.inf, neginf=-np.inf))
            for block, d in data:
                if block != home:
                    search(queries, d, best)
            found = np.nonzero(best.id != np.iinfo(np.int64).max)
            out.append(pd.DataFrame({"query_id": queries[0][found[0]], "vec_id": best.id[found], "score": best.score[found]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    right = blocks.select(F.col("q_group").alias("r_group"), F.col("part").alias("r_part"), "d_block", "bound", "data")
    return asking.groupBy("q_group", "part").cogroup(right.groupBy("r_group", "r_part")).applyInPandas(run, FOUND)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _bound() -> Column:
    return _dot("q_centre", "d_centre") + F.col("q_norm") * F.col("d_radius") + F.col("d_norm") * F.col("q_radius") + F.col("q_radius") * F.col("d_radius")


def _reach() -> Column:
    """The bound with room for rounding."""
    return F.col("bound") + F.abs("bound") * 1e-9 + 1e-6


def _cover(blocks: DataFrame) -> DataFrame:
    """dim, cell, centre, radius, norm: a ball round all blocks of a cell, its centre that of one of them."""
    one = blocks.groupBy("dim", "cell").agg(F.min_by("centre", "block").alias("middle"))
    away = F.sqrt(F.aggregate(F.zip_with("centre", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    both = blocks.select("dim", "cell", "block", "centre", "radius").join(one, ["dim", "cell"])
    return both.groupBy("dim", "cell").agg(F.first("middle").alias("centre"), (F.max(away + F.col("radius")) * (1 + 1e-9)).alias("radius"), F.sqrt(F.first(_dot("middle", "middle"))).alias("norm"))


def _named(df: DataFrame, side: str, *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in (*more, "dim", "centre", "radius", "norm")])


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    In: vec_id, embedding (further columns are not read). Queries: rows whose
    vec_id `every` divides; candidates: every other row; ties go to the
    smaller vec_id. Vectors of different lengths are not compared. Of equal
    vectors only the k + 1 least ids can be among results, so the others are
    not indexed. Repeated rows of one vec_id and vector count once; those of
    one vec_id are never each other's candidates. An empty table gives no row.
    Scores are exact up to 2**53.
    """
    rows = whole_vectors(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    n = rows.count()
    pivots = [np.array(r["v"]) for r in sample[: max(1, min(PIVOTS, n // ROWS_PER_PIVOT))]]
    celled = materialize(_cells(rows, pivots), "cells")
    same = Window.partitionBy("v").orderBy("vec_id")
    data = materialize(celled.withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= k + 1).drop("n").dropDuplicates(["vec_id", "v"]), "data")
    asked = celled.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    count = lambda df: {(r["dim"], r["cell"]): r["count"] for r in df.groupBy("dim", "cell").count().collect()}
    blocks, n_blocks = _blocks(data, count(data), BLOCK, LEAF)
    queries, n_queries = _blocks(asked, count(asked), QUERY_BLOCK, QUERY_LEAF)
    if not n_queries or not n_blocks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, queries = materialize(blocks, "blocks"), materialize(queries, "queries")
    cells = materialize(_cover(blocks), "cells")
    q, d, c = _named(queries, "q", "block"), _named(blocks, "d", "block", "cell"), _named(cells, "d", "cell")
    # A row for each query block and cell: cells are at most PIVOTS for each length of vectors.
    far = materialize(q.join(c, F.col("q_dim") == F.col("d_dim")).select("q_block", F.col("d_dim").alias("dim"), F.col("d_cell").alias("cell"), _bound().alias("bound")), "bounds")

    def opened(chosen: DataFrame) -> DataFrame:
        """q_block, d_block, bound of all blocks in the chosen cells (q_block, dim, cell)."""
        same = (F.col("dim") == F.col("d_dim")) & (F.col("cell") == F.col("d_cell"))
        return chosen.select("q_block", "dim", "cell").join(d, same).join(q.drop("q_dim"), "q_block").select("q_block", "d_block", _bound().alias("bound"))

    payload = blocks.select(F.col("block").alias("d_block"), F.col("payload").alias("data"))
    asking = queries.select(F.col("block").alias("q_block"), F.col("payload").alias("query"))
    nearest = far.groupBy("q_block").agg(F.max_by(F.struct("dim", "cell"), F.struct("bound", "cell")).alias("x")).select("q_block", "x.dim", "x.cell")
    homes = materialize(opened(nearest).groupBy("q_block").agg(F.max_by("d_block", F.struct("bound", "d_block")).alias("d_block"), F.max("bound").alias("bound")), "homes")
    none = F.lit(None).cast("array<double>").alias("floors")
    home = homes.select(F.col("q_block").cast("long").alias("q_group"), F.lit(0).alias("part"), "d_block", "bound").join(payload, "d_block")
    first = materialize(_search_blocks(asking.select(F.col("q_block").cast("long").alias("q_group"), F.lit(0).alias("part"), "query", none, F.lit(-1).alias("home")), home, k), "first")
    # The kth score in the home block is a floor for the query; a block's floor is the least of its queries'.
    kth = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "floor")
    floors = materialize(_floors(asking, kth), "floors")
    least = floors.select("q_block", "least")
    rest = opened(far.join(least, "q_block").where(_reach() >= F.col("least"))).join(homes, ["q_block", "d_block"], "left_anti")
    rest = rest.join(least, "q_block").where(_reach() >= F.col("least"))
    # Neighbours by number are of one cell or the next; blocks of different lengths stay apart.
    group = (F.col("q_dim").cast("long") * 2**32 + F.floor(F.col("q_block") / GROUP)).alias("q_group")
    lengths = q.select("q_block", "q_dim")
    rest = rest.join(lengths, "q_block").groupBy(group, "d_block").agg(F.max("bound").alias("bound"))
    by = Window.partitionBy("q_group").orderBy(F.desc("bound"), "d_block")
    rest = materialize(rest.withColumn("part", F.floor((F.row_number().over(by) - 1) / PART).cast("int")), "pairs")
    searched = floors.join(lengths, "q_block").join(homes.select("q_block", F.col("d_block").alias("home")), "q_block")
    later = rest.select("q_group", "part").distinct().join(searched.select(group, "query", "floors", "home"), "q_group")
    found = first.unionByName(_search_blocks(later.select("q_group", "part", "query", "floors", "home"), rest.join(payload, "d_block"), k))
    return _best_rows(found, k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _floors(asking: DataFrame, kth: DataFrame) -> DataFrame:
    """q_block, query, floors (a floor for each query of the block, in its order; null: none), least."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("q_block", pa.int32()), ("at", pa.int32()), ("query_id", pa.int64())])
        for b in batches:
            for i in range(b.num_rows):
                x = pickle.loads(b.column(1)[i].as_py())[0]
                yield arrays(out, [[b.column(0)[i].as_py()] * len(x), list(range(len(x))), x])

    rows = asking.select("q_block", "query").mapInArrow(ids, "q_block int, at int, query_id long").join(kth, "query_id", "left")
    pair = F.sort_array(F.collect_list(F.struct("at", "floor")))
    low = F.min(F.coalesce("floor", F.lit(float("-inf"))))
    return asking.join(rows.groupBy("q_block").agg(pair.alias("f"), low.alias("least")), "q_block").select("q_block", "query", F.col("f.floor").alias("floors"), "least")
