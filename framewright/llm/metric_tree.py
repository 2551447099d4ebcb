"""Exact top-k search: an M-tree of paged metric nodes, searched best first.

The inner product of integer vectors becomes a distance: with M the largest
squared length, x gets the further component sqrt(M - |x|^2) and a query gets
0, so that their squared distance is |q|^2 + M - 2 q.x and the nearest rows
are those of the highest products. Routers, covering radii and the distances
of entries to their parents are distances in that space.

Rows are sorted by the nearest of some pivots, the distance to it and a hash,
and cut into trees of ``TREE_ROWS``, so neither a crowded place nor copies of
one vector make a large tree. A tree has pages of ``PAGE_ROWS`` entries; the
trees' own routers and radii stand in root pages of ``ROOT_ROWS`` entries.
A search has two rounds: every query looks through the tree with the least
bound, then, with the k-th score that it has, through all trees whose bound
does not rule them out. Inside a tree pages are visited by ascending bound
until none can improve the result; a page or an entry that the stored parent
distance rules out is left out before its own distance is computed. Bounds
are doubles with a margin, scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import Scratch, stored, table
from framewright.llm.vectors import as_binary, from_binary, integers, measured

SCALE = 1024
K = 10
QUERY_EVERY = 100
#: At most so many pivots, of which one stands for a tree's worth of rows.
PIVOTS = 256
TREE_ROWS = 4096
PAGE_ROWS = 64
ROOT_ROWS = 4096
BLOCK_QUERIES = 512
#: Part of the largest distance by which a bound may be off.
MARGIN = 1e-6

TREES = "tree long, router binary, radius double, starts array<int>, radii array<double>, parents array<double>, ids array<bigint>, vectors binary, nears array<double>"
ROUTES = "query_id long, q binary, block int, tree long, lower double, away double"
FOUND = "query_id long, q binary, vec_id long, score long"


class Space:
    """Distances between rows, and between a query and rows, of the space in which the nearest have the highest products."""

    def __init__(self, width: int, longest: float):
        self.width, self.longest = width, longest
        self.margin = MARGIN * max(1.0, longest) ** 0.5
        self.exact = longest < 1 << 53  # then every product and partial sum is an integer that a double holds

    def rows(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64)

    def more(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - np.square(x).sum(1), 0))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance of every row of x to every row of y."""
        gap = np.square(x).sum(1)[:, None] + np.square(y).sum(1) - 2 * (x @ y.T) + np.square(self.more(x)[:, None] - self.more(y))
        return np.sqrt(np.maximum(gap, 0))

    def away(self, q2: float, scores: np.ndarray) -> np.ndarray:
        """Distances of rows to a query of squared length q2, by their scores."""
        return np.sqrt(np.maximum(q2 + self.longest - 2.0 * scores, 0))


def grown(x: np.ndarray, ids: np.ndarray, space: Space) -> dict:
    """One tree: rows in pages, each page around its first row."""
    at = space.rows(x)
    root = int(np.argmin(np.square(at - at.mean(0)).sum(1)))
    seeds = np.unique(np.linspace(0, len(at) - 1, -(-len(at) // PAGE_ROWS)).astype(int))
    apart = space.between(at, at[seeds])
    seed = apart.argmin(1)
    order = np.lexsort((apart[np.arange(len(at)), seed], seed))
    first = np.flatnonzero(np.append(True, np.diff(seed[order]) != 0))
    starts = np.concatenate([np.arange(a, b, PAGE_ROWS) for a, b in zip(first, np.append(first[1:], len(at)), strict=True)])
    at = at[order]
    page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
    nears = np.sqrt(np.maximum(np.square(at - at[starts[page]]).sum(1) + np.square(space.more(at) - space.more(at)[starts[page]]), 0))
    parents = space.between(at[starts], space.rows(x[root : root + 1]))[:, 0]
    radii = np.maximum.reduceat(nears, starts)
    far = float(space.between(at, space.rows(x[root : root + 1])).max())
    return {"router": x[root], "radius": far, "starts": starts, "radii": radii, "parents": parents, "ids": [ids[k] for k in order], "vectors": x[order], "nears": nears}


class Tree:
    """A stored tree, ready to be searched."""

    def __init__(self, row: dict, space: Space):
        self.space = space
        x = np.frombuffer(row["vectors"], "<i8").reshape(-1, space.width)
        self.x = x.astype(np.float64) if space.exact else x
        self.router = np.frombuffer(row["router"], "<i8").astype(self.x.dtype)
        self.starts, self.radii, self.parents, self.nears = (np.array(row[c]) for c in ("starts", "radii", "parents", "nears"))
        self.ends = np.append(self.starts[1:], len(x))
        self.ids = np.array([np.iinfo(np.int64).max if k is None else k for k in row["ids"]], np.int64)
        self.unnamed = {i for i, k in enumerate(row["ids"]) if k is None}

    def best(self, q: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int | None, int]]:
        """The k highest (vec_id, score) of other rows, ties to the smaller id; only scores of ``least`` or more."""
        q, q2 = q.astype(self.x.dtype), float(np.square(q.astype(np.float64)).sum())
        space, got, at = self.space, np.empty(0, self.x.dtype), np.empty(0, np.int64)
        reach = np.inf if least is None else float(space.away(q2, np.float64(least))) + space.margin
        home = float(space.away(q2, np.float64(self.router @ q)))
        pages = np.flatnonzero(np.abs(home - self.parents) - self.radii <= reach)
        away = space.away(q2, self.x[self.starts[pages]] @ q)
        lower = away - self.radii[pages]
        for i in np.argsort(lower, kind="stable"):
            if lower[i] > reach:
                break
            a, b = self.starts[pages[i]], self.ends[pages[i]]
            rows = a + np.flatnonzero(np.abs(away[i] - self.nears[a:b]) <= reach)
            rows = rows[(self.ids[rows] != own)]
            scores = self.x[rows] @ q
            if least is not None:
                rows, scores = rows[scores >= least], scores[scores >= least]
            got, at = np.append(got, scores), np.append(at, rows)
            if len(got) > k:
                top = np.lexsort((self.ids[at], -got))[:k]
                got, at = got[top], at[top]
            if len(got) == k:
                least = max(int(got.min()), least if least is not None else int(got.min()))
                reach = float(space.away(q2, np.float64(least))) + space.margin
        return [(None if int(i) in self.unnamed else int(self.ids[i]), int(s)) for i, s in zip(at, got, strict=True)]


class Index:
    """Trees in a stored table, and what their space is."""

    def __init__(self, trees: DataFrame, space: Space):
        self.trees, self.space = trees, space


def build(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, kept=stored) -> Index:
    """The index of all vectors but those that are null or hold null or non-finite components.

    Shorter vectors count as filled up with zeros. Pivots are the rows with the
    least hashes, one for each ``TREE_ROWS`` rows and ``PIVOTS`` at most; which
    they are changes how far a search has to look, not what it finds.
    """
    source = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    n, width, longest = measured(source, "vector", scale)
    space = Space(width, longest)
    chosen = source.filter("vector is not null").withColumn("at", F.xxhash64("vec_id", "vector")).orderBy("at").limit(min(PIVOTS, max(1, n // TREE_ROWS))).select("vector").toArrow()
    pivots = space.rows(integers(chosen.column(0).combine_chunks(), scale, width)[1])
    if not len(pivots):
        pivots = np.zeros((1, width))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integers(batch.column(1), scale, width)
            apart = space.between(space.rows(x), pivots)
            cell = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), as_binary(x), pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(x)), cell])], ["vec_id", "x", "cell", "away"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, rows = TaskContext.get().partitionId() << 32, [], np.empty((0, width), np.int64)

        def emitted(ids: list, rows: np.ndarray) -> pa.RecordBatch:
            tree = {"tree": made} | {k: v.tobytes() if k in ("router", "vectors") else v.tolist() if isinstance(v, np.ndarray) else v for k, v in grown(rows, ids, space).items()}
            return pa.RecordBatch.from_pylist([tree], SCHEMA)

        for batch in batches:
            ids, rows = ids + batch.column(0).to_pylist(), np.concatenate([rows, from_binary(batch.column(1), width)])
            while len(ids) >= 2 * TREE_ROWS:
                yield emitted(ids[:TREE_ROWS], rows[:TREE_ROWS])
                made, ids, rows = made + 1, ids[TREE_ROWS:], rows[TREE_ROWS:]
        while ids:
            cut = -(-len(ids) // 2) if len(ids) > TREE_ROWS else len(ids)
            yield emitted(ids[:cut], rows[:cut])
            made, ids, rows = made + 1, ids[cut:], rows[cut:]

    at = source.mapInArrow(placed, "vec_id long, x binary, cell int, away double").withColumn("salt", F.xxhash64("vec_id", "x"))
    parts = max(1, -(-n // (4 * TREE_ROWS)))
    at = at.repartitionByRange(parts, "cell", "away", "salt").sortWithinPartitions("cell", "away", "salt")
    return Index(kept(at.select("vec_id", "x").mapInArrow(pages, TREES), "trees"), space)


SCHEMA = pa.schema([("tree", pa.int64()), ("router", pa.binary()), ("radius", pa.float64()), ("starts", pa.list_(pa.int32())), ("radii", pa.list_(pa.float64())), ("parents", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("nears", pa.list_(pa.float64()))])


def _routes(directory: DataFrame, queries: DataFrame, space: Space, only_first: bool) -> DataFrame:
    """Trees that a query may have to look through: all that ``least`` does not rule out, or of each root page the one with the least bound."""

    def meet(root: pa.Table, asked: pa.Table) -> pa.Table:
        if not root.num_rows or not asked.num_rows:
            return pa.table([[]] * 6, schema=PAIRS)
        x, q = (space.rows(from_binary(t.column(c), space.width)) for t, c in ((root, "router"), (asked, "q")))
        q2, radii = np.square(q).sum(1), root.column("radius").to_numpy()
        away = np.sqrt(np.maximum(q2[:, None] + space.longest - 2 * (q @ x.T), 0))
        lower = np.maximum(away - radii, 0)
        if only_first:
            i = np.arange(len(q))
            j = np.lexsort((away, lower), axis=1)[:, 0]
        else:
            least = asked.column("least").to_numpy(zero_copy_only=False).astype(np.float64)  # nan without a bound
            reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(q2 + space.longest - 2 * np.nan_to_num(least), 0)) + space.margin)
            i, j = np.nonzero((lower <= reach[:, None]) & (root.column("tree").to_numpy()[None, :] != asked.column("first").to_numpy()[:, None]))
        pairs = asked.select(["query_id", "q", "block"]).take(pa.array(i))
        return pa.table([*pairs.columns, root.column("tree").take(pa.array(j)), pa.array(lower[i, j]), pa.array(away[i, j])], schema=PAIRS)

    n_roots, n_blocks = (int(df.agg(F.max(c)).first()[0] or 0) + 1 for df, c in ((directory, "root"), (queries, "block")))
    left = directory.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = queries.withColumn("root", F.explode(F.sequence(F.lit(0), F.lit(n_roots - 1))))
    return left.groupBy("root", "block").cogroup(right.groupBy("root", "block")).applyInArrow(meet, ROUTES)


PAIRS = pa.schema([("query_id", pa.int64()), ("q", pa.binary()), ("block", pa.int32()), ("tree", pa.int64()), ("lower", pa.float64()), ("away", pa.float64())])
RESULTS = pa.schema([("query_id", pa.int64()), ("q", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _looked(index: Index, pairs: DataFrame, k: int) -> DataFrame:
    """What the queries find in the trees that they are paired with: a tree meets a block of queries at a time."""
    space = index.space

    def look(trees: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[dict] = []
        for row in trees.to_pylist():
            tree = Tree(row, space)
            for one in asked.to_pylist():
                for vec_id, score in tree.best(np.frombuffer(one["q"], "<i8"), one["query_id"], k, one["least"]):
                    found.append({"query_id": one["query_id"], "q": one["q"], "vec_id": vec_id, "score": score})
        return pa.Table.from_pylist(found, RESULTS)

    visits = pairs.select(F.col("tree").alias("visited"), F.col("block").alias("by")).distinct()
    needed = index.trees.join(visits, F.col("tree") == F.col("visited")).drop("visited")
    return needed.groupBy("tree", "by").cogroup(pairs.groupBy("tree", "block")).applyInArrow(look, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows with the highest products, ties to the smaller vec_id.

    A row with the query's id is its own and doesn't count; rows without an id
    come last among ties. Equal queries count once; two vectors of one id are
    two queries. With k rows or fewer beside its own a query gets all of them.
    Vectors that are null or hold null or non-finite components ask nothing,
    and without vectors or queries there is no row. Components so large that
    squares don't fit 64 bits are an error.
    """
    spark, space = queries.sparkSession, index.space
    scratch = Scratch(spark, "search")
    width = space.width

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integers(batch.column(1), scale, width)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), as_binary(x)], ["query_id", "q"])

    rows = queries.select(F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).alias("vector")).mapInArrow(asked, "query_id long, q binary").distinct()
    rows = scratch.stored(rows, "queries")
    blocks, roots = (-(-max(1, df.count()) // most) for df, most in ((rows, BLOCK_QUERIES), (index.trees, ROOT_ROWS)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).cast("int"))
    directory = index.trees.select("tree", "router", "radius").withColumn("root", F.pmod(F.xxhash64("tree"), F.lit(roots)).cast("int"))
    first = _routes(directory, rows, space, True).groupBy("query_id", "q", "block").agg(F.min(F.struct("lower", "away", "tree")).alias("t")).select("query_id", "q", "block", F.col("t.tree").alias("tree"))
    first = scratch.stored(first.withColumn("least", F.lit(None).cast("long")), "first")
    near = scratch.stored(_top(_looked(index, first, k), k), "near")
    bound = near.filter(F.col("rank") == k).select("query_id", "q", F.col("score").alias("least"))
    rows = scratch.stored(first.select("query_id", "q", "block", F.col("tree").alias("first")).join(bound, ["query_id", "q"], "left"), "bounds")
    pairs = _routes(directory, rows, space, False).drop("lower", "away").join(rows.select("query_id", "q", "least"), ["query_id", "q"])
    pairs = scratch.stored(pairs, "pairs")
    found = _looked(index, pairs, k).unionByName(near.drop("rank"))
    out = stored(_top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
    scratch.clear()
    return out


def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scratch = Scratch(spark, "index")
    found = search(build(vectors, kept=scratch.stored), vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))
    scratch.clear()
    return found


OP11_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
