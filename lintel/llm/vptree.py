"""Approximate nearest neighbours by vantage-point trees over shards.

Inner products become distances: with M the largest norm, vectors get one more component sqrt(M^2 - |x|^2) and queries 0, so
|q - x|^2 = |q|^2 + M^2 - 2 q.x and the nearest is the one with the largest inner product. Vectors are dealt to the nearest of
a bounded sample of vantage points; the cell of each is one shard, or several by hash where it is large, and each shard is a
tree of vantage points. A query first searches its own cell. Other cells, and then branches of their trees, are passed over
when factor * (their least distance by the triangle inequality) exceeds the distance of the k-th neighbour found so far; no
task is made for a cell that all queries pass over. Factor 1 gives exact search; larger factors pass over more. Recall at a
factor falls as tables grow, so unless one is given, a sample of at most ``PILOT`` queries is searched with each of ``FACTORS``, and
the largest that finds at least ``recall`` of the neighbours found with factor 1 is taken for all (factor 1 itself where there are
no more queries than that). It is given in the column ``factor``.

Vectors that are null, zero or hold null or non-finite components, that have no id or no component take no part. A query meets
only vectors of its own length, since no others have an inner product with it. Repeated rows are candidates each, so is every
row but the query's own, of rows equal to it one; of queries with one id the smallest vector is asked. Ties go to the smaller
vec_id. Fewer than k candidates: all of them. Other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, open_store, staged

#: Neighbours, queries' divisor, vectors of a shard and queries of a block in expectation, vectors of a leaf.
NEAREST, EVERY, SHARD, BLOCK, LEAF = 20, 20, 4096, 512, 128
#: Vectors for each cell's vantage point, and the most of these: a sample that each task holds.
CELL, MOST_CELLS = 512, 4096
#: Lists of files up to this length are broadcast.
BROADCAST_FILES = 20_000
#: Factors tried on a sample of queries, the number of these (a bound), and the recall that the chosen factor reaches on them.
FACTORS, PILOT, RECALL = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0), 96, 0.95
#: Scores this much below the k-th (relative to the norms) are still computed exactly.
SLACK = 1e-9


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed component by component: equal vectors give equal scores."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that makes their norm the largest one's."""
    return np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]], 1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))


class Tree:
    """A vantage-point tree over rows kept in tree order.

    rows are the rows' own numbers, ids their vec_id. Node arrays: first and end row, the vantage row, and per child its node
    (or -1) and least and largest distance from the vantage point.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: float, nodes: np.ndarray, bounds: np.ndarray):
        self.rows, self.ids, self.vectors, self.top, self.nodes, self.bounds = rows, ids, vectors, top, nodes, bounds

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: float, leaf: int = LEAF, seed: int = 1) -> Tree:
        x = vectors.astype(np.float64)
        x = lifted(x, top)
        order, nodes, bounds, rng = np.lexsort((rows, ids)), [], [], np.random.default_rng(seed)

        def grow(a: int, b: int) -> int:
            me = len(nodes)
            nodes.append([a, b, -1, -1, -1])
            bounds.append([0.0] * 4)
            if b - a > leaf:
                pick = a + int(rng.integers(b - a))
                vantage = order[pick]
                d = np.sqrt(((x[order[a:b]] - x[vantage]) ** 2).sum(1))
                by = np.argsort(d, kind="stable")
                order[a:b], d = order[a:b][by], d[by]
                mid = (b - a) // 2
                nodes[me][2] = vantage
                bounds[me] = [d[0], d[mid - 1], d[mid], d[-1]]
                nodes[me][3] = grow(a, a + mid)
                nodes[me][4] = grow(a + mid, b)
            return me

        if len(order):
            grow(0, len(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for n in nodes:
            if n[2] >= 0:
                n[2] = place[n[2]]
        return cls(rows[order], ids[order], vectors[order], top, np.array(nodes, np.int64).reshape(-1, 5), np.array(bounds).reshape(-1, 4))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rows=self.rows, ids=self.ids, vectors=self.vectors, top=self.top, nodes=self.nodes, bounds=self.bounds)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        return cls(z["rows"], z["ids"], z["vectors"], float(z["top"]), z["nodes"], z["bounds"])

    def search(self, own: np.ndarray, queries: np.ndarray, k: int = NEAREST, factor: float = 1.0, floor: np.ndarray | None = None) -> Search:
        return Search(self, own, queries, k, factor, floor)


class Search:
    """A block of queries against one tree; ``score`` and ``near`` hold the k best, ``looked`` the pairs scored.

    own: each query's own row; floor: a score that k others are known to reach.
    """

    def __init__(self, tree: Tree, own: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None):
        self.tree, self.own, self.q, self.k, self.factor = tree, own, queries.astype(np.float64), k, factor
        self.floor = np.full(len(own), -np.inf) if floor is None else floor
        self.x = tree.vectors.astype(np.float64)
        self.square = (self.q * self.q).sum(1) + tree.top**2
        largest = np.maximum(np.abs(self.q).max(1, initial=0), 1e-300)
        self.slack = SLACK * np.maximum(1e-300, largest * np.sqrt(((self.q / largest[:, None]) ** 2).sum(1)) * tree.top)
        self.score, self.near, self.looked = np.full((len(own), k), -np.inf), np.full((len(own), k), np.iinfo(np.int64).max), 0
        if len(tree.nodes) and len(own):
            self.visit(0, np.arange(len(own)))

    def least(self, who: np.ndarray) -> np.ndarray:
        """Score that k rows reach, as far as known."""
        return np.maximum(self.score[who, -1], self.floor[who])

    def reach(self, who: np.ndarray) -> np.ndarray:
        """Distance of the k-th neighbour so far; infinite while there are fewer."""
        return np.sqrt(np.maximum(self.square[who] - 2 * (self.least(who) - self.slack[who]), 0))

    def visit(self, node: int, who: np.ndarray) -> None:
        a, b, vantage, left, right = self.tree.nodes[node]
        if vantage < 0:
            self.score_leaf(a, b, who)
            return
        d = np.sqrt(np.maximum(self.square[who] - 2 * (self.q[who] @ self.x[vantage]), 0))
        near_lo, near_hi, far_lo, far_hi = self.tree.bounds[node]
        least = {left: np.maximum(0, np.maximum(near_lo - d, d - near_hi)), right: np.maximum(0, np.maximum(far_lo - d, d - far_hi))}
        first = least[left] - least[right] + 1e-6 * (d - (near_hi + far_lo) / 2) <= 0
        for order, chosen in (((left, right), first), ((right, left), ~first)):
            at = np.flatnonzero(chosen)
            for child in order:
                open_ = at[~(self.factor * (least[child][at] - 1e-9 * (1 + d[at])) > self.reach(who[at]))]
                if len(open_):
                    self.visit(child, who[open_])

    def score_leaf(self, a: int, b: int, who: np.ndarray) -> None:
        self.looked += len(who) * (b - a)
        rough = self.q[who] @ self.x[a:b].T
        rough[self.own[who][:, None] == self.tree.rows[a:b][None, :]] = -np.inf
        least = self.least(who)
        if b - a > self.k:
            least = np.maximum(least, np.partition(rough, b - a - self.k, axis=1)[:, b - a - self.k])
        i, j = np.nonzero((rough >= (least - 2 * self.slack[who])[:, None]) & (rough > -np.inf))
        if not len(i):
            return
        score = exact_scores(self.q[who[i]], self.x[a + j])
        touched, back = np.unique(i, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(touched)), self.k), back])
        scores = np.concatenate([self.score[who[touched]].ravel(), score])
        ids = np.concatenate([self.near[who[touched]].ravel(), self.tree.ids[a + j]])
        by = np.lexsort((ids, -scores, rows))
        rows = rows[by]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        self.score[who[touched]] = scores[by][keep].reshape(-1, self.k)
        self.near[who[touched]] = ids[by][keep].reshape(-1, self.k)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows whose vector is neither null, empty, zero nor partly null or non-finite."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return known.where(~broken & F.exists("embedding", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length, none of them null, as rows."""
    if not len(column):
        return np.zeros((0, 0))
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def saved(folder: str, data: bytes) -> str:
    """The name of a new file in a folder."""
    store, base = open_store(folder)
    store.create_dir(base)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{base}/{name}.npz", compression=None) as out:
        out.write(data)
    return name


class Cells:
    """The vantage points that vectors are dealt to, how far each one's vectors reach, and its shards."""

    def __init__(self, points: np.ndarray, top: float):
        self.points, self.top = lifted(points, top), top
        self.radius, self.first, self.shards = np.zeros(len(points)), np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)

    def sized(self, found: list[tuple[int, int, float]], shard: int) -> Cells:
        """With (cell, vectors, radius) of the cells that have vectors."""
        for cell, n, radius in found:
            self.radius[cell], self.shards[cell] = radius, -(-n // shard)
        self.first = np.concatenate([[0], np.cumsum(self.shards)[:-1]])
        return self

    def of_vectors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest cell, distance from its point) of vectors."""
        d = distances(lifted(x, self.top), self.points)
        own = d.argmin(1)
        return own, d[np.arange(len(x)), own]

    def of_queries(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home cell, least distance of each cell's vectors) of queries. A cell's vectors are nearer to its point than to any
        other, and within its radius."""
        root = np.sqrt((q * q).sum(1) + self.top**2)[:, None]
        d = np.sqrt(np.maximum(root**2 - 2 * (q @ self.points[:, :-1].T), 0))
        home = np.where(self.shards > 0, d, np.inf).argmin(1)
        return home, np.maximum((d - d.min(1)[:, None]) / 2, d - self.radius) - 1e-9 * (1 + d)

    def others(self, q: np.ndarray, least_score: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """[query, cell]: cells besides the home cell that a query, each with its factor, can't pass over."""
        home, least = self.of_queries(q)
        slack = SLACK * np.sqrt((q * q).sum(1)) * self.top
        reach = np.sqrt(np.maximum((q * q).sum(1) + self.top**2 - 2 * (least_score - slack), 0))
        visit = ~(factor[:, None] * least > reach[:, None]) & (self.shards > 0)
        visit[np.arange(len(q)), home] = False
        return visit


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, factor: float | None = None, shard: int = SHARD, block: int = BLOCK, cell: int = CELL, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score, factor of the k nearest found of each query; queries are rows of vectors' form. Without a
    factor one is chosen that reaches the recall on a sample, for vectors of each length on their own."""
    part = staged(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = staged(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    own = first.join(part.withColumnRenamed("embedding", "e"), "vec_id", "left").groupBy("vec_id", "embedding").agg(F.min(F.when(F.col("e") == F.col("embedding"), F.col("row"))).alias("own"))
    asked = staged(own.select(F.col("vec_id").alias("query_id"), "embedding", F.coalesce("own", F.lit(-1)).alias("own")), "asked")
    sizes = [r[0] for r in asked.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    found = None
    for d in sizes:
        same = F.size("embedding") == d
        one = search_one(part.where(same), asked.where(same), k, factor, shard, block, cell, recall)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(1.0).alias("factor"))
    return found


def search_one(part: DataFrame, asked: DataFrame, k: int, factor: float | None, shard: int, block: int, cell: int, recall: float) -> DataFrame:
    """The search over vectors of one length: trees are files in the shared folder, a task searches one for a block of queries."""
    spark = part.sparkSession
    folder = new_folder(spark, "vptree")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    known = part.agg(F.max(norm).alias("top"), F.count(F.lit(1)).alias("n")).first()
    top, n = known["top"] or 0.0, known["n"]
    points = part.orderBy(F.xxhash64("row", F.lit("cells")), "row").limit(max(1, min(MOST_CELLS, n // cell))).select("embedding").collect()
    cells = Cells(np.array([p["embedding"] for p in points]).reshape(len(points), -1), top) if points else None
    if cells is None:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(1.0).alias("factor")).limit(0)

    def deal(batches):
        for b in batches:
            own, d = cells.of_vectors(matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(d)], ["row", "vec_id", "embedding", "cell", "d"])

    dealt = staged(part.select("row", "vec_id", "embedding").mapInArrow(deal, "row long, vec_id long, embedding array<double>, cell long, d double"), "dealt")
    sized = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()  # at most MOST_CELLS rows
    cells.sized([tuple(r) for r in sized], shard)
    shared = spark.sparkContext.broadcast(cells)

    def index(rows: pa.Table) -> pa.Table:
        tree = Tree.build(rows["row"].to_numpy(), rows["vec_id"].to_numpy(), matrix(rows["embedding"]), top)
        return pa.table({"shard": [rows["shard"][0].as_py()], "tree": [saved(folder, tree.dump())]}, pa.schema([("shard", pa.int64()), ("tree", pa.string())]))

    place = spark.createDataFrame([(int(c), int(cells.first[c]), int(cells.shards[c])) for c in np.flatnonzero(cells.shards)], "cell long, first long, shards long")
    sharded = dealt.join(F.broadcast(place), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), "shards"))
    trees = staged(sharded.select("shard", "row", "vec_id", "embedding").groupBy("shard").applyInArrow(index, "shard long, tree string"), "trees")

    asked_n = asked.count()
    blocks = max(1, -(-asked_n // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    def gather(rows: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("query_id"), io.BytesIO()
        np.savez(out, ids=rows["query_id"].to_numpy(), own=rows["own"].to_numpy(), vectors=matrix(rows["embedding"]))
        return pa.table({"block": [rows["block"][0].as_py()], "ask": [saved(folder, out.getvalue())]}, pa.schema([("block", pa.int64()), ("ask", pa.string())]))

    asks = staged(asked.groupBy("block").applyInArrow(gather, "block long, ask string"), "asks")

    def sent(first: bool):
        def run(batches):
            own = shared.value
            for b in batches:
                q = matrix(b.column(2))
                least, factors = (b.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
                if not len(q):
                    continue
                if first:
                    visit = np.zeros((len(q), len(own.shards)), bool)
                    visit[np.arange(len(q)), own.of_queries(q)[0]] = True
                else:
                    visit = own.others(q, least, factors)
                for c in np.flatnonzero(visit.any(0)):
                    who = b.select(["query_id", "block", "least", "factor"]).take(pa.array(np.flatnonzero(visit[:, c])))
                    for s in range(own.first[c], own.first[c] + own.shards[c]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(who.num_rows, s)), *who.columns], ["shard", "query_id", "block", "least", "factor"])

        return run

    def look(rows: pa.Table) -> pa.Table:
        store, base = open_store(folder)
        read = lambda c: store.open_input_stream(f"{base}/{rows[c][0].as_py()}.npz", compression=None).read()
        tree, z, at_factor = Tree.load(read("tree")), np.load(io.BytesIO(read("ask"))), rows["factor"][0].as_py()
        at = np.searchsorted(z["ids"], rows["query_id"].to_numpy())
        found = tree.search(z["own"][at], z["vectors"][at], k, at_factor, rows["least"].to_numpy())
        who, rank = np.nonzero(found.score > -np.inf)
        return pa.table({"query_id": z["ids"][at][who], "factor": np.full(len(who), at_factor), "vec_id": found.near[who, rank], "score": found.score[who, rank]}, pa.schema([("query_id", pa.int64()), ("factor", pa.float64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_FILES else df
    paths, questions = few(trees, cells.shards.sum()), few(asks, blocks)

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        """Of a query and a shard only ids are shuffled; a task reads the shard's tree and the block's queries."""
        tasks = queries.select("query_id", "block", "embedding", "least", "factor").mapInArrow(sent(first), "shard long, query_id long, block long, least double, factor double")
        return tasks.join(paths, "shard").join(questions, "block").groupBy("shard", "block", "factor").applyInArrow(look, "query_id long, factor double, vec_id long, score double")

    best = Window.partitionBy("query_id", "factor").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "factor")
    none = F.lit(-float("inf"))

    def answers(queries: DataFrame) -> DataFrame:
        """The best k of queries, each with its factor: from the home cell first, then from cells that these don't rule out."""
        home = staged(ranked(searched(queries.withColumn("least", none), True)), "home")
        kth = home.where(F.col("rank") == k).select("query_id", "factor", F.col("score").alias("least"))
        more = searched(queries.join(kth, ["query_id", "factor"], "left").withColumn("least", F.coalesce("least", none)), False)
        return ranked(home.drop("rank").unionByName(more))

    if factor is None:
        factor = 1.0
        if asked_n > PILOT:
            pilot = asked.where("block = 0").orderBy(F.xxhash64("query_id", F.lit("pilot"))).limit(PILOT)
            tried = staged(answers(pilot.withColumn("factor", F.explode(F.array(*map(F.lit, FACTORS))))), "pilot")
            true = tried.where("factor = 1").select("query_id", "vec_id")
            hits = {r["factor"]: r["count"] for r in tried.join(true, ["query_id", "vec_id"]).groupBy("factor").count().collect()}  # a row a factor
            factor = max(f for f in FACTORS if hits.get(f, 0) >= recall * hits.get(1.0, 0))
    return answers(asked.withColumn("factor", F.lit(float(factor))))
