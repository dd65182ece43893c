"""Approximate nearest neighbours: hierarchical k-means tree, best leaves first.

1. A tree of means is fitted on a bounded sample (SAMPLE distinct vectors, those with the
   least hash); every vector is then put into the leaf that it descends to.
2. Largest inner product becomes least distance by one more coordinate,
   sqrt(M**2 - |x|**2) with M the largest norm (zero for a query).
3. A query opens nodes in order of distance through a priority queue. How many leaves it
   visits is calibrated: for CALIBRATION sample queries the true neighbours are found
   among all vectors, block by block, and visits widen until TARGET of them are seen.
4. Queries and vectors meet by leaf. Leaves with many vectors or many queries are cut
   into blocks; a task compares one block with another and reports TOP + 1 per query.

Equal vectors are searched for once and stand for their TOP + 1 smallest ids, which is
exact since ties go to smaller ids. Vectors that are null, zero, of another length than most,
or hold null or non-finite numbers take no part; repeated rows with one id are ranked as
they come; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvartal.llm.shared import partitions, written

TOP = 20
EVERY = 20
SAMPLE, BRANCHES, LEAF = 4096, 8, 64
CALIBRATION, TARGET = 256, 0.93
#: Vectors, and visits of queries, that meet in one task.
BLOCK = 16_384
#: Queries that travel together.
PACK = 256
#: Groups of leaves; a query gets one list of its best from each.
GROUPS = 16
FOUND = "query long, vec_id long, score double"


@dataclass
class Tree:
    """Means of all nodes, children of inner ones, and a number for each leaf."""

    means: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, rng: np.random.Generator) -> int:
        node = len(self.means)
        self.means.append(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        parts = _k_means(x, BRANCHES, rng) if len(x) > LEAF else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self.grow(x[p], rng) for p in parts]
        return node

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _distances(x[rows], np.stack([self.means[c] for c in below])).argmin(axis=1)
                todo += [(c, rows[near == k]) for k, c in enumerate(below)]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: dict[int, int]) -> list[int]:
        """Leaves of one query, best first: ``most`` of them, and enough to hold TOP + 1 vectors."""
        out: list[int] = []
        queue, held = [(0.0, 0)], 0
        while queue and (len(out) < most or held <= TOP):
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if below:
                near = _distances(q[None], np.stack([self.means[c] for c in below]))[0]
                for d, c in zip(near.tolist(), below, strict=True):
                    heapq.heappush(queue, (d, c))
            else:
                out.append(self.leaf[node])
                held += sizes.get(self.leaf[node], 0)
        return out


def _distances(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return (means**2).sum(axis=1) - 2 * x @ means.T


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    means = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        near = _distances(x, means).argmin(axis=1)
        means = np.stack([x[near == j].mean(axis=0) if (near == j).any() else means[j] for j in range(k)])
    near = _distances(x, means).argmin(axis=1)
    return [p for j in range(k) if len(p := np.flatnonzero(near == j))]


def valid(table: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row per distinct vector: its smallest id and its TOP + 1 smallest ids.

    The limit is applied inside the map tasks before the shuffle, so a vector of a third of
    all rows arrives as a few.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= TOP + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("id"), "ids", "v"
    )


def _matrix(column) -> np.ndarray:
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _best(scores: np.ndarray, ids: list[list[int]], most: int) -> list[tuple[float, int]]:
    """The largest scores with their ids; ties go to smaller ids."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        which = np.flatnonzero(scores >= least)
    else:
        which = np.arange(len(scores))
    found = sorted((-scores[j], i) for j in which.tolist() for i in ids[j])
    return [(-s, i) for s, i in found[:most]]


def _truth(vectors: DataFrame, queries: list[tuple[int, list[float]]]) -> dict[int, list[tuple[int, int]]]:
    """(leaf, id) of the true neighbours of a few queries, each task ranking its own vectors."""
    q = np.array([v for _, v in queries])
    names = [k for k, _ in queries]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, leaf = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            scores = q @ _matrix(batch.column(1)).T
            rows = [(n, s, j) for n, row in zip(names, scores, strict=True) for s, j in _best(row, [[j] for j in range(len(ids))], TOP + 1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "query": pa.array([n for n, _, _ in rows], pa.int64()),
                    "vec_id": pa.array([ids[j] for _, _, j in rows], pa.int64()),
                    "score": pa.array([s for _, s, _ in rows], pa.float64()),
                    "leaf": pa.array([leaf[j] for _, _, j in rows], pa.int32()),
                }
            )

    found = vectors.select("id", "v", "leaf").mapInArrow(run, FOUND + ", leaf int").where("query <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    out: dict[int, list[tuple[int, int]]] = {n: [] for n in names}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= TOP).collect():
        out[r["query"]].append((r["leaf"], r["vec_id"]))
    return out


def calibrate(tree: Tree, vectors: DataFrame, queries: list[tuple[int, list[float]]], target: float) -> int:
    """Fewest leaves to visit so that ``target`` of the true neighbours are seen."""
    seen = []
    truth = _truth(vectors, queries)
    for name, v in queries:
        order = {leaf: k for k, leaf in enumerate(tree.visits(np.array([*v, 0.0]), tree.leaves, {}))}
        seen += [order[leaf] + 1 for leaf, _ in truth[name]]
    seen.sort()
    return seen[min(len(seen) - 1, int(np.ceil(target * len(seen))))] if seen else 1


def _search(left, right):
    """Best vectors of a block for each query, over those leaves of it that the query visits."""
    import pyarrow as pa

    best: dict[int, list[tuple[float, int]]] = {}
    if left.num_rows and right.num_rows:
        leaf_of, every_id = right.column("leaf").to_numpy(), right.column("ids").to_pylist()
        every_vector = _matrix(right.column("v"))
        packed: dict[int, list[tuple[bytes, bytes]]] = {}
        for leaf, names, queries in zip(*(left.column(c).to_pylist() for c in ("leaf", "names", "queries")), strict=True):
            packed.setdefault(leaf, []).append((names, queries))
        for leaf, parts in packed.items():
            rows = np.flatnonzero(leaf_of == leaf)
            if not len(rows):
                continue
            vectors, ids = every_vector[rows], [every_id[k] for k in rows.tolist()]
            for raw_names, raw in parts:
                names = np.frombuffer(raw_names, np.int64).tolist()
                scores = np.frombuffer(raw).reshape(len(names), -1) @ vectors.T
                for name, most, row in zip(names, scores.max(axis=1).tolist(), scores, strict=True):
                    have = best.get(name, [])
                    if len(have) <= TOP or most >= have[-1][0]:
                        found = sorted([*have, *_best(row, ids, TOP + 1)], key=lambda f: (-f[0], f[1]))
                        best[name] = found[: TOP + 1]
    out = [(name, i, s) for name, found in best.items() for s, i in found]
    columns = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "vec_id", "score"])


def nearest(table: DataFrame, every: int = EVERY, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score: TOP neighbours of each vector whose id ``every`` divides."""
    rows = valid(table)
    vectors = written(distinct_vectors(rows), "vectors")
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    largest = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()["m"]
    largest = float(np.sqrt(largest)) if largest else 0.0
    x = np.array([r["v"] for r in sample], dtype=np.float64)
    tree = Tree()
    tree.grow(_lifted(x if len(x) else np.zeros((0, 1)), largest), np.random.default_rng(7))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = tree.descend(_lifted(_matrix(batch.column(2)), largest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["id", "ids", "v", "leaf"])

    placed = written(vectors.mapInArrow(place, "id long, ids array<long>, v array<double>, leaf int"), "placed")
    asking = rows.where(F.col("vec_id") % every == 0)
    queries = written(asking.groupBy("v").agg(F.min("vec_id").alias("query")).select("query", "v"), "queries")
    probe = [(r["query"], r["v"]) for r in queries.orderBy(F.xxhash64("query"), "query").limit(CALIBRATION).collect()]
    most = calibrate(tree, placed, probe, target)
    counts = placed.groupBy("leaf").count()  # a row per leaf, whose number SAMPLE bounds
    sizes = {r["leaf"]: r["count"] for r in counts.collect()}

    parts = partitions(table.sparkSession)

    def visit(batches: Iterator) -> Iterator:
        """Queries packed by the leaf that they visit, PACK at a time."""
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, PACK):
                names, x = batch.column(0)[k : k + PACK].to_numpy(), _matrix(batch.column(1)[k : k + PACK])
                by_leaf: dict[int, list[int]] = {}
                for j, v in enumerate(x):
                    for leaf in tree.visits(np.append(v, 0.0), most, sizes):
                        by_leaf.setdefault(leaf, []).append(j)
                yield pa.RecordBatch.from_pydict(
                    {
                        "leaf": pa.array(list(by_leaf), pa.int32()),
                        "pack": pa.array([int(names[0])] * len(by_leaf), pa.int64()),
                        "n": pa.array([len(r) for r in by_leaf.values()], pa.int32()),
                        "names": pa.array([names[r].tobytes() for r in by_leaf.values()], pa.binary()),
                        "queries": pa.array([x[r].tobytes() for r in by_leaf.values()], pa.binary()),
                    }
                )

    visits = written(
        queries.repartition(parts).mapInArrow(visit, "leaf int, pack long, n int, names binary, queries binary"), "visits"
    )
    # leaves go to tasks in groups, so that a task reports one list per query; large groups are
    # cut into blocks of vectors and of queries, a pack's visits staying together
    group = (F.col("leaf") % GROUPS).alias("g")
    per_group = lambda rows, n, name: rows.groupBy(group).agg(F.ceil(n / BLOCK).cast("int").alias(name))
    plan = per_group(counts, F.sum("count"), "x_blocks").join(per_group(visits, F.sum("n"), "q_blocks"), "g")
    plan = F.broadcast(written(plan, "plan"))
    left = visits.withColumn("g", group).join(plan, "g").select(
        "g", F.pmod(F.xxhash64("pack"), "q_blocks").alias("a"), F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1)).alias("b"), "leaf", "names", "queries"
    )
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q_blocks").cast("bigint") - 1)).alias("a")
    right = placed.withColumn("g", group).join(plan, "g").select(
        "g", blocks, F.pmod(F.xxhash64("id"), "x_blocks").cast("int").alias("b"), "leaf", "ids", "v"
    )
    key = ("g", "a", "b")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= TOP + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    answers = queries.join(lists, "query").select("v", "found")
    own = asking.join(answers, "v").select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("vec_id")), 1, TOP)).alias("pos", "f"),
    )
    return own.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
