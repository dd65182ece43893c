"""Hard negatives by threshold joins in the manner of L2AP, thresholds falling until windows fill.

1. Vectors of whole numbers are packed, dimensions of little weight first. A pack is an
   inverted index by groups of dimensions: walking from the last group to the first, a vector
   leaves the list of a group once the norm of what is before it, times the largest such norm
   of the anchors, stays below the least threshold. Those dimensions aren't indexed.
2. Anchors (a stated query set) meet every pack, SLICE of them at a time. Partial scores
   are accumulated list by list; a pair ends once its score so far and the product of the two
   remaining norms stay below the anchor's threshold. Where few pairs are left, they are
   finished one by one, dimensions outside the index included.
3. A first join looks for an anchor's best rows of its own label. Thresholds start where
   a normal distribution of the anchor's scores has AIM rows above; anchors still short come
   again with eight times as many, in the end without a threshold.
4. A second join does the same below each positive, down to the end of its window: a
   window is full, or its threshold has come to the end, so what is found is exact.
Tasks report the best of each pack and window. A slice of anchors passes through the driver
to be broadcast, SLICE x (dimensions + 10) numbers; found rows stay in tables. Mean and
deviation come from a bounded sample (SAMPLE rows of least hash), which decides where
thresholds start, and nothing else.

Defined results: rows with a null id or label, a null vector, a null or non-finite
component, no components, or another number of them than most take no part; repeated rows are rows of their own, each
an anchor and a candidate for the other; ties go to the smaller id; a positive of negative
score has an empty window; an empty table gives an empty result. Scores are exact while they
fit into 64 bits. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvartal.llm.shared import row_id, written

EVERY = 100
#: Best rows of an anchor's label, and negatives per such row.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between SHARE hundredths of the positive's and the positive's.
SHARE = 80
SLICE, SAMPLE, PACK = 8192, 2048, 4096
#: Rows that a first threshold should let through, and how much more each further one.
AIM, MORE = 64, 8
#: Dimensions of a list, anchors that accumulate together, share of pairs from which on pairs are finished alone.
WIDTH, TOGETHER, FEW = 8, 512, 0.1
_NORMAL = NormalDist()
_INDEX = "rows binary, ids binary, labels binary, v binary"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_POSITIVE = "aid long, vec_id long, row long, score long"
_NEGATIVE = "aid long, place int, vec_id long, row long, score long"


def prepared(table: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, 256 times their vectors as whole numbers."""
    double = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), double.alias("x")).where(
        (F.size("x") > 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("x") == (usual["n"] if usual else 0))
    return rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * 256)).alias("v"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ends(d: int) -> list[int]:
    return [*range(0, d, WIDTH), d]


def _norms(x: np.ndarray) -> np.ndarray:
    """Norm of each vector before each list's first dimension, and of the whole; a little too large."""
    squares = np.cumsum(x.astype(np.float64) ** 2, axis=1)
    ends = _ends(x.shape[1])
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), squares[:, np.array(ends[1:], int) - 1]], axis=1)) * (1 + 1e-9)


def above(q: np.ndarray, least: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, vector, score) of all pairs with at least the anchor's threshold."""
    parts = [_above(q[k : k + TOGETHER], least[k : k + TOGETHER], x, k) for k in range(0, len(q), TOGETHER)]
    return tuple(np.concatenate([p[c] for p in parts]) for c in range(3)) if parts else _above(q, least, x, 0)


def _above(q: np.ndarray, least: np.ndarray, x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends, before_q, before_x = _ends(x.shape[1]), _norms(q), _norms(x)
    largest, lowest = before_q.max(axis=0, initial=0), least.min(initial=np.inf)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def finish(i: np.ndarray, j: np.ndarray, s: np.ndarray, lists: int) -> None:
        """Pairs whose last lists are accumulated: the rest, list by list."""
        for g in range(lists - 1, -1, -1):
            s = s + (q[i, ends[g] : ends[g + 1]] * x[j, ends[g] : ends[g + 1]]).sum(axis=1)
            on = s + before_q[i, g] * before_x[j, g] >= least[i]
            i, j, s = i[on], j[on], s[on]
        out.append((i, j, s))

    listed = np.flatnonzero(before_x[:, -1] * largest[-1] >= lowest)
    score = np.zeros((len(q), len(listed)), dtype=x.dtype)
    for g in range(len(ends) - 2, -1, -1):
        if not score.size:
            break
        score += q[:, ends[g] : ends[g + 1]] @ x[listed, ends[g] : ends[g + 1]].T
        alive = score + before_q[:, g, None] * before_x[None, listed, g] >= least[:, None]
        if g == 0 or alive.mean() <= FEW:
            i, j = np.nonzero(alive)
            finish(i, listed[j], score[i, j], g)
            break
        kept = before_x[listed, g] * largest[g] >= lowest
        if not kept.all():  # what is before list g isn't indexed for these
            i, j = np.nonzero(alive & ~kept)
            finish(i, listed[j], score[i, j], g)
            listed, score = listed[kept], np.ascontiguousarray(score[:, kept])
    out.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, x.dtype)))
    i, j, s = (np.concatenate([o[c] for o in out]) for c in range(3))
    return i + first, j, s


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best of each group."""
    order = np.lexsort((rows, ids, -score, group))
    ordered = group[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < most]


def _packed(order: np.ndarray, kind: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, PACK):
                rows, ids, labels, v = batch.slice(k, PACK).columns
                v = _matrix(v)[:, order].astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.tobytes()], pa.binary()) for c in (rows.to_numpy(), ids.to_numpy(), labels.to_numpy(), v)],
                    names=["rows", "ids", "labels", "v"],
                )

    return run


def _packs(batches: Iterator, anchors: dict, kind: str) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, ids, labels = (np.frombuffer(r, np.int64) for r in raw[:3])
            yield rows, ids, labels, np.frombuffer(raw[3], kind).reshape(len(rows), -1).astype(anchors["v"].dtype)


def _rows(**columns):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _join_positives(index: DataFrame, slice_, kind: str) -> DataFrame:
    """The best rows of each anchor's label, of each pack, above the anchor's threshold."""

    def run(batches: Iterator) -> Iterator:
        a = slice_.value
        for rows, ids, labels, x in _packs(batches, a, kind):
            for label in np.intersect1d(a["label"], labels).tolist():
                mine, same = np.flatnonzero(a["label"] == label), np.flatnonzero(labels == label)
                i, j, s = above(a["v"][mine], a["least"][mine], x[same])
                i, j = mine[i], same[j]
                other = rows[j] != a["row"][i]
                i, j, s = i[other], j[other], s[other]
                k = _best(i, s, ids[j], rows[j], POSITIVES)
                i, j = i[k], j[k]
                yield _rows(aid=a["row"][i], vec_id=ids[j], row=rows[j], score=s[k].astype(np.int64))

    return index.mapInArrow(run, _POSITIVE)


def _join_negatives(index: DataFrame, slice_, kind: str) -> DataFrame:
    """The best rows of other labels in each window, of each pack."""

    def run(batches: Iterator) -> Iterator:
        a = slice_.value
        for rows, ids, labels, x in _packs(batches, a, kind):
            i, j, s = above(a["v"], a["least"], x)
            other = labels[j] != a["label"][i]
            i, j, s = i[other], j[other], s[other].astype(np.int64)
            for place in range(a["high"].shape[1]):
                w = np.flatnonzero((s <= a["high"][i, place]) & (s >= a["low"][i, place]))
                k = w[_best(i[w], s[w], ids[j[w]], rows[j[w]], NEGATIVES)]
                yield _rows(aid=a["row"][i[k]], place=np.full(len(k), place, np.int32), vec_id=ids[j[k]], row=rows[j[k]], score=s[k])

    return index.mapInArrow(run, _NEGATIVE)


def _ranked(found: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def _threshold(mean: float, sd: float, share: float) -> float:
    """Score with this share of an anchor's scores above it."""
    return mean + sd * _NORMAL.inv_cdf(1 - share) if 0 < share < 1 and sd > 0 else -np.inf


def _share_above(mean: float, sd: float, score: float) -> float:
    return 1 - _NORMAL.cdf((score - mean) / sd) if sd > 0 else 1.0


def mine(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    ``rows``: (vec_id, label, v) as ``prepared`` gives them; anchors are those whose id ``every`` divides.
    """
    spark = rows.sparkSession
    rows = written(rows.select(row_id().alias("row"), "vec_id", "label", "v"), "vectors")
    weight = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(
        F.sum(F.col("x").cast("double") * F.col("x")).alias("w"), F.max(F.abs("x")).alias("most")
    )
    weight = sorted(weight.collect(), key=lambda r: (r["w"], r["pos"]))  # one row per dimension
    order, d = np.array([r["pos"] for r in weight], dtype=np.int64), len(weight)
    largest = max((r["most"] for r in weight), default=0)
    # products of doubles are exact up to 2**53, whatever the order of adding
    kind, exact = ("int32" if largest < 1 << 31 else "int64"), (np.float64 if d * largest**2 < 1 << 53 else np.int64)
    index = written(rows.mapInArrow(_packed(order, kind), _INDEX), "index")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()
    sample = spark.sparkContext.broadcast(np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), d))

    def measured(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                scores = _matrix(batch.column(3)).astype(np.float64) @ sample.value.T
                columns = [*batch.columns, pa.array(scores.mean(axis=1)), pa.array(scores.std(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "label", "v", "mean", "sd"])

    anchors = rows.where(F.col("vec_id") % every == 0)
    anchors = anchors.mapInArrow(measured, "row long, vec_id long, label long, v array<long>, mean double, sd double")
    anchors = written(anchors, "anchors")
    slices = max(1, -(-2 * anchors.count() // SLICE))
    anchors = anchors.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))

    def held(state: list, least: list[float], **more) -> object:
        v = np.array([r["v"] for r in state], dtype=exact)[:, order]
        number = lambda name: np.array([r[name] for r in state], dtype=np.int64)
        return spark.sparkContext.broadcast({"row": number("row"), "label": number("label"), "v": v, "least": np.array(least)} | more)

    positives, negatives = [], []
    for k in range(slices):
        todo, aim = anchors.where(F.col("slice") == k), AIM
        while state := todo.collect():
            least = [_threshold(r["mean"], r["sd"], aim / total) for r in state]
            sent = held(state, least)
            found = written(_ranked(_join_positives(index, sent, kind), ("aid",), POSITIVES), "positives")
            sent.unpersist()
            enough = found.groupBy("aid").count().where(F.col("count") >= POSITIVES)
            sure = F.lit(aim >= total) | F.col("count").isNotNull() | (F.col("sd") == 0)
            after = written(todo.join(enough, F.col("row") == F.col("aid"), "left").withColumn("sure", sure).drop("aid", "count"), "anchors")
            positives.append(found.join(after.where("sure").select(F.col("row").alias("aid")), "aid", "left_semi"))
            todo, aim = after.where("NOT sure").drop("sure"), aim * MORE
    if not positives:
        return spark.createDataFrame([], _RESULT)
    best = positives[0]
    for more in positives[1:]:
        best = best.unionByName(more)
    best = written(best.withColumn("place", F.col("rank") - 1), "positives")

    for k in range(slices):
        windows = best.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("windows"))
        todo, aim = anchors.where(F.col("slice") == k).join(windows, F.col("row") == F.col("aid")).drop("aid"), AIM
        while state := todo.collect():
            high = np.full((len(state), POSITIVES), -1, dtype=np.int64)
            low, end = np.zeros_like(high), np.zeros_like(high)  # a window that is closed is empty
            for n, r in enumerate(state):
                for place, score in r["windows"].items():
                    if score < 0:
                        continue
                    bottom = -(-SHARE * score // 100)
                    start = _threshold(r["mean"], r["sd"], _share_above(r["mean"], r["sd"], score) + aim / total)
                    high[n, place], end[n, place] = score, bottom
                    low[n, place] = bottom if start <= bottom else int(np.ceil(min(start, score)))
            open_ = high >= 0
            least = np.where(open_, low, np.iinfo(np.int64).max).min(axis=1).astype(np.float64)
            sent = held(state, least, high=high, low=low)
            found = written(_ranked(_join_negatives(index, sent, kind), ("aid", "place"), NEGATIVES), "negatives")
            sent.unpersist()
            counts = found.groupBy("aid", "place").count().where(F.col("count") >= NEGATIVES).select("aid", "place")
            reached = [(r["row"], p) for n, r in enumerate(state) for p in r["windows"] if not open_[n, p] or low[n, p] == end[n, p]]
            reached = spark.createDataFrame(reached, "aid long, place int")
            sure = written(counts.unionAll(reached).distinct(), "full-windows")
            negatives.append(found.join(sure, ["aid", "place"], "left_semi"))
            over = sure.groupBy("aid").agg(F.collect_set("place").alias("over"))
            left = todo.join(over, F.col("row") == F.col("aid"), "left").drop("aid")
            left = left.withColumn("windows", F.map_filter("windows", lambda p, _: ~F.array_contains(F.coalesce("over", F.array().cast("array<int>")), p)))
            todo, aim = written(left.drop("over").where(F.size("windows") > 0), "anchors"), aim * MORE
    if not negatives:
        return spark.createDataFrame([], _RESULT)
    out = negatives[0]
    for more in negatives[1:]:
        out = out.unionByName(more)
    names = anchors.select(F.col("row").alias("aid"), F.col("vec_id").alias("anchor_id"))
    best = best.select("aid", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return out.join(best, ["aid", "place"]).join(names, "aid").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
