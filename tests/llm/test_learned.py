import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvartal.llm import kmeans_tree as K
from kvartal.llm import quality_classifier as Q
from tests.llm.conftest import mixed_texts, prose


def labelled(n):
    rng = random.Random(12)
    texts = []
    for i in range(n):
        good = prose(rng, rng.randrange(20, 200), 3000)
        junk = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in good.split())
        texts.append(good if i % 3 else junk)
    return texts, [int(i % 3 > 0) for i in range(n)]


def test_held_out_accuracy(stored, spark):
    texts, quality = labelled(400)
    odd = mixed_texts()
    docs = stored(texts + odd, lang=F.lit("xx"), score=F.lit("clash"))
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality)] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    rows = Q.score(docs, Q.train(docs, labels)).withColumn("held_out", Q.held_out()).collect()
    assert len(rows) == len(texts) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id < 400]
    assert sum((r.score >= 0.3) == bool(quality[r.doc_id]) for r in out) >= 0.97 * len(out) > 40
    kept = Q.apply(docs, labels)
    assert {r.score for r in kept.collect()} == {"clash"}
    wide = labels.withColumn("quality", F.col("quality").cast("bigint"))
    assert Q.apply(docs, wide).count() == kept.count()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= 0.3}


def test_without_labels(stored, spark):
    docs = stored(["a b c", None, ""])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, Q.train(docs, none)).collect()} == {0.5}
    assert Q.score(docs.where("false"), Q.train(docs, none)).count() == 0


def test_statistics_do_not_depend_on_slices(monkeypatch):
    texts = [*mixed_texts(), *labelled(20)[0]]
    whole = np.concatenate(list(Q.statistics(pa.array(texts))))
    single = np.concatenate([np.concatenate(list(Q.statistics(pa.array([t], pa.string())))) for t in texts])
    assert np.allclose(whole, single)
    by_name = dict(zip(Q.STATISTICS, whole[texts.index("line\nline\nLine\n\n \nline")].tolist(), strict=True))
    assert (by_name["words"], by_name["distinct_words"], by_name["distinct_lines"]) == (4, 0.5, 0.5)


def test_flat_trees_follow_thresholds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    forest = Q.fit(x[:1500], y[:1500], trees=40)
    assert ((forest.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    one = Q.fit(x, np.ones(2000))
    assert len(set(one.score(x))) == 1


def vectors(spark, path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash"))
    df.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def brute(rows):
    use = []
    for i, v, _ in rows:
        if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            use.append((i, np.array(v, dtype=np.float32).astype(float)))
    out = {}
    for i, v in use:
        if i % 20 == 0:
            found = sorted((-float(v @ w), j) for j, w in use if j != i)
            out[i] = [(j, -s) for s, j in found[:20]]
    return out


@pytest.mark.parametrize("block", [4096, 50])
def test_recall_scores_and_ties(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "LEAF", 12)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = (centers[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.3) * rng.uniform(0.5, 2, (1500, 1))
    x[100:500] = x[100] * 4
    rows = [(i, [float(c) for c in np.float32(v)], 0) for i, v in enumerate(x)]
    bad = [None, [0.0] * 16, [], [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(2000 + 20 * k, v, 0) for k, v in enumerate(bad)] + [(None, [1.0] * 16, 0)]
    got: dict = {}
    for r in K.nearest(vectors(spark, str(tmp_path / "v"), rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    by_id = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows[:1500]}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(s - by_id[q] @ by_id[i]) < 1e-9 for _, i, s in found)
        assert all((-round(a[2], 9), a[1]) < (-round(b[2], 9), b[1]) for a, b in zip(found, found[1:], strict=False))
        hits += len({f[1] for f in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    equal = [i for i in range(1500) if 100 <= i < 500]
    for q, found in got.items():  # of equal vectors the smallest ids come
        some = [i for _, i, _ in found if i in equal]
        assert some == [i for i in equal if i != q][: len(some)]
    assert any(i in equal for found in got.values() for _, i, _ in found)


def test_few_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 0), (20, [0.5, 0.5], 0), (7, [0.0, 1.0], 0)]
    table = vectors(spark, str(tmp_path / "v"), rows)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in K.nearest(table).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 7, 0.0), (20, 1, 0, 0.5), (20, 2, 7, 0.5)]
    assert K.nearest(table.where("false")).count() == 0
