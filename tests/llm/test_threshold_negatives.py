import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.llm import threshold_negatives as T

SCHEMA = "vec_id long, embedding array<float>, label int, row string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    def make(rows, schema=SCHEMA):
        path = str(tmp_path_factory.mktemp("vectors") / "embeddings.parquet")
        spark.createDataFrame(rows, schema).repartition(5).write.parquet(path)
        return spark.read.parquet(path)

    return make


def brute(rows, every):
    kept = [
        (i, l, [math.floor(256 * float(x)) for x in v])
        for i, v, l, _ in rows
        if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    usual = max({len(v) for _, _, v in kept}, key=lambda n: sum(len(v) == n for _, _, v in kept), default=0)
    kept = [r for r in kept if len(r[2]) == usual]
    out = []
    for k, (a, label, v) in enumerate(kept):
        if a % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=True))  # noqa: B023, E731
        same = sorted((-score(w), i) for n, (i, m, w) in enumerate(kept) if m == label and n != k)[:5]
        others = sorted((-score(w), i) for i, m, w in kept if m != label)
        for p, i in same:
            window = [(n, j) for n, j in others if 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(window)]
    return sorted(out)


def data(seed, n=700, d=19):
    """Clusters, equal vectors, small and large norms, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    f32 = lambda x: [float(np.float32(y)) for y in x]
    rows = []
    for i in range(n):
        x = centres[i % 6] * rng.choice([0.02, 0.3, 1.0]) + rng.normal(size=d) * rng.choice([0, 0.05, 0.3])
        rows.append((i * 3, f32(x), int(rng.integers(0, 4)) if i % 50 else 90 + i, "r"))
    rows += [(3000 + i, f32(centres[0]), i % 3, "r") for i in range(40)] + [(6000, f32(-centres[1]), 1, "r"), (6010, [0.0] * d, 1, "r")]
    rows += [(6020, None, 1, "r"), (6030, f32(centres[1]), None, "r"), (6040, [*f32(centres[1])[1:], None], 1, "r"), (None, f32(centres[1]), 1, "r")]
    rows += [(6050, [*f32(centres[1])[1:], float("nan")], 1, "r"), (6060, [*f32(centres[1])[1:], float("inf")], 1, "r"), (6070, [1.0], 1, "r"), (6080, [], 1, "r")]
    return rows


def run(table, every):
    return sorted(tuple(r) for r in T.mine(T.prepared(table), every).collect())


@pytest.mark.parametrize("aim,pack,slice_", [(64, 4096, 8192), (2, 97, 60)])
def test_against_brute_force(table, monkeypatch, aim, pack, slice_):
    for name, value in {"AIM": aim, "PACK": pack, "SLICE": slice_, "SAMPLE": 100}.items():
        monkeypatch.setattr(T, name, value)
    rows = data(4)
    want = brute(rows, 10)
    got = run(table(rows), 10)
    assert len(want) > 200 and got == want


def test_odd_tables(table, spark):
    rows = data(1, 60)
    assert run(table(rows).where("false"), 10) == []
    assert run(table(rows).where("vec_id % 10 <> 0"), 10) == []
    alone = [(100, [1.0, 2.0], 5, "r"), (200, [1.0, 1.0], 6, "r")]
    assert run(table(alone), 100) == []
    same = [(100, [1.0], 1, "r")] * 3 + [(7, [1.0], 2, "r"), (7, [1.0], 2, "r")]  # repeated rows, each of its own
    assert run(table(same), 100) == [(100, 100, k, 7, 65536, 65536) for k in (1, 2) for _ in range(6)]
    large = [(100, [3e6, 1.0], 1, "r"), (1, [2e6, 1.0], 1, "r"), (2, [1.9e6, 3.0], 2, "r")]  # beyond doubles' 53 bits
    assert run(table(large), 100) == brute(large, 100) != []


def test_join_omits_and_prunes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 30)) * np.linspace(0.1, 3, 30) * rng.choice([0.01, 1], (500, 1))
    x = np.floor(256 * x)
    q = x[::20]
    scores = q @ x.T
    for least in (-np.inf, 0.0, np.quantile(scores, 0.5), np.quantile(scores, 0.99), 1e12):
        low = np.full(len(q), least) * rng.choice([1, 0.9], len(q)) if np.isfinite(least) else np.full(len(q), least)
        i, j, s = T.above(q, low, x)
        want = np.argwhere(scores >= low[:, None])
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))
        assert (s == scores[i, j]).all()
    assert [len(c) for c in T.above(q[:0], np.zeros(0), x)] == [0, 0, 0]


def test_label_and_extra_columns(table):
    rows = [(i, [float(i % 7), 1.0], i % 3, "r") for i in range(200)]
    plain = run(table(rows), 100)
    wide = table(rows).withColumn("score", F.lit(1)).withColumn("v", F.lit("x")).withColumn("anchor_id", F.lit(0))
    assert run(wide, 100) == plain == brute(rows, 100)
