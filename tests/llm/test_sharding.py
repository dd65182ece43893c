import random
import zlib

from pyspark.sql import functions as F

from kvartal.llm import sharding as S
from tests.llm.conftest import mixed_texts, prose


def check(rows, texts, ids, slack):
    assert len(rows) == len(texts)
    size = [0] * 8
    slots = [[] for _ in range(8)]
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    assert max(abs(s - sum(size) / 8) for s in size) <= slack, size


def test_mixed(stored):
    texts = mixed_texts() * 10
    rows = S.assign(stored(texts, size=F.lit("x"), k0=F.lit(1))).collect()
    check(rows, texts, range(len(texts)), 40_000)


def test_bytes_near_equal_with_hot_group(stored):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(5, 60)) for _ in range(1500)] + ["the same text again"] * 900 + [None] * 300
    ids = [None if i % 50 == 0 else i % 2000 for i in range(len(texts))]
    rows = S.assign(stored(texts, ids)).collect()
    check(rows, texts, ids, 400)
    small = {}
    for r, in zip(rows, strict=True):
        small.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in small.values()) <= 7


def test_repeated_rows_only(stored):
    texts = ["equal"] * 800
    check(S.assign(stored(texts, [7] * 800)).collect(), texts, [7] * 800, 6)


def test_few_and_none(stored):
    for texts in (["a"], ["a", None, "b"]):
        rows = S.assign(stored(texts)).collect()
        assert len(rows) == len(texts)
    assert S.assign(stored(["a"]).where("false")).count() == 0


def test_write(stored, tmp_path):
    texts = mixed_texts()
    out = S.write(stored(texts), str(tmp_path / "shards"))
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(t) for t in texts)
